"""Text functions as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that don't count as content.
STOPWORDS = """
a an the and or but if because as than
of to for from in on at by with about into through per
is am are was were be been being
do does did have has had having
can could will would shall should might must
i me my mine we us our ours you your yours
he him his she her hers it its they them their theirs
this that these those there here
what which who whom whose where when why how
hai hain hu ho tha thi ka ki ke ko se mein
main hum ham tum aap mera meri mere mujhe hamara hamari
ye yeh woh vo wo aur ya toh bhi kya kyun kaise kis kisi
""".split()
#: What auxiliary endings stand for, in this order.
ENDINGS = [(r"\bcan't\b", "can not"), (r"\bwon't\b", "will not"), (r"n't\b", " not"), (r"'ll\b", " will"), (r"'re\b", " are"), (r"'ve\b", " have"), (r"'m\b", " am"), (r"'d\b", " would"), (r"'s\b", "")]
MESSAGE_TYPES = ["text", "forwarded", "url", "image", "pdf", "voice"]


def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@lru_cache
def _combining() -> np.ndarray:
    """Which code points are combining marks."""
    return np.array([unicodedata.combining(chr(i)) > 0 for i in range(sys.maxunicode + 1)])


def without_marks(texts: list) -> list:
    """Texts without combining marks; null ones and those of ASCII alone stay. Marks are dropped from all texts at once."""
    out = list(texts)
    at = [i for i, t in enumerate(out) if t is not None and not t.isascii()]
    spelt = [unicodedata.normalize("NFKD", out[i]) for i in at]
    points = np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32)
    kept = ~_combining()[points]
    ends = np.append(0, np.cumsum(kept))[np.cumsum([0, *map(len, spelt)])]
    plain = points[kept].tobytes().decode("utf-32-le")
    for i, lo, hi in zip(at, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[i] = plain[lo:hi]
    return out


def _unaccented(texts: pd.Series) -> pd.Series:
    return pd.Series(without_marks(texts), index=texts.index)


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def normalize_text(text: Column) -> Column:
    """NFKC, casefold, single spaces, trimmed. ASCII texts stay in the JVM; no built-in knows NFKC, so others take an Arrow batch."""
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))
    return F.when(_ascii(text), plain).otherwise(F.pandas_udf(_folded, "string")(F.when(~_ascii(text), text)))


def fold_accents(text: Column) -> Column:
    """Lower case without combining marks."""
    low = F.lower(text)
    return F.when(_ascii(text), low).otherwise(F.pandas_udf(_unaccented, "string")(F.when(~_ascii(text), low)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_terms(text: Column) -> Column:
    """Words and pairs of neighbouring words of an already folded text."""
    w = words(text)
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def char_terms(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of each word with a space on either side; a padded word no longer than n counts once, as itself."""
    padded = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        size = F.char_length(w)

        def of(n: int) -> Column:
            every = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
            return F.when(F.lit(n == low) | (size >= n), every).otherwise(F.array().cast("array<string>"))

        return F.concat(*map(of, range(low, high + 1)))

    return F.flatten(F.transform(padded, grams))


def content_words(text: Column) -> Column:
    """The distinct words that carry content: endings spelt out, function words removed."""
    out = F.replace(normalize_text(text), F.lit("’"), F.lit("'"))
    for pattern, full in ENDINGS:
        out = F.regexp_replace(out, pattern, full)
    return F.array_except(F.array_distinct(F.regexp_extract_all(out, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), F.array(*map(F.lit, STOPWORDS)))


def zero_overlap(left: Column, right: Column) -> Column:
    """Of two word arrays: both have words and share none."""
    return (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)


def classify_type(text: Column) -> Column:
    """What a message's text shows it to be; marks at its start go before links."""
    out = F.when(F.startswith(text, F.lit("[Image]")), "image").when(F.startswith(text, F.lit("[PDF]")), "pdf")
    out = out.when(F.startswith(text, F.lit("[Voice message]")), "voice").when(F.startswith(text, F.lit("Forwarded:")), "forwarded")
    return out.when(F.contains(text, F.lit("https://")), "url").otherwise("text")


def local_time(ts: Column, zone: str) -> tuple[Column, Column]:
    """Date and hour of an instant in a corpus's zone (session zone UTC)."""
    local = F.from_utc_timestamp(ts, zone)
    return F.to_date(local), F.hour(local)


def truncate_tokens(text: Column, limit: int) -> tuple[Column, Column]:
    """The first ``limit`` blank-separated tokens, and whether any were cut."""
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(tokens) > limit, F.array_join(F.slice(tokens, 1, limit), " ")).otherwise(text), F.size(tokens) > limit
