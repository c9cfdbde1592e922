"""Secret scan with corpus-wide ownership frequency.

One Arrow pass over whole texts finds the candidates of every document: the three base kinds
(``assign``, ``access``, ``hex``) and ``strong``, random-looking tokens that no base span covers.
Candidate values leave the pass as hashes only. The corpus is then asked, per hash, how many distinct
repositories and owners carry it: a value that many of them share is a widely copied example, a value
that few carry looks like a live credential of its owner. ``strong`` candidates become spans
(kind ``owned``) only if they are owner-specific; base spans stay whatever their class.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.llm._shared import materialize, table

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal either way, so the length can stand in the pattern
STRONG = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
#: Bits a character that a random-looking token has at least.
STRONG_BITS = 3.5
#: A value in so many repositories, or with so many owners, is a widely copied example.
EXAMPLE_REPOS, EXAMPLE_OWNERS = 3, 3

SPAN = "struct<start:int,rank:int,end:int>"
CANDIDATE = "struct<start:int,rank:int,end:int,hash:string>"
SCAN = f"row_id long, doc_id {{id_type}}, owner string, repo string, base array<{SPAN}>, candidates array<{CANDIDATE}>"


def _bits(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _strong(token: str) -> bool:
    return bool(re.search("[A-Z]", token) and re.search("[a-z]", token) and re.search("[0-9]", token)) and _bits(token) >= STRONG_BITS


def candidates_of(text: str) -> tuple[list[dict], list[dict]]:
    """The base spans of a text, and all candidates with the hashes of their values."""
    found: list[tuple[int, int, int, str]] = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    found.sort()
    base = [{"start": s, "rank": r, "end": e} for s, r, e, _ in found]
    ends, at, reach = sorted((s, e) for s, _, e, _ in found), 0, 0
    for m in STRONG.finditer(text):
        while at < len(ends) and ends[at][0] < m.end():
            reach, at = max(reach, ends[at][1]), at + 1
        if reach <= m.start() and _strong(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return base, [{"start": s, "rank": r, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]} for s, r, e, v in found]


def _scan(batches: Iterator[pa.RecordBatch], base_type: pa.DataType, candidate_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [candidates_of(text or "") for text in batch.column("text").to_pylist()]
        kept = [batch.column(c) for c in ("row_id", "doc_id", "owner", "repo")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array([p[0] for p in pairs], base_type), pa.array([p[1] for p in pairs], candidate_type)],
            ["row_id", "doc_id", "owner", "repo", "base", "candidates"],
        )


def _arrow_types() -> tuple[pa.DataType, pa.DataType]:
    span = [pa.field("start", pa.int32()), pa.field("rank", pa.int32()), pa.field("end", pa.int32())]
    return pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, pa.field("hash", pa.string())]))


def find_candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """One row per row of ``docs``: base spans and candidates; null owners and repositories count as ''."""
    types = _arrow_types()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(lambda batches: _scan(batches, *types), SCAN.format(id_type=rows.schema["doc_id"].dataType.simpleString()))


def ownership(scanned: DataFrame, example_repos: int = EXAMPLE_REPOS, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per candidate hash: ``n_repos``, ``n_owners`` and ``example`` (widely copied or not; what one owner has is not, in however many repositories).

    A hash that a third of the rows carry costs one row per task and distinct owner before the shuffle.
    """
    seen = scanned.select("owner", "repo", F.explode("candidates.hash").alias("hash"))
    return (
        seen.groupBy("hash")
        .agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
        .withColumn("example", (F.col("n_owners") >= example_owners) | (F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos))
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, example_repos: int = EXAMPLE_REPOS, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per row of ``docs``: ``base``, ``owned`` (spans), ``live`` (spans of base or owned kind that look live), ``n_live``, ``n_example``.

    ``owner`` and ``repo`` are columns of ``docs`` (default: ``source``, and ``source`` with ``lang``).
    Null and empty texts have no spans, repeated rows each keep a row, further columns are ignored,
    an empty table gives an empty result.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    scanned = materialize(find_candidates(docs, id_col, text_col, owner, repo))
    classes = ownership(scanned, example_repos, example_owners).select("hash", "example")
    each = scanned.select("row_id", F.inline("candidates")).join(classes, "hash")
    span = F.struct("start", "rank", "end")
    judged = each.groupBy("row_id").agg(
        F.collect_list(F.when(~F.col("example") & (F.col("rank") == 3), span)).alias("owned"),
        F.collect_list(F.when(~F.col("example"), span)).alias("live"),
        F.count_if(~F.col("example")).alias("n_live"), F.count_if("example").alias("n_example"),
    )
    none = F.array().cast(f"array<{SPAN}>")
    return scanned.select("row_id", "doc_id", "base").join(judged, "row_id", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("owned", none).alias("owned"), F.coalesce("live", none).alias("live"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined with commas."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: str | None, spans: list, mask: str) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, mask: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every owner-specific, live-looking credential replaced by ``mask``; widely copied examples stay.

    What to mask depends on a text and on the corpus only, so the spans are joined back by text (hash,
    length and MD5), once per distinct text; ``length_col``, if named, follows a masked text; null texts, repeated rows and other columns stay as they were.
    """
    key = F.struct(F.xxhash64(F.col(text_col)), F.octet_length(F.col(text_col)), F.md5(F.col(text_col)))
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    keyed = docs.select(key.alias("_key"), owner.alias("_owner"), repo.alias("_repo"), F.col(text_col).alias("_text"))
    found = scan(keyed, "_key", "_text", F.col("_owner"), F.col("_repo")).where("n_live > 0").groupBy(F.col("doc_id").alias("_key")).agg(F.first("live").alias("_live"))

    @F.pandas_udf("string")
    def masked(texts, spans):
        return texts.combine(spans, lambda t, s: _masked(t, s, mask))

    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key")).join(found, "_key", "left")  # whole rows, so no column of theirs can clash
    own, live = lambda c: F.col("_row").getField(c), F.col("_live").isNotNull()
    rows = rows.withColumn("_new", F.when(live, masked(F.when(live, own(text_col)), F.col("_live"))).otherwise(own(text_col)))
    changed = {text_col: F.col("_new")}
    if length_col:
        changed[length_col] = F.when(live, F.char_length("_new").cast(docs.schema[length_col].dataType)).otherwise(own(length_col))
    return rows.select([changed.get(c, own(c)).alias(c) for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; owners are sources, repositories are sources by language."""
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "owned")).alias("spans"), "n_live", "n_example",
    )
