"""What questions ask for, for whole tables of them: people, their role, dates, day parts, message types.

Everything is a column expression over the normalised question, but for the join of its words with the
alias dimension. A date class hides what it has matched behind a filler, so later classes can't use it.
"""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleylake.functions.text import normalize_text

#: Fixed values of the grammar: month names and abbreviations, connectors, cues, events, parts of months and days.
MONTHS = "january february march april may june july august september october november december".split()
MONTH = "(?:september|february|november|december|january|october|august|march|april|sept|june|july|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
DAY, YEAR, ISO = r"\d{1,2}(?:st|nd|rd|th)?", r"\d{4}", r"\d{4}-\d{2}-\d{2}"
NAMED = rf"(?:{DAY}\s+{MONTH}|{MONTH}\s+{DAY})(?:,?\s+{YEAR})?"
ENDPOINT = rf"(?:{ISO}|{NAMED}|{MONTH}(?:\s+{YEAR})?)"
CONNECTOR, EXPLICIT = r"(?:to|through|until|and|se|[-–—])", r"(?:to|through|until|se|[-–—])"
EVENT = "(?:trip|holiday|vacation|birthday|party|exam|event|hackathon|journey)"
#: What every month begins with; what stands in any text that a range of dates, two days of a month, a relative date or a single one matches in. They are told fast, and most texts have none.
MONTH_BEGINS = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
IN_RANGES = rf"[a-z\d]\s*{CONNECTOR}\s*(?:{ISO}|{DAY}\s|{MONTH_BEGINS})"
IN_DAYS_FIRST, IN_MONTH_FIRST = rf"\d(?:st|nd|rd|th)?\s*{CONNECTOR}\s*{DAY}\s+{MONTH_BEGINS}", rf"{MONTH_BEGINS}[a-z]*\s+{DAY}\s*{CONNECTOR}\s*\d"
IN_RELATIVE, IN_SINGLE = "today|aaj|yesterday|kal|week|hafte|month|mahine", rf"{ISO}|{MONTH_BEGINS}"
BEFORE_MAY, AFTER_MAY = "in|during|of|from|since|for|about", "messages|mein|ki|ka|ke"
MONTH_PARTS = {"early": (1, 7), "start": (1, 7), "mid": (11, 20), "late": (21, 31)}
DAY_PARTS = {"morning": (0, 12), "afternoon": (12, 17), "evening": (17, 21), "night": (21, 24)}
SENDER_VERBS = "said|shared|sent|forwarded|wrote|asked|replied|suggested|proposed|confirmed"
SENDER_DOING, SENDER_ITEMS = "asking|saying|suggesting|sharing", "messages?|notes?|replies|updates?"
TYPE_BLOCKED = r"\b(?:not|never|without|except|or|versus|mention\w*|discuss\w*)\b|n't\b"
TYPE_ASKED = r"^(?:find|show|locate|get|which|what|where\s+is)\s+(?:(?:me|us|the|a|an|first|last|latest|earliest|all)\s+)*"
TYPE_NOUNS = {
    "forwarded": r"forwarded\s+(?:messages?|notices?|warnings?|updates?)\b", "pdf": r"pdf\b", "image": r"(?:image|photo|picture)\b", "voice": r"(?:voice\s+(?:message|note)|audio\s+message)\b", "url": r"(?:url|link)\b",
}
TYPE_FORWARD = r"\b(?:did|had)\s+\w+(?:\s+\w+)?\s+forward\b"

W = r"[\p{L}\p{N}_]"
NOT_IN_WORD, NOT_BEFORE_WORD = rf"(?<!{W})", rf"(?!{W})"
HIDDEN, PERSON = "", ""
INTERVAL = "struct<start:date,end:date,source:string>"
SEVERAL, CONFLICT = "several people or an ambiguous name", "dates that exclude each other"
SLASHES, KAL, MONTH_PART_CONFLICT = "ambiguous numeric date", "ambiguous kal", "a part of the month outside the dates"


def question_text(query: Column) -> Column:
    return F.replace(normalize_text(query), F.lit("’"), F.lit("'"))


# people


#: Up to so many aliases are looked up within each query's row. Of a larger dimension up to so many hashes (8 bytes each) are
#: broadcast, and only stretches of words whose hash is among them leave their row; one larger still is joined with all stretches.
MAX_ALIASES, MAX_HASHES = 10_000, 4_000_000
MENTIONS = "array<struct<less:int,alias:string,at:int,size:int,names:array<string>>>"


def _stretches(n: int, starts: list | None = None) -> Column:
    """(at, size, alias) of the ``n`` parts from each word on, or from those in ``starts``."""
    at = F.sequence(F.lit(0), F.size("parts") - 1)
    spot = lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), F.array_join(F.slice("parts", i + 1, F.lit(n)), "").alias("alias"))
    return F.transform(F.filter(at, lambda i: (i + n <= F.size("parts")) & (F.get("parts", i).rlike(f"^{W}") if starts is None else F.get("parts", i).isin(starts))), spot)


def _looked_up(rows: DataFrame, aliases: list, longest: int) -> DataFrame:
    """``rows`` with ``all``, the mentions of each: stretches of words that are among the aliases, found without moving a row.

    Only words that an alias (``alias``, ``names``, ``start``) begins with are looked at.
    """
    names, starts = {r["alias"]: r["names"] for r in aliases}, sorted({r["start"] for r in aliases if r["start"]})
    beside = rows.sparkSession.createDataFrame([(names,)], "_names map<string,array<string>>")  # one row
    among = lambda n: F.filter(_stretches(n, starts), lambda s: s["alias"].isin(list(names)))
    none = F.array().cast("array<struct<at:int,size:int,alias:string>>")
    found = F.when(F.size("parts") > 0, F.concat(*[among(2 * n - 1) for n in range(1, longest + 1)])).otherwise(none) if names else none
    rows = rows.withColumn("_found", found).crossJoin(F.broadcast(beside))
    mention = lambda s: F.struct((-F.char_length(s["alias"])).alias("less"), s["alias"].alias("alias"), s["at"].alias("at"), s["size"].alias("size"), F.try_element_at("_names", s["alias"]).alias("names"))
    return rows.withColumn("all", F.array_sort(F.transform("_found", mention))).drop("_found", "_names")


def person_mentions(queries: DataFrame, aliases: DataFrame, longest: int = 3, max_aliases: int = MAX_ALIASES, max_hashes: int = MAX_HASHES) -> DataFrame:
    """Per query: ``text``, ``candidates`` (names), ``person`` (if there is one candidate), ``marked`` (the text with a sure mention hidden).

    Stretches of up to ``longest`` words are looked up in the alias dimension (``alias``, ``names``; each alias
    once) by equality; of overlapping mentions the longest stays. Queries without mentions keep a row.
    """
    parts = F.regexp_extract_all("text", F.lit(rf"{W}+|[^\p{{L}}\p{{N}}_]+"), F.lit(0))
    rows = queries.select("query_id", "query", question_text(F.col("query")).alias("text")).withColumn("parts", parts)
    held = aliases.limit(max_aliases + 1).select("alias", "names", F.regexp_extract("alias", f"^{W}+", 0).alias("start")).collect()
    apart = lambda m, k: (m["at"] + m["size"] <= k["at"]) | (k["at"] + k["size"] <= m["at"])
    none = F.slice("all", F.lit(1), F.lit(0))
    kept = F.aggregate("all", none, lambda acc, m: F.when(F.forall(acc, lambda k: apart(m, k)), F.concat(acc, F.array(m))).otherwise(acc))
    if len(held) <= max_aliases:
        rows = _looked_up(rows, held, longest)
    else:
        hashes = aliases.select(F.xxhash64("alias").alias("hash")).limit(max_hashes + 1).toArrow()
        rows = _hashed(rows, aliases, longest, hashes.column("hash").to_numpy()) if hashes.num_rows <= max_hashes else _joined(rows, aliases, longest)
    rows = rows.withColumn("kept", kept).withColumn("_sure", F.filter("kept", lambda m: F.size(m["names"]) == 1))
    rows = rows.withColumn("candidates", F.coalesce(F.array_distinct(F.flatten(F.transform("kept", lambda m: m["names"]))), F.array().cast("array<string>")))
    person = F.when(F.size("candidates") == 1, F.col("candidates")[0])
    sure = F.col("_sure")
    hide = F.transform("parts", lambda p, i: F.when(F.exists(sure, lambda m: m["at"] == i), F.lit(PERSON)).when(F.exists(sure, lambda m: (m["at"] < i) & (i < m["at"] + m["size"])), F.lit("")).otherwise(p))
    return rows.select("query_id", "query", "text", F.array_sort("candidates").alias("candidates"), person.alias("person"), F.when(person.isNotNull(), F.array_join(hide, "")).otherwise(F.col("text")).alias("marked"))


def _hashed(rows: DataFrame, aliases: DataFrame, longest: int, hashes: np.ndarray) -> DataFrame:
    """``rows`` with ``all``: stretches of words whose hash is an alias's are joined with the aliases, which settles collisions; other rows don't move."""
    held = rows.sparkSession.sparkContext.broadcast(np.unique(hashes))

    def known(column: pa.Array) -> pa.Array:
        sizes, flat = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(held.value, flat), len(held.value) - 1)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(held.value[at] == flat))

    none = F.array().cast("array<struct<at:int,size:int,alias:string>>")
    spots = F.when(F.size("parts") > 0, F.concat(*[_stretches(2 * n - 1) for n in range(1, longest + 1)])).otherwise(none)
    rows = rows.withColumn("_spots", spots).withColumn("_known", F.arrow_udf(known, "array<boolean>")(F.transform("_spots", lambda s: F.xxhash64(s["alias"]))))
    rows = rows.withColumn("_found", F.filter("_spots", lambda s, i: F.get("_known", i))).drop("_spots", "_known")
    found = rows.where(F.size("_found") > 0).select("query_id", "query", "text", "parts", F.inline("_found")).join(aliases.select("alias", "names"), "alias", "left")
    mention = F.when(F.col("names").isNotNull(), F.struct((-F.char_length("alias")).alias("less"), "alias", "at", "size", "names"))
    listed = found.groupBy("query_id").agg(*[F.first(c).alias(c) for c in ("query", "text", "parts")], F.array_sort(F.collect_list(mention)).alias("all"))
    return rows.where(F.size("_found") == 0).drop("_found").withColumn("all", F.array().cast(MENTIONS)).unionByName(listed)


def _joined(rows: DataFrame, aliases: DataFrame, longest: int) -> DataFrame:
    """``rows`` with ``all``, by a join of their stretches of words with the aliases."""
    spots = rows.select("query_id", "parts", F.posexplode("parts").alias("at", "word")).where(F.col("word").rlike(f"^{W}"))
    sizes = F.explode(F.array(*[F.lit(2 * n - 1) for n in range(1, longest + 1)]))
    grams = spots.select("query_id", "at", "parts", sizes.alias("size")).where(F.col("at") + F.col("size") <= F.size("parts"))
    grams = grams.select("query_id", "at", "size", F.array_join(F.slice("parts", F.col("at") + 1, F.col("size")), "").alias("alias"))
    found = grams.join(aliases, "alias")
    order = F.struct((-F.char_length("alias")).alias("less"), "alias", "at", "size", "names")
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    return rows.join(listed, "query_id", "left")


def person_role(marked: Column, person: Column) -> Column:
    """``filter`` if the person is named as the sender, ``none`` if as topic or recipient (or nobody is), else ``bonus``; a joined name never counts."""
    named = rf"{PERSON}(?!\s+(?:and|or|aur)\b)"
    sender = [rf"\bdid\s+{named}", rf"\bfrom\s+{named}", rf"{named}\s+ne\b", rf"{named}\s+(?:{SENDER_VERBS})\b", rf"{named}\s+was\s+(?:{SENDER_DOING})\b", rf"{named}'s\s+(?:{SENDER_ITEMS})\b"]
    return F.when(person.isNull(), "none").when(marked.rlike("|".join(sender)), "filter").when(marked.rlike(rf"\b(?:about|to|for)\s+{named}"), "none").otherwise("bonus")


# dates


def _month(token: Column) -> Column:
    return F.floor((F.instr(F.lit("".join(m[:3] for m in MONTHS)), F.substring(token, 1, 3)) + 2) / 3).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day))


def _endpoint(value: Column, default_year: Column) -> Column:
    """``start`` and ``end`` (null where there is no such day), and the ``year`` if it is stated."""
    iso = value.rlike(f"^{ISO}$")
    year = F.when(iso, F.substring(value, 1, 4)).when(value.rlike(rf"{YEAR}$"), F.right(value, F.lit(4))).cast("int")
    month = _month(F.regexp_extract(value, MONTH, 0))
    day = F.regexp_extract(value, r"(?<!\d)(\d{1,2})(?!\d)", 1)
    first = _date(F.coalesce(year, default_year), month, F.when(day == "", F.lit(1)).otherwise(F.try_to_number(day, F.lit("99")).cast("int")))
    start = F.when(iso, F.try_to_date(value)).otherwise(first)
    return F.struct(start.alias("start"), F.when(iso | (day != ""), start).otherwise(F.last_day(start)).alias("end"), year.alias("year"))


def _range(match: Column, reference_year: Column) -> Column:
    """Both ends of a range; a year stated at one end holds for both."""
    pattern = rf"^({ENDPOINT})\s*{CONNECTOR}\s*({ENDPOINT})$"
    left, right = (F.regexp_extract(match, pattern, k) for k in (1, 2))
    l, r = _endpoint(left, reference_year), _endpoint(right, reference_year)
    l2, r2 = _endpoint(left, F.coalesce(F.year(r["end"]), reference_year)), _endpoint(right, F.coalesce(F.year(l["start"]), reference_year))
    start = F.when(l["year"].isNull() & r["year"].isNotNull(), l2["start"]).otherwise(l["start"])
    end = F.when(r["year"].isNull() & l["year"].isNotNull(), r2["end"]).otherwise(r["end"])
    return F.struct(start.alias("start"), end.alias("end"), match.alias("source"))


def _shared(match: Column, reference_year: Column) -> Column:
    """Two days of one month, whichever stands first."""
    year = F.coalesce(F.try_to_number(F.regexp_extract(match, rf"({YEAR})$", 1), F.lit("9999")).cast("int"), reference_year)
    days = F.regexp_extract_all(match, F.lit(r"(?<!\d)\d{1,2}(?!\d)"), F.lit(0))
    month = _month(F.regexp_extract(match, MONTH, 0))
    return F.struct(_date(year, month, days[0].cast("int")).alias("start"), _date(year, month, days[1].cast("int")).alias("end"), match.alias("source"))


def _single(match: Column, reference_year: Column) -> Column:
    e = _endpoint(match, reference_year)
    return F.struct(e["start"].alias("start"), e["end"].alias("end"), match.alias("source"))


def _relative(today: datetime.date) -> list[tuple[str, datetime.date, datetime.date]]:
    day, monday = datetime.timedelta(days=1), today - datetime.timedelta(days=today.weekday())
    month = today.replace(day=1)
    following = (month + 32 * day).replace(day=1)
    return [
        ("today|aaj", today, today), (r"yesterday|beete\s+kal|beetey\s+kal", today - day, today - day), (r"last\s+week|pich(?:le|hle)\s+hafte", monday - 7 * day, monday - day),
        (r"last\s+month|pich(?:le|hle)\s+mahine", (month - day).replace(day=1), month - day), (r"this\s+month|is\s+mahine", month, following - day),
    ]


def date_intervals(rows: DataFrame, text: str, reference_date: str) -> DataFrame:
    """``rows`` with ``intervals`` (start, end, source; a null end or a reversed one is invalid) and ``doubts`` (ambiguous forms)."""
    today = datetime.date.fromisoformat(reference_date)
    year = F.lit(today.year)
    between = r"(?<=\bbetween )"
    classes = [
        (IN_RANGES, rf"{ENDPOINT}\s*{CONNECTOR}\s*{ENDPOINT}", rf"{ENDPOINT}\s*{EXPLICIT}\s*{ENDPOINT}", _range),
        (IN_DAYS_FIRST, rf"{DAY}\s*{CONNECTOR}\s*{DAY}\s+{MONTH}(?:,?\s+{YEAR})?", rf"{DAY}\s*{EXPLICIT}\s*{DAY}\s+{MONTH}(?:,?\s+{YEAR})?", _shared),
        (IN_MONTH_FIRST, rf"{MONTH}\s+{DAY}\s*{CONNECTOR}\s*{DAY}(?:,?\s+{YEAR})?", rf"{MONTH}\s+{DAY}\s*{EXPLICIT}\s*{DAY}(?:,?\s+{YEAR})?", _shared),
    ]
    rows = rows.withColumn("_left", F.col(text)).withColumn("intervals", F.array().cast(f"array<{INTERVAL}>"))

    def take(pattern: str, resolve, rows: DataFrame, group: int = 0, may_match: Column | None = None) -> DataFrame:
        """What group 1 has matched is resolved and hidden; what only the rest matches is passed over and stays. Texts that can't match aren't searched."""
        searched = rows.withColumn("_may", may_match if may_match is not None else F.lit(True))
        found = F.filter(F.regexp_extract_all("_left", F.lit(pattern), F.lit(group)), lambda m: m != "")
        taken = F.when(F.col("_may"), F.concat("intervals", F.transform(found, lambda m: resolve(m, year)))).otherwise(F.col("intervals"))
        left = F.when(F.col("_may"), F.regexp_replace("_left", pattern, "$2" + HIDDEN if group else HIDDEN)).otherwise(F.col("_left"))
        return searched.withColumns({"intervals": taken, "_left": left}).drop("_may")

    for in_text, any_form, explicit, resolve in classes:
        sure = rf"(?:{between}{any_form}|{explicit})"
        rows = take(rf"{NOT_IN_WORD}(?:({sure}{NOT_BEFORE_WORD})|({any_form})){NOT_BEFORE_WORD}", resolve, rows, 1, F.col("_left").rlike(in_text))
    rows = rows.withColumn("_relative", F.col("_left").rlike(IN_RELATIVE))
    for words, start, end in _relative(today):
        rows = take(rf"{NOT_IN_WORD}(?:{words}){NOT_BEFORE_WORD}", lambda m, _, s=start, e=end: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), m.alias("source")), rows, may_match=F.col("_relative"))
    no_cue = rf"(?<!\b(?:{BEFORE_MAY}) )(?<!\d )(?<!\d(?:st|nd|rd|th) )may(?!\s+\d)(?!\s+(?:{AFTER_MAY})\b)"
    rows = rows.withColumn("_left", F.when((F.col(text) == "may") | ~F.contains("_left", F.lit("may")), F.col("_left")).otherwise(F.regexp_replace("_left", rf"{NOT_IN_WORD}{no_cue}{NOT_BEFORE_WORD}", HIDDEN)))
    rows = take(rf"{NOT_IN_WORD}(?:{ENDPOINT}){NOT_BEFORE_WORD}", _single, rows, may_match=F.col("_left").rlike(IN_SINGLE))
    doubts = F.array_compact(F.array(F.when(F.contains("_left", F.lit("/")) & F.col("_left").rlike(r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b"), F.lit(SLASHES)), F.when(F.contains("_left", F.lit("kal")) & F.col("_left").rlike(r"\bkal\b"), F.lit(KAL))))
    return rows.withColumn("doubts", doubts).drop("_left", "_relative")


def _valid(i: Column) -> Column:
    return F.coalesce(i["start"] <= i["end"], F.lit(False))


def date_mentions(queries: DataFrame, reference_date: str) -> DataFrame:
    """(``query_id``, ``source``, ``start``, ``end``, ``valid``): a row for every date expression."""
    rows = date_intervals(queries.select("query_id", question_text(F.col("query")).alias("text")), "text", reference_date)
    every = F.filter("intervals", lambda i: i.isNotNull())  # of a bare column Spark would first filter rows by its size, and make the intervals again for that
    return rows.select("query_id", F.explode(every).alias("i")).select("query_id", "i.source", "i.start", "i.end", _valid(F.col("i")).alias("valid"))


def _bounded(rows: DataFrame) -> DataFrame:
    """``start``, ``end`` and ``warnings`` of ``intervals`` and ``doubts``; any warning means no bounds."""
    bad = F.transform(F.filter("intervals", lambda i: ~_valid(i)), lambda i: F.concat(F.lit("no such dates: "), i["source"]))
    start, end = F.array_max(F.transform("intervals", lambda i: i["start"])), F.array_min(F.transform("intervals", lambda i: i["end"]))
    rows = rows.withColumn("warnings", F.concat(bad, "doubts")).withColumns({"start": start, "end": end})
    rows = rows.withColumn("warnings", F.when((F.size("warnings") == 0) & (F.col("start") > F.col("end")), F.array(F.lit(CONFLICT))).otherwise(F.col("warnings")))
    return rows.withColumns({c: F.when(F.size("warnings") == 0, F.col(c)) for c in ("start", "end")}).drop("intervals", "doubts")


def date_bounds(queries: DataFrame, reference_date: str) -> DataFrame:
    """(``query_id``, ``start``, ``end``, ``warnings``): the intersection of all dates of a query."""
    return _bounded(date_intervals(queries.select("query_id", question_text(F.col("query")).alias("text")), "text", reference_date)).select("query_id", "start", "end", "warnings")


def without_event_dates(text: Column) -> Column:
    """The text without dates that say when an event is, rather than when somebody wrote."""
    pattern = rf"{NOT_IN_WORD}(?:{ENDPOINT})\s+{EVENT}\b|\b{EVENT}\s+(?:in|on|for)\s+(?:{ENDPOINT}){NOT_BEFORE_WORD}"
    return F.regexp_replace(F.regexp_replace(text, pattern, " "), r"\s+", " ")


def month_part(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds within one month, cut to its early, middle or late days; bounds that exclude each other are reversed."""
    pattern = rf"\b(early|start|mid|late)(?:\s+of)?\s+{MONTH}\b"
    part = F.when(F.trunc(start, "month") == F.trunc(end, "month"), F.regexp_extract(text, pattern, 1))
    low, high = (F.element_at(F.create_map(*[F.lit(x) for k, v in MONTH_PARTS.items() for x in (k, v[i])]), part) for i in (0, 1))
    month = F.trunc(start, "month")
    cut = F.coalesce(part, F.lit("")) != ""
    return F.when(cut, F.greatest(start, F.date_add(month, low - 1))).otherwise(start), F.when(cut, F.least(end, F.date_add(month, high - 1))).otherwise(end)


def day_part(text: Column) -> Column:
    """``lo`` and ``hi`` hours if the text names exactly one part of the day, else null."""
    named = F.array_compact(F.array(*[F.when(text.rlike(rf"\b{k}\b"), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for k, (lo, hi) in DAY_PARTS.items()]))
    return F.when(F.size(named) == 1, F.try_element_at(named, F.lit(1)))


def type_request(query: Column) -> Column:
    """The message type that a question asks for, if it is one and clear."""
    return _type_in(question_text(query))


def _type_in(text: Column) -> Column:
    kinds = [F.when(text.rlike(TYPE_ASKED + noun) | (text.rlike(TYPE_FORWARD) if kind == "forwarded" else F.lit(False)), F.lit(kind)) for kind, noun in TYPE_NOUNS.items()]
    kinds = F.array_compact(F.array(*kinds))
    return F.when(~text.rlike(TYPE_BLOCKED) & (F.size(kinds) == 1), F.try_element_at(kinds, F.lit(1)))


def interpret(queries: DataFrame, aliases: DataFrame, reference_date: str) -> DataFrame:
    """One row of constraints per query: person, mode, start, end, hour_lo, hour_hi, message_type, has_filter, intent, reasons, warnings.

    Bounds come from the text without event dates; the intent and the listed warnings from the whole text.
    """
    rows = person_mentions(queries, aliases)
    rows = rows.withColumn("mode", person_role(F.col("marked"), F.col("person"))).withColumn("chat", without_event_dates(F.col("text")))
    changed = F.col("chat") != F.col("text")  # the whole text is read again only where it differs
    rows = _bounded(date_intervals(rows.withColumn("_whole", F.when(changed, F.col("text"))), "_whole", reference_date))
    rows = rows.withColumns({"dated": F.col("start").isNotNull(), "said": F.col("warnings")}).drop("_whole", "start", "end", "warnings")
    rows = _bounded(date_intervals(rows, "chat", reference_date))
    rows = rows.withColumns({"dated": F.when(changed, F.col("dated")).otherwise(F.col("start").isNotNull()), "said": F.when(changed, F.col("said")).otherwise(F.col("warnings"))})
    cut_start, cut_end = month_part(F.col("chat"), F.col("start"), F.col("end"))
    rows = rows.withColumns({"start": cut_start, "end": cut_end})
    clash = F.coalesce(F.col("start") > F.col("end"), F.lit(False))
    rows = rows.withColumn("warnings", F.when(clash, F.array_append("warnings", F.lit(MONTH_PART_CONFLICT))).otherwise(F.col("warnings")))
    sure = F.size("warnings") == 0
    rows = rows.withColumns({c: F.when(sure, F.col(c)) for c in ("start", "end")})
    rows = rows.withColumn("hours", F.when(F.col("start").isNotNull(), day_part(F.col("chat")))).withColumn("message_type", _type_in(F.col("text")))
    has_filter = (F.col("mode") == "filter") | F.col("start").isNotNull() | F.col("message_type").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("mode") == "filter", F.lit("the person is the sender")), F.when(F.col("mode") == "bonus", F.lit("the person is named, in no clear role")),
        F.when((F.col("mode") == "none") & F.col("person").isNotNull(), F.lit("the person is a topic or recipient")), F.when(F.size("candidates") > 1, F.lit(SEVERAL)),
        F.when(F.col("chat") != F.col("text"), F.lit("an event's date is not the message's")), F.when(F.col("start").isNotNull(), F.lit("messages outside the dates are excluded")),
        F.when(F.col("message_type").isNotNull(), F.lit("only messages of the type asked for")),
    ))
    intent = F.concat(F.when(F.col("person").isNotNull(), "person_").otherwise(""), F.when(F.col("dated"), "time_").otherwise(""), F.lit("semantic"))
    return rows.select(
        "query_id", "query", "person", "mode", "start", "end", F.col("hours.lo").alias("hour_lo"), F.col("hours.hi").alias("hour_hi"), "message_type", has_filter.alias("has_filter"), intent.alias("intent"),
        F.concat(reasons, "warnings").alias("reasons"), F.concat(F.when(F.size("candidates") > 1, F.array(F.lit(SEVERAL))).otherwise(F.array().cast("array<string>")), "said").alias("warnings"),
    )
