"""Data-quality rules, profiles and identity of message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parleylake.functions.text import MESSAGE_TYPES, classify_type, local_time
from parleylake.operators.ranges import in_ranges, numbered, range_bounds

#: Texts that a corpus must have, marks, words of mixed language, typos, topics.
SHORT_REPLIES = ["haan", "done", "ok", "😂"]
MARKS = ["[Image]", "[PDF]", "[Voice message]", "Forwarded:", "https://"]
MIXED = r"\b(hai|nahi|kya|yaar|mat)\b"
TYPOS = ["thnks", "nhi", "sorryyy", "birhtday"]


def _broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule that can't be told counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def row_violations(records: DataFrame, participants: DataFrame, threads: list[str], id_pattern: str, first: str, last: str, offset: str = "+00:00", sequence: str | None = None) -> DataFrame:
    """(``id``, ``rule``): one row for each rule that a record breaks, in one pass.

    ``participants`` (``participant_id``, ``participant_name``) is a dimension; Spark chooses how to join it.
    With ``sequence``, a format, ids follow it from 1 by (ts, id); records are numbered by ranges for it.
    """
    rows = records.join(participants.distinct(), "participant_id", "left")
    if sequence:
        rows = numbered(rows, ["ts", "id"], "place")
    present = lambda c: F.col(c).isNotNull() & (F.btrim(F.col(c).cast("string")) != "")
    rules = {
        "id": F.col("id").rlike(id_pattern), "text": present("text"), "known_type": F.col("message_type").isin(MESSAGE_TYPES),
        "type_of_text": ~present("text") | ~F.col("message_type").isin(MESSAGE_TYPES) | (F.col("message_type") == classify_type(F.col("text"))),
        "participant": F.col("participant_name").isNotNull(), "sender": F.col("sender") == F.col("participant_name"),
        "topic": present("topic") & present("episode_id"), "offset": F.endswith("timestamp", F.lit(offset)),
        "dates": F.substring("timestamp", 1, 10).between(first, last), "thread": F.col("thread_id").isNull() | F.col("thread_id").isin(threads),
    } | ({"sequence": F.col("id") == F.format_string(sequence, "place")} if sequence else {})
    return rows.select("id", F.explode(_broken(rules)).alias("rule"))


def _in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``part``, the number of their range by fixed bounds; ranges follow each other, so neighbours meet within a part or at its ends."""
    return in_ranges(rows, order, range_bounds(rows, order))


def out_of_order(records: DataFrame) -> DataFrame:
    """One row ``n``: how many records are earlier than the one before them by id. No window goes over the whole table."""
    rows = _in_order(records.select("id", "ts"), ["id"])
    inner = Window.partitionBy("part").orderBy("id")
    late = rows.select("part", "id", "ts", F.lag("ts").over(inner).alias("before")).groupBy("part").agg(
        F.count_if(F.col("ts") < F.col("before")).alias("late"), F.min_by("ts", "id").alias("head"), F.max_by("ts", "id").alias("tail")
    )
    ends = late.withColumn("before", F.lag("tail").over(Window.orderBy("part")))  # a row for each part
    return ends.agg(F.coalesce(F.sum(F.col("late") + F.when(F.col("head") < F.col("before"), 1).otherwise(0)), F.lit(0)).alias("n"))


def dataset_violations(records: DataFrame, participants: DataFrame, expected: dict[str, int | str], zone: str = "UTC") -> DataFrame:
    """(``rule``, ``ok``) of rules over the whole table; ``expected`` has ``messages``, ``days``, ``months``, ``span_days``, ``first_day``, ``last_day``, and ``start`` and ``end``, the timestamps in the metadata."""
    day, _ = local_time(F.col("ts"), zone)
    facts = records.select("*", day.alias("day")).agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.collect_set("sender").alias("senders"), F.count_distinct("day").alias("days"),
        F.count_distinct(F.date_format("day", "yyyy-MM")).alias("months"), F.datediff(F.max("day"), F.min("day")).alias("span"), F.collect_set("message_type").alias("types"),
        F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
        F.min_by("timestamp", F.struct("ts", "id")).alias("start"), F.max_by("timestamp", F.struct("ts", "id")).alias("end"),
    )
    names = participants.agg(F.collect_set("participant_name").alias("names"))
    facts = facts.crossJoin(names).crossJoin(out_of_order(records).withColumnRenamed("n", "late"))  # single rows
    rules = {
        "unique_ids": F.col("n") == F.col("ids"), "senders": F.array_sort("senders") == F.array_sort("names"), "chronological": F.col("late") == 0,
        "message_count": F.col("n") == expected["messages"], "days": F.col("days") == expected["days"], "months": F.col("months") == expected["months"],
        **{k: F.col(k) == expected[k] for k in ("first_day", "last_day", "start", "end")},
        "span": F.col("span") >= expected["span_days"], "all_types": F.size(F.array_except(F.array(*map(F.lit, MESSAGE_TYPES)), F.col("types"))) == 0,
    }
    return facts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in rules.items()])))


def variety_checks(records: DataFrame, topics: list[str]) -> DataFrame:
    """(``rule``, ``ok``): texts that stand alone, marks, mixed language, typos and topics that the corpus must show."""
    text = F.col("text")
    checks = {f"reply {x}": F.bool_or(text == x) for x in SHORT_REPLIES} | {f"mark {x}": F.bool_or(F.contains(text, F.lit(x))) for x in MARKS}
    checks |= {"mixed language": F.bool_or(text.rlike(MIXED)), "typos": F.bool_or(text.rlike("|".join(TYPOS)))}
    checks |= {"topics": F.size(F.array_except(F.array(*map(F.lit, topics)), F.collect_set("topic"))) == 0}
    return records.agg(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()]).alias("all")).select(F.inline("all"))


#: Ids, and digests of pieces, that one digest goes over.
PIECE = 256


def ordered_digest(records: DataFrame, size: int = PIECE) -> DataFrame:
    """(``of_ids``, ``ids_md5``): a digest of each thread's ids by (ts, id); null ids are left out.

    It is a tree: the MD5 of each ``size`` ids, joined with commas, then of each ``size`` of these digests, until
    one is left. Ids get their places by ranges, so no task reads a thread, and a changed id can be found from
    the top. A thread of up to ``size`` ids has the MD5 of all its ids.
    """
    rows = records.where(F.col("thread_id").isNotNull() & F.col("id").isNotNull()).select(F.col("thread_id").cast("string").alias("of_ids"), "ts", F.col("id").cast("string").alias("node"))
    most = rows.groupBy("of_ids").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    nodes = numbered(rows, ["ts", "node"], "at", within=["of_ids"], total="n").withColumn("at", F.col("at") - 1)
    whole = True
    while whole or most > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]), ",")  # at most ``size``
        digest = F.md5(joined) if whole else F.when(F.first("n") > 1, F.md5(joined)).otherwise(F.first("node"))
        nodes = nodes.groupBy("of_ids", F.floor(F.col("at") / size).alias("to")).agg(F.ceil(F.first("n") / size).alias("n"), digest.alias("node")).withColumnRenamed("to", "at")
        whole, most = False, -(-most // size)
    return nodes.select("of_ids", F.col("node").alias("ids_md5"))


def inside(rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(``key``, ``n``): how many ``rows`` have their ``ts`` strictly inside each span (``key``, ``start``, ``end``).

    Instants and ends of spans are ordered together by ranges; each end takes the number of instants before
    it, from the sum of the ranges before its own, so no row meets the spans it lies in.
    """
    of = spans.schema[key].dataType
    at = lambda c, place, by: spans.select(F.col(c).alias("ts"), F.lit(place).alias("place"), F.col(key).alias("of"), F.lit(by).alias("by"))
    points = rows.where(F.col("ts").isNotNull()).select("ts", F.lit(1).alias("place"), F.lit(None).cast(of).alias("of"), F.lit(0).alias("by"))
    placed = _in_order(points.unionByName(at("end", 0, 1)).unionByName(at("start", 2, -1)), ["ts", "place"])
    before = F.count_if(F.col("by") == 0).over(Window.partitionBy("part").orderBy("ts", "place"))
    sizes = placed.groupBy("part").agg(F.count_if(F.col("by") == 0).alias("size"))
    earlier = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))  # a row for each part
    counted = placed.withColumn("before", before).where("by <> 0").join(earlier, "part")
    return counted.groupBy(F.col("of").alias(key)).agg(F.greatest(F.sum(F.col("by") * (F.col("before") + F.col("earlier"))), F.lit(0)).alias("n"))


def thread_audit(records: DataFrame, zone: str = "UTC", metadata: DataFrame | None = None) -> DataFrame:
    """Per thread: counts, ends, digest of the ordered ids, distinct episodes, days and senders, span, and how many others' messages lie in between.

    With ``metadata`` (``thread_id``, ``message_count``, ``first_message_id``, ``last_message_id``, ``ids_md5``,
    ``conclusion_id``) also ``problems``: what it has otherwise, a conclusion that isn't of the thread or not
    strictly between its ends, and threads that only one side has.
    """
    day, _ = local_time(F.col("ts"), zone)
    key = F.struct("ts", "id")
    threads = records.where(F.col("thread_id").isNotNull()).groupBy("thread_id").agg(
        F.count("*").alias("n"), F.min_by("id", key).alias("first_id"), F.max_by("id", key).alias("last_id"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.count_distinct("episode_id").alias("episodes"), F.count_distinct(day).alias("days"), F.count_distinct("sender").alias("senders"),
    )
    ends = threads.select(F.col("thread_id").alias("of"), "start", "end")
    own = records.join(ends, F.col("thread_id") == F.col("of")).where((F.col("ts") > F.col("start")) & (F.col("ts") < F.col("end"))).groupBy("of").agg(F.count("*").alias("own"))
    foreign = inside(records, ends, "of").join(own, "of", "left").select("of", (F.col("n") - F.coalesce("own", F.lit(0))).alias("foreign"))
    digests = ordered_digest(records)
    joined = threads.join(foreign, threads["thread_id"] == foreign["of"], "left").join(digests, threads["thread_id"] == digests["of_ids"], "left")
    audit = joined.select(
        "thread_id", "n", "first_id", "last_id", F.coalesce("ids_md5", F.md5(F.lit(""))).alias("ids_md5"), "episodes", "days", "senders",
        (F.unix_timestamp("end") - F.unix_timestamp("start") >= 14 * 86400).alias("two_weeks"), F.coalesce("foreign", F.lit(0)).alias("foreign"),
    )
    return audit if metadata is None else against_metadata(audit, records, metadata)


def against_metadata(audit: DataFrame, records: DataFrame, metadata: DataFrame) -> DataFrame:
    """``audit`` of ``records`` with ``problems``, as ``thread_audit`` says; for an audit that was written once."""
    told = metadata.select("thread_id", "message_count", "first_message_id", "last_message_id", F.col("ids_md5").alias("told_md5"), "conclusion_id")
    known = records.where(F.col("thread_id").isNotNull()).select(F.col("id").alias("conclusion_id"), F.col("thread_id").alias("concludes")).distinct()
    both = audit.withColumn("found", F.lit(True)).join(told.withColumn("named", F.lit(True)), "thread_id", "full").join(known, "conclusion_id", "left")
    strictly = (F.col("concludes") == F.col("thread_id")) & (F.col("first_id") < F.col("conclusion_id")) & (F.col("conclusion_id") < F.col("last_id"))
    rules = {"count": F.col("n") == F.col("message_count"), "members": F.col("ids_md5") == F.col("told_md5"), "ends": (F.col("first_id") == F.col("first_message_id")) & (F.col("last_id") == F.col("last_message_id")), "conclusion": strictly}
    problems = F.when(F.col("found").isNull(), F.array(F.lit("missing"))).when(F.col("named").isNull(), F.array(F.lit("not named"))).otherwise(_broken(rules))
    return both.select(*audit.columns, problems.alias("problems"))


def counts_against(rows: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """(``value``, ``n``, ``expected``, ``ok``): counts of a column's values against a table (``value``, ``expected``), from either side."""
    own = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    both = own.join(expected, "value", "full")
    return both.select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"), (F.coalesce("n", F.lit(0)) == F.coalesce("expected", F.lit(0))).alias("ok"))


def corpus_stats(messages: DataFrame, reference_date: str, zone: str) -> DataFrame:
    """One row: counts, first and last timestamp by instant, inclusive months, and the corpus's reference date and zone."""
    key = F.struct("ts", "id")
    months = F.year(F.max("ts")) * 12 + F.month(F.max("ts")) - F.year(F.min("ts")) * 12 - F.month(F.min("ts")) + 1
    return messages.agg(
        F.count("*").alias("messages"), F.count_distinct("sender").alias("participants"), F.min_by("timestamp", key).alias("first"), F.max_by("timestamp", key).alias("last"), months.alias("months"),
        F.lit(reference_date).alias("reference_date"), F.lit(zone).alias("zone"),
    )


def text_profile(messages: DataFrame) -> DataFrame:
    """Per type: messages, and those of a single token."""
    return messages.groupBy("message_type").agg(F.count("*").alias("n"), F.count_if(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) == 1).alias("single_token"))


def sender_mismatch(messages: DataFrame, participants: DataFrame) -> DataFrame:
    """(``name``, ``side``): senders that are no participants, and participants that never speak."""
    said, known = messages.select(F.col("sender").alias("name")).distinct(), participants.select("name").distinct()
    return said.join(known, "name", "left_anti").withColumn("side", F.lit("unknown sender")).unionByName(known.join(said, "name", "left_anti").withColumn("side", F.lit("silent participant")))


def assign_ids(messages: DataFrame, pattern: str = "MSG_%06d") -> DataFrame:
    """``messages`` with ``new_id`` numbered from 1 by (ts, id)."""
    return numbered(messages, ["ts", "id"], "new_id").withColumn("new_id", F.format_string(pattern, "new_id"))


def fingerprint(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One row (``dataset``, ``n``, ``fingerprint``) that does not depend on the rows' order; nulls count as a mark of their own."""
    whole = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    return rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(whole, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint")).select(F.lit(name).alias("dataset"), "n", "fingerprint")


def against_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(``dataset``, ``n``, ``fingerprint``, ``state``) of fingerprints against a manifest of the same columns: same, changed, missing, or not listed."""
    listed = manifest.select("dataset", F.col("n").alias("listed_n"), F.col("fingerprint").alias("listed_fingerprint"), F.lit(True).alias("listed"))
    both = found.withColumn("there", F.lit(True)).join(listed, "dataset", "full")
    same = (F.col("n") == F.col("listed_n")) & F.col("fingerprint").eqNullSafe(F.col("listed_fingerprint"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "not listed").when(same, "same").otherwise("changed")
    return both.select("dataset", "n", "fingerprint", state.alias("state"))
