"""Neighbouring messages of every message, in one long conversation, without a window over all of it.

Neighbours must lie within ``gap`` seconds of their anchor. Time is cut into buckets of several gaps,
each row also goes to the bucket a gap before and after it, windows run within buckets, and a row's
result is taken from its own bucket: what lies between it and a neighbour is there too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A bucket's length in gaps; rows are repeated about 2 / BUCKET times.
BUCKET = 4
LABELS = {"before": "Previous message: ", "anchor": "Current message: ", "after": "Following message: "}


def _windows(messages: DataFrame, size: int, gap: int, keep: list[str]) -> DataFrame:
    """``messages`` with ``ctx``: up to ``size`` rows on either side within ``gap`` seconds of the anchor, itself included, by (ts, id)."""
    second = F.unix_timestamp("ts")
    bucket = lambda shift: F.floor((second + shift) / (BUCKET * gap))
    rows = messages.select("*", second.alias("_t"), bucket(0).alias("_own"), F.explode(F.array_distinct(F.array(bucket(-gap), bucket(0), bucket(gap)))).alias("_bucket"))
    order = Window.partitionBy("_bucket").orderBy("ts", "id")
    near = F.collect_list(F.struct(F.col("_t").alias("t"), *keep)).over(order.rowsBetween(-size, size))
    rows = rows.withColumn("ctx", near).where(F.col("_own") == F.col("_bucket"))
    return rows.withColumn("ctx", F.filter("ctx", lambda m: F.abs(m["t"] - F.col("_t")) <= gap)).drop("_own", "_bucket")


def context_window(messages: DataFrame, size: int = 2, gap: int = 1800) -> DataFrame:
    """``id``, ``t`` and ``ctx`` (t, id, text in order) of every message."""
    if not 0 <= size <= 2 or not 0 < gap <= 1800:
        raise ValueError("a context has at most two neighbours on a side, within at most 1800 seconds")
    return _windows(messages, size, gap, ["id", "text"]).select("id", F.col("_t").alias("t"), "text", "ctx")


def _lines(ctx: Column, at: Column, texts: Column) -> Column:
    """Labelled lines of the texts that aren't blank; ``at`` is the anchor's place, from 1."""
    label = lambda i: F.when(i + 1 < at, LABELS["before"]).when(i + 1 == at, LABELS["anchor"]).otherwise(LABELS["after"])
    lines = F.transform(texts, lambda t, i: F.when(F.btrim(t) != "", F.concat(label(i), t)))
    return F.array_join(F.array_compact(lines), "\n")


def _place() -> Column:
    return F.array_position(F.transform("ctx", lambda m: m["id"]), F.col("id")).cast("int")


def context_text(contexts: DataFrame) -> DataFrame:
    """``contexts`` with ``context_text``."""
    return contexts.withColumn("context_text", _lines(F.col("ctx"), _place(), F.transform("ctx", lambda m: F.coalesce(m["text"], F.lit("")))))


def display_window(messages: DataFrame, size: int = 3, gap: int = 1800) -> DataFrame:
    """``id`` with ``previous`` and ``next``: up to ``size`` messages on either side, in order."""
    rows = _windows(messages, size, gap, ["id", "sender", "timestamp", "text", "message_type"]).withColumn("_at", _place())
    bare = lambda c: F.transform(c, lambda m: m.dropFields("t"))
    return rows.select("id", bare(F.slice("ctx", F.lit(1), F.col("_at") - 1)).alias("previous"), bare(F.slice("ctx", F.col("_at") + 1, F.size("ctx"))).alias("next"))


def fit_budget(contexts: DataFrame, budget: int) -> DataFrame:
    """``contexts`` with ``fitted`` (at most ``budget`` blank-separated tokens) and ``trimmed`` (ids, in order).

    Neighbours lose their last tokens first, the longest first (of equals the earliest); a line without
    tokens goes with its label; the anchor's own text comes last. One fold over the neighbours does it,
    as each cut either suffices or empties its line. Texts within the budget stay as they are.
    """
    if budget < 8:
        raise ValueError("a budget holds at least eight tokens")
    label = 2  # tokens of each label
    tokens = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != "")
    rows = contexts.withColumn("_at", _place()).withColumn("_tokens", F.transform("ctx", lambda m: tokens(m["text"])))
    lines = F.transform("_tokens", lambda t, i: F.struct((i + 1 == F.col("_at")).alias("last"), (-F.size(t)).alias("less"), i.alias("i")))
    total = F.aggregate("_tokens", F.lit(0), lambda acc, t: acc + F.when(F.size(t) > 0, F.size(t) + label).otherwise(0))

    def step(acc: Column, line: Column) -> Column:
        cut = F.least(-line["less"], F.greatest(acc["excess"], F.lit(0)))
        gone = cut + F.when((cut > 0) & (cut == -line["less"]), label).otherwise(0)
        return F.struct((acc["excess"] - gone).alias("excess"), F.concat(acc["cuts"], F.array(F.struct(line["i"].alias("i"), cut.alias("cut")))).alias("cuts"))

    start = F.struct((total - budget).alias("excess"), F.array().cast("array<struct<i:int,cut:int>>").alias("cuts"))
    rows = rows.withColumn("_over", total > budget).withColumn("_cuts", F.array_sort(F.aggregate(F.array_sort(lines), start, step, lambda acc: acc["cuts"])))
    kept = F.transform("_tokens", lambda t, i: F.slice(t, F.lit(1), F.size(t) - F.get(F.col("_cuts"), i)["cut"]))
    whole = _lines(F.col("ctx"), F.col("_at"), F.transform("ctx", lambda m: F.coalesce(m["text"], F.lit(""))))
    short = _lines(F.col("ctx"), F.col("_at"), F.transform(kept, lambda t: F.array_join(t, " ")))
    trimmed = F.transform(F.filter("_cuts", lambda c: c["cut"] > 0), lambda c: F.get(F.col("ctx"), c["i"])["id"])
    return rows.withColumn("fitted", F.when(F.col("_over"), short).otherwise(whole)).withColumn("trimmed", trimmed).drop("_at", "_tokens", "_over", "_cuts")


def truncation_stats(fitted: DataFrame) -> DataFrame:
    """One row: contexts, those with any trimmed text, those whose own message was trimmed."""
    return fitted.agg(F.count("*").alias("contexts"), F.count_if(F.size("trimmed") > 0).alias("trimmed"), F.count_if(F.array_contains("trimmed", F.col("id"))).alias("own_trimmed"))


def attach_context(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Hits with the windows of their messages; hits are the smaller side, which Spark sees at run time."""
    return hits.join(windows, "id")
