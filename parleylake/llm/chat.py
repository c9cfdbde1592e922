"""Preference formatting: shared turns once as the prompt, what differs as two masked completions.

A pair is a chosen and a rejected conversation. The longest common prefix of their turns is rendered
once; each conversation's other turns are rendered as its completion, with the spans that training
should see (the assistant's words and the end mark behind them) beside it. All of it is array
functions on one row per pair: no pair meets another, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.llm._shared import table

#: The chat template: what stands before and after a turn's content.
HEAD, MID, END = "<|", "|>\n", "<|end|>\n"
TURN = "struct<role:string,content:string>"
SPAN = "struct<start:int,end:int>"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MID), turn["content"], F.lit(END))


def _clean(turns: Column) -> Column:
    """Null conversations are empty, null roles and contents ''."""
    turns = F.coalesce(turns, F.array().cast(f"array<{TURN}>"))
    return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["content"], F.lit("")).alias("content")))


def _mask(turns: Column, role: str) -> Column:
    """Character spans of the turns of ``role`` within their rendering: contents and end marks, without the line break."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = acc["at"] + F.char_length(turn["role"]) + len(HEAD + MID)
        after = head + F.char_length(turn["content"]) + len(END)
        own = F.array(F.struct(head.alias("start"), (after - 1).alias("end")))
        return F.struct(after.alias("at"), F.when(turn["role"] == role, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected", role: str = "assistant") -> DataFrame:
    """Per pair: ``pair_id``, ``n_common``, ``prompt``, and ``chosen`` and ``rejected`` with ``chosen_mask`` and ``rejected_mask``.

    The conversations are arrays of (role, content). Equal conversations are all prompt, with two empty
    completions; null conversations are empty; repeated pairs each keep a row; further columns are ignored.
    """
    rows = pairs.select(F.col(id_col).alias("pair_id"), _clean(F.col(chosen_col)).alias("a"), _clean(F.col(rejected_col)).alias("b"))
    shortest = F.least(F.size("a"), F.size("b"))
    differs = F.array_position(F.zip_with(F.slice("a", 1, shortest), F.slice("b", 1, shortest), lambda x, y: x == y), False)
    rows = rows.withColumn("n_common", F.when(differs > 0, differs.cast("int") - 1).otherwise(shortest))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    rows = rows.withColumns({"rest_a": rest("a"), "rest_b": rest("b")})
    text = lambda turns: F.array_join(F.transform(turns, _rendered), "")
    return rows.select(
        "pair_id", "n_common", text(F.slice("a", 1, F.col("n_common"))).alias("prompt"),
        text("rest_a").alias("chosen"), _mask(F.col("rest_a"), role).alias("chosen_mask"),
        text("rest_b").alias("rejected"), _mask(F.col("rest_b"), role).alias("rejected_mask"),
    )


def pairs_from_conversations(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """A pair for every conversation: the whole of it, and the same up to one of its answers, which another text takes the place of.

    Which answer it is goes by the id (its remainder by the number of answers), so pairs branch early and late.
    The text in its place is the answer before it, or nothing for the first. A conversation without answers
    is rejected with an empty answer after it. Turns are ordered by number (null first), then role and text,
    null roles and texts being ''; repeated turns stay repeated; turns without a ``conv_id`` belong to no
    conversation; an empty table gives no pairs; further columns are ignored. A pair is one row, so a
    conversation's turns must fit in a task.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    whole = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))
    whole = whole.withColumn("answers", F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == role))
    n = F.size("answers")
    branch = F.when(n > 0, F.abs("conv_id") % n + 1).cast("int")
    at = F.when(n > 0, F.try_element_at("answers", branch)).otherwise(F.size("turns") + 1)
    before = F.when(branch > 1, F.try_element_at("answers", branch - 1))
    stand_in = F.struct(F.lit(role).alias("role"), F.coalesce(F.try_element_at("turns", before)["content"], F.lit("")).alias("content"))
    return whole.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), at - 1), F.array(stand_in)).alias("rejected"))


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each against its stand-in."""
    done = format_pairs(pairs_from_conversations(table(spark, sf_dir, "conversations")))
    return done.withColumns({"chosen_mask": spans_text("chosen_mask"), "rejected_mask": spans_text("rejected_mask")}).withColumnRenamed("pair_id", "conv_id")


def _rendered_sql(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda x: '<|' || x.role || '|>' || chr(10) || x.content || '<|end|>' || chr(10)), ''), '')"


def _mask_sql(turns: str) -> str:
    """A turn's rendering has 13 characters besides its role and content; 5 of them and the role stand before the content, 7 behind it are seen."""
    before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda x: length(x.role) + length(x.content) + 13)), 0) + 14"
    own = f"list_filter(generate_series(1, len({turns})), lambda i: {turns}[i].role = 'assistant')"
    return f"coalesce(array_to_string(list_transform({own}, lambda i: ({before})::BIGINT || ':' || ({before} + length({turns}[i].content) + 7)::BIGINT), ','), '')"


#: The common prefix is searched for: the first place where the turns differ.
ORACLE = f"""
WITH t AS (SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, ''), 'content': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  w AS (SELECT conv_id, list_transform(ts, lambda x: {{'role': x.role, 'content': x.content}}) AS a, list_filter(generate_series(1, len(ts)), lambda i: ts[i].role = 'assistant') AS ans FROM t),
  k AS (SELECT *, CASE WHEN len(ans) > 0 THEN abs(conv_id) % len(ans) + 1 END AS br FROM w),
  p AS (SELECT conv_id, a, a[1:coalesce(ans[br], len(a) + 1) - 1] || [{{'role': 'assistant', 'content': CASE WHEN br > 1 THEN a[ans[br - 1]].content ELSE '' END}}] AS b FROM k),
  c AS (SELECT *, coalesce(list_filter(generate_series(1, least(len(a), len(b))), lambda i: a[i].role <> b[i].role OR a[i].content <> b[i].content)[1] - 1, least(len(a), len(b))) AS n_common FROM p),
  r AS (SELECT conv_id, n_common, a[1:n_common] AS pre, a[n_common + 1:] AS ra, b[n_common + 1:] AS rb FROM c)
SELECT conv_id, n_common::INTEGER AS n_common, {_rendered_sql("pre")} AS prompt, {_rendered_sql("ra")} AS chosen, {_mask_sql("ra")} AS chosen_mask, {_rendered_sql("rb")} AS rejected, {_mask_sql("rb")} AS rejected_mask
FROM r
"""
