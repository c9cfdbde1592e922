"""Evaluation of rankings: Top-1 and Recall@3 by group, comparisons of methods, failures, label audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parleylake.functions.text import content_words, zero_overlap
from parleylake.operators.ranges import numbered

METHODS = ["lexical", "semantic", "contextual", "hybrid"]
UNLIKE = "the methods answered different questions"


def run_rows(labels: DataFrame, hits: DataFrame, methods: DataFrame) -> DataFrame:
    """Per method and label: ``retrieved_ids`` (three at most, by rank), ``top1_correct``, ``recalled_at_3``; queries without hits keep a row.

    ``methods`` is a handful of names. Hits beyond rank 3 don't count.
    """
    best = hits.where(F.col("rank") <= 3).groupBy("method", "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("found"))
    rows = labels.crossJoin(F.broadcast(methods)).join(best, ["method", "query_id"], "left")
    ids = F.coalesce(F.transform("found", lambda h: h["id"]), F.array().cast("array<string>"))
    rows = rows.withColumn("retrieved_ids", ids).drop("found")
    top = F.coalesce(F.try_element_at("retrieved_ids", F.lit(1)) == F.col("expected_id"), F.lit(False))
    return rows.withColumns({"top1_correct": top, "recalled_at_3": F.array_contains("retrieved_ids", F.col("expected_id"))})


def percent(correct: Column, total: Column) -> Column:
    """Null without rows, not 0."""
    return F.round(F.try_divide(correct * 100.0, total), 6)


def metrics(rows: DataFrame, by: str = "method") -> DataFrame:
    """(``by``, ``part``, ``correct``, ``total``, ``percent``): Top-1 overall, for hard labels and by category, Recall@3, and the gap of overall and hard.

    One aggregate makes all parts: GROUPING SETS over the method and its categories. Nothing to measure is an error.
    """
    held = rows.groupingSets([[F.col(by)], [F.col(by), F.col("category")]], F.col(by), F.col("category")).agg(
        F.grouping("category").alias("overall"), F.count("*").alias("n"), F.count_if("top1_correct").alias("top1"), F.count_if("recalled_at_3").alias("recall"),
        F.count_if("hard").alias("hard_n"), F.count_if(F.col("hard") & F.col("top1_correct")).alias("hard_top1"),
    )
    part = lambda name, correct, total: F.struct(name.alias("part"), correct.alias("correct"), total.alias("total"), percent(correct, total).alias("percent"))
    gap = percent(F.col("top1"), F.col("n")) - percent(F.col("hard_top1"), F.col("hard_n"))
    none = F.lit(None).cast("long")
    overall = F.array(
        part(F.lit("top1"), F.col("top1"), F.col("n")), part(F.lit("recall_at_3"), F.col("recall"), F.col("n")), part(F.lit("hard_top1"), F.col("hard_top1"), F.col("hard_n")),
        F.struct(F.lit("gap").alias("part"), none.alias("correct"), none.alias("total"), F.round(gap, 6).alias("percent")),
    )
    single = F.array(part(F.concat(F.lit("category "), "category"), F.col("top1"), F.col("n")))
    measured = held.select(by, F.inline(F.when(F.col("overall") == 1, overall).otherwise(single)))
    return guarded(measured, rows.agg(F.count("*").alias("n")), F.col("n") > 0, "an empty evaluation set can't be scored")


def guarded(rows: DataFrame, facts: DataFrame, ok: Column, message: str) -> DataFrame:
    """``rows``, or an error if ``ok`` doesn't hold in a row of ``facts``: a branch of its own without rows, so it runs even if there are no ``rows``."""
    fails = F.when(F.coalesce(ok, F.lit(False)), F.lit(False)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return rows.unionByName(facts.where(fails).select([F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))


def same_questions(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Facts and their test for ``guarded``: every method has answered each question once, with the same text, target, category and mark."""
    asked = F.struct(*[c for c in ("query", "expected_id", "category", "hard", "language") if c in rows.columns])
    per = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("method").alias("of"), F.count_distinct(asked).alias("kinds"))
    methods = rows.agg(F.count_distinct("method").alias("methods"))  # one row
    return per.crossJoin(F.broadcast(methods)), (F.col("n") == F.col("methods")) & (F.col("of") == F.col("methods")) & (F.col("kinds") == 1)


def _paired(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Both methods' rows of each query, side by side; a query that only one has, or with two targets, ends the job."""
    pick = lambda name, to: rows.where(F.col("method") == name).select("query_id", *[F.col(c).alias(f"{to}_{c}") for c in ("expected_id", "top1_correct")])
    both = pick(baseline, "old").join(pick(candidate, "new"), "query_id", "full")
    same = F.coalesce(F.col("old_expected_id") == F.col("new_expected_id"), F.lit(False))
    return both.where(F.when(same, True).otherwise(F.raise_error(F.lit(UNLIKE)).cast("boolean")))


def newly(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(``baseline``, ``candidate``, ``query_id``, ``change``) of queries that became right or wrong."""
    changed = _paired(rows, baseline, candidate).where(F.col("old_top1_correct") != F.col("new_top1_correct"))
    return changed.select(F.lit(baseline).alias("baseline"), F.lit(candidate).alias("candidate"), "query_id", F.when(F.col("new_top1_correct"), "newly correct").otherwise("newly incorrect").alias("change"))


def compare_methods(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Per part of the metrics: both percents, the difference in points, its direction. Methods that answered different questions end the job."""
    both = rows.where(F.col("method").isin(baseline, candidate))
    deltas = guarded(_deltas(metrics(both), candidate), *same_questions(both), UNLIKE)
    return guarded(deltas, both.agg(F.count_distinct("method").alias("n")), F.col("n") == len({baseline, candidate}), f"needed: {baseline} and {candidate}")


def _deltas(measured: DataFrame, candidate: str) -> DataFrame:
    measured = measured.where(F.col("part") != "gap")
    new = measured.where(F.col("method") == candidate).select("part", F.col("percent").alias("candidate_percent"))
    old = measured.where(F.col("method") != candidate).select(F.col("method").alias("baseline"), "part", F.col("percent").alias("baseline_percent"))
    delta = F.round(F.col("candidate_percent") - F.col("baseline_percent"), 6)
    return old.join(new, "part").select(
        "baseline", F.lit(candidate).alias("candidate"), "part", "baseline_percent", "candidate_percent", delta.alias("delta"), F.when(delta > 0, "improved").when(delta < 0, "worse").when(delta == 0, "unchanged").alias("direction")
    )


def compare_all(rows: DataFrame, candidate: str = "hybrid", required: list[str] = METHODS) -> DataFrame:
    """``compare_methods`` of the candidate with each other method; exactly the required methods must be there, with the same questions."""
    held = rows.select("method").distinct().agg(F.array_sort(F.collect_set("method")).alias("m"))
    deltas = guarded(_deltas(metrics(rows), candidate), *same_questions(rows), UNLIKE)
    return guarded(deltas, held, F.col("m") == F.lit(sorted(required)), f"needed: {required}")


def comparison_table(measured: DataFrame, by: str = "method") -> DataFrame:
    """One row per method, with correct, total and percent of every part side by side."""
    parts = ["top1", "recall_at_3", "hard_top1", "gap", "category 1-URGENT", "category 2-HIGH", "category 3-MEDIUM", "category 4-NOT SPECIFIED", "category 5-LOW"]
    return pivot_parts(measured, parts, by)


def pivot_parts(measured: DataFrame, parts: list[str], by: str = "method") -> DataFrame:
    wide = measured.groupBy(by).pivot("part", parts).agg(F.first("correct").alias("correct"), F.first("total").alias("total"), F.first("percent").alias("percent"))
    return wide.select([F.col(f"`{c}`").alias(c.replace(" ", "_").replace("-", "_").lower()) for c in wide.columns])


def best_method(measured: DataFrame, order: list[str] = METHODS) -> DataFrame:
    """One row: the method with the best Top-1, of equals the first in the declared order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("method"))
    return measured.where(F.col("part") == "top1").agg(F.max_by("method", F.struct("percent", -place)).alias("method"), F.max("percent").alias("percent"))


def failures(rows: DataFrame, hits: DataFrame, messages: DataFrame, scores: tuple[str, ...] = ("score",)) -> DataFrame:
    """Wrong first answers: question, category, expected message, and each of three hits with its scores and message.

    Queries without hits have one row without any; a message that isn't there has no text. ``messages`` has
    ``id`` and what shall be shown of a message; those columns come once as ``expected_`` and once as they are named.
    """
    wrong = rows.where(~F.col("top1_correct")).select("method", "query_id", "query", "category", "expected_id")
    shown = [c for c in messages.columns if c != "id"]
    expected = messages.select(F.col("id").alias("expected_id"), *[F.col(c).alias(f"expected_{c}") for c in shown])
    found = hits.where(F.col("rank") <= 3).select("method", "query_id", "rank", "id", *scores)
    return wrong.join(found, ["method", "query_id"], "left").join(messages, "id", "left").join(expected, "expected_id", "left")


def neighbour_misses(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(``method``, ``query_id``, ``id``): wrong first hits whose context holds the expected message. They are never credited."""
    wrong = rows.where(~F.col("top1_correct") & (F.size("retrieved_ids") > 0)).select("method", "query_id", "expected_id", F.col("retrieved_ids")[0].alias("id"))
    near = contexts.select("id", F.explode(F.transform("ctx", lambda m: m["id"])).alias("near"))
    return wrong.join(near, (wrong["id"] == near["id"]) & (wrong["expected_id"] == near["near"]), "left_semi").select("method", "query_id", "id")


def tune(measured: DataFrame) -> DataFrame:
    """One row: the profile with the best Top-1, then Recall@3, then the declared order. ``measured`` has ord, profile, top1, recall."""
    return measured.agg(F.max_by("profile", F.struct("top1", "recall", -F.col("ord"))).alias("profile"))


def profile_measures(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per profile its right first hits and recalled targets over the labels."""
    wanted = labels.select("query_id", "expected_id")
    found = rows.join(wanted, "query_id").where(F.col("id") == F.col("expected_id"))
    return found.groupBy("ord", "profile").agg(F.count_if(F.col("rank") == 1).alias("top1"), F.count("*").alias("recall"))


def candidate_recall(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label the size of its candidate pool and whether the target is in it."""
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("pool"))
    inside = labels.join(pool, (labels["query_id"] == pool["query_id"]) & (labels["expected_id"] == pool["id"]), "left_semi").select("query_id", F.lit(True).alias("inside"))
    rows = labels.select("query_id", "expected_id").join(sizes, "query_id", "left").join(inside, "query_id", "left")
    return rows.select("query_id", F.coalesce("pool", F.lit(0)).alias("pool"), F.coalesce("inside", F.lit(False)).alias("target_in_pool"))


def attach_target(labels: DataFrame, messages: DataFrame) -> DataFrame:
    """(``query_id``, ``expected_id``, ``target_text``, ``dangling``): labels with their targets; a target that isn't there is dangling."""
    targets = messages.select(F.col("id").alias("expected_id"), F.col("text").alias("target_text"), F.lit(True).alias("_there"))
    return labels.join(targets, "expected_id", "left").select("query_id", "expected_id", "target_text", F.col("_there").isNull().alias("dangling"))


def pair_check(labels: DataFrame) -> DataFrame:
    """(``pair_id``, ``problem``) of pairs without two rows, without both languages, or with two targets."""
    held = labels.groupBy("pair_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("language")).alias("languages"), F.count_distinct("expected_id").alias("targets"))
    problems = F.array_compact(F.array(F.when(F.col("n") != 2, F.lit("rows")), F.when(F.col("languages") != F.lit(["english", "hinglish"]), F.lit("languages")), F.when(F.col("targets") != 1, F.lit("targets"))))
    return held.select("pair_id", F.explode(problems).alias("problem"))


def label_violations(labels: DataFrame, messages: DataFrame, categories: list[str], id_pattern: str, id_format: str = "Q%03d", least_hard: int = 8) -> DataFrame:
    """(``query_id``, ``rule``) of labels, and rows without an id for rules of the whole set.

    Labels are in the order of ``query_id``, and their own ids follow ``id_format`` from 1; queries are the same
    if they differ in outer blanks and case only.
    """
    rows = attach_target(labels, messages).select("query_id", "target_text", "dangling").join(numbered(labels, ["query_id"], "place"), "query_id")
    same = F.lower(F.btrim("query"))
    again = labels.groupBy(same.alias("same")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("same", same).join(again, "same")
    flag = zero_overlap(content_words(F.col("query")), content_words(F.coalesce("target_text", F.lit(""))))
    rules = {
        "id": F.col("label_id").rlike(id_pattern), "query": F.btrim("query") != "", "target": ~F.col("dangling"), "category": F.col("category").isin(categories), "same query": F.col("n") == 1,
        "order": F.col("label_id") == F.format_string(id_format, "place"), "query words": F.size(content_words(F.col("query"))) > 0,
        "target words": F.col("dangling") | (F.size(content_words(F.coalesce("target_text", F.lit("")))) > 0),
        "overlap flag": F.col("dangling") | (F.col("hard") == flag),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    hard = labels.agg(F.count_if("hard").alias("n")).where(F.col("n") < least_hard).select(F.lit(None).cast("long").alias("query_id"), F.lit("too few hard labels").alias("rule"))
    return rows.select("query_id", F.explode(broken).alias("rule")).unionByName(hard)


def thread_coverage(labels: DataFrame, records: DataFrame) -> DataFrame:
    """One row: distinct targets, and the threads that they reach."""
    reached = labels.select(F.col("expected_id").alias("id")).join(records.select("id", "thread_id"), "id")
    return reached.agg(F.count_distinct("id").alias("targets"), F.array_join(F.array_sort(F.collect_set("thread_id")), ",").alias("threads"))
