"""Inputs that end a job, and one mutation for each rule that audits a table."""

from __future__ import annotations

import datetime
import json

import pytest

from parleylake.operators import evaluate, quality
from parleylake.sources import io

RUN = "method string, query_id long, query string, expected_id string, category string, hard boolean, retrieved_ids array<string>, top1_correct boolean, recalled_at_3 boolean"


def runs(spark, change=lambda method, row: row):
    made = [{"method": m, "query_id": i, "query": f"q{i}", "expected_id": f"m{i}", "category": "a" if i % 2 else "b", "hard": i == 1, "retrieved_ids": [f"m{i}"], "top1_correct": True, "recalled_at_3": True} for m in evaluate.METHODS for i in range(4)]
    kept = [x for row in made if (x := change(row["method"], row)) is not None]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in RUN.split(", ")) for r in kept], RUN)


@pytest.mark.parametrize("change", [
    lambda m, r: None if m == "hybrid" and r["query_id"] == 3 else r,
    lambda m, r: r | {"expected_id": "other"} if m == "hybrid" and r["query_id"] == 3 else r,
    lambda m, r: r | {"query": "other"} if m == "semantic" and r["query_id"] == 0 else r,
    lambda m, r: r | {"hard": True} if m == "hybrid" and r["query_id"] == 2 else r,
    lambda m, r: None if m == "hybrid" else r,
])
def test_unlike_runs_are_not_compared(spark, change):
    rows = runs(spark, change)
    with pytest.raises(Exception, match="different questions|needed"):
        evaluate.compare_methods(rows, "semantic", "hybrid").collect()
    with pytest.raises(Exception, match="different questions|needed"):
        evaluate.compare_all(rows).collect()


def test_like_runs_are_compared(spark):
    assert {r["direction"] for r in evaluate.compare_all(runs(spark)).collect()} == {"unchanged"} and evaluate.compare_methods(runs(spark), "lexical", "hybrid").count() == 5


def test_nothing_to_score_is_an_error(spark):
    with pytest.raises(Exception, match="empty evaluation set"):
        evaluate.metrics(runs(spark).limit(0)).collect()


def test_failures_show_messages_and_scores(spark):
    rows = runs(spark, lambda m, r: r | {"top1_correct": r["query_id"] > 1}).where("method = 'hybrid'")
    hits = spark.createDataFrame([("hybrid", 0, 1, "m5", 0.5, 0.25), ("hybrid", 0, 2, "gone", 0.4, 0.0), ("hybrid", 3, 1, "m3", 0.9, 0.9)], "method string, query_id long, rank int, id string, score double, lexical double")
    messages = spark.createDataFrame([("m0", "wanted", "ann"), ("m5", "found", "bob")], "id string, text string, sender string")
    got = {(r["query_id"], r["rank"]): r for r in evaluate.failures(rows, hits, messages, ("score", "lexical")).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, None)}
    first = got[0, 1]
    assert (first["expected_text"], first["expected_sender"], first["text"], first["sender"], first["score"], first["lexical"], first["query"], first["category"]) == ("wanted", "ann", "found", "bob", 0.5, 0.25, "q0", "b")
    assert got[0, 2]["text"] is None and got[1, None]["id"] is None and got[1, None]["expected_text"] is None


def corpus(tmp_path, lines):
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    return str(tmp_path / "m.jsonl")


def test_blank_lines_and_null_types_are_refused(spark, tmp_path):
    good = {"id": "1", "timestamp": "2026-08-01T10:00:00+05:30", "sender": "a", "text": "hi"}
    path = corpus(tmp_path, [json.dumps(good), "", json.dumps(good | {"id": "2", "message_type": None}), json.dumps(good | {"id": "3", "message_type": 5}), json.dumps(good | {"id": "4", "message_type": "pdf"})])
    got = {r["id"]: (r["message_type"], list(r["problems"])) for r in io.read_messages(spark, path).collect()}
    assert got == {"1": ("text", []), None: (got[None][0], ["no object"]), "2": (None, ["unknown type"]), "3": (None, ["unknown type"]), "4": ("pdf", [])}
    with pytest.raises(Exception, match="no object|unknown type"):
        io.read_messages(spark, path, fail_fast=True).collect()


def test_an_empty_corpus_is_refused(spark, tmp_path):
    path = corpus(tmp_path, [])
    assert io.read_messages(spark, path).count() == 0
    with pytest.raises(Exception, match="the corpus is empty"):
        io.read_messages(spark, path, fail_fast=True).collect()


def at(minute):
    return datetime.datetime(2026, 3, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=minute)


def test_ids_follow_each_other(spark):
    people = spark.createDataFrame([("p", "p")], "participant_id string, participant_name string")
    rows = [(f"MSG_{i + (i > 5):06d}", at(i), "p", "p", "text", "text", "t", "e", f"{at(i):%Y-%m-%dT%H:%M:%S}+00:00", None) for i in range(1, 9)]
    records = spark.createDataFrame(rows, "id string, ts timestamp, sender string, participant_id string, text string, message_type string, topic string, episode_id string, timestamp string, thread_id string").repartition(3)
    got = sorted(tuple(r) for r in quality.row_violations(records, people, [], r"^MSG_\d{6}$", "2026-03-01", "2026-08-31", sequence="MSG_%06d").collect())
    assert got == [(f"MSG_{i:06d}", "sequence") for i in (7, 8, 9)]


@pytest.mark.parametrize(("column", "value", "problem"), [("message_count", 9, "count"), ("first_message_id", "x", "ends"), ("last_message_id", "x", "ends"), ("ids_md5", "x", "members"), ("conclusion_id", "m00", "conclusion"), ("conclusion_id", "m08", "conclusion"), ("conclusion_id", "m03", "conclusion"), ("conclusion_id", None, "conclusion"), (None, None, None)])
def test_thread_metadata(spark, column, value, problem):
    """Messages 0, 2, .. 8 are the thread's, the others lie in between; some share an instant with its ends."""
    from pyspark.sql import functions as F

    rows = [(f"m{i:02d}", at(i if i < 9 else 8), "T" if i % 2 == 0 and i < 10 else None, "e", "s") for i in range(12)] + [("n0", at(0), None, "e", "s"), ("n1", None, None, "e", "s")]
    records = spark.createDataFrame(rows, "id string, ts timestamp, thread_id string, episode_id string, sender string").repartition(4)
    audit = quality.thread_audit(records)
    assert [(r["n"], r["first_id"], r["last_id"], r["foreign"]) for r in audit.collect()] == [(5, "m00", "m08", 4)]
    told = audit.select("thread_id", F.col("n").alias("message_count"), F.col("first_id").alias("first_message_id"), F.col("last_id").alias("last_message_id"), "ids_md5", F.lit("m04").alias("conclusion_id"))
    if column:
        told = told.withColumn(column, F.lit(value).cast(told.schema[column].dataType))
    assert [list(r["problems"]) for r in quality.thread_audit(records, metadata=told).collect()] == [[problem] if problem else []]


def test_instants_inside_spans(spark):
    """Counted by ranges as by comparing each with each."""
    import random

    rng = random.Random(5)
    instants, spans = [rng.randrange(40) for _ in range(200)], [(k, *sorted(rng.sample(range(40), 2))) for k in range(30)] + [(30, 7, 7)]
    rows = spark.createDataFrame([(at(m),) for m in instants], "ts timestamp").repartition(6)
    asked = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in spans], "k long, start timestamp, end timestamp")
    assert {r["k"]: r["n"] for r in quality.inside(rows, asked, "k").collect()} == {k: sum(a < m < b for m in instants) for k, a, b in spans}
