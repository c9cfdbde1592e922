"""Models load once a worker, get batches of like length, and are checked; sketches count within their error."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from parleylake.operators import dense, fuse, lexical, models


def fake(folder, answer):
    """What ``load`` gives: a model that notes its loads and the lengths of its batches in files of its process."""

    def load():
        import os as own_os
        import uuid

        with open(f"{folder}/load-{own_os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

        def model(*texts):
            with open(f"{folder}/batches-{own_os.getpid()}", "a") as file:
                file.write(" ".join(str(len(t)) for t in texts[0]) + "\n")
            return answer(*texts)

        return model

    return load


def test_encoder_in_batches(spark, tmp_path):
    rng = random.Random(1)
    texts = ["x" * rng.randrange(200) for _ in range(1_500)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)
    encode = models.encoder(f"fake {tmp_path}", fake(tmp_path, lambda ts: [[len(t), 1.0] for t in ts]), 2)
    for _ in range(2):
        got = {r["id"]: r["vector"] for r in dense.embed(rows, encode).collect()}
        assert got == {i: None if t is None else [len(t), 1.0] for i, t in enumerate(texts)}
    loads = [os.path.basename(f).split("-")[1] for f in glob.glob(f"{tmp_path}/load-*")]
    assert loads and len(loads) == len(set(loads))  # once a process
    batches = [list(map(int, line.split())) for f in glob.glob(f"{tmp_path}/batches-*") for line in open(f).read().split("\n")[:-1]]
    assert max(map(len, batches)) == models.BATCH and all(b == sorted(b) for b in batches) and sum(map(len, batches)) == 2 * 1_501
    assert sum(len(b) == models.BATCH for b in batches) > 0.8 * len(batches)


def test_answers_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id int, text string")
    wrong = {"count": lambda ts: [[1.0, 1.0]] * (len(ts) - 1), "size": lambda ts: [[1.0]] * len(ts), "nan": lambda ts: [[float("nan"), 1.0]] * len(ts), "inf": lambda ts: [[float("inf"), 1.0]] * len(ts)}
    for name, answer in wrong.items():
        with pytest.raises(Exception, match="the encoder gave"):
            dense.embed(rows, models.encoder(f"{name} {tmp_path}", fake(tmp_path, answer), 2)).collect()


def test_pair_model_in_batches(spark, tmp_path):
    pool = spark.createDataFrame([(q, f"m{i}") for q in range(3) for i in range(40)], "query_id long, id string")
    queries = spark.createDataFrame([(q, "q" * (q + 1)) for q in range(3)], "query_id long, query string")
    messages = spark.createDataFrame([(f"m{i}", "x" * i, "ann", "2026-01-01T00:00:00Z") for i in range(40)], "id string, text string, sender string, timestamp string")
    model = models.pair_model(f"pair {tmp_path}", fake(tmp_path, lambda a, b: [len(x) / (len(x) + len(y)) for x, y in zip(a, b)]))
    got = {(r["query_id"], r["id"]): r["pair"] for r in fuse.pair_score(pool, queries, messages, model).collect()}
    said = len("\nSender: ann. Sent: 2026-01-01.")
    assert got == {(q, f"m{i}"): (q + 1) / (q + 1 + i + said) for q in range(3) for i in range(40)}
    with pytest.raises(Exception, match="a pair score must be in"):
        fuse.pair_score(pool, queries, messages, models.pair_model(f"high {tmp_path}", fake(tmp_path, lambda a, b: [1.5] * len(a)))).collect()


def test_sketches_of_terms(spark):
    """Merged over batches, within the stated error of the exact counts; an empty batch changes nothing."""
    rows = spark.range(3_000).select(F.col("id").cast("string").alias("id"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 1_700), F.concat(F.lit("v"), F.col("id") % 90)).alias("text"))
    own = lexical.counts(rows, "id")
    exact = {r["channel"]: r["terms"] for r in lexical.vocab_stats(own).collect()}
    half = F.col("id") % 2 == 0
    sketches = lexical.vocab_sketches(own.where(half)).unionByName(lexical.vocab_sketches(own.where(~half))).unionByName(lexical.vocab_sketches(own.limit(0)))
    merged = {r["channel"]: r["terms"] for r in lexical.vocab_estimate(sketches).collect()}
    assert merged.keys() == exact.keys() and all(abs(merged[c] - exact[c]) <= 3 * lexical.SKETCH_ERROR * exact[c] for c in exact)
