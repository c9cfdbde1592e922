"""Merging hit spans: any mix of lengths, spans that touch, one long run, many separate ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parleylake.llm.decontam import merged_spans, scan

KIND = "id int, spans array<struct<start:int,end:int>>"


def slow(spans):
    out = []
    for start, end in spans:
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("n", [1, 3, 10])
def test_merged_spans_equal_one_pass_over_them(spark, n):
    rng = random.Random(n)
    rows = [(0, []), (1, [(0, n)]), (2, [(i, i + n) for i in range(0, 40 * n, n)]), (3, [(i, i + n) for i in range(0, 40 * (n + 1), n + 1)])]
    for i in range(4, 300):
        starts = [rng.randrange(rng.choice((12, 60, 400))) for _ in range(rng.randrange(1, 60))]
        rows.append((i, sorted({(s, s + rng.randint(1, n)) for s in starts})))
    got = spark.createDataFrame(rows, KIND).select("id", merged_spans(F.col("spans"), n).alias("runs")).collect()
    assert {r["id"]: [tuple(x) for x in r["runs"]] for r in got} == {i: slow(s) for i, s in rows}


def test_many_separate_spans_in_one_text(spark):
    """200,000 runs of one text: a fold that copies what it has at each step would copy twenty thousand million."""
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: F.struct((i * 20).cast("int").alias("start"), (i * 20 + 10).cast("int").alias("end"))).alias("spans"))
    found = rows.select(merged_spans(F.col("spans"), 10).alias("runs")).select(F.size("runs").alias("n"), F.get("runs", F.lit(199_999))["end"].alias("last")).first()
    assert (found["n"], found["last"]) == (200_000, 199_999 * 20 + 10)


def test_short_items_inside_long_ones(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k y a b z"), (2, None), (3, "clean words"), (4, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], [tuple(s) for s in r["hit_spans"]]) for r in scan(docs, items).collect()}
    assert got == {1: (13, 2, [(1, 12), (13, 15)]), 2: (0, 0, []), 3: (0, 0, []), 4: (2, 1, [(0, 2)])}
