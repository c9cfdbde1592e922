"""Numbering over fixed bounds: no row is lost, whatever Spark prunes and coalesces."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parleylake.operators import dense, ranges


@pytest.mark.parametrize("payload", [False, True])
def test_numbers_of_a_large_table(spark, payload):
    """With and without a column that the counting plan doesn't read, under adaptive execution."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    rows = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("k"), *([F.repeat(F.md5(F.col("id").cast("string")), 2).alias("payload")] if payload else []))
    got = ranges.numbered(rows, ["k"], "n")
    assert got.agg(F.count("*"), F.min("n"), F.max("n"), F.count_distinct("n")).first() == (400_000, 1, 400_000, 400_000)
    assert got.withColumnRenamed("k", "one").join(got.select(F.col("k").alias("two"), (F.col("n") - 1).alias("n")), "n").where("one > two").count() == 0


def test_numbers_of_ties_nulls_and_few_rows(spark):
    """A hot key, nulls first, repeated rows, one row and none; several columns, and more ranges than keys."""
    rows = [(None if i % 10 == 0 else "hot" if i % 3 else f"s{i % 7}", None if i % 11 == 0 else i // 2) for i in range(1_000)]
    order = lambda r: [(x is not None, x) for x in r]
    for data in (rows, rows[:1], []):
        table = spark.createDataFrame(data, "source string, at long").repartition(7)
        for n in (None, 1, 5, 300):
            got = sorted((r["n"], (r["source"], r["at"])) for r in ranges.numbered(table, ["source", "at"], "n", n).collect())
            assert [r[0] for r in got] == list(range(1, len(data) + 1))
            assert [r[1] for r in got] == sorted(data, key=order)


def test_more_bounds_than_a_stride(spark):
    table = spark.range(5_000).withColumn("ts", F.timestamp_seconds(F.col("id") * 977 % 5_003))
    got = ranges.numbered(table, ["ts"], "n", 333)
    assert got.where(F.col("n") < F.unix_timestamp("ts") - 3).count() == 0 and got.agg(F.count_distinct("n")).first()[0] == 5_000


def test_every_query_of_many_is_answered(spark):
    vectors = spark.range(60_000).select(F.col("id").alias("query_id"), F.array(F.cos("id"), F.sin("id")).alias("vector"))
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.array(F.cos("id"), F.sin("id")).alias("vector"))
    got = dense.semantic_topk(vectors, rows, 1)
    assert got.count() == 60_000 and got.where(F.col("query_id") < 50).where(F.col("query_id").cast("string") != F.col("id")).count() == 0


def test_numbers_within_a_column(spark):
    """A hot value, a null value and small ones each begin anew and know their size."""
    data = [(None if i % 10 == 0 else "hot" if i % 3 else f"s{i % 7}", i * 37 % 1_009) for i in range(1_000)]
    table = spark.createDataFrame(data, "source string, at long").repartition(7)
    for n in (1, 5, 90):
        got = {}
        for r in ranges.numbered(table, ["at"], "n", n, ["source"], "of").collect():
            got.setdefault((r["source"], r["of"]), []).append((r["n"], r["at"]))
        want = {}
        for source, at in data:
            want.setdefault(source, []).append(at)
        assert {k: sorted(v) for k, v in got.items()} == {(k, len(v)): list(enumerate(sorted(v), 1)) for k, v in want.items()}
