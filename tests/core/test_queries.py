"""Every registered query against its SQL, on the smallest tables; and plans."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__
from parleylake.plans import catalog

SMALL = "/root/testdata/sf0.001"
#: The stages that `search` runs through have their own entries; these would repeat its work.
LONG = {"hybrid_topk", "top_k", "pair_score", "candidate_recall", "target_rank", "lexical_score", "tfidf_query", "vocab_stats", "eligible"}
#: What numbers, ranges or ranks is run on tables that fill several ranges and partitions too.
LARGE, NUMBERED = "/root/testdata/sf0.1", ["row_violations", "label_violations", "assign_ids", "zero_overlap", "dataset_violations", "thread_audit", "semantic_topk", "cell_topk", "eligible_counts"]


def views_of(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return c


@pytest.fixture(scope="module")
def con():
    return views_of(SMALL)


@pytest.fixture(scope="module")
def large():
    return views_of(LARGE)


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 5) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if n not in LONG or os.environ.get("ALL_QUERIES")])
def test_query_equals_its_sql(spark, con, name):
    equal(spark, con, name, SMALL)


@pytest.mark.parametrize("name", NUMBERED)
def test_query_equals_its_sql_on_larger_tables(spark, large, name):
    equal(spark, large, name, LARGE)


def equal(spark, con, name, folder):
    got = catalog.QUERIES[name](spark, folder)
    out = con.execute(catalog.ORACLES[name])
    columns = sorted(c[0] for c in out.description)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in out.description].index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in out.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == want


def test_queries_without_sql_give_rows(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_windows_are_never_global(spark):
    """Contexts, numbering and ranks partition their rows; only tables with a row a partition may be in one task."""
    for name in ("context_window", "display_window", "lexical_topk", "semantic_topk"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name
    ranked = catalog.QUERIES["lexical_topk"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in ranked


def slow_digest(nodes, size):
    import hashlib

    while True:
        nodes = [hashlib.md5(",".join(nodes[lo : lo + size]).encode()).hexdigest() for lo in range(0, len(nodes), size)]
        if len(nodes) == 1:
            return nodes[0]


def test_threads_are_never_held_whole(spark):
    """The digest of a thread's ids is a tree over pieces of a fixed size: of one level, of several, of a single id."""
    from parleylake.operators import quality
    from parleylake.plans import views

    records = views.records(spark, SMALL).select("thread_id", "ts", "id").unionByName(spark.sql("SELECT 'solo' thread_id, timestamp'2026-01-01' ts, 'x' id"))
    threads = {}
    for r in sorted(records.where("thread_id is not null").collect()):
        threads.setdefault(r["thread_id"], []).append(r["id"])
    assert max(map(len, threads.values())) == 9
    for size in (2, 9, quality.PIECE):
        assert {r["of_ids"]: r["ids_md5"] for r in quality.ordered_digest(records.repartition(5), size).collect()} == {t: slow_digest(ids, size) for t, ids in threads.items()}
    assert quality.ordered_digest(records.limit(0)).count() == 0
