"""The first stage in one pass against all pairs, pools with one exchange, and messages found by keys."""

from __future__ import annotations

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parleylake.operators import dense, fuse, pool

SCHEMA = "query_id long, id string, semantic double, contextual double, lexical double, score double"


def slow_pool(rows, width):
    out = set()
    by = lambda r: r[0]
    for q, own in itertools.groupby(sorted(rows, key=by), by):
        own = list(own)
        for at in (5, 2, 3, 4):
            fits = sorted((-round(r[at], 9), r[1]) for r in own if at == 5 or round(r[at], 9) > 0)
            out |= {(q, i) for _, i in fits[:width]}
    return out


@pytest.mark.parametrize("held", [1, 10**6])
def test_pool_of_many_ties(spark, monkeypatch, held):
    rng = random.Random(2)
    rows = [(q, f"m{i:03d}", *[rng.choice([0.0, 0.0, 0.25, 0.5, rng.random()]) for _ in range(4)]) for q in range(5) for i in range(120 if q else 3)]
    monkeypatch.setattr(pool, "HELD", held)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for width in (1, 7, 200):
        got = fuse.candidate_pool(table, 1, width)
        assert {tuple(r) for r in got.collect()} == slow_pool(rows, width)
    assert fuse.candidate_pool(table.limit(0)).count() == 0
    plan = fuse.candidate_pool(table)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(query_id") == 1


def test_firsts_by_column():
    rng = np.random.default_rng(1)
    scores = rng.choice([-np.inf, 0.0, 0.5, 1.0], (40, 6))
    for k in (1, 3, 39, 60):
        want = [[i for _, i in sorted((-s, i) for i, s in enumerate(column) if s > -np.inf)[:k]] for column in scores.T]
        got = pool.firsts(scores, k)
        assert [sorted(w) for w in want] == [np.flatnonzero(c).tolist() for c in got.T]


def tables(spark, n=90, asks=13):
    rng = random.Random(4)
    day = lambda i: datetime.date(2026, 3, 1) + datetime.timedelta(days=i)
    unit = lambda: [round(rng.uniform(-1, 1), 3) for _ in range(4)]
    terms = lambda: [(t, round(rng.random(), 3)) for t in sorted(rng.sample(range(20), rng.randrange(6)))] or None
    messages = [(f"m{i:03d}", unit(), unit(), terms(), ["ann", "bob", None][i % 3], ["text", "image"][i % 2], day(i % 20), i % 24) for i in range(n)]
    queries = []
    for q in range(asks):
        mode, dated = ["none", "filter", "bonus"][q % 3], q % 4 == 1
        queries.append((q, unit(), terms(), "ann" if mode != "none" else None, mode, day(q % 20) if dated else None, day(q % 20 + 6) if dated else None, 6 if q == 5 else None, 18 if q == 5 else None, "image" if q % 5 == 2 else None, 0.3, 0.4, 0.2, 0.05, 0.05))
    term = "terms array<struct<t:long,weight:double>>"
    m = spark.createDataFrame(messages, f"id string, own array<double>, around array<double>, {term}, sender string, own_type string, day date, hour int")
    q = spark.createDataFrame(queries, f"query_id long, vector array<double>, {term}, person string, mode string, start date, end date, hour_lo int, hour_hi int, message_type string, w_contextual double, w_semantic double, w_lexical double, person_bonus double, date_bonus double")
    return messages, queries, m, q


def slow_first(messages, queries):
    out = []
    clip = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), 0.0), 1.0)
    for q, v, terms, person, mode, start, end, lo, hi, kind, wc, ws, wl, pb, db in queries:
        for i, own, around, held, sender, own_type, day, hour in messages:
            if (mode == "filter" and sender != person) or (start and not start <= day <= end) or (lo is not None and not lo <= hour < hi) or (kind and own_type != kind):
                continue
            held = dict(held or [])
            s, c, x = clip(own, v), clip(around, v), sum(w * held.get(t, 0) for t, w in terms or [])
            is_person = mode != "none" and sender == person
            out.append((q, i, s, c, x, wc * c + ws * s + wl * x + (pb if is_person else 0) + (db if start else 0), is_person, bool(start)))
    return out


@pytest.mark.parametrize(("block", "chunk", "rows", "asked"), [(4096, 65_536, 8_192, 256), (4, 20, 16, 3)])
def test_first_stage_of_all_pairs(spark, monkeypatch, block, chunk, rows, asked):
    """Broadcast, and in blocks of questions and chunks of messages, with small matrices."""
    for where, name, value in ((dense, "QUERY_BLOCK", block), (dense, "ROW_CHUNK", chunk), (pool, "ROWS", rows), (pool, "ASKED", asked), (pool, "PRODUCTS", rows)):
        monkeypatch.setattr(where, name, value)
    messages, queries, m, q = tables(spark)
    pairs = slow_first(messages, queries)
    for width in (1, 6, 500):
        found = pool.candidate_pool(pool.first_stage(q, m.repartition(5), width), 1, width)
        got = {(r["query_id"], r["id"]): (round(r["score"], 8), round(r["lexical"], 8), r["person_match"], r["date_match"]) for r in found.collect()}
        assert got == {(p[0], p[1]): (round(p[5], 8), round(p[4], 8), p[6], p[7]) for p in pairs if (p[0], p[1]) in slow_pool(pairs, width)}
    assert pool.first_stage(q, m.limit(0), 5).count() == 0 and pool.first_stage(q.limit(0), m, 5).count() == 0


def test_eligible_by_keys(spark):
    """All kinds of constraints, long, empty and reversed intervals, null senders; a nested loop for queries without bounds only."""
    messages, queries, m, q = tables(spark, 60, 24)
    stamp = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp("day")) + F.col("hour") * 3600)
    rows = m.select("id", "sender", F.col("own_type").alias("message_type"), stamp.alias("ts"))
    extra = [(100, None, "none", datetime.date(1, 1, 1), datetime.date(9999, 12, 31)), (101, None, "none", datetime.date(2027, 1, 1), datetime.date(2027, 2, 1)), (102, None, "none", datetime.date(2026, 3, 9), datetime.date(2026, 3, 2)), (103, None, "filter", None, None)]
    added = spark.createDataFrame([(*e, None, None, None) for e in extra], "query_id long, person string, mode string, start date, end date, hour_lo int, hour_hi int, message_type string")
    asked = q.select(*added.columns).unionByName(added)
    want = {(p[0], p[1]) for p in slow_first(messages, queries)} | {(100, x[0]) for x in messages}
    assert sorted(tuple(r) for r in fuse.eligible(asked, rows, "UTC").collect()) == sorted(want)
    dated = fuse.eligible(asked.where("start is not null"), rows, "UTC")
    loops = [line for line in dated._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "kind" in line]
    assert loops and all("value" in line for line in loops)
