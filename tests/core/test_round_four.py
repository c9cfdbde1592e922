"""Round 4's findings: dates of any year in the first stage, an index that stores no postings."""

from __future__ import annotations

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parleylake.functions import terms
from parleylake.operators import dense, fuse, lexical, pool
from parleylake.sources.lexical_store import LexicalStore
from tests.core.test_pool import tables


@pytest.mark.parametrize("block", [4096, 4])
def test_first_stage_with_dates_of_any_year(spark, monkeypatch, block):
    """Messages and questions of years that nanoseconds don't reach, from both sides, broadcast and in blocks."""
    monkeypatch.setattr(dense, "QUERY_BLOCK", block)
    _, _, m, q = tables(spark, 6, 2)
    days = [datetime.date(1, 1, 1), datetime.date(1600, 2, 29), datetime.date(2262, 4, 12), datetime.date(2518, 7, 1), datetime.date(9999, 12, 31), None]
    spans = [(days[0], days[1]), (days[2], days[3]), (days[3], days[3]), (days[4], days[4]), (days[0], days[4]), (None, None)]
    kept = [c for c in m.columns if c != "day"]
    rows = m.drop("day").join(spark.createDataFrame([(f"m{i:03d}", d) for i, d in enumerate(days)], "id string, day date"), "id").select(*kept, "day")
    own = q.where("query_id = 0").drop("query_id", "start", "end").crossJoin(spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "query_id long, start date, end date")).select(*q.columns)
    found = {(r["query_id"], r["id"], r["date_match"]) for r in pool.first_stage(own, rows, 10).collect()}
    assert found == {(i, f"m{j:03d}", s is not None) for i, (s, e) in enumerate(spans) for j, d in enumerate(days) if s is None or (d is not None and s <= d <= e)}


def flat(df):
    return sorted((r["id"], r["channel"], r["term"], round(r["weight"], 9)) for r in df.collect())


def size_of(path) -> int:
    return sum(p.stat().st_size for p in Path(str(path).removeprefix("file:")).rglob("*.parquet"))


def long_texts(n: int, words: int) -> list[tuple[str, str]]:
    draw = random.Random(5)
    parts = ["an", "the", "on", "ré", "io", "st", "ing", "wh", "or", "ti"]
    return [(f"d{i}", " ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(words))) for i in range(n)]


@pytest.mark.parametrize("merged", [300, 4_000_000])
def test_index_cut_in_parts_equals_flat_counts(spark, monkeypatch, merged):
    """Terms that many parts merge, in texts beyond ASCII, blank and null ones, and keys that stand twice; as are those of a piece when its terms were stored."""
    monkeypatch.setattr(lexical, "MERGED", merged)
    monkeypatch.setattr(terms.pieces, "__defaults__", ("folded", 400))
    texts = long_texts(12, 40) + [("e1", "Éclair à 漢字 😀 x_1"), ("e2", None), ("e3", " \n"), ("e4", "a\x00b"), ("d0", "the same key once more")]
    rows = spark.createDataFrame(texts, "id string, text string").repartition(3)
    index = lexical.Index(rows)
    parts = index._merged().where("piece is null").groupBy("channel").count().collect()
    assert all((r["count"] > 3) == (merged < 1000) for r in parts) and len(parts) == 2
    own = lexical.counts(rows.withColumn("id", F.when(F.col("text").startswith("the same key"), "d0'").otherwise(F.col("id"))), "id")
    idf = lexical.document_frequency(rows, own)
    want = sorted((i.rstrip("'"), *rest) for i, *rest in flat(lexical.weighted(own, idf, "id")))
    assert flat(index.postings()) == want
    pair = lambda df: sorted((r["channel"], r["term"], round(r["idf"], 9)) for r in df.collect())
    assert pair(index.idf) == pair(idf)
    path = index.paths[0] + "-terms"
    lexical.write_terms(index, path)
    again = lexical.Index.stored(spark, "id", "string", index.paths, [path])
    assert flat(again.postings()) == want and pair(again.idf) == pair(idf)


def test_an_index_and_a_store_take_less_disk_than_their_texts(spark, tmp_path):
    """Texts and frequencies are packed, and no posting is stored: it was several times the texts."""
    rows = spark.createDataFrame(long_texts(400, 900), "id string, text string").repartition(8)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    index = lexical.Index(rows)
    assert index.lengths().count() == 800
    assert size_of(index.paths[0]) + size_of(index._merged().inputFiles()[0].rsplit("/", 1)[0]) < size
    store = LexicalStore(spark, str(tmp_path / "index"), buckets=2)
    for k in range(2):
        store.append(rows.where(F.crc32("id") % 2 == k), f"b{k}")
    assert size_of(tmp_path) < 1.5 * size


def test_query_weights_leave_the_frequencies_where_they_are(spark):
    """Of all frequencies only those of the queries' terms move, also without the terms that no text has."""
    rows = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(["goa beach", "goa", "night at goa beach"])], "id string, text string")
    queries = spark.createDataFrame([(0, "goa beach nowhere"), (1, ""), (2, None)], "query_id long, query string")
    idf = lexical.Index(rows).idf
    found = lexical.tfidf_query(queries, idf)
    want = lexical.weighted(lexical.counts(queries, "query_id", "query"), idf, "query_id")
    plain = lambda df: sorted((r["query_id"], r["channel"], r["term"], round(r["weight"], 9)) for r in df.collect())
    assert plain(found) == plain(want) and len(plain(found)) > 5
    assert "LeftSemi, BuildRight" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [4096, 3])
def test_signals_made_at_once_equal_joined_ones(spark, monkeypatch, block):
    """Null senders, hours and types, queries and messages without words or terms, broadcast and in blocks; no table of pairs is sorted or joined."""
    monkeypatch.setattr(dense, "QUERY_BLOCK", block)
    _, _, _, q = tables(spark, 1, 9)
    draw = random.Random(8)
    said = ["goa beach", "budget on monday", "", "night at goa", None]
    messages = [(f"m{i:02d}", draw.choice(["ann", "bob", None]), draw.choice(["text", "image", None]), datetime.datetime(2026, 3, 1 + i % 20, i % 24) if i % 7 else None, draw.choice(said)) for i in range(40)]
    m = spark.createDataFrame(messages, "id string, sender string, message_type string, ts timestamp, text string")
    asks = spark.createDataFrame([(i, t) for i, t in enumerate(["goa", "monday night", "", "unknown", "beach", "on", "at goa", "budget", "the"])], "query_id long, query string")
    index = lexical.Index(m)
    weights = lexical.tfidf_query(asks, index.idf)
    vectors = asks.select("query_id", dense.hashed_vector(F.col("query")).alias("vector"))
    own = m.select("id", dense.hashed_vector(F.col("text")).alias("own"), dense.hashed_vector(F.upper("sender")).alias("around"))
    pairs = dense.dense_channels(vectors, own, "id", "string", {"semantic": "own", "contextual": "around"}, 0.0, 1.0)
    joined = fuse.hybrid_signals(pairs, lexical.lexical_score(weights, index), q, m, "UTC")
    made = fuse.hybrid_signals((vectors, own), (weights, index), q, m, "UTC")
    assert made.columns == joined.columns and made.dtypes == joined.dtypes
    plain = lambda df: sorted((r[0], r[1], *[round(x, 9) for x in r[2:5]], *r[5:]) for r in df.collect())
    assert plain(made) == plain(joined) and len(plain(made)) == 360
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" not in plan.split("MapInArrow")[0].split("FlatMapCoGroupsInArrow")[0]
