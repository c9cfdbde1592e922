"""The stored index: appends equal a rebuild, postings stay in their buckets, half-done and repeated batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parleylake.operators import lexical
from parleylake.sources import io
from parleylake.sources.lexical_store import LexicalStore

TEXTS = ["goa trip budget", "budget meeting on monday", "goa goa goa beach", "the beach at night", "", None, "monday night trip", "Éclair at the beach", "same text", "same text"]


def answers(found, key="id"):
    return sorted((r["query_id"], r["rank"], r[key], round(r["lexical"], 9)) for r in found.collect())


def test_appended_index_equals_a_rebuild(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(TEXTS)], "id string, text string")
    queries = spark.createDataFrame([(0, "goa beach"), (1, "budget on monday night"), (2, "unknown wörd"), (3, ""), (4, "same eclair")], "query_id long, query string")
    store = LexicalStore(spark, str(tmp_path / "index"), buckets=3)
    place = F.substring("id", 2, 9).cast("int")
    for name, part in (("a", place < 4), ("b", place.between(4, 6)), ("none", place < 0), ("c", place > 6)):
        store.append(rows.where(part), name)
    want = answers(lexical.lexical_topk(queries, *lexical.tfidf_index(rows), 3))
    assert answers(store.topk(queries, 3)) == want and len(want) > 6
    assert answers(LexicalStore(spark, str(tmp_path / "index"), buckets=3).topk(queries, 3)) == want

    for batch, again in (("a", rows.limit(0)), ("d", rows.limit(1)), ("e", spark.createDataFrame([("new", "x"), ("new", "y")], "id string, text string"))):
        with pytest.raises(ValueError):
            store.append(again, batch)
    # postings of a batch that was never committed are neither read nor taken up
    store._add(lexical.counts(spark.createDataFrame([("zz", "goa beach")], "id string, text string"), "id").withColumns({"gram": F.concat("channel", F.lit("\x1f"), "term"), "batch": F.lit("half")}), "postings")
    assert answers(store.topk(queries, 3)) == want
    with pytest.raises(ValueError):
        store.append(rows.limit(0), "half")

    plan = store.postings(spark.createDataFrame([("word", "goa")], "channel string, term string"))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "_postings" in line)
    assert "Bucketed: true" in scan or "Bucketed: false (disabled by query planner)" in scan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(gram" in line and "_postings" in line]


def test_reports_are_published_whole(spark, tmp_path, monkeypatch):
    """A report that fails on the way leaves the one before it; unlike runs are refused."""
    rows = spark.createDataFrame([(m, q, str(q), m) for m in ("a", "b") for q in range(3)], "method string, query_id long, expected_id string, note string")
    table, path = spark.createDataFrame([("a", 1)], "method string, n int"), str(tmp_path / "reports")
    io.write_reports(table, rows, path, 2)
    assert io.read_reports(spark, path, "rows").count() == 6
    broken = table.withColumn("n", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception):
        io.write_reports(broken, rows.limit(6), path, 2)
    assert io.read_reports(spark, path, "rows").count() == 6 and io.read_reports(spark, path, "comparison_csv").first()["n"] == "1"
    io.write_reports(table.withColumn("n", F.lit(7)), rows, path, 2)
    assert io.read_reports(spark, path, "comparison_json").first()["n"] == 7
    with pytest.raises(ValueError):
        io.write_reports(table, rows.where("method = 'a' or query_id < 2"), path, 2)


def test_vectors_that_are_no_use_are_refused(spark, tmp_path):
    """Null, ragged, endless and zero vectors end the job before anything is stored; a store that holds one isn't extended."""
    texts, path = spark.createDataFrame([("one",), ("two",)], "text string"), str(tmp_path / "store")
    good = F.array(F.length("text").cast("float"), F.lit(1.0).cast("float"))
    for bad in (F.lit(None).cast("array<float>"), F.array(F.lit(float("nan")), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0)), F.when(F.col("text") == "one", F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))):
        with pytest.raises(Exception):
            io.extend_store(texts, path, "s", bad).count()
    assert io.extend_store(texts, path, "s", good).count() == 2 == io.extend_store(texts, path, "s", good).count()
    io.check_store(spark, path)
    with pytest.raises(ValueError):  # another size than the store's
        io.extend_store(spark.createDataFrame([("three",)], "text string"), path, "s", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    assert io.read_store(spark, path).count() == 2


def test_damaged_stores_and_second_writers(spark, tmp_path, monkeypatch):
    texts, path = spark.createDataFrame([("one",), ("two",)], "text string"), str(tmp_path / "store")
    vector = F.array(F.length("text").cast("float"), F.lit(1.0).cast("float"))
    io.extend_store(texts.limit(1), path, "s", vector)
    held, commits = io._commits(spark, f"{path}/commits"), io._commits
    monkeypatch.setattr(io, "_commits", lambda *a: [])  # a writer who hasn't seen the commit of another
    with pytest.raises(Exception, match="already exists"):
        io.extend_store(texts, path, "s", vector)
    monkeypatch.setattr(io, "_commits", commits)
    assert io._commits(spark, f"{path}/commits") == held and io.read_store(spark, path).count() == 1
    assert io.extend_store(texts, path, "s", vector, verify=True).count() == 2
    file = next((tmp_path / "store" / "vectors" / held[0]["batch"]).glob("part-*.parquet"))
    spark.createDataFrame([("other", [1.0, 2.0])], io.STORE).coalesce(1).write.parquet(str(tmp_path / "other"))
    for damage in (next((tmp_path / "other").glob("part-*.parquet")).read_bytes(), b"PAR1 nothing PAR1"):
        file.write_bytes(damage)
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
        spark.catalog.clearCache()
        with pytest.raises(ValueError):
            io.extend_store(texts, path, "s", vector, verify=True)


def test_an_append_reads_its_own_batch_only(spark, tmp_path):
    """Pieces of a batch are written once and postings by term when they are asked for; both give a text's terms the same weights."""
    store, path = LexicalStore(spark, str(tmp_path / "index"), buckets=2), tmp_path / "index"
    rows = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(TEXTS)], "id string, text string")
    store.append(rows.where("id < 'd5'"), "a")
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    store.append(rows.where("id >= 'd5'"), "b")
    new = [f for f in path.rglob("*.parquet") if f not in before]
    assert new and not [f for f in path.glob("postings/*.parquet")] and not (path / "lengths").exists()
    wanted = spark.createDataFrame([("word", "goa"), ("word", "goa beach"), ("char", "bea"), ("word", "none")], "channel string, term string")
    weights = lambda found: sorted((r["id"], r["channel"], r["term"], round(r["weight"], 9)) for r in found.collect())
    want = weights(lexical.tfidf_index(rows)[0].join(wanted, ["channel", "term"]))
    assert weights(store.postings(wanted)) == want == weights(store.postings(wanted)) and len(want) > 4
