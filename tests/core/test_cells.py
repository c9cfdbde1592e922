"""Nearest rows through an index of cells: the rows of the plain search, from few of the blocks where vectors are clustered."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parleylake.operators import cells, dense
from parleylake.plans.catalog import written


def table(spark, vectors, key="id"):
    unit = np.array(vectors, float)
    lengths = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit / np.where(lengths > 0, lengths, 1)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], f"{key} long, vector array<double>").repartition(5)


def slow(queries, rows, k):
    own = sorted((r["id"], np.array(r["vector"])) for r in rows.collect()) if rows.count() else []
    out = []
    for q in queries.collect():
        scored = sorted((-round(float(np.clip(v @ np.array(q["vector"]), -1, 1)), 9), i) for i, v in own)
        out += [(q["query_id"], i, rank, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def clustered(n, centres, noise, seed=3, dims=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    return middle[rng.integers(centres, size=n)] + noise * rng.normal(size=(n, dims)) / np.sqrt(dims)


def held(found):
    return sorted((r["query_id"], r["id"], r["rank"], round(r["semantic"], 9)) for r in found.collect())


def close(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-9)


@pytest.mark.parametrize("case", ["clustered", "random", "hot", "zero"])
def test_equal_to_brute_force(spark, case):
    """Clusters; no clusters at all; a third of the rows the same vector; zero vectors on both sides."""
    vectors = clustered(900, 12, 9.0 if case == "random" else 0.2)
    if case == "hot":
        vectors[::3] = vectors[0]
    if case == "zero":
        vectors[::50] = 0
    rows = table(spark, vectors)
    queries = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    for k in (1, 7):
        found, _ = cells.cell_topk(queries, cells.cell_index(rows, written, cells=10, block_rows=40), written, k, probes=2)
        close(held(found), slow(queries, rows, k))


def test_few_blocks_are_read_where_vectors_are_clustered(spark):
    rows = table(spark, clustered(6_000, 60, 0.15))
    queries = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    index = cells.cell_index(rows, written, cells=120, block_rows=64)
    found, read = cells.cell_topk(queries, index, written, 5, probes=2)
    close(held(found), held(dense.semantic_topk(queries, rows, 5, key_type="long")))
    assert read.count() == read.distinct().count()
    done = read.join(index[1], "block").agg(F.sum("size")).first()[0]
    assert done < 0.1 * rows.count() * queries.count()
    assert index[1].agg(F.max("size")).first()[0] <= 64 and index[0].count() == 6_000


def test_more_queries_than_a_block_of_them(spark, monkeypatch):
    """Queries in parts, and blocks that several parts ask for."""
    monkeypatch.setattr(cells, "QUERY_BLOCK", 16)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 16)
    rows = table(spark, clustered(400, 5, 0.3))
    queries = rows.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    found, _ = cells.cell_topk(queries, cells.cell_index(rows, written, block_rows=50), written, 3, probes=1)
    close(held(found), slow(queries, rows, 3))


def test_few_rows_and_none(spark):
    """More wanted than there are rows; no rows; no queries."""
    rows = table(spark, clustered(9, 2, 0.3))
    queries = rows.where("id < 3").withColumnRenamed("id", "query_id")
    for own, asked in ((rows, queries), (rows.limit(0), queries), (rows, queries.limit(0))):
        found, _ = cells.cell_topk(asked, cells.cell_index(own, written), written, 20)
        close(held(found), slow(asked, own, 20))
    with pytest.raises(ValueError):
        cells.cell_topk(queries, cells.cell_index(rows, written), written, 0)
