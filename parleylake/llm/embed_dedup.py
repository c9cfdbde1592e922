"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

Equal vectors are first merged, with their count. Cells come from spherical k-means on a bounded
sample; every vector is placed in its ``PROBES`` nearest cells. Cells that still hold too many vectors
are cut again by k-means on a bounded sample of their own, so the number of cells follows the data.
Centres that lie closer than ``CLOSE`` become one: a clump whose vectors all link stays in one cell,
however large. A cell is cut into blocks, and each pair of blocks is one group of at most two blocks'
rows: one double-precision matrix product. A pair that shares several cells counts in the first of
them only. Groups emit a count per vector and a spanning forest of their links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.llm._shared import materialize, table
from parleylake.llm.components import components

THRESHOLD = 0.9
#: Documented bounds: vectors that one k-means is fitted on, and its cells.
SAMPLE, MAX_CELLS = 16_384, 2_048
PER_CELL, PROBES, BLOCK, ROUNDS, SEED = 400, 3, 2_048, 12, 11
#: Cells of more than so many times ``PER_CELL`` rows are cut again, this often at most: beyond 2,048 to the power of 4 cells they would grow.
SPLIT, LEVELS = 16, 3
#: Centres with at least this cosine share a cell.
CLOSE = (1 + THRESHOLD) / 2
#: Rows of a cell that one task places in the cell's new cells.
DEALT = 16_384


def usable(vector: str) -> F.Column:
    """Neither null nor zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: list | np.ndarray, dim: int) -> np.ndarray:
    """Rows of length 1 in double precision; shorter vectors count as followed by zeros."""
    rows = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        rows[i, : len(v)] = v
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """At most ``k`` unit centres of unit ``rows``; a cell that loses all rows gets the row that fits its own worst. Of centres closer than ``close`` the one with most rows stays."""
    rng = np.random.default_rng(SEED)
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        fit = rows @ centres.T
        own, best = fit.argmax(axis=1), fit.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        for c in np.flatnonzero(np.bincount(own, minlength=k) == 0):
            worst = int(best.argmin())
            sums[c], best[worst] = rows[worst], 2
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    near, kept = centres @ centres.T >= close, np.zeros(k, bool)
    for c in np.argsort(-np.bincount((rows @ centres.T).argmax(axis=1), minlength=k), kind="stable"):
        kept[c] = not (near[c] & kept).any()
    return centres[kept]


def _nearest(rows: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the ``probes`` nearest centres of each row, sorted."""
    fit = rows @ centres.T
    near = np.argpartition(-fit, min(probes, fit.shape[1]) - 1, axis=1)[:, :probes]
    near.sort(axis=1)
    return near


def _placed(batches, centres: np.ndarray, dim: int, probes: int):
    for batch in batches:
        if batch.num_rows:
            near = _nearest(_unit(batch.column("vector").to_pylist(), dim), centres, probes)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("vector"), pa.array(list(near), pa.list_(pa.int64()))], ["node", "n", "vector", "cells"])


def _cut_again(placed: DataFrame, dim: int, probes: int, per_cell: int, max_cells: int, sample: int) -> DataFrame | None:
    """``placed`` with the cells of more than ``SPLIT * per_cell`` rows replaced by smaller ones; None if no cell can be cut.

    Cells are fitted on about ``sample`` of their rows, picked by hash. Their rows are placed by groups of
    some ``DEALT`` rows, each beside the cell's new centres, so no task holds a cell.
    """
    limit = SPLIT * per_cell
    sizes = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > limit)
    sizes = materialize(sizes.withColumn("salts", F.ceil(F.col("size") / DEALT).cast("int")))
    rows = placed.select("node", "vector", F.explode("cells").alias("cell"))
    draw = F.pmod(F.xxhash64("vector", "cell"), F.lit(1 << 30)) < F.lit(float((1 << 30) * sample)) / F.col("size")
    picked = rows.join(sizes, "cell").where(draw).select("cell", "size", "vector")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        k = int(min(max_cells, -(-int(group["size"].iloc[0]) // per_cell), len(group)))
        centres = spherical_kmeans(_unit(group["vector"].tolist(), dim), k)
        return pd.DataFrame({"cell": [group["cell"].iloc[0]], "centres": [centres.ravel()], "k": [len(centres)]})

    fitted = materialize(picked.groupBy("cell").applyInPandas(fit, "cell long, centres array<double>, k long").where("k > 1"))
    if fitted.isEmpty():
        return None
    numbered = fitted.select("cell", "k").join(sizes.select("cell", "salts"), "cell")
    parted = rows.join(numbered, "cell").select("cell", "node", "vector", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"))
    beside = fitted.join(numbered.drop("k"), "cell").select("cell", "centres", "k", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def place(own: pd.DataFrame, with_centres: pd.DataFrame) -> pd.DataFrame:
        if own.empty or with_centres.empty:
            return pd.DataFrame({"node": [], "cell": [], "at": []})
        centres = np.asarray(with_centres["centres"].iloc[0], float).reshape(-1, dim)
        near = _nearest(_unit(own["vector"].tolist(), dim), centres, probes)
        return pd.DataFrame({"node": np.repeat(own["node"].to_numpy(), near.shape[1]), "cell": own["cell"].iloc[0], "at": near.ravel()})

    smaller = parted.groupBy("cell", "salt").cogroup(beside.groupBy("cell", "salt")).applyInPandas(place, "node long, cell long, at long")
    cut = smaller.groupBy("node").agg(F.collect_set("cell").alias("old"), F.collect_set(F.xxhash64("cell", "at")).alias("new"))
    found = placed.join(cut, "node", "left")
    cells = F.when(F.col("old").isNull(), F.col("cells")).otherwise(F.array_sort(F.array_union(F.array_except("cells", "old"), "new")))
    return materialize(found.select("node", "n", "vector", cells.alias("cells")))


def _labels(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest reachable label of rows (0..) and columns (rows.. on) of a bipartite link matrix."""
    n, m = mask.shape
    left, right, far = np.arange(n), np.arange(n, n + m), n + m
    while True:
        new_right = np.minimum(right, np.where(mask, left[:, None], far).min(axis=0, initial=far))
        new_left = np.minimum(left, np.where(mask, new_right[None, :], far).min(axis=1, initial=far))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _earlier(cells: pd.Series, cell: int) -> np.ndarray:
    """A row's cells before ``cell``, filled up with ``cell`` itself."""
    own = [[c for c in row if c < cell] for row in cells]
    out = np.full((len(own), max(map(len, own), default=0)), cell, np.int64)
    for i, row in enumerate(own):
        out[i, : len(row)] = row
    return out


def _compare(group: pd.DataFrame, dim: int, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks: (``node``, ``to``, ``links``); ``to`` is a node of the same component here, or null."""
    cell, one, two = (int(group[c].iloc[0]) for c in ("cell", "one", "two"))
    a, b = group[group["block"] == one], group[group["block"] == two]
    if not len(a) or not len(b):
        return pd.DataFrame({"node": [], "to": [], "links": []})
    linked = _unit(a["vector"].tolist(), dim) @ _unit(b["vector"].tolist(), dim).T >= threshold
    if one == two:  # a row is joined with itself, so that both sides of the matrix get one label, but isn't counted
        np.fill_diagonal(linked, True)
    left, right = _labels(linked)
    if one == two:
        np.fill_diagonal(linked, False)
    at, to = np.nonzero(linked)
    cells_a, cells_b = _earlier(a["cells"], cell), _earlier(b["cells"], cell)
    counted = np.ones(len(at), bool)
    for lo in range(0, len(at), 1 << 18):  # a pair that also shares an earlier cell counts there
        x, y = cells_a[at[lo : lo + (1 << 18)]], cells_b[to[lo : lo + (1 << 18)]]
        counted[lo : lo + (1 << 18)] = ~((x[:, :, None] == y[:, None, :]) & (x[:, :, None] != cell)).any(axis=(1, 2))
    nodes_a, nodes_b = a["node"].to_numpy(), b["node"].to_numpy()
    links_a = np.bincount(at[counted], weights=b["n"].to_numpy()[to[counted]], minlength=len(a))
    both = np.concatenate([nodes_a, nodes_b])
    out = [pd.DataFrame({"node": nodes_a, "to": both[left], "links": links_a})]
    if one != two:
        links_b = np.bincount(to[counted], weights=a["n"].to_numpy()[at[counted]], minlength=len(b))
        out.append(pd.DataFrame({"node": nodes_b, "to": both[right], "links": links_b}))
    found = pd.concat(out).astype({"links": "int64"})
    return found[(found["links"] > 0) | (found["node"] != found["to"])]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES, per_cell: int = PER_CELL, block: int = BLOCK, max_cells: int = MAX_CELLS, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Null, zero and non-finite vectors link with nothing; shorter vectors count as followed by zeros;
    repeated rows are vectors of their own that link with each other; a component without any id has a
    null id and keeps its rows; further columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), usable(vector_col).alias("ok"))
    distinct = rows.where("ok").groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not size["n"]:
        return alone
    dim, k = size["dim"], int(min(max_cells, -(-size["n"] // per_cell)))
    drawn = distinct.orderBy(F.xxhash64("vector"), "node").limit(max(sample, k)).select("vector").toPandas()["vector"].tolist()
    k = min(k, len(drawn))
    held = spark.sparkContext.broadcast(spherical_kmeans(_unit(drawn, dim), k))  # at most MAX_CELLS vectors
    kind = distinct.schema["vector"].dataType.simpleString()
    placed = distinct.select("node", "n", "vector").mapInArrow(lambda b: _placed(b, held.value, dim, probes), f"node long, n long, vector {kind}, cells array<long>")
    placed = materialize(placed)
    for _ in range(LEVELS):
        if size["n"] <= max_cells * per_cell or (smaller := _cut_again(placed, dim, probes, per_cell, max_cells, sample)) is None:
            break
        placed = smaller

    sizes = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = placed.select("*", F.explode("cells").alias("cell")).join(sizes, "cell")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    compared = dealt.select("cell", "one", "two", "block", "node", "n", "vector", "cells").groupBy("cell", "one", "two")
    compared = materialize(compared.applyInPandas(lambda g: _compare(g, dim, threshold), "node long, to long, links long"))

    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(compared.select(F.col("node").alias("a"), F.col("to").alias("b")))
    rooted = distinct.select("node", "vector", "n", "first_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(links, "node", "left").join(first, "component")
    known = known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    found = rows.where("ok").join(known, "vector").select("vec_id", "n_links", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())).unionByName(alone)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, cosine of at least 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
                     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
  r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.m, vec_id) AS component_id, coalesce(c.m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
