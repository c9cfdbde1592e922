"""Exact nearest rows by cells: bounds on angles tell which blocks of rows can't hold one of a query's best.

A row belongs to the nearest of some centres and there, in the order of its angle to the centre, to a block of
a fixed size, so a cell that holds any share of the rows is many blocks. Angles keep the triangle inequality:
a query at angle a from the centre is no nearer than |a - b| to a row at angle b. The nearest blocks give a
query its k-th score so far, and only blocks that can reach it are read besides. Centres decide the cost and
never the result; where vectors have no clusters, all blocks are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parleylake.operators.dense import QUERY_BLOCK, dealt, in_blocks, matrix_of, vectors_of
from parleylake.operators.lexical import best, check_k, top_k
from parleylake.operators.pool import firsts
from parleylake.operators.ranges import numbered

#: Vectors that centres are fitted on, the most centres, rounds of fitting, and rows of a block.
SAMPLE, MAX_CELLS, ROUNDS, BLOCK_ROWS = 16_384, 2_048, 8, 4_096
#: Blocks that a query reads first.
PROBES = 8
#: What rounded scores and angles may be off by.
SCORE_SLACK, ANGLE_SLACK = 2e-9, 1e-6
SEED = 7


def fit_centres(rows: DataFrame, cells: int | None = None) -> np.ndarray:
    """Unit centres by spherical k-means over a sample of at most twice ``SAMPLE`` vectors; as many as the root of the rows, ``MAX_CELLS`` at most."""
    n = rows.count()
    cells = cells or max(1, min(MAX_CELLS, math.isqrt(n)))
    drawn = rows.select("vector") if n <= SAMPLE else rows.select("vector").sample(False, SAMPLE / n, SEED)
    x = vectors_of(drawn.limit(2 * SAMPLE).toArrow().column("vector"))
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[np.random.default_rng(SEED).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    return centres


def angles(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A zero vector is a right angle from all others, which keeps the triangle inequality."""
    return np.arccos(np.clip(vectors @ others.T, -1.0, 1.0))


def cell_index(rows: DataFrame, write: Callable[[DataFrame], DataFrame], key: str = "id", cells: int | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows (``key``, vector, block) and blocks (block, centre, lo, hi, size): the index, both written.

    ``rows`` has ``key`` and ``vector``, of length 1 or zero, as ``normalize_vectors`` gives them; ``write`` writes a
    table and reads it again. ``lo`` and ``hi`` bound the angles of a block's rows to its centre.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    rows = rows.select(key, F.col("vector").cast("array<double>").alias("vector"))
    centres = fit_centres(rows, cells)
    held = spark.sparkContext.broadcast(centres)  # at most MAX_CELLS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                found = angles(vectors_of(part.column("vector")), held.value)
                cell = found.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("vector"), pa.array(cell.astype(np.int32)), pa.array(found[np.arange(len(cell)), cell])], [key, "vector", "_cell", "_angle"])

    placed = write(rows.mapInArrow(assign, f"{key} {kind}, vector array<double>, _cell int, _angle double"))
    block = F.shiftleft(F.col("_cell").cast("long"), 40) + F.floor((F.col("_n") - 1) / block_rows).cast("long")
    own = write(numbered(placed, ["_angle", key], "_n", within=["_cell"]).withColumn("block", block).drop("_n"))
    table = pa.table({"_cell": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float64()))})
    sizes = own.groupBy("block", "_cell").agg(F.min("_angle").alias("lo"), F.max("_angle").alias("hi"), F.count("*").alias("size"))
    blocks = write(sizes.join(F.broadcast(spark.createDataFrame(table)), "_cell").select("block", "centre", "lo", "hi", "size"))
    return own.select(key, "vector", "block"), blocks


def _distances(batches: Iterator[pa.RecordBatch], matrix: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of blocks with the angles from their centres to the queries, and the least angle that a row of a block can have."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            a = angles(vectors_of(part.column("centre")), matrix)
            lo, hi = (part.column(c).to_numpy()[:, None] for c in ("lo", "hi"))
            yield part, a, np.maximum(np.maximum(a - hi, lo - a), 0.0)


def first_blocks(queries: DataFrame, blocks: DataFrame, probes: int = PROBES) -> DataFrame:
    """(``query_id``, ``block``): the blocks that a query reads first, by the angle to the centre and the least angle to a row."""

    def nearest(batches: Iterator[pa.RecordBatch], asked: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, matrix = matrix_of(asked)
        for part, a, least in _distances(batches, matrix):
            near = -(a + least)
            at, of = best(near, probes)
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), part.column("block").take(pa.array(at)), pa.array(near[at, of])], ["query_id", "block", "near"])

    found = in_blocks(queries.select("query_id", "vector"), blocks, "block", nearest, "query_id long, block long, near double")
    return top_k(found, "near", "block", probes).select("query_id", "block")


def open_blocks(queries: DataFrame, blocks: DataFrame, reached: DataFrame) -> DataFrame:
    """(``query_id``, ``block``): all blocks that can hold a row as good as a query's ``kth`` score in ``reached``; all blocks for a query without one."""

    def within(batches: Iterator[pa.RecordBatch], asked: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, matrix = matrix_of(asked)
        kth = asked.column("kth").to_numpy()
        furthest = np.arccos(np.clip(kth - SCORE_SLACK, -1.0, 1.0)) + ANGLE_SLACK
        for part, _, least in _distances(batches, matrix):
            at, of = np.nonzero(least <= furthest[None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), part.column("block").take(pa.array(at))], ["query_id", "block"])

    asked = queries.select("query_id", "vector").join(reached, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-1.0)))
    return in_blocks(asked, blocks, "block", within, "query_id long, block long")


def block_scores(queries: DataFrame, pairs: DataFrame, rows: DataFrame, k: int, key: str, n_queries: int) -> DataFrame:
    """(``query_id``, ``key``, ``semantic``) of the ``k`` best rows of each pair of a query and a block.

    A task holds one block and at most some ``QUERY_BLOCK`` of its queries. Rows of blocks that no query asks for don't move.
    """
    parts = max(-(-n_queries // QUERY_BLOCK), 1)
    pairs = pairs.withColumn("_part", dealt("query_id", parts))
    theirs = rows.join(pairs.select("block", F.col("_part").alias("_of")).distinct(), "block").select(key, "vector", F.col("block").alias("_in"), "_of")
    ours = pairs.join(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")), "query_id")
    schema = f"query_id long, {key} {rows.schema[key].dataType.simpleString()}, semantic double"
    empty = to_arrow_schema(StructType.fromDDL(schema))

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return empty.empty_table()
        ids, matrix = matrix_of(asked)
        own = own.take(pc.sort_indices(own.column(key)))  # so that of equal scores the first row goes first
        scores = np.clip(vectors_of(own.column("vector")) @ matrix.T, -1.0, 1.0)
        at, of = np.nonzero(firsts(scores, k))
        return pa.table([pa.array(ids[of]), own.column(key).take(pa.array(at)), pa.array(scores[at, of])], ["query_id", key, "semantic"])

    return theirs.groupBy("_in", "_of").cogroup(ours.groupBy("block", "_part")).applyInArrow(meet, schema)


def cell_topk(queries: DataFrame, index: tuple[DataFrame, DataFrame], write: Callable[[DataFrame], DataFrame], k: int = 5, key: str = "id", probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """The rows of ``semantic_topk`` from a ``cell_index``, and the (``query_id``, ``block``) that were read for them.

    ``queries`` has ``query_id`` (long, each once) and ``vector``, of length 1 or zero. Equal scores (to nine digits) go by
    ``key``. A query whose first blocks hold fewer than ``k`` rows reads all blocks.
    """
    rows, blocks = index
    n = queries.count()
    first = write(first_blocks(queries, blocks, probes))
    found = write(top_k(block_scores(queries, first, rows, check_k(k), key, n), "semantic", key, k))
    reached = found.where(F.col("rank") == k).select("query_id", F.col("semantic").alias("kth"))
    more = write(open_blocks(queries, blocks, reached).join(first, ["query_id", "block"], "left_anti"))
    scores = found.drop("rank").unionByName(block_scores(queries, more, rows, k, key, n))
    return top_k(scores, "semantic", key, k), first.unionByName(more)
