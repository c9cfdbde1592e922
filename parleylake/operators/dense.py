"""Vectors: a native stand-in encoder, checks, and exact top-k by blocks of matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parleylake.functions.terms import pieces
from parleylake.functions.terms import words as word_counts
from parleylake.functions.text import without_marks
from parleylake.operators.lexical import best, check_k, top_k

DIMS = 64
#: Queries whose vectors one broadcast matrix holds; more are taken in blocks of so many, each with chunks of rows.
QUERY_BLOCK, ROW_CHUNK = 4096, 65_536


def hashed_vector(text: Column, dims: int = DIMS) -> Column:
    """Signed hashing of words and word pairs into ``dims`` sums, of length 1 (zero without words). It carries no meaning: a stand-in for a caller's encoder.

    The text is taken once, and terms are made and hashed once a piece of some megabytes, however many texts of it have them.
    """

    def vectors(lowered: pa.Array) -> pa.Array:
        return _signed_vectors(lowered, dims)

    return F.arrow_udf(vectors, "array<double>")(F.lower(F.coalesce(text, F.lit(""))))


def _signed_vectors(lowered: pa.Array, dims: int) -> pa.Array:
    """Of each term's hash, the remainder says which sum and the rest the sign; lower-case texts."""
    batch = pa.RecordBatch.from_arrays([pa.array(without_marks(lowered.to_pylist()), pa.string())], ["folded"])
    parts = [_sums(piece.column("folded"), dims) for piece in pieces(iter([batch] if batch.num_rows else []))]
    sums = np.concatenate([*parts, np.zeros((0, dims))])
    norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    units = np.divide(sums, norms, out=sums, where=norms > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * dims), pa.array(units.ravel()))


def _sums(folded: pa.Array, dims: int) -> np.ndarray:
    terms, row, t, n = word_counts(folded)
    hashes = np.fromiter((int.from_bytes(hashlib.md5(x.encode(), usedforsecurity=False).digest()[:3]) for x in terms.to_pylist()), np.int64, len(terms))[t]
    sums = np.bincount(row * dims + hashes % dims, weights=n * (1.0 - 2.0 * (hashes // dims % 2)), minlength=len(folded) * dims)
    return sums.reshape(len(folded), dims)


def length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vector: Column) -> Column:
    """Of length 1; zero vectors stay."""
    n = length(vector)
    scaled = F.zip_with(vector, F.array_repeat(n, F.size(vector)), lambda x, y: F.when(y > 0, x.cast("double") / y).otherwise(x.cast("double")))
    return F.when(vector.isNotNull(), scaled)


def embed(rows: DataFrame, encode=hashed_vector, text: str = "text") -> DataFrame:
    """``rows`` with ``vector``; ``encode`` maps a text column to a vector column (a caller's model is a Pandas UDF that loads it once a worker)."""
    return rows.withColumn("vector", encode(F.col(text)))


def vector_problems(vector: Column, dims: int) -> Column:
    """Why a vector can't be normalised: null, ragged, not finite, zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.array_compact(F.array(F.when(vector.isNull(), F.lit("null")), F.when(F.size(vector) != dims, F.lit("ragged")), F.when(~F.coalesce(finite, F.lit(True)), F.lit("not finite")), F.when(length(vector) <= 0, F.lit("zero"))))


def normalize_vectors(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """``rows`` with ``problems``, and ``unit``: the vector of length 1 where there are none."""
    rows = rows.withColumn("problems", vector_problems(F.col(vector), dims))
    return rows.withColumn("unit", F.when(F.size("problems") == 0, unit(F.col(vector))))


def check_vectors(rows: DataFrame, vector: str, dims: int, texts: int) -> DataFrame:
    """One row: vectors, whether all are finite and of the right size, whether all have length 1, whether there are as many as texts."""
    problems = vector_problems(F.col(vector), dims)
    return rows.agg(
        F.count("*").alias("vectors"), F.bool_and(F.size(problems) == 0).alias("sound"), F.bool_and(F.abs(length(F.col(vector)) - 1) <= 1e-5).alias("unit_length"), (F.count("*") == texts).alias("complete")
    )


def dense_scores(queries: DataFrame, rows: DataFrame, key: str, key_type: str, name: str, low: float, high: float, keep: int | None = None) -> DataFrame:
    """(``query_id``, ``key``, ``name``): products of query and row vectors, clipped; with ``keep``, each Arrow batch gives its best ``keep`` a query only.

    The stated queries (``query_id`` long, ``vector``) are broadcast up to ``QUERY_BLOCK``, and rows never move; more
    queries meet the rows in blocks, each task with one block and one chunk of rows.
    """
    return _by_blocks(queries, rows, key, key_type, {name: "vector"}, low, high, keep)


def dense_channels(queries: DataFrame, rows: DataFrame, key: str, key_type: str, channels: dict[str, str], low: float, high: float) -> DataFrame:
    """(``query_id``, ``key``, a score a channel): products of each query with several vectors of a row at once.

    ``channels`` gives the column of ``rows`` that a score is taken from, so the channels of a pair never have to be joined.
    """
    return _by_blocks(queries, rows, key, key_type, channels, low, high, None)


def _by_blocks(queries: DataFrame, rows: DataFrame, key: str, key_type: str, channels: dict[str, str], low: float, high: float, keep: int | None) -> DataFrame:
    schema = f"query_id long, {key} {key_type}, " + ", ".join(f"{name} double" for name in channels)
    return in_blocks(queries.select("query_id", "vector"), rows.select(key, *channels.values()), key, lambda b, asked: products(b, matrix_of(asked), key, channels, low, high, keep), schema)


def dealt(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def in_blocks(queries: DataFrame, rows: DataFrame, key: str, work, schema: str) -> DataFrame:
    """``work`` (Arrow batches of ``rows``, a table of queries) over all rows and queries.

    Up to ``QUERY_BLOCK`` queries are broadcast and rows stay where they are; beyond, blocks of queries meet chunks of rows in tasks of bounded size.
    """
    held = queries.limit(QUERY_BLOCK + 1).toArrow()  # the bound is checked: one more says that there are too many
    if held.num_rows <= QUERY_BLOCK:
        block = rows.sparkSession.sparkContext.broadcast(held)
        return rows.mapInArrow(lambda b: work(b, block.value) if block.value.num_rows else iter(()), schema)
    blocks, chunks = (-(-n // size) for n, size in ((queries.count(), QUERY_BLOCK), (rows.count(), ROW_CHUNK)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    ours = queries.select("*", dealt("query_id", blocks).alias("_block"), spread(chunks).alias("_chunk"))
    theirs = rows.select("*", dealt(key, max(chunks, 1)).alias("_chunk"), spread(blocks).alias("_block"))
    empty = to_arrow_schema(StructType.fromDDL(schema))

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = list(work(own.combine_chunks().to_batches(), asked)) if asked.num_rows else []
        return pa.Table.from_batches(found) if found else empty.empty_table()

    return theirs.groupBy("_block", "_chunk").cogroup(ours.groupBy("_block", "_chunk")).applyInArrow(meet, schema)


def vectors_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors, all of one size and none null, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if n and (column.null_count or np.ptp(column.value_lengths().to_numpy())):
        raise ValueError("vectors that are null or of different sizes; normalize_vectors tells which")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1 if n else 0)


def matrix_of(asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of queries."""
    return asked.column("query_id").to_numpy(), vectors_of(asked.column("vector"))


def products(batches: Iterator[pa.RecordBatch], block, key: str, channels: dict[str, str], low: float, high: float, keep: int | None) -> Iterator[pa.RecordBatch]:
    """``keep`` is for one channel, as each channel has its own best rows."""
    ids, matrix = block
    for batch in batches:
        if not batch.num_rows or not len(ids):
            continue
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            scores = [np.clip(vectors_of(part.column(vector)) @ matrix.T, low, high) for vector in channels.values()]
            at, of = best(scores[0], keep)
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), part.column(key).take(pa.array(at)), *(pa.array(s[at, of]) for s in scores)], ["query_id", key, *channels])


def semantic_topk(queries: DataFrame, rows: DataFrame, k: int = 5, key: str = "id", key_type: str = "string") -> DataFrame:
    """The ``k`` nearest rows a query by cosine in [-1, 1]; scores below zero stay."""
    return top_k(dense_scores(queries, rows, key, key_type, "semantic", -1.0, 1.0, check_k(k)), "semantic", key, k)
