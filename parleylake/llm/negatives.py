"""Hard negatives by exact integer products in a residue number system.

Components become whole numbers. A block of anchors meets a chunk of rows in one task: both matrices are
taken modulo several small primes, multiplied in float32 (sums of centred residues stay below 2**24, so
they are exact), and the signed scores are put together again by Chinese remaindering. Two passes over the
blocks: the first keeps each anchor's best rows of its own label, the second the best rows of other labels
in the window that each positive's score opens. A task gives a bounded number of rows an anchor; windows
over these give the result. Every row meets every anchor; no pair is written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parleylake.llm._shared import materialize, table

SCALE, POSITIVES, NEGATIVES, EVERY = 256, 5, 3, 50
#: Anchors and rows that one task multiplies: a row moves once for each block of anchors.
BLOCK, CHUNK = 4_096, 16_384
#: Anchors and rows that it multiplies at once.
SLICE, STEP = 512, 4_096
#: Primes lie below this; so many components are summed before the next reduction.
PRIMES_BELOW, SLAB = 256, 1_024
LOWEST = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """The largest primes below ``PRIMES_BELOW`` whose product holds every whole number of at most ``bound`` on either side of 0."""
    found, product = [], 1
    for p in range(PRIMES_BELOW - 1, 1, -1):
        if product > 2 * bound:
            break
        if all(p % d for d in range(2, math.isqrt(p) + 1)):
            found, product = [*found, p], product * p
    return found


def _centred(values: np.ndarray, p: int) -> np.ndarray:
    """Residues between -p / 2 and p / 2."""
    rest = np.mod(values, p)
    return np.where(rest > p // 2, rest - p, rest)


def residues(rows: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [_centred(rows, p).astype(np.float32) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact products of the rows of two matrices, given by their residues: one float32 product a prime and slab, then mixed-radix digits.

    Digits are centred, so the number they spell is signed; 64-bit sums may pass their limits on the way and end right.
    """
    digits, weight, total = [], 1, None
    for p, a, b in zip(primes, left, right, strict=True):
        own = np.zeros((len(a), len(b)), np.int64)
        for lo in range(0, max(a.shape[1], 1), SLAB):
            own += (a[:, lo : lo + SLAB] @ b[:, lo : lo + SLAB].T).astype(np.int64)
        radix = 1
        for q, digit in zip(primes, digits):
            own -= digit * (radix % p)
            radix *= q
        digits.append(_centred(np.mod(own, p) * pow(radix % p, -1, p), p) if digits else _centred(own, p))
        with np.errstate(over="ignore"):
            part = digits[-1] * np.int64((weight + 2**63) % 2**64 - 2**63)
            total = part if total is None else total + part
        weight *= p
    return total


def first_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` greatest scores above ``LOWEST``; of equal ones the leftmost."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k, None]
        above, equal = scores > least, scores == least
        kept = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))
    else:
        kept = np.ones(scores.shape, bool)
    return np.nonzero(kept & (scores > LOWEST))


def _matrix(held: pa.Table, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are followed by zeros."""
    lists = held.column("vector").combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    out = np.zeros((len(lists), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> list[np.ndarray]:
    """Of (place, score, position) rows each place's ``k`` first: by score from the greatest, then by position."""
    place, score, position = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((position, -score, place))
    place, score, position = place[order], score[order], position[order]
    rank = np.arange(len(place)) - np.searchsorted(place, place)
    return [c[rank < k] for c in (place, score, position)]


def _meet(rows: DataFrame, anchors: DataFrame, work, schema: str, dim: int, primes: list[int]) -> DataFrame:
    """``work`` (rows, anchors, a function of a row range giving their scores) over each block of anchors with each chunk of rows."""
    blocks, chunks = (max(1, -(-n // size)) for n, size in ((anchors.count(), BLOCK), (rows.count(), CHUNK)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = rows.select("*", dealt(chunks).alias("chunk"), spread(blocks).alias("block"))
    theirs = anchors.select("*", dealt(blocks).alias("block"), spread(chunks).alias("chunk"))
    empty = {f.split(" ")[0]: pa.array([], {"long": pa.int64(), "int": pa.int32()}[f.split(" ")[1]]) for f in schema.split(", ")}

    def one(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return pa.table(empty)
        own = own.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last, so of equal scores the leftmost goes first
        right, found = residues(_matrix(own, dim), primes), []
        for lo in range(0, asked.num_rows, SLICE):
            some = asked.slice(lo, SLICE)
            left = residues(_matrix(some, dim), primes)
            columns = work(own, some, lambda at, left=left: products(left, [r[at : at + STEP] for r in right], primes))
            found.append(pa.table([pa.array(c, t.type) if isinstance(c, np.ndarray) else c for c, t in zip(columns, empty.values(), strict=True)], names=list(empty)))
        return pa.concat_tables(found)

    return ours.groupBy("block", "chunk").cogroup(theirs.groupBy("block", "chunk")).applyInArrow(one, schema)


def _positives(k: int):
    def work(own, asked, scores):
        label, row = own.column("label").to_numpy(), own.column("row").to_numpy()
        wanted, self_ = asked.column("label").to_numpy(), asked.column("row").to_numpy()
        found = []
        for lo in range(0, len(row), STEP):
            s = scores(lo)
            s[(label[None, lo : lo + STEP] != wanted[:, None]) | (row[None, lo : lo + STEP] == self_[:, None])] = LOWEST
            at, to = first_of(s, k)
            found.append((at, s[at, to], to + lo))
        at, s, to = _best(found, k)
        return self_[at], own.column("row").take(pa.array(to)), own.column("vec_id").take(pa.array(to)), s

    return work


def _negatives(k: int):
    def work(own, asked, scores):
        label, wanted, anchor = own.column("label").to_numpy(), asked.column("label").to_numpy(), asked.column("row").to_numpy()
        windows = asked.column("positives").to_pylist()
        most, found = max(map(len, windows)), []
        score = np.array([[*w, *[LOWEST] * (most - len(w))] for w in windows], np.int64).reshape(len(windows), most)
        low, high = -(-score // 2), score + (-score // 20)  # from half a positive's score to 95 % of it
        high = np.where(score == LOWEST, LOWEST, high)
        for lo in range(0, len(label), STEP):
            s = scores(lo)
            s[label[None, lo : lo + STEP] == wanted[:, None]] = LOWEST
            for w in range(most):
                some = np.flatnonzero((low[:, w] <= high[:, w]) & (high[:, w] > LOWEST))
                inside = np.where((s[some] >= low[some, w, None]) & (s[some] <= high[some, w, None]), s[some], LOWEST)
                at, to = first_of(inside, k)
                found.append((some[at] * most + w, inside[at, to], to + lo))
        place, s, to = _best(found, k)
        return anchor[place // max(most, 1)], place % max(most, 1), own.column("row").take(pa.array(to)), own.column("vec_id").take(pa.array(to)), s

    return work


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(``row``, ``vec_id``, ``label``, ``vector``) of the rows that take part, their components whole numbers.

    Rows with a null label, a null vector, or null or non-finite components take no part, nor do those with components so large that products might pass a long.
    """
    x = F.transform(vector_col, lambda x: F.when(F.abs(x.cast("double")) < float("inf"), x.cast("double") * SCALE))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    limit = F.sqrt(F.lit(2.0**62) / F.greatest(F.size("vector"), F.lit(1)))
    return rows.where(F.forall("vector", lambda x: F.abs(x) <= limit)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("vector", lambda x: F.floor(x)).alias("vector"))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` of ``rows`` for ``anchors``, which are some of them.

    An anchor's positives are its ``positives`` best other rows of the same label, their negatives the
    ``negatives`` best rows of other labels whose score is from 50 to 95 percent of the positive's. Equal
    scores go by id, null ids last; repeated rows are rows of their own, also as anchors; vectors of unlike
    lengths count as followed by zeros; anchors without positives or positives without negatives give no row.
    """
    facts = rows.agg(F.max(F.size("vector")).alias("dim"), F.max(F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("most")).first()
    dim, primes = facts["dim"] or 1, primes_for((facts["dim"] or 1) * (facts["most"] or 1) ** 2)
    near = _meet(rows, anchors, _positives(positives), "anchor long, positive long, positive_id long, positive_score long", dim, primes)
    order = lambda by, score, id_, row: Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_).asc_nulls_last(), F.col(row))
    ranked = near.withColumn("at", F.row_number().over(order(["anchor"], "positive_score", "positive_id", "positive")) - 1).where(F.col("at") < positives)
    ranked = materialize(ranked.select("anchor", F.col("at").cast("int").alias("at"), "positive_id", "positive_score"))
    listed = ranked.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))  # at most ``positives``
    asked = anchors.join(listed, anchors["row"] == listed["anchor"]).drop("anchor")
    far = _meet(rows, materialize(asked), _negatives(negatives), "anchor long, at int, negative long, negative_id long, negative_score long", dim, primes)
    far = far.withColumn("rank", F.row_number().over(order(["anchor", "at"], "negative_score", "negative_id", "negative"))).where(F.col("rank") <= negatives)
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return far.join(ranked, ["anchor", "at"]).join(named, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings against every fiftieth by id; every seventh has another label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = materialize(prepared(table(spark, sf_dir, "embeddings").withColumn("label", moved)))
    return mine(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS MATERIALIZED (SELECT a.row AS a, a.vec_id AS anchor_id, b.row AS b, b.vec_id, a.label = b.label AS own, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.row <> b.row WHERE a.vec_id % 50 = 0),
  p AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id) AS r FROM s WHERE own) WHERE r <= 5),
  n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.s AS positive_score, s.s AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT s.own AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT * FROM n WHERE rank <= 3
"""
