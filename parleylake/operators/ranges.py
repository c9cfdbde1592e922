"""Ranges of a table by fixed bounds, and numbering over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a range should hold, the most ranges there are, and the sampled keys behind each bound.
RANGE_ROWS, MAX_RANGES, PER_BOUND = 1_000_000, 4_096, 32
#: Tables of no more rows are one range, larger ones have at least one for each of as many rows, up to one a core.
FEW_ROWS = 10_000
#: Bounds that are looked through one by one, after the coarse step.
STRIDE = 64
SEED = 7


def _key(order: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])


def range_bounds(table: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """One row ``bounds``: the sorted keys at which the next range begins, from a sample of bounded size.

    The row is data, not a plan: whatever is recomputed later, and however Spark coalesces partitions, a key
    stays in its range. Nulls come first, as in Spark's own ascending order.
    """
    keys = table.select(_key(order).alias("key"))
    if ranges is None and keys.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        ranges = 1
    if ranges == 1:
        return keys.limit(0).agg(F.collect_list("key").alias("bounds"))
    n = keys.count()
    if ranges is None:
        ranges = max(-(-n // RANGE_ROWS), min(table.sparkSession.sparkContext.defaultParallelism, -(-n // FEW_ROWS)))
    ranges = max(1, min(ranges, MAX_RANGES))
    fraction = min(1.0, ranges * PER_BOUND / max(n, 1))
    drawn = (keys if fraction == 1.0 else keys.sample(False, fraction, SEED)).agg(F.array_sort(F.collect_list("key")).alias("drawn"))
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("drawn", (i * F.size("drawn") / ranges).cast("int"))) if ranges > 1 else F.slice("drawn", 1, 0)
    held = drawn.select(F.array_distinct(F.array_compact(at)).alias("bounds")).toArrow()  # at most MAX_RANGES keys
    return table.sparkSession.createDataFrame(held)


def in_ranges(table: DataFrame, order: list[str], bounds: DataFrame, name: str = "part") -> DataFrame:
    """``table`` with ``name``, the number of its range from 0: how many bounds are at most the row's key.

    Every key of a range comes before every key of the next; rows with equal keys share one. The bounds are
    one broadcast row; a row looks through every ``STRIDE``-th of them, then through one stride.
    """
    own, after = _key(order), F.filter("_bounds", lambda b, i: i % STRIDE == STRIDE - 1)
    rows = table.crossJoin(F.broadcast(bounds.withColumnRenamed("bounds", "_bounds").withColumn("_coarse", after)))
    passed = F.size(F.filter("_coarse", lambda b: b <= own)) * STRIDE
    return rows.withColumn(name, (passed + F.size(F.filter(F.slice("_bounds", passed + 1, F.lit(STRIDE)), lambda b: b <= own))).cast("int")).drop("_bounds", "_coarse")


def numbered(table: DataFrame, order: list[str], name: str, ranges: int | None = None, within: list[str] = [], total: str | None = None) -> DataFrame:  # noqa: B006
    """``table`` with its rows numbered from 1 by ``order``, without gaps: each range is numbered by itself, from the sum of the counts before it.

    With ``within``, numbers begin anew for each value of these columns, of which one may have any share of the
    rows; ``total`` then names a column of how many there are. Rows that are equal in all of ``within`` and
    ``order`` are numbered in any order among themselves. Counting and numbering are two plans over the table;
    that they mean the same ranges rests on the fixed bounds alone.
    """
    rows = in_ranges(table, [*within, *order], range_bounds(table, [*within, *order], ranges), "_part")
    own = [f"_w{i}" for i in range(len(within))]
    sizes = rows.groupBy("_part", *[F.col(c).alias(o) for c, o in zip(within, own, strict=True)]).agg(F.count("*").alias("_size"))
    all_ = Window.partitionBy(*own)  # at most MAX_RANGES rows a value
    earlier = F.sum("_size").over(all_.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(F.col("_part").alias("_of"), *own, F.coalesce(earlier, F.lit(0)).alias("_before"), *([F.sum("_size").over(all_).alias(total)] if total else []))
    same = F.col("_part") == F.col("_of")
    for c, o in zip(within, own, strict=True):
        same &= F.col(c).eqNullSafe(F.col(o))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *within).orderBy(*order)))
    return placed.join(before if within else F.broadcast(before), same).withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_of", "_before", "_at", *own)
