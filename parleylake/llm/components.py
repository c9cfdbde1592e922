"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleylake.llm._shared import discard, materialize

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``links`` (``a``, ``b``); the component is its smallest node.

    Each half round takes the smallest neighbour of every node by a pre-aggregated ``min`` and sends the
    node's other neighbours to it; hubs meet in sort-merge joins, which adaptive execution splits.
    Rounds are written to the shared folder, each deleted once the next is there; only a count and a sum
    come to the driver. Links with a null end are left out, repeated and reversed ones count once, and no
    links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = materialize(edges), None
    for _ in range(MAX_ROUNDS):
        large = _star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), only_larger=True)
        last, edges = edges, materialize(_star(large, only_larger=False))
        discard(last)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _star(edges: DataFrame, only_larger: bool) -> DataFrame:
    """Large star: of each ``u``, neighbours larger than it go to its smallest one. Small star (edges point down): all of them, and itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if only_larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()
