"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities.

Documents of an old shard are dealt into blocks by a hash that takes in a row's number, and only the
blocks' sizes come to the driver. The flow network has the old shards, the new shards and their
capacities as nodes, and costs a byte that changes its shard 1, one that stays 0. The solved flow is
turned into block transfers; only a block in which a flow ends, of which there are no more than there
are shards, is split between documents. All other documents find their place from their block alone,
without a shuffle, and the files of affected shards are written anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parleylake.llm._shared import materialize, shared_dir, table

NEW_SHARDS, OLD_SHARDS = 8, 6
#: An old shard has at least so many blocks, and one for each so many bytes of the table; the plan has a row for each, and one for each old and new shard.
BLOCKS, BLOCK_BYTES = 1_024, 1 << 30


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost=lambda old, new: int(old != new)) -> dict[tuple[int, int], int]:
    """Bytes from old to new shards that meet all supplies at the least cost, by successive shortest paths.

    The capacities must hold the supplies together. Nodes are shards, so the network is small whatever the data.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the new shards hold less than the old ones have")
    source, sink = ("s",), ("t",)
    room: dict[tuple, dict[tuple, int]] = {source: {}, sink: {}}
    price: dict[tuple[tuple, tuple], int] = {}

    def arc(a: tuple, b: tuple, size: int, each: int) -> None:
        room.setdefault(a, {})[b], room.setdefault(b, {})[a] = size, 0
        price[a, b], price[b, a] = each, -each

    for old, size in supply.items():
        arc(source, ("old", old), size, 0)
        for new in capacity:
            arc(("old", old), ("new", new), size, cost(old, new))
    for new, size in capacity.items():
        arc(("new", new), sink, size, 0)
    while True:
        best, came, queue = {source: 0}, {}, [source]
        while queue:  # label-correcting search, as residual arcs can have negative costs
            a = queue.pop(0)
            for b, free in room[a].items():
                if free and (b not in best or best[a] + price[a, b] < best[b]):
                    best[b], came[b] = best[a] + price[a, b], a
                    queue.append(b)
        if sink not in best:
            break
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        step = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= step
            room[b][a] += step
    return {(old, new): room["new", new]["old", old] for old in supply for new in capacity if room["new", new]["old", old]}


def block_transfers(sizes: dict[tuple[int, int], int], flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """(old shard, block, first byte, end byte, new shard): each old shard's blocks in turn, those that stay first."""
    left: dict[int, list[list[int]]] = {}
    for (old, new), size in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        left.setdefault(old, []).append([new, size])
    plan = []
    for (old, block), size in sorted(sizes.items()):
        at = 0
        while at < size:
            new, free = left[old][0]
            end = min(size, at + free)
            plan.append((old, block, at, end, new))
            left[old][0][1] -= end - at
            if not left[old][0][1]:
                left[old].pop(0)
            at = end
    return plan


def numbered(docs: DataFrame, old_shard: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``old_shard`` (null: 0), ``size``, ``text_crc32``, and ``row``, a number of each row. Write it before ``reshard`` reads it several times."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"))
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), F.crc32(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", "old_shard", size.alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("row"), "text")


def reshard(rows: DataFrame, shards: int = NEW_SHARDS, blocks: int | None = None) -> DataFrame:
    """``rows`` of ``numbered`` with ``block`` and ``shard``: new shards are equal in bytes, to within a document or so.

    A size is the text's UTF-8 bytes (null: none) and 1. Repeated rows and null ids are placed like others:
    the row's number spreads them over the blocks. An empty table gives an empty result. Within a split
    block a document goes where its first byte goes.
    """
    spark = rows.sparkSession
    if blocks is None:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
        blocks = max(BLOCKS, -(-total // BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "row"), F.lit(blocks)).cast("int"))
    held = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("size")).collect()  # old shards times blocks
    sizes = {(r["old_shard"], r["block"]): r["size"] for r in held}
    supply: dict[int, int] = {}
    for (old, _), size in sizes.items():
        supply[old] = supply.get(old, 0) + size
    flow = min_cost_flow(supply, dict(enumerate(even_capacities(sum(supply.values()), shards))))
    transfers = block_transfers(sizes, flow)
    whole = [(old, block, new) for old, block, lo, hi, new in transfers if hi - lo == sizes[old, block]]
    split = [t for t in transfers if t[3] - t[2] < sizes[t[:2]]]
    moves = F.broadcast(spark.createDataFrame(whole, "old_shard int, block int, shard int"))  # a row for each block
    parts = F.broadcast(spark.createDataFrame(split, "p_old int, p_block int, lo long, hi long, shard int"))  # at most old and new shards together
    torn = F.broadcast(spark.createDataFrame(sorted({t[:2] for t in split}), "old_shard int, block int"))
    order = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size", "row")
    first_byte = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    narrow = rows.select("old_shard", "block", "doc_id", "text_crc32", "size", "row").join(torn, ["old_shard", "block"]).withColumn("first_byte", first_byte)
    own = (F.col("old_shard") == F.col("p_old")) & (F.col("block") == F.col("p_block")) & (F.col("first_byte") >= F.col("lo")) & (F.col("first_byte") < F.col("hi"))
    between = rows.join(torn, ["old_shard", "block"]).join(narrow.join(parts, own).select("row", "shard"), "row")
    columns = [*rows.columns, "shard"]
    return rows.join(moves, ["old_shard", "block"]).select(columns).unionByName(between.select(columns))


def with_slots(placed: DataFrame) -> DataFrame:
    """``slot``: gapless from 0 within each new shard. ``placed`` is read twice, so hand in a written table; texts don't move if they aren't among its columns."""
    keys = ["shard", "old_shard", "block"]
    counts = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    firsts = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("row"))
    return placed.withColumn("_own", within).join(firsts, keys).withColumn("slot", F.col("first_slot") + F.col("_own") - 1).drop("_own", "first_slot")


def rewrite(placed: DataFrame, path: str) -> DataFrame:
    """Write the affected shards' files below ``path`` (``shard=k``) and read them back: the rows of those shards only.

    A shard is affected if a row enters it or leaves it; another shard keeps its old files. Columns may be
    null and rows repeated; an empty table, or one in which nothing moves, writes no rows.
    """
    moved = placed.where(F.col("shard") != F.col("old_shard")).select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    affected = [r["shard"] for r in moved.collect()]  # shard numbers
    placed.where(F.col("shard").isin(affected)).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)


def source_shards(docs: DataFrame, shards: int = OLD_SHARDS) -> Column:
    """The layout that the documents come in: each source in one shard."""
    return F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(shards)).cast("int")


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from six shards by source into eight of equal bytes; sizes and checksums are those of the files that were written."""
    docs = table(spark, sf_dir, "documents")
    path = shared_dir(spark)
    placed = reshard(materialize(numbered(docs, source_shards(docs))))
    placed.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    files = spark.read.schema(placed.schema).parquet(path)
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), F.crc32(F.coalesce("text", F.lit("")))
    files = files.select("doc_id", size.alias("size"), crc.alias("text_crc32"), "shard", "old_shard", "block", "row")
    return with_slots(files).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
