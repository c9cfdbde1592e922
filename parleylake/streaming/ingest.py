"""New messages as a stream: the same fields and rules as a batch, ids once within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parleylake.functions.text import classify_type

SCHEMA = "id string, timestamp string, sender string, text string, message_type string"


def read_messages(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """JSON lines of a growing folder: message fields, ``ts`` and ``problems``; an id that comes again within ``late`` is dropped.

    Only good rows are compared by their ids: refused ones, which may have none, all stay.
    """
    rows = spark.readStream.schema(SCHEMA).json(path)
    rows = rows.withColumn("ts", F.when(F.col("timestamp").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.col("timestamp").try_cast("timestamp")))
    blank = lambda c: F.coalesce(F.btrim(c) == "", F.lit(True))
    problems = F.array_compact(F.array(
        *[F.when(blank(c), F.lit(f"bad {c}")) for c in ("id", "sender", "text")], F.when(F.col("ts").isNull(), F.lit("no instant")),
        F.when(F.coalesce(F.col("message_type") != classify_type(F.col("text")), F.lit(False)), F.lit("type of text")),
    ))
    rows = rows.withColumn("message_type", F.coalesce("message_type", classify_type(F.col("text")))).withColumn("problems", problems)
    good, refused = F.size("problems") == 0, F.size("problems") > 0
    return rows.where(good).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"]).unionByName(rows.where(refused))


def hourly_counts(messages: DataFrame, window: str = "1 hour") -> DataFrame:
    """Good messages by hour and type; a window is given once the watermark has passed it."""
    return messages.where(F.size("problems") == 0).groupBy(F.window("ts", window), "message_type").agg(F.count("*").alias("n")).select("window.start", "message_type", "n")


def write(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Good and refused messages into two Parquet tables, what is there now and then stop; run again for what came since."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where(F.size("problems") == 0).drop("problems").write.mode("overwrite").parquet(f"{path}/good/batch={number}")
        batch.where(F.size("problems") > 0).write.mode("overwrite").parquet(f"{path}/refused/batch={number}")
        batch.unpersist()

    return messages.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
