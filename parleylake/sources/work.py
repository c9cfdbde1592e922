"""Tables that several plans read, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder name where driver and executors can both write; without ``spark.checkpoint.dir`` only a local session has one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="parleylake-")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A table that several plans read, written once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
