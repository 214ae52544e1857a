"""A folder that the driver and all executors share, for tables and indexes that a job writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used with a local master where ``spark.checkpoint.dir`` is not set (tests).
LOCAL = "/tmp/checkpoints/quarry"


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``; a cluster must have that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or LOCAL).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new shared folder and read back, so that what precedes is not computed again."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
