"""Helpers shared by the operators: table access, materialised intermediates and small column idioms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and U+0009..U+000D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = r"[\x20\x09-\x0D]+"
NO_FOLDER_SET = "/tmp/checkpoints/quarry"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data set folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read: the session's ``spark.checkpoint.dir``, or a local one where unset (tests).

    A local folder is no shared one on a cluster, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or NO_FOLDER_SET).rstrip("/")


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so lost executors cost no recomputation of what precedes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, label: str) -> None:
    """Delete what was materialised under ``label``, a folder of its own or one table; what is still needed must have been written elsewhere before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{label}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, for columns of our own beside the caller's."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_RE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that results do not depend on locale tables."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
