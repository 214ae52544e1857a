"""Versioned snapshots of keyed tables: a base layer, delta layers over it, and an order-free hash of what they hold together.

A version is a folder of its own below each table and a row in the manifest; nothing that is there is written again. A read
takes the newest base at or below a version and lays the deltas over it: rows of each layer whose key no later delta takes,
unless they are marked gone. The rows that a delta takes are noted when it is written; where they are few, Spark broadcasts
their keys, so the layers are scanned, not shuffled, however large the delta is. The hash adds up and XORs the hashes of the rows, so it does not depend on their order, files or layers, and
a delta changes it by the rows that it touches alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.workspace import written

MANIFEST = "version int, kind string, name string, keys string, n_rows long, total decimal(38,0), parity long"
GONE = "is_gone"
#: Folder of the rows that a delta takes from the layers below it, before its version.
REPLACED = "taken"


def _row_hash(columns: list[str]) -> Column:
    """Hash of a row, for which null differs from every value and column order does not count."""
    return F.xxhash64(*[x for c in sorted(columns) for x in (F.col(c).isNull(), F.col(c))])


def _sums(df: DataFrame, columns: list[str], sign: int = 1) -> DataFrame:
    h = _row_hash(columns)
    return df.agg(F.count("*").alias("n_rows"), (sign * F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).cast("decimal(38,0)").alias("total"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("parity"))


def content_hash(df: DataFrame) -> DataFrame:
    """n_rows, total and parity of a table: equal tables have equal ones, whatever the order of their rows."""
    return _sums(df, df.columns)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Every version of every table: base or delta, its keys, and rows and hash of the whole table at that version."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _add(spark: SparkSession, root: str, version: int, kind: str, name: str, keys: list[str], sums) -> None:
    spark.createDataFrame([(version, kind, name, ",".join(keys), sums["n_rows"], sums["total"], sums["parity"])], MANIFEST).write.mode("append").parquet(f"{root}/manifest")


def _state(spark: SparkSession, root: str, name: str, version: int | None = None) -> list:
    rows = manifest(spark, root).filter(F.col("name") == name).orderBy("version").collect()
    rows = [r for r in rows if version is None or r["version"] <= version]
    if not rows:
        raise ValueError(f"no version of {name} in {root}")
    return rows


def _layer(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a layer of its own, read back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, root: str, name: str, keys: list[str], version: int = 1) -> None:
    """A base layer: the whole table as ``version``, which must be new."""
    held = _layer(df, f"{root}/{name}/v{version}")
    _add(df.sparkSession, root, version, "base", name, keys, _sums(held, held.columns).first())


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The table at a version, the newest by default."""
    rows = _state(spark, root, name, version)
    base = max(i for i, r in enumerate(rows) if r["kind"] == "base")
    keys, versions = rows[base]["keys"].split(","), [r["version"] for r in rows[base:]]
    held = spark.read.parquet(f"{root}/{name}/v{versions[0]}")
    layers = [held, *[spark.read.parquet(f"{root}/{name}/v{v}").filter(~F.col(GONE)).select(*held.columns) for v in versions[1:]]]
    taken = [spark.read.parquet(f"{root}/{name}/{REPLACED}{v}").select(*keys) for v in versions[1:]]
    # A row stands until a later layer takes its key.
    standing = [layer.join(reduce(DataFrame.unionByName, taken[i:]), keys, "left_anti").select(*held.columns) if taken[i:] else layer for i, layer in enumerate(layers)]
    return reduce(DataFrame.unionByName, standing)


def _touched(before: DataFrame, layer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``before`` whose key ``layer`` has. Only hashes of keys meet at first; the rows with a hash of both are compared by their keys."""
    hashed = lambda df: df.withColumn("_h", F.xxhash64(*keys))
    met = written(hashed(before).select("_h").join(hashed(layer).select("_h"), "_h", "left_semi").distinct(), "snapshot-met")
    some = lambda df: hashed(df).join(met, "_h", "left_semi").drop("_h")
    return some(before).join(some(layer.select(*keys)), keys, "left_semi").select(*before.columns)


def apply(delta: DataFrame, root: str, name: str, added: tuple[str, ...] = ()) -> int:
    """Lay ``delta`` (rows by unique, non-null keys; ``is_gone`` marks keys that leave) over the newest version; returns the new version.

    Columns in ``added`` are added to what the key had before. The rows that the delta takes from the layers below are a table
    of their own beside it, so that a read need not look for them.
    """
    spark = delta.sparkSession
    rows = _state(spark, root, name)
    keys, version = rows[-1]["keys"].split(","), rows[-1]["version"] + 1
    before = read(spark, root, name)
    path = f"{root}/{name}/v{version}"
    marked = delta if GONE in delta.columns else delta.withColumn(GONE, F.lit(False))
    rows_ = marked.select(*[F.col(f.name).cast(f.dataType) for f in before.schema.fields], GONE)
    layer = written(rows_, "snapshot-delta") if added else _layer(rows_, path)
    taken = _layer(_touched(before, layer, keys), f"{root}/{name}/{REPLACED}{version}")
    if added:
        had = taken.select(*keys, *[F.col(c).alias(f"_{c}") for c in added])
        sums = layer.join(had, keys, "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in added})
        layer = _layer(sums.select(*layer.columns), path)
    out, new = (_sums(x, before.columns).first() for x in (taken, layer.filter(~F.col(GONE))))
    last = rows[-1]
    _add(spark, root, version, "delta", name, keys, {"n_rows": last["n_rows"] - out["n_rows"] + new["n_rows"], "total": last["total"] - out["total"] + new["total"], "parity": last["parity"] ^ out["parity"] ^ new["parity"]})
    return version
