"""Sources and sinks: JSON lines with a declared schema, Markdown folders, XML templates, metric text, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """source_path and whole text of every Markdown file below ``path``."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))


def read_script_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Script nodes of XML files: source_path, name and class in document order; metadata files are skipped."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("n"), F.col("value").alias("xml")).filter(~F.col("n").startswith("._"))
    names, classes = (F.xpath("xml", F.lit(f"//ScriptNode/@{a}")) for a in ("Name", "ClassName"))
    return files.select("source_path", F.posexplode(F.arrays_zip(names.alias("name"), classes.alias("class_name"))).alias("node_ord", "z")).select("source_path", "node_ord", "z.name", "z.class_name")


# Fixed value: the grammar of a line of the text exposition format.
METRIC_LINE = r"^\s*([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?\s+([-+]?Inf|NaN|[-+0-9.eE]+)"
#: Longest label value that counts.
LABEL = 120


def parse_prometheus(lines: DataFrame) -> DataFrame:
    """name and summed value from exposition text (column value); buckets and lines with a very long label value are dropped."""
    part = lambda g: F.regexp_extract("value", METRIC_LINE, g)
    number = F.when(part(3).rlike("Inf$"), F.regexp_replace(part(3), "Inf$", "Infinity")).otherwise(part(3)).try_cast("double")
    rows = lines.filter(~F.col("value").rlike(r"^\s*#")).select(part(1).alias("name"), part(2).alias("labels"), number.alias("n"))
    long = F.exists(F.regexp_extract_all("labels", F.lit(r'="([^"]*)"'), F.lit(1)), lambda v: F.length(v) > LABEL)
    kept = rows.filter((F.col("name") != "") & F.col("n").isNotNull() & ~F.endswith("name", F.lit("_bucket")) & ~F.contains("labels", F.lit("le=")) & ~long)
    return kept.groupBy("name").agg(F.round(F.sum("n"), 6).alias("value"))


def manifest(df: DataFrame, content: str) -> DataFrame:
    """One row: number of rows, and a digest of the content that does not depend on row order."""
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.coalesce(F.bit_xor(F.xxhash64(content)), F.lit(0)).cast("string"), 256).alias("content_sha256"))
