"""Chunking: ordered blocks to paragraphs, Markdown to sections, HTML to blocks and links, first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import cleaned


def paragraphs(blocks: DataFrame, by: str, order: str, new: Column, content: str) -> DataFrame:
    """Runs of blocks that no boundary parts: number, joined text and block count (gaps and islands)."""
    w = Window.partitionBy(by).orderBy(order)
    first = F.lag(F.lit(1)).over(w).isNull()
    flagged = blocks.withColumn("_new", F.when(first | F.coalesce(new, F.lit(False)), 1).otherwise(0))
    numbered = flagged.withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content]), " ")
    return numbered.groupBy(by, "paragraph").agg(joined.alias("text"), F.count("*").alias("n_blocks"))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, title, body, first and last line; text before the first heading is titled ``document``."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    heading = F.col("raw").rlike(r"^#{1,6}\s+\S")
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("head", F.when(heading, F.trim(F.regexp_replace("raw", r"^#{1,6}\s+", "")))).withColumn("section", F.sum(F.when(heading, 1).otherwise(0)).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~heading, F.struct("line", "raw")))), lambda x: x["raw"]), "\n")
    out = numbered.groupBy("doc_id", "section").agg(F.coalesce(F.max("head"), F.lit("document")).alias("title"), F.trim(body).alias("body"), (F.min("line") + 1).alias("first_line"), (F.max("line") + 1).alias("last_line"))
    return out.filter("section > 0 OR body <> ''")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id and href of every link."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, position and cleaned text of every closed paragraph."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1))).alias("position", "raw"))
    return each.select("page_id", "position", cleaned(F.col("raw")).alias("text")).filter("text <> ''")


def html_table_rows(tables: DataFrame) -> DataFrame:
    """table_id, row_index and fields (header to cell) of well-formed tables; empty headers and cells are dropped."""
    rows = tables.select("table_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("i", "row"))
    cells = rows.select("table_id", "i", F.transform(F.regexp_extract_all("row", F.lit("(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), cleaned).alias("cells"))
    heads = cells.filter("i = 0").select("table_id", F.col("cells").alias("heads"))
    pairs = F.filter(F.arrays_zip("heads", "cells"), lambda z: (F.coalesce(z["heads"], F.lit("")) != "") & (F.coalesce(z["cells"], F.lit("")) != ""))
    return cells.filter("i > 0").join(heads, "table_id").select("table_id", F.col("i").alias("row_index"), F.map_from_entries(F.transform(pairs, lambda z: F.struct(z["heads"], z["cells"]))).alias("fields"))


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key under a total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
