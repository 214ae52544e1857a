"""Layout blocks to evidence: parser items to blocks, blocks to knowledge and evidence rows, and to semantic chunks.

A block has doc_id, ord (position within its document, from 1), type (text, table, image or equation), page, bbox
(array<int>, empty if unknown), text, caption and footnote (array<string>), body (table HTML) and img_path. Positions are
data here: they number the ids and decide which blocks belong together, so they travel with the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

GAP = 28
# Unit and evidence types of blocks and chunks, signals of flowcharts, and the pattern of numbered headings.
UNIT_TYPES = {"text": "text_chunk", "table": "table_chunk", "image": "image_region", "equation": "equation_chunk"}
CHUNK_UNITS = {"table": "table_chunk", "table_row": "table_chunk", "image": "image_region", "flowchart": "image_region", "equation": "equation_chunk"}
CHUNK_EVIDENCE = {"table": "table", "table_row": "table", "image": "image", "flowchart": "flowchart", "equation": "equation"}
CHUNK_ROLES = {"table": "table", "table_row": "table_row", "image": "image", "flowchart": "flowchart_image", "section": "section_text"}
BODY_SIGNALS = [r"\breq\s*:", r"\bres\s*:", "positive response", "positive respone", "negative response", "time out", "failed", "routine aborted"]
FLOW_IMAGE = r"(?i)\b(flow|process|sequence|type\s*\d+|io\s*control|dtc)\b|流程|跳转|分支"
FLOW_CHUNK = ["flow", "process", "sequence", "type", "io control", "dtc", "流程", "跳转", "分支"]
HEADING = r"^\s*(?:#{1,6}\s+)?\d+(?:\.\d+){1,8}\s+\S+"


def coded(value: Column, table: dict[str, str], otherwise: str) -> Column:
    """A fixed small code table as one expression."""
    return reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.lit(otherwise))


def blocks_from_items(items: DataFrame) -> DataFrame:
    """Parser items (type, page_idx, bbox as doubles, text, content, code_body, table_body, captions …) as blocks.

    Unknown types count as text; the first non-blank field is the text; a box that is not four numbers is empty; text
    without words, and equations without words and image, go.
    """
    filled = lambda *cs: F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in cs], F.lit(""))
    kind = F.when(F.col("type").isin(*UNIT_TYPES), F.col("type")).otherwise(F.lit("text"))
    listed = lambda a, b: F.filter(F.coalesce(F.when(F.col("kind") == "table", F.col(a)).otherwise(F.col(b)), F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) != "")
    typed = items.withColumn("kind", kind)
    text = F.when(F.col("kind") == "text", filled("text", "content", "code_body")).when(F.col("kind") == "equation", filled("text", "content"))
    box = F.when((F.size("bbox") == 4) & ~F.exists("bbox", lambda x: x.isNull()), F.transform("bbox", lambda x: F.bround(x).cast("int"))).otherwise(F.array().cast("array<int>"))
    made = typed.select(
        "doc_id", "ord", F.col("kind").alias("type"), F.coalesce("page_idx", F.lit(0)).alias("page"), box.alias("bbox"), text.alias("text"), listed("table_caption", "image_caption").alias("caption"),
        listed("table_footnote", "image_footnote").alias("footnote"), F.when(F.col("kind") == "table", filled("table_body", "text", "content")).alias("body"), F.coalesce("img_path", F.lit("")).alias("img_path"),
    )
    return made.filter((F.col("type").isin("table", "image")) | (F.coalesce("text", F.lit("")) != "") | ((F.col("type") == "equation") & (F.col("img_path") != "")))


def content() -> Column:
    """Clean text of a block: its text, or caption, table and footnote."""
    parts = F.concat_ws(" ", F.array_join("caption", " "), F.when(F.col("type") == "table", F.coalesce("body", F.lit(""))), F.array_join("footnote", " "))
    return T.cleaned(F.when(F.col("type").isin("text", "equation"), F.coalesce("text", F.lit(""))).otherwise(parts))


def flowchart_body(value: Column) -> Column:
    """Three or more of the signals of a flowchart's inside."""
    return reduce(add, [F.lower(value).rlike(s).cast("int") for s in BODY_SIGNALS]) >= 3


def identifiers(value: Column) -> dict[str, Column]:
    return {"service_ids": T.service_ids(value), "dids": T.data_ids(value), "sessions": T.sessions(value), "security_levels": T.security_levels(value)}


def block_id(kind: str, ordinal: str) -> Column:
    return F.format_string(f"%s_{kind}%04d", F.col("doc_id").cast("string"), F.col(ordinal).cast("int"))


def knowledge_units(blocks: DataFrame) -> DataFrame:
    """One unit per block with text; ids keep the block's own position, so gaps stay."""
    made = blocks.withColumn("content", content()).filter("content <> ''")
    return made.select(block_id("", "ord").alias("chunk_id"), coded(F.col("type"), UNIT_TYPES, "text_chunk").alias("unit_type"), "content", *[c.alias(n) for n, c in identifiers(F.col("content")).items()], "page", "bbox")


def evidence_units(blocks: DataFrame) -> DataFrame:
    """One evidence row per block with text, or an image with a path only, with type, role and identifiers."""
    made = blocks.withColumn("content", content())
    made = made.withColumn("content", F.when((F.col("content") == "") & (F.col("type") == "image"), F.col("img_path")).otherwise(F.col("content"))).filter("content <> ''")
    flow = (F.col("type") == "image") & F.concat_ws(" ", "content", "img_path").rlike(FLOW_IMAGE)
    kind = F.when(flow, F.lit("flowchart")).otherwise(F.col("type"))
    role = F.when(flowchart_body(F.col("content")), F.lit("flowchart_body")).when(flow, F.lit("flowchart_image")).when(F.col("type") == "table", F.lit("table")).otherwise(F.lit("section_text"))
    return made.select(block_id("", "ord").alias("evidence_id"), "doc_id", kind.alias("evidence_type"), role.alias("block_role"), "content", *[c.alias(n) for n, c in identifiers(F.col("content")).items()], "page", "bbox")


def heading(value: Column) -> Column:
    return value.rlike(HEADING)


def vertical_gap(above: Column, below: Column) -> Column:
    """Pixels between the foot of one box and the head of the next; 0 where a box is unknown or they overlap."""
    return F.when((F.size(above) >= 4) & (F.size(below) >= 4), F.greatest(F.lit(0), F.get(below, F.lit(1)) - F.get(above, F.lit(3)))).otherwise(0)


def _row_lists(body: Column) -> Column:
    """Rows (table_index, row_index, fields) of every table of a block's HTML, as one array; see :func:`table_rows`."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), T.cleaned)
    tables = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))
    filled = lambda html: F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), cells), lambda r: F.exists(r, lambda c: c != ""))
    # Tables without a filled row do not count.
    parsed = F.filter(F.transform(tables, filled), lambda rows: F.size(rows) > 0)
    headed = F.transform(parsed, lambda rows, t: F.struct((t + 1).alias("t"), F.transform(F.get(rows, F.lit(0)), F.upper).alias("heads"), F.slice(rows, 2, F.size(rows)).alias("rows")))
    pairs = lambda heads, row: F.filter(F.transform(heads, lambda h, i: F.struct(h.alias("header"), F.get(row, i).alias("cell"))), lambda p: (p["header"] != "") & (F.coalesce(p["cell"], F.lit("")) != ""))
    each = F.transform(headed, lambda x: F.transform(x["rows"], lambda row, i: F.struct(x["t"].alias("table_index"), (i + 1).alias("row_index"), pairs(x["heads"], row).alias("fields"))))
    return F.filter(F.flatten(each), lambda r: F.size(r["fields"]) > 0)


def table_rows(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, table_index, row_index and fields (header to cell, array of structs) of every row of every table.

    The first row of a table is its header; empty headers and cells are dropped, and so are rows without any.
    """
    return blocks.select("doc_id", "ord", F.inline(_row_lists(F.col("body"))))


def semantic_chunks(blocks: DataFrame) -> DataFrame:
    """Paragraphs, tables with their rows, and images in reading order, numbered as the document's chunks.

    Text and equation blocks join into a paragraph until the page or type changes, a numbered heading starts after other
    text, the boxes lie more than ``GAP`` apart, or a table or image stands between. A table's chunk is the parent of its rows,
    which stay in the table's row until the chunks have their numbers: all steps are by document, so blocks that are
    dealt by document are not shuffled again.
    """
    in_doc = Window.partitionBy("doc_id").orderBy("ord")
    made = blocks.withColumns({"content": content(), "rows": F.when((F.col("type") == "table") & F.col("doc_id").isNotNull(), _row_lists(F.col("body")))})
    made = made.withColumn("content", F.when((F.col("content") == "") & (F.col("type") == "image"), F.col("img_path")).otherwise(F.col("content"))).filter("content <> ''")
    before = lambda c: F.lag(c).over(in_doc)
    flows = F.col("type").isin("text", "equation")
    breaks = ~flows | before("type").isNull() | (before("type") != F.col("type")) | (before("page") != F.col("page")) | (heading(F.col("content")) & ~heading(before("content"))) | (vertical_gap(before("bbox"), F.col("bbox")) > GAP)
    marked = made.withColumn("breaks", F.coalesce(breaks, F.lit(True)).cast("int"))
    numbered = marked.withColumn("element", F.sum("breaks").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"])
    boxes = F.filter(ordered("bbox"), lambda b: F.size(b) >= 4)
    edge = lambda bs, i, pick: pick(F.transform(bs, lambda b: F.get(b, F.lit(i))))
    elements = numbered.groupBy("doc_id", "element").agg(
        F.min("ord").alias("ord"), F.first("type").alias("type"), F.array_join(ordered("content"), " ").alias("joined"), boxes.alias("boxes"), F.first("img_path").alias("img_path"), F.min_by("page", "ord").alias("page"),
        F.transform(F.array_sort(F.collect_list("ord")), lambda o: F.format_string("%s_block_%04d", F.col("doc_id").cast("string"), o.cast("int"))).alias("source_block_ids"), F.count("*").alias("n_blocks"), F.first("rows").alias("rows"),
    )
    sized = elements.withColumn("n_chunks", F.coalesce(F.size("rows"), F.lit(0)) + 1)
    at = Window.partitionBy("doc_id").orderBy("element").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("ordinal", F.coalesce(F.sum("n_chunks").over(at), F.lit(0)) + 1).withColumn("chunk_id", block_id("sem_", "ordinal"))
    image = F.lower(F.concat_ws(" ", "joined", "img_path"))
    kind = F.when(flows, F.when(F.col("type") == "equation", F.lit("equation")).otherwise(F.lit("paragraph"))).when(F.col("type") == "table", F.lit("table")).when(reduce(lambda a, b: a | b, [F.contains(image, F.lit(s)) for s in FLOW_CHUNK]), F.lit("flowchart")).otherwise(F.lit("image"))
    box = F.when(F.size("boxes") > 0, F.array(edge(F.col("boxes"), 0, F.array_min), edge(F.col("boxes"), 1, F.array_min), edge(F.col("boxes"), 2, F.array_max), edge(F.col("boxes"), 3, F.array_max))).otherwise(F.array().cast("array<int>"))
    wholes = placed.select("doc_id", "chunk_id", kind.alias("chunk_type"), F.when(flows, T.cleaned(F.col("joined"))).otherwise(F.col("joined")).alias("content"), "page", box.alias("bbox"), "source_block_ids", "n_blocks", "ord", "rows")
    none = F.array().cast("array<struct<header:string,cell:string>>")
    title = F.when((F.col("chunk_type") == "paragraph") & heading(F.col("content")), F.substring("content", 1, 160)).otherwise(F.lit(""))
    chunk = lambda *cs: F.struct(*[c.alias(n) for c, n in zip(cs, ("chunk_id", "chunk_type", "content", "parent_chunk_id", "section_title", "fields", "n_blocks"))])
    line = lambda fields: F.array_join(F.transform(fields, lambda p: F.concat(p["header"], F.lit(": "), p["cell"])), " ")
    name = lambda r: F.concat("chunk_id", F.lit("_tbl_"), r["table_index"].cast("string"), F.lit("_"), r["row_index"].cast("string"))
    below = F.transform("rows", lambda r: chunk(name(r), F.lit("table_row"), line(r["fields"]), F.col("chunk_id"), F.lit(""), r["fields"], F.lit(1).cast("long")))
    whole = F.array(chunk(F.col("chunk_id"), F.col("chunk_type"), F.col("content"), F.lit(""), title, none, F.col("n_blocks")))
    each = wholes.select("doc_id", "page", "bbox", "source_block_ids", "ord", F.inline(F.flatten(F.array_compact(F.array(whole, below)))))
    return each.select("doc_id", "chunk_id", "chunk_type", "content", "page", "bbox", "source_block_ids", "parent_chunk_id", "section_title", "fields", "n_blocks", "ord")


def units_from_chunks(chunks: DataFrame) -> DataFrame:
    """Knowledge units of chunks: type by the chunk's kind, identifiers read anew from its text."""
    made = chunks.withColumn("content", F.trim("content")).filter("content <> ''")
    return made.select("chunk_id", coded(F.col("chunk_type"), CHUNK_UNITS, "text_chunk").alias("unit_type"), "content", *[c.alias(n) for n, c in identifiers(F.col("content")).items()], "page", "bbox")


def evidence_from_chunks(chunks: DataFrame) -> DataFrame:
    """Evidence rows of chunks with role, parent and source blocks."""
    made = chunks.withColumn("content", F.trim("content")).filter("content <> ''")
    return made.select(
        F.col("chunk_id").alias("evidence_id"), "doc_id", coded(F.col("chunk_type"), CHUNK_EVIDENCE, "text").alias("evidence_type"), coded(F.col("chunk_type"), CHUNK_ROLES, "paragraph").alias("block_role"), "content",
        F.col("parent_chunk_id").alias("parent_evidence_id"), "source_block_ids", "section_title", "fields", *[c.alias(n) for n, c in identifiers(F.col("content")).items()], "page", "bbox",
    )


def told_from_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks`` with text, with what both of their units say: unit_type, evidence_type and identifiers, each read once."""
    made = chunks.withColumn("content", F.trim("content")).filter("content <> ''")
    return made.withColumns({"unit_type": coded(F.col("chunk_type"), CHUNK_UNITS, "text_chunk"), "evidence_type": coded(F.col("chunk_type"), CHUNK_EVIDENCE, "text"), **identifiers(F.col("content"))})


def chunks_from_evidence(evidence: DataFrame) -> DataFrame:
    """Chunks of evidence rows (evidence_id, evidence_type, block_role, content): ids get the mark ``md_``."""
    role = F.coalesce("block_role", F.lit(""))
    kind = F.when(role == "table_row", F.lit("table_row")).when((role == "flowchart_title") | (F.col("evidence_type") == "flowchart"), F.lit("flowchart")).when(F.col("evidence_type").isin("table", "image", "equation"), F.col("evidence_type")).otherwise(F.lit("section"))
    return evidence.select(F.concat(F.lit("md_"), F.col("evidence_id").cast("string")).alias("chunk_id"), kind.alias("chunk_type"), "content", F.col("evidence_id").cast("string").alias("source_evidence_id"), F.when(role != "", role).otherwise(F.col("evidence_type")).alias("block_role"))
