"""Workbooks (zipped XML spreadsheets) as rows: cells with shared and inline strings, and the flow steps they hold.

``parts`` unzips each file within its row; everything after is expressions over the parts' node table: shared strings are
joined by their index, values belong to cells and cells to rows by parent, and texts are found inside strings by intervals. Files come
from ``binaryFile``, so they may lie in any store that Spark reads, one split a file.

Defined results: a file that is no workbook, or lacks its sheet list, has no cells (``problems`` names the first kind); a sheet whose
part is absent has none; rows without a number are left out; a shared string that is not there, and a cell without a value, are
empty and give no row.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.planning import _escape
from quarry.operators.xml_nodes import node_table, within
from quarry.sources.workspace import written

# Names of parts and namespaces of the format, and how a flow cell and a step are written.
BOOK, LINKS, STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
SHEETS = r"^xl/.*\.xml$"
FLOW_CELL = r"(?s)^(.*?)\s*\((.*?)\)\s*$"
WHITE = " \t\n\r\x0b\x0c"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every workbook below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def parts(files: DataFrame) -> DataFrame:
    """path, part, xml of the parts that hold cells; a file that is no archive has one row with a null part and the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as archive:
                        names = [n for n in archive.namelist() if n == LINKS or (n.startswith("xl/") and n.endswith(".xml"))]
                        rows += [(path, n, archive.read(n).decode("utf-8", "replace")) for n in names]
                except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError) as problem:
                    rows.append((path, None, str(problem)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["path", "part", "xml"])

    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, "path string, part string, xml string")


def problems(found: DataFrame) -> DataFrame:
    """path and reason of the files of ``parts`` that are no workbooks."""
    return found.filter("part IS NULL").select("path", F.col("xml").alias("reason"))


def column_number(letters: Column) -> Column:
    """Number of a column's letters, A being 1; no letters give 0."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def column_letters(number: Column, width: int = 3) -> Column:
    """Letters of a column's number, the inverse of ``column_number`` up to ``width`` letters."""
    step = lambda a: F.when(a["n"] > 0, F.struct(((a["n"] - 1) / 26).cast("int").alias("n"), F.concat(F.char(65 + (a["n"] - 1) % 26), a["s"]).alias("s"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(width)), F.struct(number.cast("int").alias("n"), F.lit("").alias("s")), lambda a, _: step(a), lambda a: a["s"])


def _joined_texts(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """doc, pre, value: the texts of all ``t`` nodes inside each node of ``outer``, in order."""
    texts = nodes.filter("tag = 't'").select("doc", F.col("pre").alias("inner"), F.coalesce("text", F.lit("")).alias("text"))
    met = within(outer, nodes.filter("tag = 't'")).join(texts, ["doc", "inner"])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inner", "text"))), lambda x: x["text"]), "")
    return met.groupBy("doc", F.col("outer").alias("pre")).agg(ordered.alias("value"))


def cells(found: DataFrame) -> DataFrame:
    """path, sheet_ord, sheet, row, column, text of the cells of ``parts`` that have a value, trimmed."""
    wanted = found.filter(F.col("part").isNotNull()).select(F.struct("path", "part").alias("doc"), "xml")
    # Written, since its parts are read again and again below: each time the files would be unzipped and parsed anew.
    nodes = written(node_table(wanted).filter("pre >= 0"), "workbook-nodes")
    of = lambda part: nodes.filter(F.col("doc.part") == part)
    path = F.col("doc.path").alias("path")

    target = F.regexp_replace(F.col("attrs")["Target"], "^/+", "")
    links = of(LINKS).filter("tag = 'Relationship'").select(path, F.col("attrs")["Id"].alias("id"), F.when(F.col("attrs")["Target"].startswith("/") | target.startswith("xl/"), target).otherwise(F.concat(F.lit("xl/"), target)).alias("part"))
    # Sheets of one part of the book each: they are numbered by their place in the list.
    listed = of(BOOK).filter("tag = 'sheet'").select(path, F.col("pre").alias("sheet_ord"), F.col("attrs")["name"].alias("sheet"), F.col("attrs")[f"{{{RELATION}}}id"].alias("id"))
    sheets = listed.join(links, ["path", "id"]).select("path", "part", "sheet_ord", "sheet")

    strings = of(STRINGS)
    items = strings.filter("tag = 'si' AND depth = 1")
    texts = items.select("doc", "pre").join(_joined_texts(strings, items), ["doc", "pre"], "left")
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("pre")) - 1
    shared = texts.select(path, nth.alias("index"), F.coalesce("value", F.lit("")).alias("shared"))

    body = nodes.filter(F.col("doc.part").rlike(SHEETS) & ~F.col("doc.part").isin(BOOK, STRINGS))
    rows = body.filter("tag = 'row'").select("doc", F.col("pre").alias("parent"), F.col("attrs")["r"].try_cast("int").alias("row")).filter("row IS NOT NULL")
    each = body.filter("tag = 'c'").select("doc", "pre", "last", "parent", column_number(F.regexp_replace(F.coalesce(F.col("attrs")["r"], F.lit("")), "[^A-Za-z]", "")).alias("column"), F.col("attrs")["t"].alias("kind")).join(rows, ["doc", "parent"])
    plain = body.filter("tag = 'v'").groupBy("doc", F.col("parent").alias("pre")).agg(F.min_by("text", "pre").alias("v"))
    inline = _joined_texts(body, each.filter("kind = 'inlineStr'"))
    valued = each.join(plain, ["doc", "pre"], "left").join(inline, ["doc", "pre"], "left").withColumn("index", F.when(F.col("kind") == "s", F.col("v").try_cast("int")))
    placed = valued.select(path, F.col("doc.part").alias("part"), "row", "column", "kind", "index", "v", "value").join(sheets, ["path", "part"]).join(shared, ["path", "index"], "left")
    text = F.when(F.col("kind") == "s", F.col("shared")).when(F.col("kind") == "inlineStr", F.col("value")).otherwise(F.col("v"))
    return placed.select("path", "sheet_ord", "sheet", "row", "column", F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)).alias("text")).filter("text <> ''")


def flow_cell(text: Column) -> tuple[Column, Column]:
    """Name and template of ``Name(Template)``; other texts are a name with an empty template."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    fits = flat.rlike(FLOW_CELL)
    return F.when(fits, F.trim(F.regexp_extract(flat, FLOW_CELL, 1))).otherwise(flat), F.when(fits, F.trim(F.regexp_extract(flat, FLOW_CELL, 2))).otherwise(F.lit(""))


def flow_steps(found: DataFrame, include_others: bool = False) -> DataFrame:
    """path, step, step_key, display_name, column, row, sheet, nth, name, template: columns are steps, cells of a column are parallel nodes by row.

    Cells of all sheets of a file count together; ``include_others`` also keeps cells without a template.
    """
    name, template = flow_cell(F.col("text"))
    kept = found.withColumns({"name": name, "template": template})
    kept = kept if include_others else kept.filter("template <> ''")
    by_file = Window.partitionBy("path").orderBy("column")
    in_step = Window.partitionBy("path", "column").orderBy("row", "sheet_ord")
    out = kept.withColumn("step", F.dense_rank().over(by_file)).withColumn("nth", F.row_number().over(in_step))
    return out.select("path", "step", F.format_string("step_%03d", "step").alias("step_key"), F.concat(F.lit("第"), F.col("step").cast("string"), F.lit("步")).alias("display_name"), "column", "row", "sheet", "nth", "name", "template")


def workbook_files(rows: DataFrame) -> DataFrame:
    """path and content of workbooks with the given cells (path, sheet, row, column, text, kind): the sink of this format.

    ``kind`` is s (shared string), inlineStr or null (a plain value). A workbook is one row, so its cells are collected by file.
    """
    shared = rows.filter("kind = 's'").select("path", "text").distinct().withColumn("index", F.row_number().over(Window.partitionBy("path").orderBy("text")) - 1)
    met = rows.join(shared.withColumn("kind", F.lit("s")), ["path", "text", "kind"], "left")
    start = F.concat(F.lit('<c r="'), column_letters(F.col("column")), F.col("row").cast("string"), F.lit('"'))
    safe = _escape(F.col("text"))
    cell = F.when(F.col("kind") == "s", F.concat(start, F.lit(' t="s"><v>'), F.col("index").cast("string"), F.lit("</v></c>"))).when(F.col("kind") == "inlineStr", F.concat(start, F.lit(' t="inlineStr"><is><t>'), safe, F.lit("</t></is></c>"))).otherwise(F.concat(start, F.lit("><v>"), safe, F.lit("</v></c>")))
    ordered = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "xml"))), lambda x: x["xml"]), "")
    lines = met.withColumn("xml", cell).groupBy("path", "sheet", "row").agg(ordered("column").alias("xml")).withColumn("xml", F.concat(F.lit('<row r="'), F.col("row").cast("string"), F.lit('">'), "xml", F.lit("</row>")))
    sheets = lines.groupBy("path", "sheet").agg(ordered("row").alias("xml")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("sheet", "xml"))).alias("sheets"))
    strings = shared.withColumn("xml", F.concat(F.lit("<si><t>"), safe, F.lit("</t></si>"))).groupBy("path").agg(ordered("index").alias("strings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for sheets_, strings_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    names = "".join(f'<sheet name="{s["sheet"]}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets_, 1))
                    archive.writestr(BOOK, f'<workbook xmlns="{MAIN}" xmlns:r="{RELATION}"><sheets>{names}</sheets></workbook>')
                    archive.writestr(LINKS, f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets_) + 1)) + "</Relationships>")
                    if strings_:
                        archive.writestr(STRINGS, f'<sst xmlns="{MAIN}">{strings_}</sst>')
                    for i, s in enumerate(sheets_, 1):
                        archive.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{s["xml"]}</sheetData></worksheet>')
                made.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return sheets.join(strings, "path", "left").select(F.col("path").cast("string"), "sheets", "strings").mapInArrow(run, "path string, content binary")
