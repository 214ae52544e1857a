"""HTML tables as grids: cells with spans laid out, nested tables apart, omitted end tags implied; and the row that fits best.

A document's tables are read within its row; what follows are expressions over cells. A cell that spans columns or rows
stands in each place that it covers; row spans end with the table. A nested table is a table of its own, and its text is
no part of the cell that holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import tokens

#: Most places that one span may cover, as browsers have it.
SPAN = 1000
#: Texts whose tables are held at once.
READ = 512


#: A plain tag, and a plain attribute in it. Whatever else stands after ``<`` is left to the parser, and so are elements whose content is no markup.
_TAG = re.compile(r"(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+[A-Za-z]+=(?:\"[^\"<>&]*\"|'[^'<>&]*'|[A-Za-z0-9%#.]+))*+)[ \t\n\r\f]*")
_ATTRIBUTE = re.compile(r"([A-Za-z]+)=(?:\"([^\"]*)\"|'([^']*)'|([A-Za-z0-9%#.]+))")
_RAW = {"iframe", "math", "noembed", "noframes", "noscript", "plaintext", "script", "style", "svg", "textarea", "title", "xmp"}
_BLANK = re.compile("[ \t\n\x0b\f\r]+")
_CELLS = pa.list_(pa.list_(pa.list_(pa.string())))


class _Tables:
    """Tables of a text as lists of rows of cells: a place that no cell covers is None; tables by where they open."""

    def __init__(self) -> None:
        self.found: list[list[list[str | None]]] = []
        #: Open tables: number, row, places taken by (row, column), and the open cell as (parts, columns, rows).
        self.open: list[dict] = []

    def start(self, tag: str, columns: int = 1, rows: int = 1) -> None:
        if tag == "table":
            self.open.append({"table": len(self.found), "row": -1, "taken": {}, "cell": None})
            self.found.append([])
        elif self.open and tag == "tr":
            self._end_cell()
            self.open[-1]["row"] += 1
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            top = self.open[-1]
            top["row"] = max(top["row"], 0)
            top["cell"] = ([], columns, rows)

    def end(self, tag: str) -> None:
        if not self.open:
            return
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table":
            self._end_table()

    def data(self, text: str) -> None:
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][0].append(text)

    def _end_cell(self) -> None:
        top = self.open[-1]
        if not top["cell"]:
            return
        parts, columns, rows = top["cell"]
        top["cell"], column, at, taken = None, 0, top["row"], top["taken"]
        text = _BLANK.sub(" ", "".join(parts)).strip(" ")
        while (at, column) in taken:
            column += 1
        if rows == columns == 1:
            taken[at, column] = text
            return
        for r in range(at, at + rows):
            for c in range(column, column + columns):
                taken.setdefault((r, c), text)

    def _end_table(self) -> None:
        self._end_cell()
        top = self.open.pop()
        rows = self.found[top["table"]]
        rows += [[] for _ in range(top["row"] + 1)]
        for (r, c), text in sorted(top["taken"].items()):
            if r <= top["row"]:
                rows[r] += [None] * (c - len(rows[r]))
                rows[r].append(text)

    def close(self) -> list[list[list[str | None]]]:
        while self.open:
            self._end_table()
        return self.found


def _spans(attrs: list) -> tuple[int, int]:
    span = {k: int(v.lstrip("0")[:9] or 0) if (v or "").isdecimal() else 1 for k, v in attrs if k in ("colspan", "rowspan")}
    return min(max(span.get("colspan", 1), 1), SPAN), min(max(span.get("rowspan", 1), 1), SPAN)


class _Reader(HTMLParser):
    """Any text, read by Python's parser."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables = _Tables()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tables.start(tag, *_spans(attrs))

    def handle_endtag(self, tag: str) -> None:
        self.tables.end(tag)

    def handle_data(self, data: str) -> None:
        self.tables.data(data)


@lru_cache(maxsize=4096)
def _plain_tag(text: str) -> tuple[bool, str, int, int] | None:
    """(is an end tag, name, columns, rows) of what stands between ``<`` and ``>``; None if it is not plain."""
    m = _TAG.fullmatch(text)
    if not m or m[2].lower() in _RAW or (m[1] and m[3]):
        return None
    return bool(m[1]), m[2].lower(), *_spans([(a[1].lower(), a[a.lastindex]) for a in _ATTRIBUTE.finditer(m[3])])


def _read(html: str) -> list[list[list[str | None]]]:
    """Tables of a text. Plain tags are told apart by themselves, which is much faster; a text with any other goes to the parser."""
    first, *parts = html.split("<")
    tables = _Tables()
    for part in parts:
        tag, closed, data = part.partition(">")
        plain = _plain_tag(tag) if closed else None
        if plain is None:
            reader = _Reader()
            reader.feed(html)
            reader.close()
            return reader.tables.close()
        is_end, name, columns, rows = plain
        if is_end:
            tables.end(name)
        else:
            tables.start(name, columns, rows)
        if data and tables.open and (cell := tables.open[-1]["cell"]):
            cell[0].append(unescape(data) if "&" in data else data)
    return tables.close()


def grids(docs: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """doc, table_index, row, column, text of every place of every table, text cleaned; null html has none."""
    places = F.filter(F.transform("cells", lambda x, i: F.struct(i.alias("column"), x.alias("text"))), lambda p: p["text"].isNotNull())
    rows = _read_tables(docs, doc, html).select("doc", F.posexplode("tables").alias("table_index", "rows")).select("doc", "table_index", F.posexplode("rows").alias("row", "cells"))
    return rows.select("doc", "table_index", "row", F.inline(places))


def _read_tables(docs: DataFrame, doc: str, html: str) -> DataFrame:
    """doc and its tables, each an array of rows of cells."""
    schema = T.StructType([T.StructField("doc", docs.schema[doc].dataType), T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A part of a batch at a time, since spans make more of a text than it holds.
            for at in range(0, b.num_rows, READ):
                part = b.slice(at, READ)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_read(x.as_py() or "") for x in part.column(1)], _CELLS)], names=schema.names)

    return docs.select(F.col(doc).alias("doc"), F.col(html).cast("string").alias("html")).mapInArrow(run, schema)


def rows_of(docs: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """What :func:`fields` gives for the grids of ``docs``: a table's rows stay together until their fields are known, so no cell is a row or shuffled."""
    filled = F.filter(F.transform("rows", lambda r, i: F.struct(i.alias("row"), r.alias("cells"))), lambda r: F.exists(r["cells"], lambda x: F.coalesce(x, F.lit("")) != ""))
    tables = _read_tables(docs, doc, html).select("doc", F.posexplode("tables").alias("table_index", "rows")).select("doc", "table_index", filled.alias("filled")).filter(F.size("filled") > 1)
    heads = F.transform(F.get("filled", F.lit(0))["cells"], lambda x: F.coalesce(header(x), F.lit("")))
    named = tables.select("doc", "table_index", "filled", heads.alias("heads"))
    # A header and its columns, once for a table; ``x`` holds them for all rows.
    columns = lambda hs: F.transform(F.filter(F.array_distinct(hs), lambda h: h != ""), lambda h: F.struct(h.alias("header"), F.filter(F.transform(hs, lambda y, i: F.when(y == h, i)), lambda i: i.isNotNull()).alias("at")))
    held = lambda r, g: F.struct(g["header"].alias("header"), F.filter(F.transform(g["at"], lambda i: F.struct(i.alias("at"), F.get(r["cells"], i).alias("cell"))), lambda p: F.coalesce(p["cell"], F.lit("")) != "").alias("filled"))
    placed = lambda r, gs: F.transform(F.filter(F.transform(gs, lambda g: held(r, g)), lambda h: F.size(h["filled"]) > 0), lambda h: F.struct(F.get(h["filled"], F.lit(0))["at"].alias("at"), h["header"].alias("header"), F.element_at(h["filled"], -1)["cell"].alias("cell")))
    pairs = lambda r, gs: F.transform(F.array_sort(placed(r, gs)), lambda p: F.struct(p["header"].alias("header"), p["cell"].alias("cell")))
    body = lambda x: F.transform(F.slice(x["filled"], 2, F.size(x["filled"])), lambda r: F.struct(r["row"].alias("row"), pairs(r, x["groups"]).alias("fields")))
    once = F.flatten(F.transform(F.array(F.struct("filled", columns(F.col("heads")).alias("groups"))), body))
    return named.select("doc", "table_index", F.inline(once)).filter(F.size("fields") > 0)


def header(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))


def fields(cells: DataFrame) -> DataFrame:
    """doc, table_index, row, fields (array of header and cell): the rows below each table's first filled row, which is its header.

    Rows without a filled cell do not count; of places with one header in a row the last filled one stays.
    """
    c = F.col
    table = Window.partitionBy("doc", "table_index")
    column = Window.partitionBy("doc", "table_index", "column")
    # Only filled cells say anything; they are read once, and a table's header meets them by windows.
    placed = cells.filter("text <> ''").withColumn("top", F.min("row").over(table))
    headed = placed.withColumn("header", F.max(F.when(c("row") == c("top"), header(c("text")))).over(column))
    pairs = headed.filter("row > top AND header <> ''")
    last = pairs.groupBy("doc", "table_index", "row", "header").agg(F.max_by("text", "column").alias("cell"), F.min("column").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "header", "cell"))), lambda x: F.struct(x["header"].alias("header"), x["cell"].alias("cell")))
    return last.groupBy("doc", "table_index", "row").agg(ordered.alias("fields"))


def best_rows(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """node, doc, table_index, row, score, fields: for each ask (node, doc, aliases) the row whose cells hold most of an alias.

    The score is the largest share of an alias' distinct tokens; of equal rows the first one in the document counts, also where
    all scores are 0.
    """
    c = F.col
    held = rows.withColumn("words", F.array_distinct(tokens(F.array_join(F.transform("fields", lambda f: f["cell"]), " "))))
    named = asks.withColumn("named", F.filter(F.transform("aliases", lambda a: F.array_distinct(tokens(a))), lambda ws: F.size(ws) > 0))
    share = F.coalesce(F.array_max(F.transform("named", lambda ws: F.size(F.array_intersect(ws, c("words"))) / F.size(ws))), F.lit(0.0))
    met = named.select("node", "doc", "named").join(held, "doc").withColumn("score", F.round(share, 6))
    w = Window.partitionBy("node", "doc").orderBy(F.desc("score"), "table_index", "row")
    return met.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("node", "doc", "table_index", "row", "score", "fields")
