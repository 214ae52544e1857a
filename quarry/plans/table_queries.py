"""Registered queries over HTML tables made from line items; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import tables as TB
from quarry.plans.catalogue import _t, query

# A table per order: a header over two columns, a cell over two rows, wide cells from the third line on, end tags left out
# for every second order, and a nested table in the last column of some lines.
_LINES = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_partkey AS p, CAST(l_suppkey AS {s}) AS s, l_orderkey % 2 = 0 AS closed, l_partkey % 7 = 0 AS nested FROM lineitem"
_END = "CASE WHEN closed THEN '</td>' ELSE '' END"
_ROW = f"""concat('<tr>', CASE WHEN i = 1 THEN concat('<td rowspan="2">first &amp; second', {_END}, '<TD>P', p, {_END}) WHEN i = 2 THEN concat('<td>P', p, {_END}) ELSE concat('<td colspan=2>part <b>P', p, '</b>', {_END}) END,
 '<td> S', s, CASE WHEN nested THEN '<table><tr><th>K<tr><td>in</table>' ELSE '' END, {_END}, CASE WHEN closed THEN '</tr>' ELSE '' END)"""


def _tables(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("quarry_table_lines")
    lines = spark.sql(_LINES.format(s="string").replace("lineitem", "quarry_table_lines")).selectExpr("doc", "i", f"{_ROW} AS x")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]), "")
    return lines.groupBy("doc").agg(F.concat(F.lit("text <table><tr><th colspan='2'>Item </th><th>supplier  id</th></tr>"), body, F.lit("</table>")).alias("html"))


_G = f"""l AS ({_LINES.format(s='VARCHAR')}), n AS (SELECT *, count(*) FILTER (nested) OVER (PARTITION BY doc ORDER BY i) AS k FROM l), d AS (SELECT DISTINCT doc FROM l),
g AS (SELECT doc, 0 AS table_index, 0 AS row, unnest([0, 1, 2]) AS "column", unnest(['Item', 'Item', 'supplier id']) AS text FROM d
  UNION ALL SELECT doc, 0, i, 0, CASE WHEN i <= 2 THEN 'first & second' ELSE 'part P' || p END FROM l UNION ALL SELECT doc, 0, i, 1, CASE WHEN i <= 2 THEN 'P' || p ELSE 'part P' || p END FROM l UNION ALL SELECT doc, 0, i, 2, 'S' || s FROM l
  UNION ALL SELECT doc, k, unnest([0, 1]), 0, unnest(['K', 'in']) FROM n WHERE nested)"""


@query(f"WITH {_G} SELECT CAST(doc AS BIGINT) AS doc, CAST(table_index AS INT) AS table_index, CAST(row AS INT) AS row, \"column\", text FROM g")
def table_grids(spark, d):
    return TB.grids(_tables(spark, d))


# Each order asks for a part of its own by two names, or for one that no line has.
@query(f"""WITH {_G}, q AS (SELECT doc, min(p) AS p FROM l GROUP BY doc), w AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN 'none' ELSE 'P' || p END AS name FROM q),
r AS (SELECT l.doc, i, CASE WHEN i <= 2 THEN 'P' || l.p ELSE 'part P' || l.p END AS item, s, CASE WHEN name = 'P' || l.p THEN 1e0 WHEN i > 2 THEN 0.5e0 ELSE 0e0 END AS score FROM l JOIN w USING (doc)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, i) AS nth FROM r)
SELECT doc AS node, CAST(i AS INT) AS row, score, 'ITEM=' || item || ';SUPPLIER ID=S' || s AS fields FROM b WHERE nth = 1""")
def best_table_rows(spark, d):
    docs = _tables(spark, d)
    least = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.min("l_partkey").alias("p"))
    name = F.when(F.col("doc") % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("P"), F.col("p").cast("string")))
    asks = least.select(F.col("doc").alias("node"), "doc", F.array(name, F.concat(F.lit("part "), name)).alias("aliases"))
    found = TB.best_rows(TB.rows_of(docs), asks).filter("table_index = 0")
    return found.select("node", "row", "score", F.array_join(F.transform("fields", lambda f: F.concat(f["header"], F.lit("="), f["cell"])), ";").alias("fields"))
