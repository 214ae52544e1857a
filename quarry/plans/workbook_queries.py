"""Registered queries over workbooks made from ``orders``; importing this module adds them to the catalogue."""

from __future__ import annotations

from quarry.plans.catalogue import _t, query
from quarry.sources import workbooks as W

# A workbook per customer, two sheets, a cell per order; texts that are flow cells, plain, blank or hold more brackets.
_CELL = {
    "path": "concat('flows/', o_custkey, '.xlsx')", "sheet": "concat('S', o_orderkey % 2)", "col": "CAST(o_orderkey % 53 + 1 AS INT)", "row": "CAST(floor(o_orderkey / 53) AS INT) + 1",
    "text": "CASE o_orderkey % 6 WHEN 0 THEN concat('plain ', o_orderkey) WHEN 1 THEN '  ' WHEN 2 THEN concat(' node <', o_orderkey, '>  (T & ', o_orderpriority, ') (x) ') ELSE concat('n', o_orderkey, '(', o_orderpriority, ')') END",
    "kind": "CASE o_orderkey % 4 WHEN 0 THEN 'inlineStr' WHEN 1 THEN NULL ELSE 's' END",
}
_C = "c AS (SELECT {}, o_custkey FROM orders), k AS (SELECT path, sheet, row, col, trim(text) AS text FROM c WHERE trim(text) <> '')".format(", ".join(f"{v} AS {k}" for k, v in _CELL.items()))


def _parts(spark, d):
    rows = _t(spark, d, "orders").selectExpr(*[f"{v} AS {'column' if k == 'col' else k}" for k, v in _CELL.items()])
    return W.parts(W.workbook_files(rows))


@query(f'WITH {_C} SELECT path, sheet, row, col AS "column", text FROM k')
def workbook_cells(spark, d):
    return W.cells(_parts(spark, d)).drop("sheet_ord")


@query(rf"""WITH {_C}, f AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM k), p AS (SELECT *, trim(regexp_extract(flat, '^(.*?)\s*\((.*?)\)\s*$', 1)) AS name, trim(regexp_extract(flat, '^(.*?)\s*\((.*?)\)\s*$', 2)) AS template FROM f),
s AS (SELECT path, dense_rank() OVER (PARTITION BY path ORDER BY col) AS step, col, row, sheet, row_number() OVER (PARTITION BY path, col ORDER BY row, sheet) AS nth, name, template FROM p WHERE template <> '')
SELECT path, step, 'step_' || lpad(CAST(step AS VARCHAR), 3, '0') AS step_key, '第' || step || '步' AS display_name, col AS "column", row, sheet, nth, name, template FROM s""")
def workbook_flow_steps(spark, d):
    return W.flow_steps(W.cells(_parts(spark, d)))
