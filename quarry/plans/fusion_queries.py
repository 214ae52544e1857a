"""Registered queries that fuse planned nodes into workflows made from ``orders``; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import fusion as FU
from quarry.operators import xml_nodes as X
from quarry.plans.catalogue import _t, query
from quarry.plans.xml_queries import _ARG, _O, _TYPE, _workflows

# Plans: two of three orders are planned nodes, of which one is in the base under its name; steps hold several of them.
_P = {
    "doc": "o_custkey", "step": "CAST(o_orderkey % 4 AS INT) + 1", "step_key": "concat('step_', o_orderkey % 4)", "row": "CAST(o_orderkey % 7 AS INT)", "node": "CASE o_orderkey % 3 WHEN 0 THEN concat('n', o_orderkey) ELSE concat('x', o_orderkey) END",
    "class": "CASE o_orderkey % 5 WHEN 0 THEN 'New & C' WHEN 1 THEN '' ELSE o_orderpriority END", "script_type": "'NORMAL'", "dead_ms": "0", "retry_times": "CAST(o_orderkey % 2 AS INT)", "interupt_start": "'false'",
}
_PLANNED = "o_orderkey % 3 < 2"
_PA = [("DID", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('d', o_orderkey) END", 1), ("Level", "concat(o_orderkey % 10 + o_orderkey % 2, '')", 2), ("Extra", "'<e>'", 3)]
_HAS = "o_orderkey % 8 > 0"


def _plan(spark, d):
    orders = _t(spark, d, "orders").filter(_PLANNED)
    plan = orders.selectExpr(*[f"{v} AS {k}" for k, v in _P.items()])
    args = orders.filter(_HAS).selectExpr(f"{_P['doc']} AS doc", f"{_P['node']} AS node", "inline(array(" + ", ".join(f"struct({o} AS ord, '{a}' AS arg, {v} AS value)" for a, v, o in _PA) + "))")
    return plan, args


def _fused(spark, d, mode):
    docs = _workflows(spark, d)
    return FU.fuse_workflow(X.node_table(docs), *_plan(spark, d), mode=mode, indent=False)


# The base holds (arg of the order, value), then Level; of one name the first counts.
_V0 = "CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '{{value}}' ELSE CAST(o_orderkey AS VARCHAR) END"


def _args_sql(mode: str) -> str:
    due = "true" if mode == "overwrite" else "trim(held) = ''"
    each = " UNION ALL ".join(f"SELECT doc, o_orderkey, 'n' || o_orderkey AS node, {o} AS ord, '{a}' AS arg, {v} AS value, CASE WHEN {_ARG} = '{a}' THEN {_V0} {f'ELSE CAST(o_orderkey % 10 AS VARCHAR)' if a == 'Level' else ''} END AS held FROM o WHERE doc % 31 > 0 AND o_orderkey % 3 = 0 AND {_HAS}" for a, v, o in _PA)
    return f"""{_O}, pa AS ({each}), ac AS (SELECT *, CASE WHEN held IS NULL THEN 'appended' WHEN value IS NOT NULL AND {due} AND trim(held) <> value THEN 'updated' ELSE 'kept' END AS action FROM pa)"""


@query(f"WITH {_args_sql('fill_missing')} SELECT doc, node, arg, CASE WHEN action = 'kept' THEN held ELSE value END AS value, action FROM ac")
def fused_arguments(spark, d):
    return _fused(spark, d, "fill_missing")[1]


@query(f"WITH {_args_sql('overwrite')} SELECT doc, node, arg, CASE WHEN action = 'kept' THEN held ELSE value END AS value, action FROM ac")
def fused_arguments_overwrite(spark, d):
    return _fused(spark, d, "overwrite")[1]


_NEWCLASS = "CASE o_orderkey % 5 WHEN 0 THEN 'New &amp; C' ELSE o_orderpriority END"


def _xml_sql(mode: str) -> str:
    esc = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    arg = "CASE WHEN coalesce(value, '') = '' THEN '<Arg ArgName=\"' || arg || '\" />' ELSE '<Arg ArgName=\"' || arg || '\">' || " + esc.format(x="value") + " || '</Arg>' END"
    shown = lambda name, v: f"CASE WHEN {v} = '' THEN '<Arg ArgName=\"' || {name} || '\" />' ELSE '<Arg ArgName=\"' || {name} || '\">' || {v} || '</Arg>' END"
    return f"""{_args_sql(mode)},
ups AS (SELECT doc, o_orderkey, max(value) FILTER (action = 'updated' AND arg = 'DID') AS did, max(value) FILTER (action = 'updated' AND arg = 'Level') AS level, coalesce(string_agg({arg}, '' ORDER BY ord) FILTER (action = 'appended'), '') AS more FROM ac GROUP BY ALL),
base AS (SELECT o.doc, o.i, o.o_orderkey, {_ARG} AS a0, CASE WHEN {_ARG} = 'DID' THEN coalesce(did, {_V0}) WHEN {_ARG} = 'Level' THEN coalesce(level, {_V0}) ELSE {_V0} END AS v0, CASE WHEN {_ARG} = 'Level' THEN CAST(o.o_orderkey % 10 AS VARCHAR) ELSE coalesce(level, CAST(o.o_orderkey % 10 AS VARCHAR)) END AS v1, coalesce(more, '') AS more FROM o LEFT JOIN ups USING (doc, o_orderkey) WHERE o.doc % 31 > 0),
scripts AS (SELECT b.doc, string_agg('<ScriptNode Name="n' || o_orderkey || '" DeadMS="0"' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' RetryTimes="1"' END || ' ScriptType="' || {_TYPE} || '" InteruptStart="false" ClassName="' || CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'New &amp; C' ELSE o_orderpriority END ELSE o_orderpriority END || '"><Args>' || {shown('a0', 'v0')} || {shown("'Level'", 'v1')} || more || '</Args></ScriptNode>', '' ORDER BY i) AS s FROM base b JOIN orders USING (o_orderkey) GROUP BY b.doc),
xa AS (SELECT o_orderkey, string_agg({arg}, '' ORDER BY ord) AS args FROM ({' UNION ALL '.join(f"SELECT o_orderkey, {o} AS ord, '{a}' AS arg, {v} AS value FROM orders WHERE o_orderkey % 3 = 1 AND {_HAS}" for a, v, o in _PA)}) GROUP BY o_orderkey),
new AS (SELECT o_custkey AS doc, o_orderkey % 4 AS step, o_orderkey % 7 AS row, 'x' || o_orderkey AS node, '<ScriptNode Name="x' || o_orderkey || '" DeadMS="0" RetryTimes="' || (o_orderkey % 2) || '" ScriptType="NORMAL" InteruptStart="false" ClassName="' || CASE o_orderkey % 5 WHEN 1 THEN '' ELSE {_NEWCLASS} END || '"' || CASE WHEN args IS NULL THEN ' />' ELSE '><Args>' || args || '</Args></ScriptNode>' END AS x FROM orders LEFT JOIN xa USING (o_orderkey) WHERE o_orderkey % 3 = 1),
steps AS (SELECT doc, step, CASE WHEN count(*) = 1 THEN any_value(x) ELSE '<ParallelNode Name="step_' || step || '_parallel" DeadMS="0"><Tasks>' || string_agg(x, '' ORDER BY row, node) || '</Tasks></ParallelNode>' END AS x FROM new GROUP BY doc, step),
ins AS (SELECT doc, string_agg(x, '' ORDER BY step) AS x FROM steps GROUP BY doc), r AS (SELECT doc, s, coalesce(x, '') AS x, CASE WHEN doc % 10 = 0 THEN 'Workflow' ELSE 'SerialNode' END AS root FROM scripts LEFT JOIN ins USING (doc))
SELECT doc, '<' || root || '><Serials>' || s || CASE WHEN root = 'Workflow' THEN '</Serials>' || x ELSE x || '</Serials>' END || '</' || root || '>' AS xml FROM r"""


@query("WITH " + _xml_sql("fill_missing"))
def fused_workflows(spark, d):
    """Whole documents: every base node and attribute in place, arguments filled and appended, missing nodes inserted by step."""
    return _fused(spark, d, "fill_missing")[0]


@query("WITH " + _xml_sql("overwrite"))
def fused_workflows_overwrite(spark, d):
    return _fused(spark, d, "overwrite")[0]


@query(f"""WITH {_args_sql('fill_missing')}, m AS (SELECT doc, o_orderkey, o_orderkey % 5 = 0 AS reclass FROM o WHERE doc % 31 > 0 AND o_orderkey % 3 = 0),
u AS (SELECT doc, o_orderkey, count_if(action = 'updated') AS up, count_if(action = 'appended') AS app FROM ac GROUP BY ALL), e AS (SELECT m.doc, reclass OR coalesce(up + app, 0) > 0 AS changed, coalesce(up, 0) AS up, coalesce(app, 0) AS app FROM m LEFT JOIN u USING (doc, o_orderkey)),
f AS (SELECT doc, count(*) AS matched, count_if(changed) AS changed, sum(up) AS up, sum(app) AS app FROM e GROUP BY doc), n AS (SELECT doc, count(*) AS k FROM o WHERE o_orderkey % 3 = 1 GROUP BY doc), d AS (SELECT DISTINCT doc FROM o WHERE doc % 31 > 0)
SELECT doc, CASE WHEN doc % 10 = 0 THEN 'Workflow' ELSE 'SerialNode' END AS root_tag, coalesce(matched, 0) AS matched_nodes, coalesce(changed, 0) + coalesce(k, 0) AS updated_nodes, coalesce(k, 0) AS inserted_nodes, 0 AS missing_nodes, CAST(coalesce(up, 0) AS BIGINT) AS updated_args, CAST(coalesce(app, 0) AS BIGINT) AS appended_args
FROM d LEFT JOIN f USING (doc) LEFT JOIN n USING (doc)""")
def fusion_stats(spark, d):
    return _fused(spark, d, "fill_missing")[2]
