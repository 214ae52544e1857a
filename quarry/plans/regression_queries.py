"""Registered queries that judge a run per nation, with artifacts made from its orders; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import regression as G
from quarry.plans.catalogue import _t, _values, query
from quarry.plans.xml_queries import _O, _workflows

_EXPECT = [("flow_steps", "7 + n_nationkey % 2"), ("planned_nodes", "CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 600 END"), ("trace_operations", "500 + n_nationkey"), ("operation_xml_files", "20"), ("serial_script_nodes", "40"), ("fused_script_nodes_min", "300"), ("graph_entities_min", "100"), ("graph_paths_min", "1000 * (n_nationkey % 4)"), ("arg_selection_score_coverage_min", "0.74"), ("operation_graph_path_coverage_min", "0.66"), ("operation_retrieval_coverage_min", "0.8"), ("operation_dense_retrieval_coverage_min", "0.61"), ("operation_hybrid_retrieval_coverage_min", "0.2"), ("audit_review_items_max", "150"), ("resolution_review_required_max", "90 + n_nationkey")]
_OPS = "CASE o_orderkey % 5 WHEN 0 THEN {a}() WHEN 1 THEN {a}('sparse') WHEN 2 THEN {a}('dense') WHEN 3 THEN {a}('sparse', 'dense+sparse') ELSE {a}('hybrid', 'dense') END"
_KIND = "CASE doc % 7 WHEN 0 THEN 'serial' WHEN 1 THEN 'operation' ELSE 'fused' END"
_SELF = "n AS (SELECT c_nationkey AS workload, o.* FROM orders o JOIN customer ON o_custkey = c_custkey)"
_M = f"""{_SELF}, {_O}, dn AS (SELECT DISTINCT doc FROM o), x AS (SELECT c_nationkey AS workload, doc, {_KIND} AS kind FROM dn JOIN customer ON doc = c_custkey),
bad AS (SELECT DISTINCT doc FROM o WHERE doc % 31 = 0 OR doc % 10 = 0 OR o_orderkey % 4 = 1 OR o_orderkey % 7 = 0 OR o_orderkey % 5 IN (1, 2) OR o_orderkey % 6 = 0), sc AS (SELECT doc, count(*) AS s FROM o WHERE doc % 31 > 0 GROUP BY doc),
xs AS (SELECT x.*, coalesce(s, 0) AS s, bad.doc IS NULL AS ok FROM x LEFT JOIN sc USING (doc) LEFT JOIN bad ON bad.doc = x.doc),
a AS (SELECT workload, CASE WHEN l_partkey % 4 > 0 THEN 1 END AS score FROM n JOIN lineitem ON l_orderkey = o_orderkey),
m(workload, metric, value) AS (
  SELECT workload, unnest(['flow_steps', 'planned_nodes', 'trace_operations', 'graph_paths', 'operation_graph_path_coverage', 'operation_retrieval_coverage', 'operation_dense_retrieval_coverage', 'operation_hybrid_retrieval_coverage', 'graph_entities', 'graph_relations', 'audit_review_items', 'resolution_review_required']),
    unnest([count(DISTINCT o_orderkey % 8), count(*), count(*), sum(o_orderkey % 3), count_if(o_orderkey % 3 > 0) / count(*), count_if(o_orderkey % 5 > 0) / count(*), count_if(o_orderkey % 5 >= 2) / count(*), count_if(o_orderkey % 5 = 4) / count(*), count_if(o_orderkey % 2 = 0), count_if(o_orderkey % 2 = 1), count_if(o_orderkey % 4 = 0), count_if(o_orderkey % 6 = 0)]::DOUBLE[]) FROM n GROUP BY workload
  UNION ALL SELECT workload, unnest(['plan_args', 'arg_selection_score_coverage']), unnest([count(*), count(score) / count(*)]::DOUBLE[]) FROM a GROUP BY workload
  UNION ALL SELECT workload, unnest(['operation_xml_files', 'operation_xml_valid', 'serial_xml_valid', 'fused_xml_valid', 'serial_script_nodes', 'serial_parallel_nodes', 'fused_script_nodes', 'fused_parallel_nodes']),
    unnest([count_if(kind = 'operation'), count_if(kind = 'operation' AND ok), CAST(bool_and(CASE WHEN kind = 'serial' THEN ok END) AS INT), CAST(bool_and(CASE WHEN kind = 'fused' THEN ok END) AS INT), coalesce(sum(CASE WHEN kind = 'serial' THEN s END), 0), 0, coalesce(sum(CASE WHEN kind = 'fused' THEN s END), 0), 0]::DOUBLE[]) FROM xs GROUP BY workload)"""


def _metrics(spark, d):
    orders = _t(spark, d, "orders").join(_t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("workload")), F.expr("o_custkey = c_custkey"))
    args = _t(spark, d, "lineitem").join(orders.select("workload", "o_orderkey"), F.expr("l_orderkey = o_orderkey")).selectExpr("workload", "CASE WHEN l_partkey % 4 > 0 THEN 1 END AS selection_score")
    ops = orders.selectExpr("workload", "o_orderkey % 3 AS n_paths", _OPS.format(a="array").replace("array()", "cast(array() AS array<string>)") + " AS sources")
    graph = orders.selectExpr("workload", "CASE WHEN o_orderkey % 2 = 0 THEN 'entity' ELSE 'relation' END AS kind")
    decisions = orders.selectExpr("workload", "o_orderkey % 4 = 0 AS audit_review", "o_orderkey % 6 = 0 AS requires_review")
    docs = _workflows(spark, d).join(_t(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_nationkey").alias("workload")), "doc").withColumn("kind", F.expr(_KIND))
    return G.run_metrics(orders.selectExpr("workload", "o_orderkey % 8 AS step"), args, ops, graph, decisions, docs)


@query(f"WITH {_M} SELECT workload, metric, round(value, 6) AS value FROM m")
def regression_metrics(spark, d):
    return _metrics(spark, d).withColumn("value", F.round("value", 6))


_RULES = ", ".join(f"('{k}', '{G.EXPECTED_BY.get(k, k)}', '{m}', '{r}')" for k, m, r in G.CHECKS)
_SHOW = "printf('%.6f', {x})"
_HAVE = f"have AS (SELECT n_nationkey AS workload, unnest([{', '.join(repr(r) for r in G.REQUIRED)}]) AS name FROM nation)"
_GONE = "workload % 6 = 5 AND name = 'serial_xml'"


@query(f"""WITH {_M}, {_HAVE}, e AS (SELECT n_nationkey AS workload, unnest([{', '.join(f"'{k}'" for k, _ in _EXPECT)}]) AS name, unnest([{', '.join(v for _, v in _EXPECT)}]::DOUBLE[]) AS expected FROM nation), rules(check_name, name, metric, rule) AS (VALUES {_RULES}),
j AS (SELECT e.workload, check_name, rule, expected, value FROM e JOIN rules USING (name) LEFT JOIN m ON m.workload = e.workload AND m.metric = rules.metric WHERE expected IS NOT NULL),
c AS (SELECT c_nationkey AS workload, c_custkey AS node, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'v' END AS want, CASE WHEN c_custkey % 4 > 0 THEN 'v' END AS got FROM customer WHERE c_custkey % 5 = 0),
r AS (SELECT workload, check_name, CASE WHEN rule = '=' THEN '' ELSE rule || ' ' END || {_SHOW.format(x='expected')} AS expected, {_SHOW.format(x='value')} AS actual, coalesce(CASE rule WHEN '=' THEN value = expected WHEN '>=' THEN value >= expected ELSE value <= expected END, false) AS passed FROM j
  UNION ALL SELECT workload, metric, 'valid XML', CASE WHEN value = 1 THEN 'valid XML' ELSE 'invalid XML' END, value = 1 FROM m WHERE metric IN ('serial_xml_valid', 'fused_xml_valid')
  UNION ALL SELECT workload, 'critical_arg:' || node || '.DID', want, got, want IS NOT DISTINCT FROM got FROM c)
SELECT workload, 'artifact_exists:' || name AS check_name, 'existing path' AS expected, CASE WHEN NOT ({_GONE}) THEN 'existing path' END AS actual, NOT ({_GONE}) AS passed FROM have UNION ALL SELECT * FROM r WHERE workload % 6 <> 5""")
def regression_report(spark, d):
    nation = _t(spark, d, "nation")
    expected = nation.select(F.col("n_nationkey").alias("workload"), F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.expr(v).cast("double").alias("expected")) for k, v in _EXPECT])))
    have = nation.select(F.col("n_nationkey").alias("workload"), F.explode(F.array(*map(F.lit, G.REQUIRED))).alias("name")).filter(f"NOT ({_GONE})")
    customer = _t(spark, d, "customer").filter("c_custkey % 5 = 0").selectExpr("c_nationkey AS workload", "cast(c_custkey AS string) AS node", "'DID' AS arg", "CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'v' END AS value", "c_custkey % 4 > 0 AS there")
    return G.report(_metrics(spark, d), expected, have, customer.drop("there"), customer.filter("there").select("workload", "node", "arg", F.lit("v").alias("value")))
