"""Registered queries over template families and audit issues; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import audit
from quarry.operators import families as FM
from quarry.plans.catalogue import _t, _values, query

_SIG = "SELECT 'F' || (l_suppkey % 20) AS family, CASE l_linenumber % 4 WHEN 0 THEN 'service' WHEN 1 THEN 'arg' WHEN 2 THEN 'marker' ELSE 'response' END AS kind, CASE WHEN l_partkey % 5 > 0 THEN 'i' || (l_partkey % 60) WHEN l_partkey % 10 = 0 THEN '' END AS item FROM lineitem"


def _sig(spark, d):
    return _t(spark, d, "lineitem").selectExpr("concat('F', l_suppkey % 20) AS family", "CASE l_linenumber % 4 WHEN 0 THEN 'service' WHEN 1 THEN 'arg' WHEN 2 THEN 'marker' ELSE 'response' END AS kind", "CASE WHEN l_partkey % 5 > 0 THEN concat('i', l_partkey % 60) WHEN l_partkey % 10 = 0 THEN '' END AS item")


@query(f"SELECT DISTINCT family, kind, item FROM ({_SIG}) WHERE item <> ''")
def family_signatures(spark, d):
    return FM.merged_items(_sig(spark, d))


@query("SELECT 'F' || (l_suppkey % 20) AS family, 'tag' || (l_partkey % 9) AS name, max(l_quantity) AS n, arg_max(l_returnflag, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey) AS type FROM lineitem GROUP BY 1, 2")
def family_tag_counts(spark, d):
    return FM.merged_counts(_t(spark, d, "lineitem").selectExpr("concat('F', l_suppkey % 20) AS family", "concat('tag', l_partkey % 9) AS name", "l_quantity AS n", "l_returnflag AS type", "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS source"))


@query("""WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS template_id, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS class_name, CASE WHEN o_orderkey % 4 > 0 THEN 'n' || (o_orderkey % 25) ELSE '' END AS node_name, o_orderkey AS ord FROM orders),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ord) AS r FROM t) WHERE r = 1), u AS (SELECT 'class' AS index, class_name AS key, template_id FROM f UNION ALL SELECT 'node', node_name, template_id FROM f)
SELECT index, key, string_agg(template_id, ',' ORDER BY template_id) AS templates FROM u WHERE key <> '' GROUP BY index, key""")
def template_indexes(spark, d):
    return FM.indexes(_t(spark, d, "orders").selectExpr("cast(o_custkey AS string) AS template_id", "CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS class_name", "CASE WHEN o_orderkey % 4 > 0 THEN concat('n', o_orderkey % 25) ELSE '' END AS node_name", "o_orderkey AS ord"))


_KEY = "trim(upper(regexp_replace(coalesce({c}, ''), '[^0-9A-Za-z]+', ' ', 'g')))"


@query(f"WITH a AS (SELECT DISTINCT {_KEY.format(c='alias')} AS alias, family FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN '--' WHEN p_partkey % 9 = 1 THEN NULL ELSE 'Type_' || (p_partkey % 30) || '-read' END AS alias, 'F' || (p_partkey % 7) AS family FROM part)) SELECT alias, string_agg(family, ',' ORDER BY family) AS families FROM a WHERE alias <> '' GROUP BY alias")
def family_alias_index(spark, d):
    return FM.alias_index(_t(spark, d, "part").selectExpr("CASE WHEN p_partkey % 9 = 0 THEN '--' WHEN p_partkey % 9 = 1 THEN NULL ELSE concat('Type_', p_partkey % 30, '-read') END AS alias", "concat('F', p_partkey % 7) AS family"))


_MARKS = [*dict.fromkeys((*FM.EVIDENCE, *FM.HINTS)), "fault_handling"]
_PICK = " || ".join(f"CASE WHEN c_custkey % {i + 2} = 0 THEN ['{m}'] ELSE [] END" for i, m in enumerate(_MARKS))
_LISTED = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_EV = " || ".join([f"CASE WHEN list_contains(ms, '{m}') THEN {_LISTED(xs)} ELSE [] END" for m, xs in FM.EVIDENCE.items()])
_HI = " || ".join([f"CASE WHEN list_contains(ms, '{m}') THEN {_LISTED(xs)} ELSE [] END" for m, xs in FM.HINTS.items()])


@query(f"""WITH m AS (SELECT c_custkey AS family, {_PICK} AS ms, c_custkey % 3 = 0 AS fl, c_custkey % 4 > 0 AS sv FROM customer)
SELECT family, array_to_string(list_sort(['template_xml_example'] || CASE WHEN fl THEN ['flowchart_description'] ELSE [] END || CASE WHEN sv THEN ['uds_service_flow'] ELSE [] END || {_EV}), ',') AS evidence, array_to_string(list_sort({_LISTED(FM.ALWAYS_HINTS)} || {_HI}), ',') AS hints FROM m""")
def family_requirements(spark, d):
    marks = F.array_compact(F.array(*[F.when(F.col("c_custkey") % (i + 2) == 0, F.lit(m)) for i, m in enumerate(_MARKS)]))
    return FM.requirements(_t(spark, d, "customer").select(F.col("c_custkey").alias("family"), marks.alias("markers"), F.expr("c_custkey % 3 = 0").alias("has_flowchart"), F.expr("c_custkey % 4 > 0").alias("has_service")))


FAMILIES = [("DTC_Read", ["DTC_Read_Type1", "DTC_Read_Type2"], ["DTC Read", "dtc-read snapshot"]), ("DTC_Clear", ["DTC_Clear_Type2"], ["DTC Clear", "clear all dtc"]), ("Write", ["Information_Write_Type3"], ["Information Write", "Write Data By Id"])]
_NAMES = ["DTC_Read_Type1", "DTC Clear", "Information_Write_Type3", "clear_all_dtc", "other thing", "write data by"]
_NODE = {"node": "concat(CASE o_custkey % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('_', o_orderkey) END, '/', o_orderkey)", "template": "CASE o_orderkey % 5 WHEN 0 THEN 'DTC_Read_Type2' WHEN 1 THEN 'DTC-Clear' WHEN 2 THEN 'write_data' ELSE '' END", "node_family": "CASE o_custkey % 4 WHEN 0 THEN 'DTC_Clear' WHEN 1 THEN 'Write' ELSE 'None' END", "template_family": "CASE o_orderkey % 5 WHEN 0 THEN 'DTC_Read' WHEN 1 THEN 'DTC_Clear' ELSE 'Other' END"}
_FAM = f"fam(family, classes, aliases) AS (VALUES {', '.join(f"('{f}', {_LISTED(c)}, {_LISTED(a)})" for f, c, a in FAMILIES)})"
_W = "list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> ''))"
_J = f"CASE WHEN len({_W.format(c='a')}) = 0 OR len({_W.format(c='q')}) = 0 THEN 0e0 ELSE len(list_intersect({_W.format(c='a')}, {_W.format(c='q')})) / len(list_distinct({_W.format(c='a')} || {_W.format(c='q')})) END"


@query(f"""WITH {_FAM}, n AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _NODE.items())} FROM orders), k AS (SELECT family, {_KEY.format(c='x')} AS a FROM (SELECT family, unnest(aliases) AS x FROM fam)),
q AS (SELECT DISTINCT node, i, q FROM (SELECT node, 1 AS i, {_KEY.format(c='node')} AS q FROM n UNION ALL SELECT node, 2, {_KEY.format(c='template')} FROM n)),
h AS (SELECT node, family, a, i, CASE WHEN q <> '' AND q = a THEN {FM.ALIAS}e0 WHEN {_J} >= {FM.LIKE} THEN {_J} * {FM.NEAR} END AS s FROM q, k WHERE a <> ''),
al AS (SELECT node, family, sum(s) AS s FROM (SELECT node, family, a, arg_min(s, i) AS s FROM h WHERE s IS NOT NULL GROUP BY node, family, a) GROUP BY node, family),
t AS (SELECT n.node, fam.family, round(CASE WHEN list_contains(classes, template) THEN {FM.EXACT} ELSE 0 END + CASE WHEN template_family = fam.family THEN {FM.GENERAL} ELSE 0 END + CASE WHEN node_family = fam.family THEN {FM.OF_NODE} ELSE 0 END + coalesce(al.s, 0), 6) AS score
  FROM n CROSS JOIN fam LEFT JOIN al ON al.node = n.node AND al.family = fam.family),
b AS (SELECT node, arg_min({{'f': family, 's': CAST(score AS DOUBLE)}}, (-score, family)) AS x FROM t WHERE score > 0 GROUP BY node)
SELECT n.node, x.f AS family, x.s AS score, CASE WHEN x IS NULL THEN 'not_found' WHEN x.s >= {FM.FOUND} THEN 'found' ELSE 'ambiguous' END AS status FROM n LEFT JOIN b USING (node)""")
def family_resolution(spark, d):
    nodes = _t(spark, d, "orders").select(*[F.expr(v).alias(k) for k, v in _NODE.items()])
    return FM.resolve(nodes, spark.createDataFrame(FAMILIES, "family string, classes array<string>, aliases array<string>"))


_MISS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in FM.MISSING.items()) + " END"
_CODE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in FM.MISSING.items()) + " END"


@query(f"""WITH s AS ({_SIG}), e AS (SELECT DISTINCT family AS template, kind, CASE WHEN item = 'i7' THEN 'fault_handling' ELSE item END AS item FROM s WHERE item <> ''), a AS (SELECT DISTINCT family AS template, kind, item FROM s WHERE item <> '' AND substr(item, 2) > '3')
SELECT template, {_MISS} AS severity, {_CODE} AS code, item FROM e ANTI JOIN a USING (template, kind, item) WHERE item <> 'fault_handling'""")
def family_conformity(spark, d):
    s = FM.merged_items(_sig(spark, d)).withColumnRenamed("family", "template")
    expected = s.withColumn("item", F.when(F.col("item") == "i7", F.lit("fault_handling")).otherwise(F.col("item"))).distinct()
    return FM.missing_parts(expected, s.filter("substr(item, 2) > '3'"))


_ST = "CASE o_custkey % 4 WHEN 0 THEN 'node_missing_in_base' WHEN 1 THEN 'node_missing_in_fused' WHEN 2 THEN 'conflict' ELSE 'ok' END"


@query(f"""WITH i AS (SELECT o_orderkey AS node, {_ST} AS status, 'a' || (o_custkey % 9) AS arg, o_orderkey % 3 = 0 AS requires_review FROM orders)
SELECT node, CASE WHEN status = 'node_missing_in_fused' THEN 'error' ELSE 'warning' END AS severity, CASE status WHEN 'node_missing_in_base' THEN 'WORKFLOW_NODE_MISSING_IN_BASE' WHEN 'node_missing_in_fused' THEN 'WORKFLOW_NODE_MISSING_IN_FUSED' ELSE 'WORKFLOW_ARG_REVIEW_REQUIRED' END AS code, arg
FROM i WHERE status IN ('node_missing_in_base', 'node_missing_in_fused') OR requires_review""")
def audit_issues(spark, d):
    return FM.audit_issues(_t(spark, d, "orders").selectExpr("o_orderkey AS node", f"{_ST} AS status", "concat('a', o_custkey % 9) AS arg", "o_orderkey % 3 = 0 AS requires_review"))


@query("""WITH n AS (SELECT DISTINCT o_custkey AS node FROM orders), b AS (SELECT DISTINCT c_custkey AS node FROM customer WHERE c_custkey % 3 > 0), f AS (SELECT DISTINCT c_custkey AS node FROM customer WHERE c_custkey % 5 > 0)
SELECT node, '*' AS arg, CASE WHEN node NOT IN (SELECT node FROM f) THEN 'node_missing_in_fused' ELSE 'node_missing_in_base' END AS status, true AS needs_review FROM n WHERE node NOT IN (SELECT node FROM f) OR node NOT IN (SELECT node FROM b)""")
def missing_workflow_nodes(spark, d):
    nodes = lambda c: _t(spark, d, "customer").filter(c).selectExpr("c_custkey AS node")
    return audit.missing_nodes(_t(spark, d, "orders").selectExpr("o_custkey AS node"), nodes("c_custkey % 3 > 0"), nodes("c_custkey % 5 > 0"))
