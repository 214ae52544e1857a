"""Registered queries over XML node tables built from ``part`` and ``orders`` rows; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import families as FM
from quarry.operators import planning
from quarry.operators import xml_nodes as X
from quarry.plans.catalogue import _spread, _t, query

# One expression for both engines: a task node per part; some do not parse, have another root, or lack a section.
_TASK = """concat(CASE WHEN p_partkey % 17 = 0 THEN '<SerialNode>' WHEN p_partkey % 11 = 0 THEN '<x:TaskNode xmlns:x="urn:x">' ELSE '<TaskNode Name="t">' END,
 CASE WHEN p_partkey % 19 = 0 THEN '' ELSE '<MainNodes><MainNode/></MainNodes>' END, '<CVNodes><CreateVarNode Name="v', CAST(p_partkey % 4 AS STRING), '" Type="int"/><CreateVarNode Name="w', CAST(p_partkey % 3 AS STRING), '"/></CVNodes><FlowsNodes>',
 CASE WHEN p_partkey % 23 = 0 THEN '' ELSE '<NormalBoxNode/>' END,
 CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('<CallFunctionNode FunctionName="Lib.SendUDSRawData"><Param Value="0x22F1', CAST(p_partkey % 10 AS STRING), '0"/><Param Value="0x', substr(p_type, 1, 1), CAST(p_partkey % 90 + 10 AS STRING), '"/><Param Value="0x', CAST(p_partkey % 90 + 10 AS STRING), '01"/></CallFunctionNode>') END,
 '<AssignNode LeftVar="r', CAST(p_partkey % 6 AS STRING), '">', CASE p_partkey % 4 WHEN 0 THEN '_argLibrary.Get("DID")' WHEN 1 THEN 'RetryCount - 1' WHEN 2 THEN 'AllowedNRC 2703' ELSE '' END, ' _argLibrary.Get("A', CAST(p_partkey % 7 AS STRING), '") 0x6', CAST(p_partkey % 10 AS STRING), 'aa 0x3101</AssignNode>',
 CASE WHEN p_partkey % 6 = 0 THEN '<GotoPair/>' ELSE '' END, '</FlowsNodes>',
 CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN '</SerialNode>' WHEN p_partkey % 11 = 0 THEN '</x:TaskNode>' ELSE '</TaskNode>' END)"""
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_FIRST = "substr({v}, 3, 2)"
_ALL = r"regexp_extract_all(xml, '{p}', {g})"
_HEX = f"list_transform({_ALL.format(p='0x[0-9A-Fa-f]+', g=0)}, lambda h: upper(h))"
_SENT = "list_transform(regexp_extract_all(regexp_extract(xml, '<CallFunctionNode.*</CallFunctionNode>'), '0x[0-9A-Fa-f]+'), lambda h: upper(h))"
_JOIN = "array_to_string(list_sort(list_distinct({x})), ',')"
_KEPT = lambda xs, known: f"list_filter({xs}, lambda h: {_FIRST.format(v='h')} IN ({_IN(known)}))"
_MARK = " || ".join(f"CASE WHEN {' OR '.join(f'contains(xml, {chr(39)}{w}{chr(39)})' for w in ws)} THEN ['{k}'] ELSE [] END" for k, ws in X.MARKERS.items())
_SIGNED = f"""x AS (SELECT p_partkey AS doc, {_TASK.replace('STRING', 'VARCHAR')} AS xml FROM part),
s AS (SELECT doc, xml, {_KEPT(_SENT, X.REQUESTS)} AS sent, {_HEX} AS hexes FROM x WHERE doc % 13 > 0 AND doc % 17 > 0),
r AS (SELECT *, CASE WHEN len(sent) > 0 THEN sent ELSE {_KEPT('hexes', X.REQUESTS)} END AS requests, {_KEPT('hexes', X.RESPONSES)} AS responses,
  {_MARK} || CASE WHEN contains(replace(xml, ' ', ''), '{X.RETRY_LESS}') THEN ['retry_decrement'] ELSE [] END || CASE WHEN contains(xml, '<GotoPair') THEN ['branching'] ELSE [] END AS markers FROM s)"""


def _tasks(spark, d):
    return _spread(_t(spark, d, "part")).selectExpr("p_partkey AS doc", f"{_TASK} AS xml")


def _joined(found):
    return found.select("doc", *[F.array_join(F.array_sort(c), ",").alias(c) for c in found.columns if c != "doc"])


@query(f"""WITH {_SIGNED}, tags AS (SELECT doc, string_agg(tag || '=' || n, ',' ORDER BY tag || '=' || n) AS tag_counts FROM (SELECT doc, tag, count(*) AS n FROM (SELECT doc, unnest({_ALL.format(p='<(?:x:)?([A-Za-z]+)', g=1)}) AS tag FROM s) GROUP BY ALL) GROUP BY doc)
SELECT doc, {_JOIN.format(x="list_transform(" + _ALL.format(p='<CreateVarNode (Name="[^"]*"(?: Type="[^"]*")?)', g=1) + ", lambda v: regexp_extract(v, 'Name=\"([^\"]*)', 1) || '=' || regexp_extract(v, 'Type=\"([^\"]*)', 1))")} AS create_vars,
  {_JOIN.format(x=_ALL.format(p='Get[(]"([^"]+)', g=1))} AS arg_names, {_JOIN.format(x=_ALL.format(p='FunctionName="([^"]+)', g=1))} AS function_names, {_JOIN.format(x=_ALL.format(p='LeftVar="([^"]+)', g=1))} AS assigned_vars,
  {_JOIN.format(x='hexes')} AS hex_literals, {_JOIN.format(x='requests')} AS request_literals, {_JOIN.format(x='responses')} AS response_literals, {_JOIN.format(x='markers')} AS logic_markers, tag_counts,
  {_JOIN.format(x="list_transform(requests, lambda h: " + _FIRST.format(v='h') + ")")} AS service_ids, {_JOIN.format(x="list_transform(responses, lambda h: " + _FIRST.format(v='h') + ")")} AS positive_responses FROM r JOIN tags USING (doc)""")
def tasknode_signatures(spark, d):
    return _joined(X.signatures(X.node_table(_tasks(spark, d))))


_CLASS = "concat('ECU', CAST(p_partkey % 5 AS STRING), CASE p_partkey % 3 WHEN 0 THEN '_DTC_Read_Type' WHEN 1 THEN '_dtc_clear_type' ELSE '-plain-' END, CAST(p_partkey % 4 AS STRING))"
_FAMILY = "CASE p_partkey % 3 WHEN 0 THEN 'DTC_Read_Type' || (p_partkey % 4) WHEN 1 THEN 'DTC_Clear_Type' || (p_partkey % 4) ELSE 'ECU' || (p_partkey % 5) || '_plain_' || (p_partkey % 4) END"


@query(f"""WITH {_SIGNED}, f AS (SELECT p_partkey AS doc, {_FAMILY} AS family FROM part),
i AS (SELECT doc, unnest([{{'kind': 'service', 'v': list_transform(requests, lambda h: {_FIRST.format(v='h')})}}, {{'kind': 'response', 'v': list_transform(responses, lambda h: {_FIRST.format(v='h')})}}, {{'kind': 'arg', 'v': {_ALL.format(p='Get[(]"([^"]+)', g=1)}}}, {{'kind': 'marker', 'v': markers}}, {{'kind': 'function', 'v': {_ALL.format(p='FunctionName="([^"]+)', g=1)}}}]) AS k FROM r)
SELECT family, k.kind AS kind, item, count(DISTINCT doc) AS n_templates FROM (SELECT family, doc, k, unnest(k.v) AS item FROM i JOIN f USING (doc)) WHERE item <> '' GROUP BY ALL""")
def template_family_registry(spark, d):
    """Registry of families: what the signatures of their templates hold, and how many of them hold it."""
    tasks = _spread(_t(spark, d, "part")).selectExpr("p_partkey", f"{_TASK} AS xml", f"{_CLASS} AS class_name")
    # The family is part of a document's key, so that it need not be joined.
    keyed = tasks.select(F.struct("p_partkey", planning.family_id(F.col("class_name")).alias("family")).alias("doc"), "xml")
    return FM.registry(X.signature_items(X.signatures(X.node_table(keyed))).withColumn("family", F.col("doc.family")))


_TN = [("17 = 0", "TASKNODE_ROOT_MISMATCH", "'SerialNode'"), ("19 = 0", "TASKNODE_MISSING_MAINNODES", "NULL"), ("19 = 0", "TASKNODE_MISSING_MAINNODE", "NULL"), ("23 = 0", "TASKNODE_MISSING_FLOW_BOX", "NULL")]


@query("SELECT p_partkey AS doc, 'error' AS severity, 'TASKNODE_XML_PARSE_ERROR' AS code, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS INT) AS place FROM part WHERE p_partkey % 13 = 0 AND p_partkey % 29 > 0 UNION ALL SELECT p_partkey, 'error', 'TASKNODE_XML_EMPTY', NULL, NULL FROM part WHERE p_partkey % 29 = 0 " + " ".join(f"UNION ALL SELECT p_partkey, 'error', '{code}', {item}, NULL FROM part WHERE p_partkey % 13 > 0 AND p_partkey % 29 > 0 AND p_partkey % {when}" for when, code, item in _TN))
def tasknode_validation(spark, d):
    docs = _tasks(spark, d).withColumn("xml", F.when(F.col("doc") % 29 > 0, F.col("xml")).otherwise(F.when(F.col("doc") % 2 > 0, F.lit(" \n"))))
    return X.tasknode_issues(docs, X.node_table(docs))


# A workflow per customer: each order is a script node with two arguments, some of them wrong.
_SCRIPT = """concat('<ScriptNode Name="n', CAST(o_orderkey AS STRING), '" DeadMS="0"', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' RetryTimes="1"' END, ' ScriptType="', CASE o_orderkey % 5 WHEN 0 THEN 'START' WHEN 1 THEN 'LATE' WHEN 2 THEN '' ELSE 'NORMAL' END, '" InteruptStart="false" ClassName="', o_orderpriority, '"><Args><Arg ArgName="', CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'DID' ELSE 'Level' END, '">',
 CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '{{value}}' ELSE CAST(o_orderkey AS STRING) END, '</Arg><Arg ArgName="Level">', CAST(o_orderkey % 10 AS STRING), '</Arg></Args></ScriptNode>')"""
_O = f"o AS (SELECT o_custkey AS doc, o_orderkey, {_SCRIPT.replace('STRING', 'VARCHAR')} AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE TRUE)"
_PLACE = "CAST(4 * i - 2 AS INT)"
_TYPE = "CASE o_orderkey % 5 WHEN 0 THEN 'START' WHEN 1 THEN 'LATE' WHEN 2 THEN '' ELSE 'NORMAL' END"
_ARG = "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'DID' ELSE 'Level' END"
_VALUE = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '{{value}}' ELSE CAST(o_orderkey AS VARCHAR) END"


def _workflows(spark, d):
    """One document per customer; its serial node holds a list element, so that the script of order i stands at 4 i - 2."""
    scripts = _t(spark, d, "orders").selectExpr("o_custkey AS doc", "o_orderkey", f"{_SCRIPT} AS s")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "s"))), lambda x: x["s"]), "")
    root = F.when(F.col("doc") % 10 == 0, F.lit("Workflow")).otherwise(F.lit("SerialNode"))
    whole = scripts.groupBy("doc").agg(body.alias("b"))
    return whole.select("doc", F.concat(F.lit("<"), root, F.lit("><Serials>"), "b", F.when(F.col("doc") % 31 == 0, F.lit("")).otherwise(F.lit("</Serials>")), F.lit("</"), root, F.lit(">")).alias("xml"))


@query(f"""WITH {_O}, ok AS (SELECT * FROM o WHERE doc % 31 > 0), d AS (SELECT doc, count(*) AS n, bool_or({_TYPE} = 'END') AS ends, bool_or(o_orderkey % 4 = 1) AS open FROM ok GROUP BY doc),
a AS (SELECT doc, {_ARG} AS arg, {_VALUE} AS value, 2 * i AS pos FROM ok UNION ALL SELECT doc, 'Level', CAST(o_orderkey % 10 AS VARCHAR), 2 * i + 1 FROM ok),
f AS (SELECT doc, arg, arg_min(value, pos) AS value FROM a WHERE arg IN ('DID', 'Level') GROUP BY ALL), w AS (SELECT doc, unnest(['DID', 'Level', 'Session']) AS arg FROM d), q AS (SELECT w.*, value FROM w LEFT JOIN f USING (doc, arg))
SELECT doc, 'error' AS severity, code, item, place FROM (
  SELECT DISTINCT doc, 'XML_PARSE_ERROR' AS code, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS INT) AS place FROM o WHERE doc % 31 = 0
  UNION ALL SELECT doc, 'UNSUPPORTED_ROOT_TAG', 'Workflow', 0 FROM d WHERE doc % 10 = 0 UNION ALL SELECT doc, 'PLACEHOLDER_REMAINS', NULL, NULL FROM d WHERE open
  UNION ALL SELECT doc, 'SCRIPT_NODE_COUNT_TOO_LOW', CAST(n AS VARCHAR), NULL FROM d WHERE n < 5 UNION ALL SELECT doc, 'REQUIRED_SCRIPT_TYPE_MISSING', 'END', NULL FROM d WHERE NOT ends
  UNION ALL SELECT doc, 'SCRIPT_NODE_ATTR_MISSING', array_to_string(CASE WHEN o_orderkey % 7 = 0 THEN ['RetryTimes'] ELSE [] END || CASE WHEN o_orderkey % 5 = 2 THEN ['ScriptType'] ELSE [] END, ', '), {_PLACE} FROM ok WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 2
  UNION ALL SELECT doc, 'INVALID_SCRIPT_TYPE', 'LATE', {_PLACE} FROM ok WHERE o_orderkey % 5 = 1 UNION ALL SELECT doc, 'ARG_NAME_MISSING', NULL, {_PLACE} + 2 FROM ok WHERE o_orderkey % 6 = 0
  UNION ALL SELECT doc, CASE WHEN value IS NULL THEN 'REQUIRED_ARG_MISSING' ELSE 'REQUIRED_ARG_EMPTY' END, arg, NULL FROM q WHERE value IS NULL OR value = '')""")
def workflow_validation(spark, d):
    docs = _workflows(spark, d)
    return X.xml_issues(docs, X.node_table(docs), ["DID", "Level", "Session"], ["END"], min_scripts=5)


@query(f"WITH {_O} SELECT doc, CASE WHEN doc % 10 = 0 THEN 'Workflow' ELSE 'SerialNode' END AS root_tag, count(*) AS script_nodes, CASE WHEN doc % 10 = 0 THEN 0 ELSE 1 END AS serial_nodes, 0 AS parallel_nodes, 2 * count(*) AS args FROM o WHERE doc % 31 > 0 GROUP BY doc")
def workflow_xml_stats(spark, d):
    return X.xml_stats(X.node_table(_workflows(spark, d)))


@query(f"""WITH {_O}, a AS (SELECT doc, o_orderkey, {_ARG} AS arg, replace({_VALUE}, '', '') AS v, o_orderkey % 4 = 0 AS blank, 1 AS p FROM o WHERE doc % 31 > 0 UNION ALL SELECT doc, o_orderkey, 'Level', CAST(o_orderkey % 10 AS VARCHAR), false, 2 FROM o WHERE doc % 31 > 0),
f AS (SELECT doc, o_orderkey, arg, arg_min(CASE WHEN blank THEN ' ' ELSE v END, p) AS value, min(p) AS p FROM a WHERE arg <> '' GROUP BY ALL)
SELECT doc, 'n' || o_orderkey AS name, row_number() OVER (PARTITION BY doc, o_orderkey ORDER BY p) AS position, arg, value FROM f""")
def workflow_script_args(spark, d):
    """First argument of each name of the first script node of each name."""
    nodes = X.node_table(_workflows(spark, d))
    scripts = X.first_scripts(nodes).select("doc", F.col("pre").alias("script"), "name")
    return X.script_args(nodes).join(scripts, ["doc", "script"]).select("doc", "name", "position", "arg", "value")


_PS = {"plan": "o_custkey", "step": "CAST(o_orderkey % 100 AS INT)", "node": "CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'n{{x}}' ELSE concat('n', o_orderkey % 12) END", "class": "CASE o_orderkey % 8 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE o_orderpriority END"}
_PA = {"plan": "o_custkey", "step": "CAST(l_orderkey % 100 AS INT)", "ord": "(l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey", "arg": "CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'DID' ELSE concat('a', l_partkey % 4) END", "value": "CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{{v}}' WHEN 2 THEN ' ' ELSE 'x' END", "n_evidence": "CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 END"}
_COLS = lambda m: ", ".join(f"{v} AS {k}" for k, v in m.items())


@query(f"""WITH s AS (SELECT {_COLS(_PS)} FROM orders), n AS (SELECT o_custkey AS plan, CAST(o_orderkey % 100 AS INT) AS step, CASE WHEN o_orderkey % 3 = 0 THEN ['DID', 'level'] ELSE [] END AS missing FROM orders WHERE o_orderkey % 10 > 0),
a AS (SELECT {_COLS(_PA)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT plan, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT plan, count(*) AS n FROM s GROUP BY plan) FULL JOIN (SELECT plan, count(*) AS m FROM n GROUP BY plan) USING (plan)),
l AS (SELECT plan, step, max(ord) AS ord FROM a WHERE arg = 'DID' GROUP BY ALL), q AS (SELECT s.plan, s.step, l.ord, a.value FROM s LEFT JOIN l ON s.plan = l.plan AND s.step = l.step LEFT JOIN a ON a.plan = l.plan AND a.step = l.step AND a.ord = l.ord AND a.arg = 'DID')
SELECT plan, severity, code, item, step FROM (
  SELECT plan, 'error' AS severity, 'SCRIPT_NODE_COUNT_TOO_LOW' AS code, CAST(n AS VARCHAR) AS item, CAST(NULL AS INT) AS step FROM c WHERE n < 6 UNION ALL SELECT plan, 'error', 'PLAN_NODE_COUNT_MISMATCH', NULL, NULL FROM c WHERE n <> m
  UNION ALL SELECT plan, 'error', 'DUPLICATE_SCRIPT_NODE', node, NULL FROM s GROUP BY plan, node HAVING count(*) > 1 UNION ALL SELECT plan, 'error', 'SCRIPT_NODE_NAME_MISSING', NULL, step FROM s WHERE trim(node) = ''
  UNION ALL SELECT plan, 'error', 'SCRIPT_CLASS_NAME_MISSING', node, step FROM s WHERE trim(coalesce(class, '')) = '' UNION ALL SELECT plan, 'error', 'XML_PLAN_PLACEHOLDER_REMAINS', node, step FROM s WHERE contains(node, '{{{{x}}}}')
  UNION ALL SELECT plan, 'error', 'XML_PLAN_ARG_NAME_MISSING', NULL, step FROM a WHERE arg = '' UNION ALL SELECT plan, 'error', 'XML_PLAN_PLACEHOLDER_REMAINS', arg, step FROM a WHERE value = '{{{{v}}}}'
  UNION ALL SELECT plan, 'error', 'XML_PLAN_ARG_EVIDENCE_MISSING', arg, step FROM a WHERE n_evidence IS NULL UNION ALL SELECT plan, 'warning', 'XML_PLAN_FIELD_MISSING', unnest(missing), step FROM n
  UNION ALL SELECT plan, 'error', CASE WHEN ord IS NULL THEN 'XML_PLAN_REQUIRED_ARG_MISSING' ELSE 'XML_PLAN_REQUIRED_ARG_EMPTY' END, 'DID', step FROM q WHERE ord IS NULL OR trim(coalesce(value, '')) = '')""")
def plan_validation(spark, d):
    orders = _t(spark, d, "orders")
    scripts = orders.selectExpr(*[f"{v} AS {k}" for k, v in _PS.items()])
    args = _t(spark, d, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(*[f"{v} AS {k}" for k, v in _PA.items()])
    nodes = orders.filter("o_orderkey % 10 > 0").selectExpr("o_custkey AS plan", "cast(o_orderkey % 100 AS int) AS step", "CASE WHEN o_orderkey % 3 = 0 THEN array('DID', 'level') ELSE cast(array() AS array<string>) END AS missing")
    return X.plan_issues(scripts, args, nodes, ["DID"], require_evidence=True, min_scripts=6)
