"""Registered queries over workflows, evidence chains, prompts and graphs; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.text import comparable
from quarry.operators import audit, evidence, graph, planning, prompts, reporting
from quarry.plans.catalogue import _STATUS, _VALUE, _edges, _t, _tok, _values, query

_CAND = {
    "target": "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'BCM' ELSE 'ecm1' END",
    "unit": "CASE doc_id % 3 WHEN 0 THEN 'BCM2' WHEN 1 THEN 'ECM1' END",
    "module": "CASE doc_id % 7 WHEN 0 THEN 'eol_process' WHEN 6 THEN NULL ELSE 'ecu_parameter' END",
    "title": "CASE doc_id % 11 WHEN 0 THEN 'Revision History' WHEN 1 THEN 'BCM9 and TCAM-2 setup' WHEN 2 THEN 'about ecm1' END",
    "content": "CASE WHEN doc_id % 13 = 0 THEN ' <br> ' WHEN doc_id % 13 = 1 THEN concat('contents ', text) ELSE text END",
    "score": "CAST(doc_id % 40 AS DOUBLE)",
}
_PLAIN = "regexp_replace(coalesce(content, ''), '<[^>]+>', ' ', 'g')"
_OK = "(u <> '' AND t <> '' AND (starts_with(u, t) OR list_contains({tok}, t)))".format(tok=f"list_transform(regexp_extract_all(u, '{evidence.WORD}'), lambda w: regexp_replace(lower(w), '^0x', ''))")


@query(f"""WITH c AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _CAND.items())} FROM documents),
n AS (SELECT *, {_PLAIN} AS p, upper(coalesce(unit, '')) AS u, upper(coalesce(target, '')) AS t,
  list_distinct(list_transform(regexp_extract_all(concat_ws(' ', coalesce(title, ''), regexp_replace(substr(content, 1, 500), '<[^>]+>', ' ', 'g')), '{evidence.UNIT}', 1), lambda x: upper(x))) AS named FROM c),
o AS (SELECT *, {_OK} AS fits FROM n),
s AS (SELECT doc_id, count(*) FILTER (NOT fits) > 0 AS strange FROM (SELECT doc_id, t, {_OK} AS fits FROM (SELECT doc_id, t, unnest(named) AS u FROM n)) GROUP BY doc_id),
r AS (SELECT o.*, CASE WHEN NOT regexp_matches(p, '\\S') OR (length(p) > 3000 AND contains(array_to_string({_tok('substr(p, 1, 1000)')}, ' '), 'contents')) OR contains(lower(coalesce(title, '')), 'revision history') OR contains(lower(coalesce(title, '')), 'requirement log') THEN 'noise'
  WHEN module = 'eol_process' THEN 'public_process_keep' WHEN t <> '' AND u <> '' AND NOT fits AND module = 'ecu_parameter' THEN 'explicit_ecu_conflict'
  WHEN t <> '' AND fits AND coalesce(strange, false) THEN 'local_ecu_context_conflict' ELSE 'generic_keep' END AS reason FROM o LEFT JOIN s USING (doc_id))
SELECT doc_id, reason, CASE WHEN reason IN ('noise', 'explicit_ecu_conflict') THEN 'drop' WHEN reason = 'local_ecu_context_conflict' THEN 'demote' ELSE 'keep' END AS decision,
  CASE WHEN reason = 'local_ecu_context_conflict' THEN greatest(score - 20, 0) ELSE score END AS score FROM r""")
def filter_evidence_context(spark, d):
    c = _t(spark, d, "documents").select("doc_id", *[F.expr(v).alias(k) for k, v in _CAND.items()])
    return evidence.decide(c).select("doc_id", "reason", "decision", "score")


_CHAIN = {
    "node": "l_orderkey",
    "evidence_id": "l_orderkey * 10 + l_linenumber",
    "module": "CASE l_returnflag WHEN 'R' THEN 'ecu_parameter' WHEN 'A' THEN 'eol_process' END",
    "role": "CASE l_partkey % 5 WHEN 0 THEN 'section_text' WHEN 1 THEN 'table' WHEN 2 THEN 'table_row' WHEN 3 THEN 'flowchart_title' ELSE 'paragraph' END",
    "source": "CASE WHEN l_linestatus = 'O' THEN 'parent_context' ELSE 'hybrid' END",
    "score": "l_quantity",
}
_CHAIN_SQL = f"""c AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _CHAIN.items())}, bool_or(l_suppkey % 3 = 0) OVER (PARTITION BY l_orderkey, l_linenumber) AS hop FROM lineitem),
k AS (SELECT *, coalesce(module, '') = 'ecu_parameter' AS param, source = 'parent_context' AS parent, role IN ('section_text', 'table') AS wide FROM c),
r AS (SELECT *, CASE WHEN param AND parent AND wide THEN 0 WHEN param AND role = 'section_text' THEN 1 WHEN param AND role = 'table' THEN 2 WHEN param AND role = 'table_row' THEN 3
    WHEN parent AND wide THEN 4 WHEN role = 'section_text' THEN 5 WHEN role = 'table' THEN 6 WHEN role = 'table_row' THEN 7 ELSE 8 END AS p,
  CASE WHEN role = 'flowchart_title' AND hop THEN 0 WHEN role = 'flowchart_title' OR coalesce(module, '') = 'eol_process' THEN 1 END AS f FROM k),
report AS (SELECT node, (list(evidence_id ORDER BY p, score DESC, evidence_id))[1] AS parameter_id, (list(evidence_id ORDER BY f, score DESC, evidence_id) FILTER (f IS NOT NULL))[1] AS flowchart_id, count(*) AS n_kept FROM r GROUP BY node)"""


@query(f"WITH {_CHAIN_SQL} SELECT * FROM report")
def evidence_chain_report(spark, d):
    li = _t(spark, d, "lineitem").select(*[F.expr(v).alias(k) for k, v in _CHAIN.items()], (F.col("l_suppkey") % 3 == 0).alias("reached"))
    return evidence.primary(li.drop("reached"), li.filter("reached"))


@query(f"WITH {_CHAIN_SQL} SELECT count(*) AS nodes, round(count(parameter_id) / count(*), 6) AS parameter_coverage, round(count(flowchart_id) / count(*), 6) AS flowchart_coverage FROM report")
def evidence_chain_coverage(spark, d):
    return evidence.coverage(evidence_chain_report(spark, d))


CONTRACT = [("1-URGENT", "status", True), ("2-HIGH", "status", False), ("3-MEDIUM", "other", True)]
_CONTRACT_SQL = f"k(class, arg, by_contract) AS (VALUES {_values(CONTRACT).replace('True', 'true').replace('False', 'false')})"
_RESOLVE = f"""WITH j AS (SELECT CAST(o_orderkey AS VARCHAR) AS node, o_orderpriority AS class, 'status' AS arg, {', '.join(f'{v} AS {k}_value' for k, v in _VALUE.items())}, o_orderkey % 2 = 0 AS required FROM orders),
s AS (SELECT node, class, arg, {_STATUS} AS status FROM j), {_CONTRACT_SQL},
r AS (SELECT s.*, k.class IS NOT NULL AS allowed, coalesce(by_contract, false) AS needed, s.class IN (SELECT class FROM k) AS has FROM s LEFT JOIN k USING (class, arg)),
a AS (SELECT *, CASE WHEN status = 'extra_plan_arg_ignored' THEN 'ignore_plan_arg|0.9' WHEN status IN ({', '.join(f"'{x}'" for x in audit.SETTLED)}) THEN 'no_action|1'
  WHEN status = 'plan_arg_missing_in_fused' THEN CASE WHEN has AND NOT allowed THEN 'ignore_plan_arg|0.9' WHEN has AND needed THEN 'append_plan_arg|0.75' WHEN has THEN 'needs_review|0.4' ELSE 'needs_review|0.2' END
  WHEN status = 'plan_conflict_kept_base' THEN CASE WHEN allowed THEN 'keep_base|0.65' ELSE 'keep_base|0.8' END ELSE 'needs_review|0.25' END AS x FROM r),
d AS (SELECT node, class, arg, status, allowed, split_part(x, '|', 1) AS action, CAST(split_part(x, '|', 2) AS DOUBLE) AS confidence, split_part(x, '|', 1) IN ('keep_base', 'needs_review') AS requires_review FROM a)"""


def _order_side(spark, d, key):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").cast("string").alias("node"), F.lit("status").alias("arg"))
    return o.select("node", "arg", F.expr(_VALUE[key]).alias("value"))


@query(f"{_RESOLVE} SELECT * FROM d")
def resolve_actions(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("node"), F.col("o_orderpriority").alias("class"), F.lit("status").alias("arg"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    audited = audit.audit(*(_order_side(spark, d, k) for k in ("plan", "base", "fused")), o.filter("even"))
    return audit.resolve(audited, o.select("node", "class"), spark.createDataFrame(CONTRACT, "class string, arg string, required boolean"))


@query(f"{_RESOLVE} SELECT action, count(*) AS n, count(*) FILTER (requires_review) AS n_review FROM d GROUP BY action")
def resolution_summary(spark, d):
    return resolve_actions(spark, d).groupBy("action").agg(F.count("*").alias("n"), F.count_if("requires_review").alias("n_review"))


@query(f"""WITH j AS (SELECT {_VALUE['plan']} AS want, {_VALUE['fused']} AS got, o_orderkey % 17 <> 0 AS there FROM orders)
SELECT count(*) AS total, count(*) FILTER (there AND want IS NOT DISTINCT FROM got) AS met, count(*) FILTER (NOT there) AS absent, round(count(*) FILTER (there AND want IS NOT DISTINCT FROM got) / count(*), 6) AS accuracy FROM j""")
def golden_accuracy(spark, d):
    return audit.golden_accuracy(_order_side(spark, d, "plan"), _order_side(spark, d, "fused").filter("CAST(node AS BIGINT) % 17 <> 0"))


_WANT = "concat('0x', lpad(CAST(p_partkey AS STRING), 6, '0'))"
_GOT = "CASE p_partkey % 4 WHEN 0 THEN concat(' 0X', CAST(p_partkey AS STRING)) WHEN 1 THEN CAST(p_partkey AS STRING) WHEN 2 THEN NULL ELSE concat('0x', CAST(p_partkey + 1 AS STRING)) END"


@query(f"""WITH v AS (SELECT p_partkey AS node, 'id' AS arg, {_WANT} AS expected, {_GOT} AS raw FROM part),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(raw, '\\s+', '', 'g')), '^0x', ''), '^0+(.)', '\\1') AS a, regexp_replace(regexp_replace(expected, '^0x', ''), '^0+(.)', '\\1') AS b FROM v)
SELECT node, arg, raw, expected, CASE WHEN raw IS NULL THEN 'added' WHEN a <> b THEN 'replaced' ELSE 'kept' END AS action FROM k""")
def guardrail_corrections(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.lit("id").alias("arg"), F.expr(_WANT).alias("want"), F.expr(_GOT).alias("got"))
    return audit.guardrails(p.filter("got IS NOT NULL").select("node", "arg", F.col("got").alias("value")), p.select("node", "arg", F.col("want").alias("value")))


_LEFT = "CASE p_partkey % 6 WHEN 0 THEN concat('0x00', p_partkey) WHEN 1 THEN concat('A ', p_partkey, ' b ') WHEN 2 THEN concat('zz', p_partkey) WHEN 3 THEN NULL WHEN 4 THEN CAST(p_partkey AS {s}) ELSE '0' END"
_RIGHT = "CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey AS {s}) WHEN 1 THEN concat('a', p_partkey, 'B') WHEN 2 THEN concat('zy', p_partkey) WHEN 3 THEN '' WHEN 4 THEN CAST(p_partkey + 1 AS {s}) ELSE '0x000' END"


@query("SELECT p_partkey AS id, p_partkey % 6 IN (0, 1, 3, 5) AS same FROM part")
def value_equivalence(spark, d):
    pairs = _t(spark, d, "part").selectExpr("p_partkey AS id", _LEFT.format(s="string") + " AS a", _RIGHT.format(s="string") + " AS b")
    return pairs.select("id", (comparable(F.col("a")) == comparable(F.col("b"))).alias("same"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
SELECT *, CASE WHEN total = 1 THEN 'NORMAL' WHEN position = 1 THEN 'START' WHEN position = total THEN 'END' ELSE 'NORMAL' END AS script_type FROM n""")
def plan_positions(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return planning.positions(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "position", "total", "script_type")


@query(f"""WITH d AS (SELECT o_orderkey AS k, {_VALUE['base']} AS d FROM orders WHERE o_orderkey % 8 <> 1), g AS (SELECT o_orderkey AS k, {_VALUE['plan']} AS g FROM orders WHERE o_orderkey % 8 <> 2)
SELECT CAST(k AS VARCHAR) AS node, 'status' AS arg, coalesce(g, d) AS value FROM d FULL JOIN g USING (k)""")
def default_args(spark, d):
    return planning.merge_args(_order_side(spark, d, "base").filter("CAST(node AS BIGINT) % 8 <> 1"), _order_side(spark, d, "plan").filter("CAST(node AS BIGINT) % 8 <> 2"))


# Class names as templates write them, and the family of each.
CLASSES = [("Adcu_dtc_clear_type7", "DTC_Clear_Type7"), ("x DTC-Clear-Type7", "DTC_Clear_Type7"), ("BCM_vmm_Change", "VMM_Change"), ("io_control_TYPE12", "IO_Control_Type12"), ("own class", "own_class"), ("--", "unknown_template_family"), (None, "unknown_template_family")]
_CLASS = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN " + (f"'{c}'" if c else "NULL") for i, (c, _) in enumerate(CLASSES)) + " ELSE concat(c_nationkey, '_Routine_control_type', c_custkey % 3) END"
_FAMILY = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, (_, f) in enumerate(CLASSES)) + " ELSE 'Routine_Control_Type' || (c_custkey % 3) END"


@query(f"SELECT {_FAMILY} AS family, count(DISTINCT c_custkey) AS n_templates, count(DISTINCT {_CLASS}) AS n_classes FROM customer GROUP BY 1")
def template_families(spark, d):
    return planning.families(_t(spark, d, "customer").selectExpr("c_custkey AS template", f"{_CLASS} AS class"))


# A plan per customer: orders are script nodes, in steps by their keys, every second one with two arguments.
_SCRIPT = {"plan": "CAST(o_custkey AS {s})", "step": "CAST(o_orderkey % 3 AS INT)", "row": "CAST(o_orderkey % 5 AS INT)", "node": "concat('a<', o_orderkey)", "class": "concat('C&', o_orderpriority)", "script_type": "CASE o_orderkey % 2 WHEN 0 THEN 'START' ELSE 'NORMAL' END"}


@query(f"""WITH n AS (SELECT {', '.join(f"{v.replace('{s}', 'VARCHAR')} AS {k}" for k, v in _SCRIPT.items())}, o_orderkey AS k FROM orders),
t AS (SELECT plan, step, string_agg('<ScriptNode Name="a&lt;' || k || '" DeadMS="0" RetryTimes="0" ScriptType="' || script_type || '" ClassName="' || replace(class, '&', '&amp;') || '"' || CASE WHEN k % 2 = 0 THEN '><Args><Arg ArgName="DID">x &amp; ' || k || '</Arg>' || CASE WHEN k % 4 = 0 THEN '<Arg ArgName="Note" />' ELSE '<Arg ArgName="Note"></Arg>' END || '</Args></ScriptNode>' ELSE ' />' END, '' ORDER BY row, node) AS x, count(*) AS c FROM n GROUP BY plan, step),
b AS (SELECT plan, string_agg(CASE WHEN c = 1 THEN x ELSE '<ParallelNode Name="step_' || step || '_parallel" DeadMS="0"><Tasks>' || x || '</Tasks></ParallelNode>' END, '' ORDER BY step) AS body FROM t GROUP BY plan)
SELECT plan, '<SerialNode Name="' || plan || '" DeadMS="0"><Serials>' || body || '</Serials></SerialNode>' AS xml FROM b""")
def xml_render(spark, d):
    orders = _t(spark, d, "orders")
    nodes = orders.selectExpr(*[f"{v.replace('{s}', 'string')} AS {k}" for k, v in _SCRIPT.items()])
    args = orders.filter("o_orderkey % 2 = 0").selectExpr("cast(o_custkey AS string) AS plan", "concat('a<', o_orderkey) AS node", "inline(array(struct(2 AS position, 'Note' AS arg, CASE WHEN o_orderkey % 4 > 0 THEN '' END AS value), struct(1 AS position, 'DID' AS arg, concat('x & ', o_orderkey) AS value)))")
    return planning.render(nodes, args)


_KEY = "substr(regexp_replace(content, '\\s+', ' ', 'g'), 1, 512)"
_ROOM = "greatest(1, (60 - used) * 4)"


@query(f"""WITH RECURSIVE m AS (SELECT conv_id, CAST(turn AS VARCHAR) AS label, CAST(turn % 3 AS DOUBLE) AS score, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS content FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, label, content) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM m),
f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS labels, CAST([] AS VARCHAR[]) AS keys, CAST([] AS VARCHAR[]) AS shown, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL SELECT conv_id, pos, CASE WHEN ok THEN list_append(labels, label) ELSE labels END, CASE WHEN ok THEN list_append(keys, key) ELSE keys END,
    CASE WHEN ok THEN list_append(shown, '[' || label || ']' || chr(10) || cut) ELSE shown END, CASE WHEN ok THEN used + greatest(1, CAST(ceil(length(cut) / 4.0) AS BIGINT)) ELSE used END, n
  FROM (SELECT *, content <> '' AND NOT list_contains(labels, label) AND NOT list_contains(keys, key) AND len(labels) < 8 AND used < 60 AS ok,
      CASE WHEN greatest(1, ceil(length(content) / 4.0)) > 60 - used AND length(content) > {_ROOM}
        THEN regexp_replace(substr(content, 1, greatest(1, {_ROOM} - {len(prompts.CUT)})), '\\s+$', '') || chr(10) || '{prompts.CUT.strip()}' ELSE content END AS cut
    FROM (SELECT o.*, f.labels, f.keys, f.shown, f.used, {_KEY} AS key FROM f JOIN o ON o.conv_id = f.conv_id AND o.pos = f.pos + 1)))
SELECT conv_id, array_to_string(labels, ',') AS kept, used AS used_tokens, CAST(n - len(labels) AS BIGINT) AS n_dropped, array_to_string(shown, chr(10) || chr(10)) AS context FROM f WHERE pos = n AND pos > 0""")
def prompt_budget_sections(spark, d):
    s = _t(spark, d, "conversations").select("conv_id", F.col("turn").cast("string").alias("label"), (F.col("turn") % 3).cast("double").alias("score"), "text")
    return prompts.budget_sections(s, "conv_id", 60)


@query("""WITH e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
s AS (SELECT DISTINCT a AS start FROM e WHERE a LIKE 'r%'),
h1 AS (SELECT start, b AS node FROM (SELECT start, b, row_number() OVER (PARTITION BY start ORDER BY b) AS k FROM (SELECT DISTINCT start, b FROM s JOIN e ON a = start)) WHERE k <= 3),
h2 AS (SELECT start, b AS node FROM (SELECT start, b, row_number() OVER (PARTITION BY start ORDER BY b) AS k FROM (SELECT DISTINCT start, b FROM h1 JOIN e ON a = node)) WHERE k <= 3)
SELECT start, start AS node, 0 AS depth FROM s UNION ALL SELECT start, node, 1 FROM h1 UNION ALL SELECT start, node, 2 FROM h2""")
def reference_expand(spark, d):
    e = _edges(spark, d).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return graph.expand(e, e.filter("source LIKE 'r%'").select(F.col("source").alias("node")).distinct(), 2, 3)


@query("""SELECT l_partkey AS node_id, count(DISTINCT l_orderkey) AS n_evidence, min(l_orderkey) AS first_evidence,
  (list(l_returnflag ORDER BY l_orderkey * 10 + l_linenumber DESC) FILTER (l_returnflag <> 'N'))[1] AS label FROM lineitem GROUP BY l_partkey""")
def kg_node_merge(spark, d):
    label = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    m = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("evidence_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), label.alias("label"))
    return graph.merge_nodes(m)


@query("SELECT event_type, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS wall_s, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS per_second FROM events GROUP BY event_type")
def endpoint_throughput(spark, d):
    return reporting.endpoint_throughput(_t(spark, d, "events").select("event_type", "ts"), "event_type", "ts")


@query(f"SELECT item, count(*) AS count FROM (SELECT unnest({_tok('text')}) AS item FROM documents) GROUP BY item ORDER BY count DESC, item LIMIT 20")
def frequent_tokens(spark, d):
    return reporting.most_frequent(_t(spark, d, "documents"), T.tokens(F.col("text")), 20)
