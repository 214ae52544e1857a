"""Registered queries over benchmark and regression measures; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import measures as M
from quarry.plans.catalogue import _t, query
from quarry.sources import readers

# Line items as requests: durations, first tokens and token counts follow from quantity and keys.
_REQ = {
    "profile": "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'short' ELSE l_returnflag END",
    "duration": "CAST(l_quantity AS DOUBLE) / 4",
    "ttft": "CASE WHEN l_partkey % 7 > 0 THEN CAST(l_partkey % 50 AS DOUBLE) / 100 END",
    "prompt_tokens": "l_partkey % 900",
    "completion_tokens": "CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 400 END",
    "valid": "l_orderkey % 9 > 0",
    "xml_evaluated": "l_orderkey % 2 = 0",
    "xml_valid": "l_orderkey % 8 > 0",
}
_R = f"r AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{v} AS {k}' for k, v in _REQ.items())} FROM lineitem)"
_TIMED = """t AS (SELECT *, CASE WHEN ttft IS NOT NULL AND completion_tokens > 1 THEN floor(greatest(duration - ttft, 0) / (completion_tokens - 1) * 1e6 + 0.5e0) / 1e6 END AS tpot,
  floor(CASE WHEN duration > 0 AND completion_tokens > 0 THEN completion_tokens / duration ELSE 0 END * 1e6 + 0.5e0) / 1e6 AS tokens_per_second FROM r)"""


def _requests(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(v).alias(k) for k, v in _REQ.items()])


@query(f"WITH {_R}, {_TIMED} SELECT l_orderkey, l_linenumber, tpot, tokens_per_second FROM t")
def request_timing(spark, d):
    return M.timed(_requests(spark, d)).select("l_orderkey", "l_linenumber", "tpot", "tokens_per_second")


_SERIES = ", ".join(f"round(avg({s}), 6) AS {s}_mean, round(quantile_cont(CAST({s} AS DOUBLE), 0.5), 6) AS {s}_p50, round(quantile_cont(CAST({s} AS DOUBLE), 0.95), 6) AS {s}_p95" for s in M.SERIES)


@query(f"""WITH {_R}, {_TIMED} SELECT coalesce(profile, 'default') AS profile, count(*) AS requests, count_if(valid) AS n_valid, count_if(NOT valid) AS n_invalid, round(count_if(valid) / count(*), 6) AS success_rate,
  CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens_total, round(sum(duration), 6) AS wall_seconds, round(count_if(valid) / sum(duration), 6) AS requests_per_second, count_if(xml_evaluated) AS xml_samples,
  round(count_if(xml_evaluated AND xml_valid) / count_if(xml_evaluated), 6) AS xml_valid_rate, {_SERIES} FROM t GROUP BY 1""")
def replay_metrics(spark, d):
    return M.replay(M.timed(_requests(spark, d)), "profile")


@query("""WITH g AS (SELECT o_orderpriority AS class, o_orderkey % 4 > 0 AS valid, o_orderkey % 5 = 0 AS needs_review, o_custkey % 3 AS repairs, o_custkey % 1000 AS prompt_tokens, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 100 AS DOUBLE) / 10 END AS latency, CAST(o_custkey % 2 AS DOUBLE) AS repair_latency FROM orders)
SELECT class, count(*) AS generations, count_if(valid) AS n_valid, count_if(needs_review) AS n_review, CAST(sum(repairs) AS BIGINT) AS n_repairs, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, round(coalesce(avg(nullif(latency, 0)), 0), 6) AS mean_latency, round(coalesce(avg(nullif(repair_latency, 0)), 0), 6) AS mean_repair_latency FROM g GROUP BY class""")
def generation_metrics(spark, d):
    g = _t(spark, d, "orders").selectExpr("o_orderpriority AS class", "o_orderkey % 4 > 0 AS valid", "o_orderkey % 5 = 0 AS needs_review", "o_custkey % 3 AS repairs", "o_custkey % 1000 AS prompt_tokens", "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 100 AS DOUBLE) / 10 END AS latency", "CAST(o_custkey % 2 AS DOUBLE) AS repair_latency")
    return M.generation_metrics(g, "class")


_CORR = "SELECT CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN '' ELSE l_linestatus END AS arg, CASE WHEN l_tax > 0.05 THEN 'semantic_default' ELSE l_returnflag END AS source FROM lineitem"


@query(f"WITH c AS ({_CORR}) SELECT 'arg' AS dimension, coalesce(nullif(arg, ''), 'unknown') AS key, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown'), count(*) FROM c GROUP BY ALL")
def guardrail_counts(spark, d):
    c = _t(spark, d, "lineitem").selectExpr("CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN '' ELSE l_linestatus END AS arg", "CASE WHEN l_tax > 0.05 THEN 'semantic_default' ELSE l_returnflag END AS source")
    return M.correction_counts(c)


@query("""WITH s AS (SELECT s_name AS name, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 7 AS DOUBLE) / 3 END AS rps, CAST(s_acctbal AS DOUBLE) AS ttft, CAST(NULL AS DOUBLE) AS tps FROM supplier),
f AS (SELECT name, round(coalesce(rps, 0), 6) AS requests_per_second, round(coalesce(ttft, 0), 6) AS ttft_p95, round(coalesce(tps, 0), 6) AS tokens_per_second FROM s)
SELECT *, row_number() OVER (ORDER BY requests_per_second DESC, name) AS rank FROM f""")
def scenario_ranking(spark, d):
    return M.ranked_scenarios(_t(spark, d, "supplier").selectExpr("s_name AS name", "CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 7 AS DOUBLE) / 3 END AS requests_per_second", "CAST(s_acctbal AS DOUBLE) AS ttft_p95", "CAST(NULL AS DOUBLE) AS tokens_per_second"))


_STATUS = "CASE o_custkey % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'blocked' WHEN 3 THEN 'dry_run' ELSE 'passed' END"


@query(f"SELECT o_orderpriority AS class, count(*) AS scenarios, " + ", ".join(f"count_if({_STATUS} = '{s}') AS {s}" for s in ("passed", "failed", "blocked", "dry_run")) + " FROM orders GROUP BY o_orderpriority")
def acceptance_summary(spark, d):
    return M.acceptance(_t(spark, d, "orders").selectExpr("o_orderpriority AS class", f"{_STATUS} AS status"), "class")


@query("""WITH c AS (SELECT o_orderpriority AS class, CASE WHEN o_custkey % 3 = 0 THEN 'pipeline' ELSE 'regression' END AS stage, o_orderkey AS ord, concat('c', o_custkey) AS name FROM orders WHERE NOT o_custkey % 6 > 0)
SELECT class, rank, stage, name FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY CASE WHEN stage = 'pipeline' THEN 0 ELSE 1 END, ord) AS rank FROM c) WHERE rank <= 30""")
def acceptance_failures(spark, d):
    return M.failed_samples(_t(spark, d, "orders").selectExpr("o_orderpriority AS class", "CASE WHEN o_custkey % 3 = 0 THEN 'pipeline' ELSE 'regression' END AS stage", "o_orderkey AS ord", "concat('c', o_custkey) AS name", "o_custkey % 6 > 0 AS passed"), "class")


@query("""WITH r AS (SELECT c_custkey AS run, c_custkey % 6 AS iterations, c_nationkey % 2 AS warmups, c_custkey % 3 AS n_timeout, c_custkey % 4 AS n_failed FROM customer)
SELECT run, array_to_string(list_filter([CASE WHEN iterations < 4 THEN concat('measured_iterations ', iterations, ' is below recommended minimum 4') END, CASE WHEN warmups <= 0 THEN 'warmup_iterations is 0; first-sample cold effects may affect metrics' END,
  CASE WHEN n_timeout > 0 THEN 'one or more samples timed out' END, CASE WHEN n_failed > 0 THEN 'one or more samples failed' END], lambda x: x IS NOT NULL), ' | ') AS warnings FROM r""")
def run_warnings(spark, d):
    runs = _t(spark, d, "customer").selectExpr("c_custkey AS run", "c_custkey % 6 AS iterations", "c_nationkey % 2 AS warmups", "c_custkey % 3 AS n_timeout", "c_custkey % 4 AS n_failed")
    return M.quality_warnings(runs, 4).select("run", F.array_join("warnings", " | ").alias("warnings"))


_JSON = "concat('{\"rows\": ', s_suppkey, ', \"rate\" : ', s_nationkey, '.5, \"ok\": true, \"name\": \"', s_name, '\", \"text\": \"12\", \"none\": null, \"neg\": -', s_suppkey % 3, '}')"


@query("""WITH v AS (SELECT s_nationkey % 4 AS run, unnest([('stdout_rows', CAST(s_suppkey AS DOUBLE)), ('stdout_rate', s_nationkey + 0.5e0), ('stdout_neg', CAST(-(s_suppkey % 3) AS DOUBLE))]) AS p FROM supplier)
SELECT run, p[1] AS key, count(*) AS n, round(avg(p[2]), 6) AS mean, min(p[2]) + 0 AS min, max(p[2]) + 0 AS max FROM v GROUP BY ALL""")
def stdout_metrics(spark, d):
    done = M.stdout_series(_t(spark, d, "supplier").selectExpr("s_nationkey % 4 AS run", f"{_JSON} AS stdout"), "run")
    return done.withColumns({"min": F.col("min") + 0.0, "max": F.col("max") + 0.0})


@query("""WITH b AS (SELECT event_type AS name, sum(user_id % 100) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT event_type AS name, sum(user_id % 100) AS v FROM events GROUP BY 1)
SELECT concat('delta_', regexp_replace(concat('app:', a.name, '-total '), '[^a-zA-Z0-9_]+', '_', 'g').trim('_')) AS metric, round(CAST(a.v - coalesce(b.v, 0) AS DOUBLE), 6) AS value FROM a LEFT JOIN b USING (name)
UNION ALL SELECT concat('after_', regexp_replace(concat('app:', name, '-total '), '[^a-zA-Z0-9_]+', '_', 'g').trim('_')), CAST(v AS DOUBLE) FROM a""")
def observability_metrics(spark, d):
    from quarry.operators import reporting

    ev = _t(spark, d, "events").selectExpr("concat('app:', event_type, '-total ') AS name", "cast(user_id % 100 AS double) AS value", "event_id")
    total = ev.groupBy("name").agg(F.sum("value").alias("value"))
    return M.observability(reporting.metric_delta(ev.filter("event_id % 2 = 0"), ev), total)


@query("""WITH o AS (SELECT l_orderkey AS op, CASE WHEN l_linenumber = 2 THEN 'Dense' WHEN l_linenumber = 1 THEN NULL ELSE 'sparse' END AS source, CASE WHEN l_partkey % 20 = 0 THEN ['SPARSE', 'DENSE'] END AS hs, CASE WHEN l_suppkey % 9 = 0 THEN 3 END AS n FROM lineitem)
SELECT op, bool_or(lower(coalesce(source, '')) = 'dense' OR list_contains(list_transform(coalesce(hs, []), lambda x: lower(x)), 'dense') OR coalesce(n, 0) > 0) AS present FROM o GROUP BY op""")
def retrieval_source_presence(spark, d):
    ops = _t(spark, d, "lineitem").selectExpr("l_orderkey AS op", "CASE WHEN l_linenumber = 2 THEN 'Dense' WHEN l_linenumber = 1 THEN NULL ELSE 'sparse' END AS source", "CASE WHEN l_partkey % 20 = 0 THEN array('SPARSE', 'DENSE') END AS hybrid_sources", "CASE WHEN l_suppkey % 9 = 0 THEN 3 END AS n_trace")
    return M.source_presence(ops, "dense")


@query("SELECT l_returnflag AS source, round(coalesce(avg(CASE WHEN l_returnflag <> 'A' AND l_linenumber > 2 THEN CAST(l_quantity AS DOUBLE) / 100 END), 0), 6) AS mean_latency FROM lineitem GROUP BY l_returnflag")
def retrieval_latency(spark, d):
    return M.mean_latency(_t(spark, d, "lineitem").selectExpr("l_returnflag AS source", "CASE WHEN l_returnflag <> 'A' AND l_linenumber > 2 THEN CAST(l_quantity AS DOUBLE) / 100 END AS latency"), "source")


_NODE = {"n_kept": "o_custkey % 4", "n_decisions": "o_custkey % 3", "document": "CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'not_found' WHEN 2 THEN '' ELSE concat('c', o_custkey) END", "has_reference": "o_custkey % 5 > 1", "flowchart_status": "CASE WHEN o_orderkey % 2 = 0 THEN 'found' ELSE 'not_found' END"}


@query(f"""WITH n AS (SELECT o_orderpriority AS class, {', '.join(f'{v} AS {k}' for k, v in _NODE.items())} FROM orders)
SELECT class, count(*) AS nodes, round(count_if(n_kept > 0) / count(*), 6) AS kept_coverage, round(coalesce(count_if(has_reference AND flowchart_status = 'found') / nullif(count_if(has_reference), 0), 0), 6) AS reference_rate,
  round(count_if(coalesce(document, '') NOT IN ('', 'not_found', 'not_available', 'not_applicable')) / count(*), 6) AS document_coverage, round(count_if(n_decisions > 0) / count(*), 6) AS trace_coverage FROM n GROUP BY class""")
def chain_metrics(spark, d):
    return M.chain_metrics(_t(spark, d, "orders").selectExpr("o_orderpriority AS class", *[f"{v} AS {k}" for k, v in _NODE.items()]), "class")


@query("SELECT o_orderpriority AS class, count_if(o_orderstatus = 'F') AS \"F\", count_if(o_orderstatus = 'O') AS \"O\", count_if(o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority")
def audit_status_counts(spark, d):
    return M.status_counts(_t(spark, d, "orders").withColumnRenamed("o_orderpriority", "class"), "class", "o_orderstatus", ["F", "O", "P"])


@query("SELECT endpoint, request_id, age FROM (SELECT event_type AS endpoint, event_id AS request_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 256")
def route_trace(spark, d):
    return M.latest_routes(_t(spark, d, "events").selectExpr("event_type AS endpoint", "event_id AS request_id", "ts AS at"), "endpoint").select("endpoint", "request_id", "age")


_PATHS = "SELECT l_suppkey AS node, 'p' || (l_partkey % 15) AS path, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS ord FROM lineitem"


@query(f"""WITH f AS (SELECT node, path, min(ord) AS ord, count(*) AS n FROM ({_PATHS}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ord, path) AS rank FROM f)
SELECT node, CAST(sum(n) AS BIGINT) AS original_paths, count_if(rank <= 6) AS kept_paths, string_agg(path, ' | ' ORDER BY rank) FILTER (rank <= 6) AS paths FROM r GROUP BY node""")
def budgeted_graph_paths(spark, d):
    return M.budgeted_paths(_t(spark, d, "lineitem").selectExpr("l_suppkey AS node", "concat('p', l_partkey % 15) AS path", "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS ord"), 6)


_LINE = "concat(CASE event_id % 7 WHEN 0 THEN '# HELP ' ELSE '' END, 'app_', event_type, CASE event_id % 5 WHEN 0 THEN '_bucket' ELSE '' END, CASE event_id % 3 WHEN 0 THEN concat('{le=\"', user_id, '\"}') WHEN 1 THEN concat('{user=\"', repeat('u', cast(user_id % 200 AS int)), '\"}') ELSE '' END, ' ', user_id, '.5')"


@query("""WITH e AS (SELECT 'app_' || event_type AS name, user_id + 0.5e0 AS n, user_id % 200 AS len, event_id FROM events WHERE event_id % 7 > 0 AND event_id % 5 > 0 AND event_id % 3 > 0)
SELECT name, round(sum(n), 6) AS value FROM e WHERE event_id % 3 = 2 OR len <= 120 GROUP BY name""")
def metric_lines(spark, d):
    return readers.parse_prometheus(_t(spark, d, "events").select(F.expr(_LINE).alias("value")))
