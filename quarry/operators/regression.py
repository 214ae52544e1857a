"""Regression of workflow runs: metrics of each workload folded from its artifacts, and one row a declared check.

Every artifact is a table with a ``workload`` column, so any number of workloads is judged in one pass over each artifact: it
is aggregated to a few rows a workload, the metrics are stacked as (workload, metric, value), and the declared checks are
joined to them. A workload that lacks a required artifact is judged by that alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.xml_nodes import judged, node_table
from quarry.sources.workspace import written

# Artifacts that a run must have, and checks as (name, metric, rule); an expectation has the check's name.
REQUIRED = ["xml_plan", "flow_evidence_trace", "diagnostic_graph", "serial_xml", "fused_workflow", "arg_audit_report", "audit_resolution_report", "operation_xml_dir"]
CHECKS = [
    ("flow_steps", "flow_steps", "="), ("planned_nodes", "planned_nodes", "="), ("trace_operations", "trace_operations", "="), ("operation_xml_files", "operation_xml_files", "="), ("operation_xml_valid", "operation_xml_valid", "="),
    ("serial_script_nodes", "serial_script_nodes", "="), ("serial_parallel_nodes", "serial_parallel_nodes", "="), ("fused_script_nodes_min", "fused_script_nodes", ">="), ("fused_parallel_nodes_min", "fused_parallel_nodes", ">="),
    ("graph_entities_min", "graph_entities", ">="), ("graph_relations_min", "graph_relations", ">="), ("graph_paths_min", "graph_paths", ">="), ("arg_selection_score_coverage_min", "arg_selection_score_coverage", ">="),
    ("operation_graph_path_coverage_min", "operation_graph_path_coverage", ">="), ("operation_retrieval_coverage_min", "operation_retrieval_coverage", ">="), ("operation_dense_retrieval_coverage_min", "operation_dense_retrieval_coverage", ">="),
    ("operation_hybrid_retrieval_coverage_min", "operation_hybrid_retrieval_coverage", ">="), ("audit_review_items_max", "audit_review_items", "<="), ("resolution_review_required_max", "resolution_review_required", "<="),
]
#: The expectation that a check shares with another one.
EXPECTED_BY = {"operation_xml_valid": "operation_xml_files"}


def share(part, whole):
    """Unrounded share, 0 of nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def stacked(folded: DataFrame) -> DataFrame:
    """(workload, metric, value) of the columns of one row a workload."""
    names = [c for c in folded.columns if c != "workload"]
    return folded.select("workload", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias("metric", "value"))


def run_metrics(nodes: DataFrame, args: DataFrame, operations: DataFrame, graph: DataFrame, decisions: DataFrame, documents: DataFrame) -> DataFrame:
    """(workload, metric, value) of every artifact.

    ``nodes``: workload, step (planned nodes); ``args``: workload, selection_score; ``operations``: workload, n_paths, sources
    (array of the retrieval sources of its matches); ``graph``: workload, kind (entity or relation); ``decisions``: workload,
    audit_review, requires_review; ``documents``: workload, doc, kind (serial, fused or operation), xml.
    """
    c = F.col
    by = lambda df: df.groupBy("workload")
    has = lambda s: F.count_if(F.exists("sources", lambda x: F.contains(x, F.lit(s))))
    n = F.count("*")
    parts = [
        by(nodes).agg(F.countDistinct("step").alias("flow_steps"), n.alias("planned_nodes")),
        by(args).agg(n.alias("plan_args"), share(F.count("selection_score"), n).alias("arg_selection_score_coverage")),
        by(operations).agg(
            n.alias("trace_operations"), F.sum("n_paths").alias("graph_paths"), share(F.count_if(c("n_paths") > 0), n).alias("operation_graph_path_coverage"), share(F.count_if(F.size("sources") > 0), n).alias("operation_retrieval_coverage"),
            share(has("dense"), n).alias("operation_dense_retrieval_coverage"), share(has("hybrid"), n).alias("operation_hybrid_retrieval_coverage"),
        ),
        by(graph).agg(F.count_if(c("kind") == "entity").alias("graph_entities"), F.count_if(c("kind") == "relation").alias("graph_relations")),
        by(decisions).agg(F.count_if("audit_review").alias("audit_review_items"), F.count_if("requires_review").alias("resolution_review_required")),
    ]
    docs = documents.select("doc", "xml")
    # Issues and counts come from one aggregate over the nodes, which are parsed once.
    found = judged(docs, node_table(docs)).select("doc", "script_nodes", "parallel_nodes", (F.size("issues") == 0).alias("ok"))
    of_docs = documents.select("workload", "doc", "kind").join(found, "doc", "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    of = lambda kind, what: F.coalesce(F.sum(F.when(c("kind") == kind, what)), F.lit(0))
    parts.append(by(of_docs).agg(
        F.count_if(c("kind") == "operation").alias("operation_xml_files"), F.count_if((c("kind") == "operation") & c("ok")).alias("operation_xml_valid"), F.bool_and(F.when(c("kind") == "serial", c("ok"))).cast("int").alias("serial_xml_valid"),
        F.bool_and(F.when(c("kind") == "fused", c("ok"))).cast("int").alias("fused_xml_valid"), of("serial", c("script_nodes")).alias("serial_script_nodes"), of("serial", c("parallel_nodes")).alias("serial_parallel_nodes"),
        of("fused", c("script_nodes")).alias("fused_script_nodes"), of("fused", c("parallel_nodes")).alias("fused_parallel_nodes"),
    ))
    out = stacked(parts[0])
    for p in parts[1:]:
        out = out.unionByName(stacked(p))
    return out


def report(metrics: DataFrame, expectations: DataFrame, artifacts: DataFrame, critical: DataFrame | None = None, args: DataFrame | None = None) -> DataFrame:
    """workload, check_name, expected, actual, passed: one row for every check that has an expectation.

    ``expectations`` has workload, name and expected (number); ``artifacts`` workload and name of what is there; ``critical``
    workload, node, arg and value that the run's ``args`` (workload, node, arg, value) must have. Several parts read the metrics, a
    few rows a workload: they are written first, so that the artifacts are folded once.
    """
    spark, c = metrics.sparkSession, F.col
    metrics = written(metrics, "regression-metrics")
    known = metrics.select("workload").union(expectations.select("workload")).union(artifacts.select("workload")).distinct()
    there = artifacts.select("workload", "name").distinct().withColumn("there", F.lit(True))
    files = known.withColumn("name", F.explode(F.array(*map(F.lit, REQUIRED)))).join(there, ["workload", "name"], "left")
    files = files.select("workload", F.concat(F.lit("artifact_exists:"), "name").alias("check_name"), F.lit("existing path").alias("expected"), F.when(c("there"), F.lit("existing path")).alias("actual"), F.coalesce("there", F.lit(False)).alias("passed"))
    whole = files.groupBy("workload").agg(F.bool_and("passed").alias("complete")).filter("complete").select("workload")

    declared = F.broadcast(spark.createDataFrame([(k, EXPECTED_BY.get(k, k), m, r) for k, m, r in CHECKS], "check_name string, name string, metric string, rule string"))
    asked = expectations.filter("expected IS NOT NULL").join(declared, "name").join(metrics, ["workload", "metric"], "left")
    ok = F.when(c("rule") == "=", c("value") == c("expected")).when(c("rule") == ">=", c("value") >= c("expected")).otherwise(c("value") <= c("expected"))
    shown = lambda x: F.format_string("%.6f", x)
    numbers = asked.select("workload", "check_name", F.when(c("rule") == "=", shown(c("expected"))).otherwise(F.concat("rule", F.lit(" "), shown(c("expected")))).alias("expected"), F.when(c("value").isNotNull(), shown(c("value"))).alias("actual"), F.coalesce(ok, F.lit(False)).alias("passed"))
    valid = metrics.filter(c("metric").isin("serial_xml_valid", "fused_xml_valid")).select("workload", c("metric").alias("check_name"), F.lit("valid XML").alias("expected"), F.when(c("value") == 1, "valid XML").otherwise("invalid XML").alias("actual"), (c("value") == 1).alias("passed"))
    out = numbers.unionByName(valid)
    if critical is not None:
        met = critical.select("workload", "node", "arg", c("value").alias("expected")).join(args.select("workload", "node", "arg", c("value").alias("actual")), ["workload", "node", "arg"], "left")
        out = out.unionByName(met.select("workload", F.concat(F.lit("critical_arg:"), "node", F.lit("."), "arg").alias("check_name"), "expected", "actual", c("actual").eqNullSafe(c("expected")).alias("passed")))
    return files.unionByName(out.join(whole, "workload", "left_semi"))


def verdicts(checks: DataFrame) -> DataFrame:
    """workload, checks, failed, valid."""
    return checks.groupBy("workload").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("valid"))
