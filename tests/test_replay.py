"""Replay datasets on literal traces: prompts, numbers, joins by the last operation of a name, and samples that do not depend on partitions."""

import hashlib

from pyspark.sql import functions as F

from quarry.operators import replay as R

OPS = "workload string, ord int, node string, template string, selected array<string>, matches array<struct<evidence_id:string,score:string,terms:array<string>,excerpt:string>>, notes array<string>, paths array<string>, args array<struct<name:string,value:string,score:string>>, missing array<string>"
DECISIONS = "workload string, ord int, node string, arg string, class string, plan_value string, base_value string, fused_value string, action string, reason string, evidence array<string>, requires_review boolean"


def _items(spark, parts=2):
    ops = [
        ("w", 1, "Read DTC", "T", ["e1"], [("e1", "0.5", ["a"], " x " + "y" * 300)], [], ["p1", "p2"], [("DID", "1", "0.9")], ["RID"]), ("w", 2, "Read DTC", None, [], [], ["late"], [], [], []),
        ("w", 3, " ", "", [], [], [], [], [], []), ("v", 1, "Other", "T", [], [], [], [], [], []),
    ]
    decisions = [("w", 1, "Read DTC", "DID", "C", "1", None, "2", "keep", None, ["e1", "e2"], True), ("w", 2, "unknown", "", None, None, None, None, "keep", "why", [], True), ("w", 3, "Read DTC", "X", "C", "1", "1", "1", "keep", "r", [], False)]
    return R.trace_items(spark.createDataFrame(ops, OPS).repartition(parts), spark.createDataFrame(decisions, DECISIONS).repartition(parts))


def test_items(spark):
    got = {(r["workload"], r["item_id"]): r for r in _items(spark).collect()}
    assert set(got) == {
        ("w", "short_audit:000:read_dtc-did"), ("w", "short_audit:001:unknown"), ("w", "repair:000:read_dtc-did"), ("w", "repair:001:unknown"), ("w", "rerank:000:read_dtc"),
        ("w", "long_context:000:read_dtc"), ("w", "long_context:001:read_dtc"), ("w", "long_context:002:item"), ("v", "long_context:000:other"),
    }
    audit = got[("w", "short_audit:000:read_dtc-did")]["prompt"].split("\n")
    assert audit[3:] == ["", "Node: Read DTC", "Template: C", "Arg: DID", "PlanValue: 1", "BaseValue: ", "FusedValue: 2", "Reason: ", "EvidenceIds: e1, e2", "SelectedArgs: None", "OperationNotes: late"]
    rerank = got[("w", "rerank:000:read_dtc")]
    assert rerank["prompt"].endswith("Candidates:\n- evidence_id=e1; score=0.5; matched_terms=a; excerpt=x " + "y" * 238) and rerank["max_tokens"] == 160 and rerank["tokens"] == len(rerank["prompt"]) // 4
    assert "GraphPaths:\n- p1\n- p2\nRetrievalEvidence:\n- evidence_id=e1" in got[("w", "long_context:000:read_dtc")]["prompt"] and "SelectedArgs: DID=1 (score=0.9)\nMissingFields: RID" in got[("w", "long_context:000:read_dtc")]["prompt"]
    assert got[("w", "repair:001:unknown")]["prompt"].endswith("CurrentAction: keep\nReason: why\nGraphPaths:\nNone\nEvidence:\nNone")


def test_samples_and_profiles(spark):
    one, two = (sorted(r["item_id"] + r["workload"] for r in R.sample(_items(spark, n), 2, "k").collect()) for n in (1, 5))
    assert one == two and len(one) == 7
    sums = {(r["workload"], r["profile"]): r["items"] for r in R.summary(_items(spark)).collect()}
    assert sums == {("w", "short_audit"): 2, ("w", "repair"): 2, ("w", "rerank"): 1, ("w", "long_context"): 3, ("v", "long_context"): 1}
    df = spark.createDataFrame([("x" * 4 * 8192,), ("x" * (4 * 8192 + 4),), ("",)], "p string")
    assert [r[0] for r in df.select(R.generation_profile(df["p"])).collect()] == ["xml_generation", "long_context_xml_generation", "xml_generation"]


def test_no_workload_is_numbered_in_one_task(spark):
    """Rows of one workload, and of none, are numbered over several tasks."""
    rows = [(w, (i * 7919) % 500) for i in range(500) for w in ("w", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.numbered(spark.createDataFrame(rows, "workload string, ord int").repartition(5)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 1000 and all(r["nth"] == r["ord"] for r in got) and len({r["task"] for r in got if r["workload"] == "w"}) > 1


def test_samples_sort_few_rows(spark):
    """A profile with fewer items than asked for keeps them all; in a large one the least hashes are those of a full sort."""
    items = spark.range(5000).selectExpr("'w' AS workload", "concat('i', id) AS item_id", "CASE WHEN id < 3 THEN 'rare' ELSE 'often' END AS profile")
    got = {(r["profile"], r["item_id"]) for r in R.sample(items, 20, "k").collect()}
    by_hash = sorted((hashlib.md5(f"k\0w\0i{i}".encode()).hexdigest(), f"i{i}") for i in range(3, 5000))
    assert got == {("rare", f"i{i}") for i in range(3)} | {("often", i) for _, i in by_hash[:20]}
    plan = R.sample(items, 20, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")
