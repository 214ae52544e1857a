"""Workflow audit: three-way argument audit, resolution, fusion, contracts, guardrails and service rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import comparable

# Statuses that need a review, and those that are settled.
REVIEW = ["node_missing_in_base", "node_missing_in_fused", "plan_conflict_kept_base", "plan_conflict_fused_diff", "plan_arg_missing_in_fused", "workflow_changed_without_plan", "plan_not_applied"]
SETTLED = ["confirmed_by_plan", "base_only_unchanged", "filled_from_plan", "appended_from_plan", "overwritten_from_plan"]


def audit_status(plan: Column, base: Column, fused: Column, required: Column) -> Column:
    """Status of one argument; null (absent) and '' (empty) differ."""
    same = fused == plan
    planned = (
        F.when(fused.isNull(), F.when(required, "plan_arg_missing_in_fused").otherwise("extra_plan_arg_ignored"))
        .when(required & (fused == "") & (plan != ""), "plan_arg_missing_in_fused")
        .when(base.isNull(), F.when(same, "appended_from_plan").otherwise("plan_conflict_fused_diff"))
        .when(base == "", F.when(same, "filled_from_plan").when(fused == "", "plan_not_applied").otherwise("plan_conflict_fused_diff"))
        .when(fused == base, F.when(plan == base, "confirmed_by_plan").otherwise("plan_conflict_kept_base"))
        .when(same, "overwritten_from_plan")
        .otherwise("plan_conflict_fused_diff")
    )
    unplanned = F.when(required & fused.isNull(), "workflow_changed_without_plan").when(base.eqNullSafe(fused), "base_only_unchanged").otherwise("workflow_changed_without_plan")
    return F.when(plan.isNull(), unplanned).otherwise(planned)


def audit(plan: DataFrame, base: DataFrame, fused: DataFrame, contracts: DataFrame) -> DataFrame:
    """node, arg, the three values, required and status; each input has node, arg and value (contracts: node, arg)."""
    side = lambda d, c: d.select("node", "arg", F.trim("value").alias(c))
    joined = side(plan, "plan_value").join(side(base, "base_value"), ["node", "arg"], "full").join(side(fused, "fused_value"), ["node", "arg"], "full")
    joined = joined.join(contracts.select("node", "arg", F.lit(True).alias("required")), ["node", "arg"], "left").fillna({"required": False})
    out = joined.withColumn("status", audit_status(F.col("plan_value"), F.col("base_value"), F.col("fused_value"), F.col("required")))
    return out.withColumn("needs_review", F.col("status").isin(REVIEW))


def missing_nodes(plan: DataFrame, base: DataFrame, fused: DataFrame) -> DataFrame:
    """(node, arg ``*``, status) of planned nodes that the fused workflow, or else the base one, does not have; all need a review."""
    side = lambda d, c: d.select("node").distinct().withColumn(c, F.lit(True))
    joined = plan.select("node").distinct().join(side(base, "in_base"), "node", "left").join(side(fused, "in_fused"), "node", "left")
    status = F.when(F.col("in_fused").isNull(), F.lit("node_missing_in_fused")).when(F.col("in_base").isNull(), F.lit("node_missing_in_base"))
    return joined.select("node", F.lit("*").alias("arg"), status.alias("status")).filter("status is not null").withColumn("needs_review", F.col("status").isin(REVIEW))


def resolve(audited: DataFrame, classes: DataFrame, contract: DataFrame) -> DataFrame:
    """Adds class, allowed, action, confidence and requires_review to (node, arg, status).

    ``classes`` has node and class; ``contract`` has class, arg and required. A class without any row has no contract.
    """
    known = contract.groupBy("class").agg(F.lit(True).alias("_contract"))
    rule = contract.select("class", "arg", F.lit(True).alias("allowed"), F.col("required").alias("by_contract"))
    j = audited.join(classes.select("node", "class"), "node", "left").join(known, "class", "left").join(rule, ["class", "arg"], "left").fillna({"_contract": False, "allowed": False, "by_contract": False})
    status, allowed, needed, has = F.col("status"), F.col("allowed"), F.col("by_contract"), F.col("_contract")
    out = lambda a, c, r: F.struct(F.lit(a).alias("action"), F.lit(c).alias("confidence"), F.lit(r).alias("requires_review"))
    missing = status == "plan_arg_missing_in_fused"
    done = (
        F.when(status == "extra_plan_arg_ignored", out("ignore_plan_arg", 0.9, False))
        .when(status.isin(SETTLED), out("no_action", 1.0, False))
        .when(missing & has & ~allowed, out("ignore_plan_arg", 0.9, False))
        .when(missing & allowed & needed, out("append_plan_arg", 0.75, False))
        .when(missing & allowed, out("needs_review", 0.4, True))
        .when(missing, out("needs_review", 0.2, True))
        .when((status == "plan_conflict_kept_base") & allowed, out("keep_base", 0.65, True))
        .when(status == "plan_conflict_kept_base", out("keep_base", 0.8, True))
        .when(status.isin("plan_conflict_fused_diff", "plan_not_applied", "workflow_changed_without_plan"), out("needs_review", 0.25, True))
        .otherwise(out("needs_review", 0.0, True))
    )
    return j.withColumn("_d", done).select("node", "class", "arg", "status", "allowed", "_d.action", "_d.confidence", "_d.requires_review")


def golden_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: expected arguments, those met, those absent, and the share met (0 for none); an absent argument is not met."""
    a = actual.select("node", "arg", F.col("value").alias("got"), F.lit(True).alias("there"))
    j = expected.join(a, ["node", "arg"], "left")
    met = F.count_if(F.col("there") & F.col("value").eqNullSafe(F.col("got")))
    return j.agg(F.count("*").alias("total"), met.alias("met"), F.count_if(F.col("there").isNull()).alias("absent"), F.round(F.coalesce(F.try_divide(met, F.count("*")), F.lit(0.0)), 6).alias("accuracy"))


def fuse(plan: DataFrame, base: DataFrame, mode: str = "fill_missing") -> DataFrame:
    """Fused arguments: empty base values are filled, all overwritten in ``overwrite``; plan-only ones are appended."""
    p, b = plan.select("node", "arg", F.col("value").alias("p")), base.select("node", "arg", F.col("value").alias("b"), F.lit(True).alias("has_base"))
    j = p.join(b, ["node", "arg"], "full")
    keep = F.col("has_base") & F.col("p").isNull() if mode == "overwrite" else F.col("has_base") & (F.coalesce("b", F.lit("")) != "")
    return j.select("node", "arg", F.when(F.coalesce(keep, F.lit(False)), F.col("b")).otherwise(F.coalesce("p", "b")).alias("value"), F.coalesce(~F.col("has_base"), F.lit(True)).alias("appended"))


def contracts(templates: DataFrame, ratio: float) -> DataFrame:
    """class, arg, count and whether required: seen in at least ``ratio`` of the class's distinct templates."""
    total = templates.groupBy("class").agg(F.countDistinct("template").alias("total"))
    seen = templates.groupBy("class", "arg").agg(F.countDistinct("template").alias("seen"))
    return seen.join(total, "class").select("class", "arg", "seen", "total", (F.col("seen") >= F.col("total") * ratio).alias("required"))


def guardrails(generated: DataFrame, expected: DataFrame) -> DataFrame:
    """High-risk arguments replaced or added where the generated value is not equivalent to the expected one."""
    j = expected.select("node", "arg", F.col("value").alias("expected")).join(generated.select("node", "arg", F.col("value").alias("raw")), ["node", "arg"], "left")
    action = F.when(F.col("raw").isNull(), "added").when(comparable(F.col("raw")) != comparable(F.col("expected")), "replaced").otherwise("kept")
    return j.select("node", "arg", "raw", "expected", action.alias("action"))


def service_rules(steps: DataFrame) -> DataFrame:
    """Rule violations of (plan, step, send, expect): response byte, session before security, seed before key."""
    hexes = lambda c: F.split(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"\s+")
    s = steps.withColumn("sid", F.get(hexes(F.col("send")), F.lit(0))).withColumn("sub", F.get(hexes(F.col("send")), F.lit(1))).withColumn("got", F.get(hexes(F.col("expect")), F.lit(0)))
    before = Window.partitionBy("plan").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("had_session", F.coalesce(F.max((F.col("sid") == "10").cast("int")).over(before), F.lit(0)))
    s = s.withColumn("had_seed", F.coalesce(F.max(((F.col("sid") == "27") & (F.col("sub") == "01")).cast("int")).over(before), F.lit(0)))
    wanted = F.hex(F.conv("sid", 16, 10).cast("int") + 64)
    codes = F.array_compact(F.array(
        F.when((F.col("got") != "") & (F.col("got") != wanted), F.lit("response_mismatch")),
        F.when((F.col("sid") == "27") & (F.col("had_session") == 0), F.lit("security_without_session")),
        F.when((F.col("sid") == "27") & (F.col("sub") == "02") & (F.col("had_seed") == 0), F.lit("key_without_seed")),
    ))
    return s.select("plan", "step", F.explode(codes).alias("code"))
