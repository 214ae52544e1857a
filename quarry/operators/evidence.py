"""Evidence context: keep, demote and drop decisions, primary evidence of a node, and coverage of a chain report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens

# Prefixes of control unit names, and titles of pages that carry no evidence.
UNIT_PREFIXES = ["ADCU", "ASDM", "BCM", "CMD", "CMP", "ECM", "FAH", "HCML", "HCMR", "TCAM", "WPC", "ZCUD"]
NOISE_TITLES = ["revision history", "requirement log"]
# Fixed value: words of unit names.
WORD = "0x[0-9a-fA-F]+|[A-Za-z]+[A-Za-z0-9-]*|[0-9a-fA-F]{2,8}"
UNIT = r"(?i)\b((?:" + "|".join(UNIT_PREFIXES) + r")[A-Z0-9-]*)\b"
DEMOTION = 20.0


def plain(text: Column) -> Column:
    """Markup to spaces."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")


def units_named(title: Column, content: Column) -> Column:
    """Control units named in the title or the first 500 characters, upper-cased, distinct."""
    head = F.concat_ws(" ", F.coalesce(title, F.lit("")), plain(F.substring(content, 1, 500)))
    return F.array_distinct(F.transform(F.regexp_extract_all(head, F.lit(UNIT), F.lit(1)), F.upper))


def compatible(unit: Column, target: Column) -> Column:
    """Equal to the target, beginning with it, or holding it as a token without letters; an empty side is never compatible.

    Hyphens belong to words here, so the number of ``BCM-12`` is no token of its own.
    """
    u, t = F.upper(F.coalesce(unit, F.lit(""))), F.upper(F.coalesce(target, F.lit("")))
    words = F.transform(F.regexp_extract_all(u, F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(F.lower(w), "^0x", ""))
    return (u != "") & (t != "") & (F.startswith(u, t) | F.array_contains(words, t))


def noise(title: Column, content: Column) -> Column:
    """Empty, a long table of contents, or a revision page."""
    text = plain(content)
    titled = [F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(t)) for t in NOISE_TITLES]
    contents = F.contains(F.array_join(tokens(F.substring(text, 1, 1000)), " "), F.lit("contents")) & (F.length(text) > 3000)
    return ~text.rlike(r"\S") | contents | titled[0] | titled[1]


def decide(candidates: DataFrame) -> DataFrame:
    """Adds decision, reason and the changed score to (target, unit, module, title, content, score); first match wins."""
    target, unit, module = (F.coalesce(c, F.lit("")) for c in ("target", "unit", "module"))
    strange = F.exists(units_named(F.col("title"), F.col("content")), lambda u: ~compatible(u, F.col("target")))
    reason = (
        F.when(noise(F.col("title"), F.col("content")), "noise")
        .when(module == "eol_process", "public_process_keep")
        .when((target != "") & (unit != "") & ~compatible(unit, target) & (module == "ecu_parameter"), "explicit_ecu_conflict")
        .when((target != "") & compatible(unit, target) & strange, "local_ecu_context_conflict")
        .otherwise("generic_keep")
    )
    decision = F.when(F.col("reason").isin("noise", "explicit_ecu_conflict"), "drop").when(F.col("reason") == "local_ecu_context_conflict", "demote").otherwise("keep")
    judged = candidates.withColumn("reason", reason).withColumn("decision", decision)
    return judged.withColumn("score", F.when(F.col("decision") == "demote", F.greatest(F.col("score") - DEMOTION, F.lit(0.0))).otherwise(F.greatest("score", F.lit(0.0))))


def primary(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """node, parameter_id and flowchart_id: per node the best candidate by precedence, then score, then id; one aggregation.

    ``candidates`` has node, evidence_id, module, role, source and score; ``resolved`` (node, evidence_id) holds what reference hops reached.
    """
    c = candidates.join(resolved.select("node", "evidence_id", F.lit(True).alias("hop")).distinct(), ["node", "evidence_id"], "left")
    role, module = F.col("role"), F.coalesce("module", F.lit(""))
    wide, parent = role.isin("section_text", "table"), F.col("source") == "parent_context"
    param, chart = module == "ecu_parameter", role.isin("flowchart_title", "flowchart_image")
    order = [param & parent & wide, param & (role == "section_text"), param & (role == "table"), param & (role == "table_row"), parent & wide, role == "section_text", role == "table", role == "table_row"]
    rank = F.coalesce(*[F.when(p, F.lit(i)) for i, p in enumerate(order)], F.lit(len(order)))
    chart_rank = F.when(chart & F.coalesce("hop", F.lit(False)), 0).when(chart | (module == "eol_process"), 1)
    best = lambda r: F.min(F.when(r.isNotNull(), F.struct(r.alias("rank"), (-F.col("score")).alias("neg"), "evidence_id")))["evidence_id"]
    return c.groupBy("node").agg(best(rank).alias("parameter_id"), best(chart_rank).alias("flowchart_id"), F.count("*").alias("n_kept"))


def coverage(report: DataFrame) -> DataFrame:
    """One row: nodes, and the shares of them with a parameter source and with a flowchart (0 for no nodes)."""
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count(c), F.count("*")), F.lit(0.0)), 6)
    return report.agg(F.count("*").alias("nodes"), share("parameter_id").alias("parameter_coverage"), share("flowchart_id").alias("flowchart_coverage"))
