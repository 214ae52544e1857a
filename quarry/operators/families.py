"""Template families: merged signatures, alias and class indexes, required evidence, resolution and conformity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Evidence and hints that a marker asks for, severities of missing parts, and score weights.
EVIDENCE = {"clear_dtc_loop": ["dtc_table", "dtc_hex_values"], "allowed_nrc": ["nrc_allowed_values"], "did_based": ["did_or_identifier"], "request_parameter": ["request_parameter"], "security_access": ["security_access_level"]}
HINTS = {"clear_dtc_loop": ["dtc_hex_values_must_come_from_evidence", "clear_dtc_count_should_match_evidence_rows"], "allowed_nrc": ["allowed_nrc_values_must_come_from_evidence"], "retry_count": ["retry_logic_should_be_preserved"]}
ALWAYS_HINTS = ["well_formed_tasknode", "contains_mainnodes", "contains_flowsnodes"]
MISSING = {"service": ("error", "TEMPLATE_FAMILY_SERVICE_ID_MISSING"), "response": ("warning", "TEMPLATE_FAMILY_POSITIVE_RESPONSE_MISSING"), "marker": ("warning", "TEMPLATE_FAMILY_LOGIC_MARKER_MISSING"), "arg": ("warning", "TEMPLATE_FAMILY_ARG_SOURCE_MISSING")}
EXACT, GENERAL, OF_NODE, ALIAS, NEAR, FOUND, LIKE = 120.0, 90.0, 45.0, 30.0, 15.0, 50.0, 0.65


def alias_key(value: Column) -> Column:
    """Letters and digits in upper case, single blanks between."""
    return F.trim(F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9A-Za-z]+", " ")))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two keys' words; 0 where one has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    a, b = words(left), words(right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def merged_items(items: DataFrame) -> DataFrame:
    """(family, kind, item) of the distinct items of a family's signatures (family, kind, item)."""
    return items.filter("item is not null and item <> ''").select("family", "kind", "item").distinct()


def registry(items: DataFrame) -> DataFrame:
    """(family, kind, item, n_templates): the merged signature of each family with the number of templates (doc) that hold an item."""
    return items.filter("item <> ''").groupBy("family", "kind", "item").agg(F.countDistinct("doc").alias("n_templates"))


def merged_counts(tags: DataFrame) -> DataFrame:
    """The largest count of each tag, and the last type of each variable by source (family, name, n, type, source)."""
    return tags.groupBy("family", "name").agg(F.max("n").alias("n"), F.max_by("type", "source").alias("type"))


def indexes(templates: DataFrame) -> DataFrame:
    """(index, key, templates): by class and by node name, the sorted ids of the first row of each template id."""
    w = Window.partitionBy("template_id").orderBy("ord")
    first = templates.withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    each = first.select("template_id", F.inline(F.array(F.struct(F.lit("class").alias("index"), F.col("class_name").alias("key")), F.struct(F.lit("node").alias("index"), F.col("node_name").alias("key"))))).filter("key is not null and key <> ''")
    return each.groupBy("index", "key").agg(F.array_join(F.array_sort(F.collect_list("template_id")), ",").alias("templates"))


def alias_index(aliases: DataFrame) -> DataFrame:
    """(alias, families): normal aliases with the families that use them, sorted."""
    keyed = aliases.select(alias_key(F.col("alias")).alias("alias"), "family").filter("alias <> ''").distinct()
    return keyed.groupBy("alias").agg(F.array_join(F.array_sort(F.collect_list("family")), ",").alias("families"))


def requirements(markers: DataFrame) -> DataFrame:
    """(family, evidence, hints) from a family's markers, whether it has services, and whether it has flowcharts."""
    has = lambda m: F.array_contains("markers", m)
    listed = lambda c, xs: F.when(c, F.array(*map(F.lit, xs))).otherwise(F.array().cast("array<string>"))
    evidence = F.concat(F.array(F.lit("template_xml_example")), listed(F.col("has_flowchart"), ["flowchart_description"]), listed(F.col("has_service"), ["uds_service_flow"]), *[listed(has(m), xs) for m, xs in EVIDENCE.items()])
    hints = F.concat(F.array(*map(F.lit, ALWAYS_HINTS)), *[listed(has(m), xs) for m, xs in HINTS.items()])
    return markers.select("family", F.array_join(F.array_sort(evidence), ",").alias("evidence"), F.array_join(F.array_sort(hints), ",").alias("hints"))


def resolve(nodes: DataFrame, families: DataFrame) -> DataFrame:
    """node, family, score, status: the best family of each node (node, template, node_family, template_family); none is ``not_found``.

    ``families`` (family, classes, aliases) is a registry of some hundred rows, broadcast to the nodes.
    """
    asked = F.array(alias_key(F.col("node")), alias_key(F.col("template")))

    def of_alias(a: Column) -> Column:
        # The first asked name that is equal, or alike enough, counts.
        each = F.filter(F.transform(asked, lambda q: F.when((q != "") & (q == a), F.lit(ALIAS)).when(jaccard(a, q) >= LIKE, jaccard(a, q) * NEAR)), lambda s: s.isNotNull())
        return F.coalesce(F.get(each, F.lit(0)), F.lit(0.0))

    c = F.col
    known = families.withColumn("keys", F.filter(F.transform("aliases", alias_key), lambda a: a != ""))
    points = F.when(F.array_contains("classes", c("template")), EXACT).otherwise(0.0) + F.when(c("template_family") == c("family"), GENERAL).otherwise(0.0) + F.when(c("node_family") == c("family"), OF_NODE).otherwise(0.0)
    total = points + F.aggregate("keys", F.lit(0.0), lambda acc, a: acc + of_alias(a))
    met = nodes.join(F.broadcast(known), F.lit(True)).withColumn("score", F.round(total, 6)).filter("score > 0")
    best = met.groupBy("node").agg(F.min_by(F.struct("family", "score"), F.struct((-c("score")).alias("neg"), "family")).alias("b"))
    status = F.when(c("b").isNull(), F.lit("not_found")).when(c("b.score") >= FOUND, F.lit("found")).otherwise(F.lit("ambiguous"))
    return nodes.select("node").join(best, "node", "left").select("node", c("b.family").alias("family"), c("b.score").alias("score"), status.alias("status"))


def missing_parts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Issues (template, severity, code, item) where a template lacks a part of its family's signature (fault handling may go).

    ``expected`` has template, kind and item; ``actual`` the same for what the template holds.
    """
    gone = expected.filter("item <> 'fault_handling'").join(actual, ["template", "kind", "item"], "left_anti")
    of = lambda i: reduce(lambda c, kv: c.when(F.col("kind") == kv[0], F.lit(kv[1][i])), MISSING.items(), F.when(F.lit(False), F.lit("")))
    return gone.select("template", of(0).alias("severity"), of(1).alias("code"), "item")


def audit_issues(items: DataFrame) -> DataFrame:
    """Issues (node, severity, code, arg) of audit items: missing nodes, and arguments that need a review."""
    status = F.col("status")
    severity = F.when(status == "node_missing_in_fused", F.lit("error")).when((status == "node_missing_in_base") | F.col("requires_review"), F.lit("warning"))
    code = F.when(status == "node_missing_in_base", F.lit("WORKFLOW_NODE_MISSING_IN_BASE")).when(status == "node_missing_in_fused", F.lit("WORKFLOW_NODE_MISSING_IN_FUSED")).otherwise(F.lit("WORKFLOW_ARG_REVIEW_REQUIRED"))
    return items.select("node", severity.alias("severity"), code.alias("code"), "arg").filter("severity is not null")
