"""Typed paths from many nodes to many targets: search from both ends that meets in the middle, and paths attached to nodes.

An ask is one search: source, target, the relations that may be used (none: all) and the longest path. All asks are searched
together. A path of length L is the join of a forward half of ceil(L / 2) edges and a backward half of floor(L / 2) edges at
its middle node, so it is found exactly once; no half is longer than half of the longest ask, and halves are kept only for asks
that can still use them. Halves with a node in common are no simple path and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.knowledge import field_key, node_id, rendered
from quarry.sources.workspace import written

# What a node's template, evidence and fields are looked for by: relations and the longest path.
BY_TEMPLATE = [("TemplateClass", ["uses_template"], 1), ("XmlTemplate", ["uses_template", "backed_by_xml_template"], 2)]
BY_EVIDENCE = (["supported_by"], 1)
BY_TITLE = (["supported_by", "section_refers_flowchart"], 2)
BY_FIELD = (["supported_by", "row_has_field", "section_has_field"], 2)
NEXT_STEP, NEXT_PATHS = "next_step", 2


def _halves(edges: DataFrame, asks: DataFrame, key: list[str], start: str, leave: str, enter: str, hops: int, rounded: Column) -> list[DataFrame]:
    """Halves of 0 to ``hops`` edges from ``start``: ``key``, at, nodes and relations in the order they were walked."""
    c = F.col
    level = asks.select(*key, "allowed", rounded.alias("most"), c(start).alias("at"), F.array(start).alias("nodes"), F.array().cast("array<string>").alias("relations"))
    out = [level]
    for depth in range(1, hops + 1):
        step = edges.select(c(leave).alias("at"), c(enter).alias("to"), "relation")
        met = level.filter(c("most") >= depth).join(step, "at").filter(((F.size("allowed") == 0) | F.array_contains("allowed", c("relation"))) & ~F.array_contains("nodes", c("to")))
        level = met.select(*key, "allowed", "most", c("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"))
        level = written(level, "graph-halves")
        out.append(level)
    return out


def typed_paths(edges: DataFrame, asks: DataFrame, max_paths: int) -> DataFrame:
    """ask, nth, depth, nodes, relations: up to ``max_paths`` simple paths of each ask by (length, nodes, relations).

    ``edges`` has source, relation and target (equal rows count once); ``asks`` ask, source, target, allowed (relations) and
    max_depth (at most a handful, as the reference's searches have). Backward halves belong to a target and its relations, so
    a target that very many asks share is walked from once.
    """
    c = F.col
    asks = asks.filter(c("source") != c("target")).withColumn("by", F.to_json("allowed"))
    asks = written(asks, "graph-asks")
    longest = asks.agg(F.coalesce(F.max("max_depth"), F.lit(0))).first()[0]
    edges = written(edges.select("source", "relation", "target").distinct(), "graph-edges") if longest else edges
    goals = asks.groupBy("target", "by").agg(F.max("max_depth").alias("max_depth"), F.first("allowed").alias("allowed"))
    forward = _halves(edges, asks, ["ask", "target", "by", "max_depth"], "source", "source", "target", -(-longest // 2), F.ceil(c("max_depth") / 2))
    backward = _halves(edges, goals, ["target", "by"], "target", "target", "source", longest // 2, F.floor(c("max_depth") / 2))
    found = None
    for length in range(1, longest + 1):
        a, b = forward[-(-length // 2)].filter(c("max_depth") >= length), backward[length // 2]
        b = b.select("target", "by", "at", F.reverse(F.slice("nodes", 1, F.size("nodes") - 1)).alias("after"), F.reverse("relations").alias("rest"))
        # `nodes` of the second half are walked from the target, so its reverse without the middle follows the first half.
        met = a.join(b, ["target", "by", "at"]).filter(~F.arrays_overlap("nodes", "after"))
        here = met.select("ask", F.lit(length).alias("depth"), F.concat("nodes", "after").alias("nodes"), F.concat("relations", "rest").alias("relations"))
        found = here if found is None else found.unionByName(here)
    if found is None:
        return asks.select("ask", F.lit(0).alias("nth"), F.lit(0).alias("depth"), F.array("source").alias("nodes"), F.array().cast("array<string>").alias("relations")).limit(0)
    w = Window.partitionBy("ask").orderBy("depth", "nodes", "relations")
    return found.withColumn("nth", F.row_number().over(w)).filter(c("nth") <= max_paths).select("ask", "nth", "depth", "nodes", "relations")


def path_targets(bundles: DataFrame, items: DataFrame) -> DataFrame:
    """node, ord, target, allowed, max_depth: what each node's paths are looked for, each (target, relations) once.

    ``bundles`` has node and template; ``items`` node, item (order), role_id and fields (array of header and cell) of its candidates.
    """
    c = F.col
    rels = lambda names: F.array(*map(F.lit, names))
    by_template = bundles.filter("template <> ''").select("node", F.inline(F.array(*[F.struct(F.lit(0).alias("item"), F.lit(i).alias("place"), node_id(kind, c("template")).alias("target"), rels(names).alias("allowed"), F.lit(depth).alias("max_depth")) for i, (kind, names, depth) in enumerate(BY_TEMPLATE)])))
    by_item = items.select("node", (c("item") + 1).alias("item"), F.lit(0).alias("place"), c("role_id").alias("target"), rels(BY_EVIDENCE[0]).alias("allowed"), F.lit(BY_EVIDENCE[1]).alias("max_depth"))
    each = items.select("node", (c("item") + 1).alias("item"), F.posexplode("fields").alias("place", "f")).select("node", "item", (c("place") + 1).alias("place"), "f.header", "f.cell")
    title = field_key(c("header")) == "FLOWCHART_TITLE"
    field = F.concat(F.regexp_replace(node_id("ParameterField", c("header")), "$", "="), F.regexp_replace(node_id("", F.substring("cell", 1, 100)), "^:", ""))
    by_field = each.select("node", "item", "place", F.when(title, node_id("FlowchartTitle", c("cell"))).otherwise(field).alias("target"), F.when(title, rels(BY_TITLE[0])).otherwise(rels(BY_FIELD[0])).alias("allowed"), F.lit(BY_FIELD[1]).alias("max_depth"))
    all_ = by_template.unionByName(by_item).unionByName(by_field)
    first = all_.groupBy("node", "target", "allowed").agg(F.min(F.struct("item", "place")).alias("at"), F.first("max_depth").alias("max_depth"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("node").orderBy("at", "target"))).select("node", "ord", "target", "allowed", "max_depth")


def attached(edges: DataFrame, starts: DataFrame, targets: DataFrame, own: DataFrame, max_paths: int, max_depth: int) -> DataFrame:
    """node, nth, path: each node's readable paths, each text once, at most ``max_paths``.

    First the paths that its candidates bring (``own``: node, ord, path), then up to ``NEXT_PATHS`` next steps, then those to its
    ``targets`` in their order. ``starts`` has node and source (its place in the graph).
    """
    c = F.col
    asks = targets.join(starts, "node").select(F.struct("node", "ord").alias("ask"), "source", "target", "allowed", F.least("max_depth", F.lit(max_depth)).alias("max_depth"))
    to_targets = typed_paths(edges, asks, max_paths).select("ask.node", F.struct(F.lit(2).alias("group"), c("ask.ord").alias("ord"), c("nth").alias("nth")).alias("at"), rendered(c("nodes"), c("relations")).alias("path"))
    steps = edges.filter(c("relation") == NEXT_STEP).select("source", "target").distinct().filter("source <> target").join(starts, "source")
    steps = steps.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("target"))).filter(c("nth") <= NEXT_PATHS)
    ahead = steps.select("node", F.struct(F.lit(1).alias("group"), F.lit(0).alias("ord"), "nth").alias("at"), rendered(F.array("source", "target"), F.array(F.lit(NEXT_STEP))).alias("path"))
    first = own.select("node", F.struct(F.lit(0).alias("group"), c("ord").cast("int").alias("ord"), F.lit(0).alias("nth")).alias("at"), "path")
    once = first.unionByName(ahead).unionByName(to_targets).groupBy("node", "path").agg(F.min("at").alias("at"))
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("at", "path"))).filter(c("nth") <= max_paths).select("node", "nth", "path")
