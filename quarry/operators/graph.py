"""Evidence graph: merged edges with stable ids, same-as links, bounded path search and reference resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.lookups import title_images


def merge_edges(edges: DataFrame) -> DataFrame:
    """source, relation, target with a stable id and the number of rows merged."""
    ident = F.substring(F.sha1(F.concat_ws("\x00", "source", "relation", "target")), 1, 20)
    return edges.groupBy("source", "relation", "target").agg(F.count("*").alias("n")).withColumn("edge_id", ident)


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """node_id, distinct evidence count, least evidence id, and the last non-empty label of (node_id, evidence_id, ord, label).

    The evidence ids themselves stay rows of ``mentions``: a node named everywhere must not become one unbounded array.
    """
    label = F.max(F.when(F.coalesce("label", F.lit("")) != "", F.struct("ord", "label")))["label"]
    return mentions.groupBy("node_id").agg(F.countDistinct("evidence_id").alias("n_evidence"), F.min("evidence_id").alias("first_evidence"), label.alias("label"))


def same_as(nodes: DataFrame) -> DataFrame:
    """node_id and canonical_id of nodes whose names have the same set of tokens."""
    key = F.array_join(F.array_sort(F.array_distinct(tokens(F.col("name")))), " ")
    keyed = nodes.withColumn("key", key).filter("key <> ''")
    least = keyed.groupBy("key").agg(F.min("node_id").alias("canonical_id"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(least, "key").filter("node_id <> canonical_id").select("node_id", "canonical_id")


def paths(edges: DataFrame, starts: DataFrame, max_depth: int, max_paths: int, relations: list[str] | None = None, target: str | None = None) -> DataFrame:
    """start, depth, path: simple paths breadth first, at most ``max_paths`` per start, by (depth, path).

    ``relations`` takes edges of these relations only; ``target`` returns paths that end there. Paths of a level come before
    all longer ones, so a start that has its ``max_paths`` is not followed further: without a target no start carries more
    than ``max_paths`` paths into the next level.
    """
    used = edges.filter(F.col("relation").isin(relations)) if relations else edges
    step = used.select(F.col("source").alias("at"), F.col("target").alias("to")).distinct()
    level = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("nodes"))
    found = None
    for depth in range(1, max_depth + 1):
        level = level.join(step, "at").filter(~F.array_contains("nodes", F.col("to"))).select("start", F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"))
        ends = level if target is None else level.filter(F.col("at") == target)
        here = ends.select("start", F.lit(depth).alias("depth"), F.array_join("nodes", " > ").alias("path"))
        found = here if found is None else found.unionByName(here)
        if depth < max_depth:
            done = found.groupBy("start").count().filter(F.col("count") >= max_paths).select("start")
            level = level.join(done, "start", "left_anti")
    w = Window.partitionBy("start").orderBy("depth", "path")
    return found.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= max_paths).drop("nth")


def resolve_by_tokens(references: DataFrame, targets: DataFrame, threshold: float) -> DataFrame:
    """ref_id, target_id, score: share of the reference's distinct tokens in the target, candidates by the rarest tokens only."""
    found = title_images(references.select(F.col("ref_id").alias("title_id"), F.col("reference").alias("title")), targets.select(F.col("target_id").alias("image_id"), F.col("title").alias("name")), threshold)
    return found.select(F.col("title_id").alias("ref_id"), F.col("image_id").alias("target_id"), F.col("overlap").alias("score"))


def expand(edges: DataFrame, starts: DataFrame, max_depth: int, per_hop: int) -> DataFrame:
    """start, node, depth: bounded closure; a node counts at its first depth, at most ``per_hop`` new ones per start and hop."""
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, max_depth + 1):
        nxt = front.join(edges.select(F.col("source").alias("node"), "target"), "node").select("start", F.col("target").alias("node")).distinct()
        fresh = nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        w = Window.partitionBy("start").orderBy("node")
        front = fresh.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_hop).select("start", "node", F.lit(depth).alias("depth"))
        seen = seen.unionByName(front)
    return seen
