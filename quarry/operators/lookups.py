"""Joins between candidates, evidence, flow nodes and plans: lookups, parents, siblings, semi and anti joins.

All are equi-joins on normalised keys; per-group limits are ranked windows, which Spark cuts before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.sources.workspace import written

#: Most rows of one set of tokens that are not dealt over parts.
COPIES = 4096
#: Most sibling rows that one table row brings along.
SIBLINGS = 80


def evidence_key(value: Column) -> Column:
    """An evidence id without blanks around it and without the mark ``md_``."""
    return F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^md_", "")


def find_evidence(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id, source_id) with the evidence row that the source id names, or else the chunk id; others are dropped."""
    rows = evidence.select(F.col("evidence_id").alias("found_id"), *[c for c in evidence.columns if c != "evidence_id"])
    named = F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.col("chunk_id"))
    return chunks.withColumn("found_id", named).join(rows, "found_id").withColumnRenamed("found_id", "evidence_id")


def parents(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(evidence_id, parent_id) by the parent id as it stands, else without ``md_``, else with it."""
    asked = rows.select("evidence_id", F.trim("parent_evidence_id").alias("named")).filter("named <> ''")
    bare = evidence_key(F.col("named"))
    ways = F.array(F.struct(F.lit(0).alias("rank"), F.col("named").alias("id")), F.struct(F.lit(1).alias("rank"), bare.alias("id")), F.struct(F.lit(2).alias("rank"), F.concat(F.lit("md_"), bare).alias("id")))
    each = asked.select("evidence_id", F.inline(ways))
    hit = each.join(evidence.select(F.col("evidence_id").alias("id")), "id")
    return hit.groupBy("evidence_id").agg(F.min_by("id", "rank").alias("parent_id"))


def siblings(rows: DataFrame, evidence: DataFrame, limit: int = SIBLINGS) -> DataFrame:
    """(evidence_id, sibling_id, rank): other table rows of the same parent, by (row_index, id)."""
    key = evidence_key(F.col("parent_evidence_id"))
    asked = rows.select("evidence_id", key.alias("key")).filter("key <> ''")
    others = evidence.filter("block_role = 'table_row'").select(F.col("evidence_id").alias("sibling_id"), key.alias("key"), F.coalesce("row_index", F.lit(0)).alias("row_index"))
    w = Window.partitionBy("evidence_id").orderBy("row_index", "sibling_id")
    met = asked.join(others, "key").filter("evidence_id <> sibling_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("evidence_id", "sibling_id", "rank")


def with_context(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates (node, evidence_id, score, parent_evidence_id) plus parents (+0.05) and sibling rows (-0.02, at least 0).

    Of several ways to one evidence row the candidate itself counts first, then a parent, then a sibling; the best score of
    a way is taken.
    """
    ids = candidates.select("evidence_id", "parent_evidence_id").distinct()
    up = candidates.join(parents(ids, evidence), "evidence_id").select("node", F.col("parent_id").alias("evidence_id"), F.greatest(F.col("score") + 0.05, F.lit(0.0)).alias("score"), F.lit("parent_context").alias("source"), F.lit(1).alias("way"))
    side = candidates.join(siblings(ids, evidence), "evidence_id").select("node", F.col("sibling_id").alias("evidence_id"), F.greatest(F.col("score") - 0.02, F.lit(0.0)).alias("score"), F.lit("sibling_table_context").alias("source"), F.lit(2).alias("way"))
    own = candidates.select("node", "evidence_id", "score", F.lit("candidate").alias("source"), F.lit(0).alias("way"))
    best = F.min(F.struct("way", (-F.col("score")).alias("neg"), "source")).alias("b")
    return own.unionByName(up).unionByName(side).groupBy("node", "evidence_id").agg(best).select("node", "evidence_id", F.round(-F.col("b.neg"), 6).alias("score"), F.col("b.source").alias("source"))


def unmatched(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches whose evidence is no candidate of their node."""
    return matches.join(candidates.select("node", "evidence_id"), ["node", "evidence_id"], "left_anti")


def unknown_evidence(args: DataFrame, evidence: DataFrame) -> DataFrame:
    """(node, arg, evidence_id) of arguments that name evidence which does not exist."""
    each = args.select("node", "arg", F.explode("evidence_ids").alias("evidence_id"))
    return each.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select("node", "arg", "evidence_id")


def with_bundles(flow: DataFrame, bundles: DataFrame) -> DataFrame:
    """Every flow node with its bundle's counts; nodes without a bundle are placeholders."""
    counted = bundles.groupBy("node").agg(F.count("*").alias("n_evidence"), F.round(F.max("score"), 6).alias("best"))
    status = F.when(F.col("n_evidence").isNull(), F.lit("not_found")).otherwise(F.lit("found"))
    return flow.join(counted, "node", "left").select(*flow.columns, F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "best", status.alias("status"))


def next_steps(flow: DataFrame) -> DataFrame:
    """(flow, source, target) of every task of a step and every task of the next one."""
    nxt = flow.select("flow", (F.col("step") - 1).alias("step"), F.col("node").alias("target"))
    return flow.join(nxt, ["flow", "step"]).select("flow", F.col("node").alias("source"), "target")


def title_images(titles: DataFrame, images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(title_id, image_id, overlap) where enough of the title's distinct tokens stand in the image's name, by token join.

    Texts with one set of tokens are one class, so sets are compared by class and copies only meet in the result. Only a
    class's rarest tokens are joined: one that reaches the threshold has a token among its rarest
    ``n - ceil(threshold * n) + 1``, so a very frequent token meets few classes and no pair is lost.
    """
    held = lambda d, i, c, n: d.select(i, F.array_join(F.sort_array(F.array_distinct(tokens(F.col(c)))), " ").alias(n)).filter(F.col(n) != "")
    own, other = held(titles, "title_id", "title", "a"), held(images, "image_id", "name", "b")
    sized = other.groupBy("b").agg(F.count("*").alias("copies"))
    one = own.select("a").distinct().withColumn("as", F.split("a", " ")).select("a", "as", F.explode("as").alias("token"))
    two = sized.select("b", F.explode(F.split("b", " ")).alias("token"))
    often = two.groupBy("token").agg(F.count("*").alias("n"))
    ranked = one.join(often, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("n", "token")))
    # Written, so that Spark knows whether they are few: then they are broadcast, and the classes' tokens, each with its class, are not shuffled.
    rare = written(ranked.filter(F.col("rank") <= F.size("as") - F.ceil(F.size("as") * threshold - 1e-9) + 1).select("a", "token"), "title-tokens")
    met = two.join(rare, "token").select("a", "b").distinct().select("a", "b", F.split("a", " ").alias("as"), F.split("b", " ").alias("bs"))
    alike = met.select("a", "b", F.round(F.size(F.array_intersect("as", "bs")) / F.size("as"), 6).alias("overlap")).filter(F.col("overlap") >= threshold)
    # A class of many copies makes far more rows than it reads, so its images are dealt over parts, and the pairs of that class alone are repeated for
    # each; such classes are at most one for every ``COPIES`` images. The partitions are counted, not coalesced by their size.
    n = 8 * own.sparkSession.sparkContext.defaultParallelism
    crowded = F.broadcast(sized.filter(F.col("copies") > COPIES).select("b", F.ceil(F.col("copies") / COPIES).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    asked = own.join(alike, "a").drop("a").join(crowded, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts").repartition(n, "b", "salt")
    images_ = other.join(crowded, "b", "left").withColumn("salt", F.pmod(F.xxhash64("image_id"), parts).cast("int")).drop("parts").repartition(n, "b", "salt")
    return asked.join(images_, ["b", "salt"]).select("title_id", "image_id", "overlap")


def distinct_trace(results: DataFrame) -> DataFrame:
    """The first result of each (node, chunk_id, source, query_type)."""
    w = Window.partitionBy("node", "chunk_id", "source", "query_type").orderBy("ord")
    return results.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def best_per_evidence(results: DataFrame) -> DataFrame:
    """Several queries' results per (node, evidence_id): the best score (the earliest of equal ones) and all query types in order."""
    types = F.transform(F.array_sort(F.collect_list(F.struct("ord", "query_type"))), lambda x: x["query_type"])
    best = F.max(F.struct("score", (-F.col("ord")).alias("back"), "query_type")).alias("b")
    return results.groupBy("node", "evidence_id").agg(best, F.array_join(F.array_distinct(types), ",").alias("query_types")).select("node", "evidence_id", "b.score", F.col("b.query_type").alias("query_type"), "query_types")


def matched_terms(terms: Column, text: Column) -> Column:
    """Those of the terms, lowered, that the lowered text holds."""
    return F.array_distinct(F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: (t != "") & F.contains(F.lower(text), t)))
