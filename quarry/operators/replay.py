"""Replay datasets: prompts made from traced operations and audit decisions, and bounded samples of them by profile.

Each family of items is a projection of its source with its operation's fields joined by name; numbers in item ids follow
the source's order within a workload. A sample takes the items of lowest keyed hash in each profile, so it is the same
however the rows are dealt and grows with no table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens_floor
from quarry.sources.workspace import written

# How each profile's prompt begins, its answer's form, and its token range, cache mode and tags.
PROFILES = {
    "short_audit": (["你是诊断流程参数审计助手。", "请判断下面这个 workflow 参数冲突应如何处理，并只输出 JSON：", '{"action":"keep_base|accept_plan|needs_review","confidence":0.0,"reason":"..."}'], 192, 48, "warm", "audit,review,real_trace"),
    "rerank": (["你在做诊断证据重排。", "请从候选证据中选出最相关的 3 条 evidence_id，并只输出 JSON：", '{"top_evidence_ids":["..."],"reason":"..."}'], 160, 48, "warm", "rerank,retrieval,real_trace"),
    "long_context": (["你在做诊断流程长上下文校核。", "请结合 operation、graph path 和检索证据，输出 JSON：", '{"status":"ok|risk","summary":"...","key_args":["..."]}'], 256, 96, "cold", "long_context,graph,real_trace"),
    "repair": (["你在做 XML workflow repair 建议生成。", "请根据参数冲突和真实证据，输出 JSON：", '{"action":"keep_base|accept_plan|ignore_plan_arg|needs_review","confidence":0.0,"reason":"..."}'], 256, 80, "cold", "repair,review,real_trace"),
}
#: From so many estimated tokens on, XML generation counts as a profile of its own.
LONG_GENERATION = 8192
EXCERPT = 240
NONE = "None"
#: Hexadecimal digits of a hash by which a sample's items are counted.
DIGITS = 4


def _or_none(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NONE))


def _ids(ids: Column) -> Column:
    return _or_none(F.array_join(ids, ", "))


def _lines(items: Column, limit: int) -> Column:
    return _or_none(F.array_join(F.transform(F.slice(items, 1, limit), lambda x: F.concat(F.lit("- "), x)), "\n"))


def _matches(limit: int) -> Column:
    """Retrieval matches (evidence_id, score as text, terms, excerpt), a line each."""
    line = lambda m: F.concat(F.lit("- evidence_id="), m["evidence_id"], F.lit("; score="), m["score"], F.lit("; matched_terms="), _or_none(F.array_join(m["terms"], ",")), F.lit("; excerpt="), F.substring(F.btrim(F.coalesce(m["excerpt"], F.lit("")), F.lit(" \t\n\r\x0b\x0c")), 1, EXCERPT))
    return _or_none(F.array_join(F.transform(F.slice("matches", 1, limit), line), "\n"))


def slug(value: Column) -> Column:
    bare = F.lower(F.btrim(F.regexp_replace(F.trim(value), "[^a-zA-Z0-9]+", "_"), F.lit("_")))
    return F.when(bare == "", F.lit("item")).otherwise(bare)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with nth, their number from 0 on within a workload by ``ord``.

    Rows are dealt by ranges of (workload, ord), sorted there and written with their places; a number is a place less the
    first one of its workload in that range, plus what earlier ranges hold of it. So no workload has to fit into one task.
    """
    dealt = rows.repartitionByRange("workload", "ord").sortWithinPartitions("workload", "ord")
    placed = written(dealt.withColumn("_place", F.monotonically_increasing_id()), "replay-rows").withColumn("_range", F.shiftright("_place", 33))
    # A row for each workload in each range; written, so that Spark knows its size.
    held = written(placed.groupBy("workload", "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")), "replay-ranges")
    earlier = Window.partitionBy("workload").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(F.col("workload").alias("_of"), F.col("_range").alias("_in"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    met = placed.join(starts, F.col("workload").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    return met.withColumn("nth", F.col("_place") + F.col("_shift")).drop("_place", "_range", "_of", "_in", "_shift")


def _items(rows: DataFrame, profile: str, fields: list[tuple[str, Column]], parts: list[str]) -> DataFrame:
    """workload, item_id (where rows have a number nth), profile, prompt, tokens, max_tokens, min_tokens, cache_mode, tags: one item for each row."""
    intro, most, least, cache, tags = PROFILES[profile]
    said = [F.lit("\n".join([*intro, ""])), *[F.concat(F.lit(f"{name}: "), value) if name[-1] != "\n" else F.concat(F.lit(name), value) for name, value in fields]]
    named = F.array_join(F.transform(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p != ""), slug), "-")
    prompt = F.trim(F.array_join(F.array(*said), "\n"))
    ids = [F.concat(F.format_string(f"{profile}:%03d:", "nth"), F.coalesce(F.nullif(named, F.lit("")), F.lit("item"))).alias("item_id")] if "nth" in rows.columns else []
    made = rows.select("workload", *ids, F.lit(profile).alias("profile"), prompt.alias("prompt"))
    return made.select("*", tokens_floor(F.col("prompt")).alias("tokens"), F.lit(most).alias("max_tokens"), F.lit(least).alias("min_tokens"), F.lit(cache).alias("cache_mode"), F.lit(tags).alias("tags"))


def trace_items(operations: DataFrame, decisions: DataFrame, ids: bool = True) -> DataFrame:
    """Items of the four families that traces give rise to; without ``ids`` they have no item_id, and no row is sorted for one.

    ``operations`` (workload, ord, node, template, selected (evidence ids), matches, notes, paths, args (array of name, value, score
    as text), missing); ``decisions`` (workload, ord, node, arg, class, plan_value, base_value, fused_value, action, reason,
    evidence (ids), requires_review). Of operations of one name the last one is a decision's; absent values are empty.
    """
    c = F.col
    text = lambda name: F.coalesce(c(name), F.lit(""))
    args = _or_none(F.array_join(F.transform(F.slice("args", 1, 8), lambda a: F.concat(a["name"], F.lit("="), a["value"], F.lit(" (score="), a["score"], F.lit(")"))), "; "))
    notes = _or_none(F.array_join(F.slice("notes", 1, 6), "; "))
    last = Window.partitionBy("workload", "node").orderBy(F.desc("ord"))
    # Dealt first: before it is, the window would sort all that a task reads, and small files hold many rows.
    known = operations.filter(F.trim("node") != "").repartition("workload", "node").withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("workload", "node", "matches", "notes", "paths", "args")
    asked = decisions.filter("requires_review").join(known, ["workload", "node"], "left")
    lists = {"matches": operations.schema["matches"].dataType, "notes": operations.schema["notes"].dataType, "paths": operations.schema["paths"].dataType, "args": operations.schema["args"].dataType}
    asked = asked.withColumns({k: F.coalesce(c(k), F.array().cast(t)) for k, t in lists.items()})
    number = numbered if ids else lambda rows: rows
    asked = number(asked)  # two families count the same rows
    conflict = [("Node", text("node")), ("Template", text("class")), ("Arg", text("arg")), ("PlanValue", text("plan_value")), ("BaseValue", text("base_value")), ("FusedValue", text("fused_value"))]
    audit = _items(asked, "short_audit", [*conflict, ("Reason", text("reason")), ("EvidenceIds", _ids(c("evidence"))), ("SelectedArgs", args), ("OperationNotes", notes)], ["node", "arg"])
    repair = _items(asked, "repair", [*conflict, ("CurrentAction", text("action")), ("Reason", text("reason")), ("GraphPaths:\n", _lines(c("paths"), 6)), ("Evidence:\n", _matches(5))], ["node", "arg"])
    where = [("Operation", text("node")), ("Template", text("template"))]
    rerank = _items(number(operations.filter(F.size("matches") > 0)), "rerank", [*where, ("SelectedEvidenceIds", _ids(c("selected"))), ("Candidates:\n", _matches(5))], ["node"])
    context = _items(number(operations), "long_context", [*where, ("SelectedArgs", args), ("MissingFields", _ids(c("missing"))), ("OperationNotes", notes), ("GraphPaths:\n", _lines(c("paths"), 8)), ("RetrievalEvidence:\n", _matches(6))], ["node"])
    return audit.unionByName(rerank).unionByName(context).unionByName(repair)


def generation_profile(prompt: Column) -> Column:
    """Profile of an XML generation prompt by its estimated tokens."""
    return F.when(tokens_floor(prompt) > LONG_GENERATION, F.lit("long_context_xml_generation")).otherwise(F.lit("xml_generation"))


def sample(items: DataFrame, per_profile: int, key: str) -> DataFrame:
    """At most ``per_profile`` items of each profile: those of the lowest hash of key, workload and item id.

    Items are counted by the first digits of their hashes; only those up to the digits by which a profile has its number
    are sorted, and nothing but they has its prompt made.
    """
    h = F.md5(F.concat_ws("\x00", F.lit(key), "workload", "item_id"))
    head = F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("int")
    # At most 16 ** DIGITS rows of counts for each profile, and a row of limits; written, so that Spark knows its size.
    up_to = Window.partitionBy("profile").orderBy("_head")
    counts = items.groupBy("profile", head.alias("_head")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(up_to) - F.col("_n"))
    limits = written(counts.filter(F.col("_before") < per_profile).groupBy(F.col("profile").alias("_of")).agg(F.max("_head").alias("_last")), "replay-limits")
    few = items.join(limits, F.col("profile").eqNullSafe(F.col("_of")) & (head <= F.col("_last")), "left_semi")
    w = Window.partitionBy("profile").orderBy(h, "workload", "item_id")
    return few.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_profile).drop("_r")


def summary(items: DataFrame) -> DataFrame:
    """workload, profile, items, avg_prompt_chars, max_prompt_chars."""
    size = F.length("prompt")
    return items.groupBy("workload", "profile").agg(F.count("*").alias("items"), F.round(F.avg(size), 2).alias("avg_prompt_chars"), F.max(size).alias("max_prompt_chars"))
