"""Benchmark and regression measures: request timing, replay and run metrics, generation and guardrail counts, warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("duration", "ttft", "tpot", "tokens_per_second", "prompt_tokens", "completion_tokens")


def ratio(part: Column, whole: Column) -> Column:
    """Share to six decimals, 0 where there is nothing."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 6)


def micros(value: Column) -> Column:
    """A value of 0 or more to six decimals by the same floating-point steps in every engine: halves go up."""
    return F.floor(value * 1e6 + 0.5) / 1e6


def timed(requests: DataFrame) -> DataFrame:
    """Adds tpot (seconds per token after the first, null without a first token or with one token) and tokens_per_second."""
    late = F.greatest(F.col("duration") - F.col("ttft"), F.lit(0.0))
    tpot = F.when(F.col("ttft").isNotNull() & (F.col("completion_tokens") > 1), micros(late / (F.col("completion_tokens") - 1)))
    rate = F.when((F.col("duration") > 0) & (F.col("completion_tokens") > 0), F.col("completion_tokens") / F.col("duration")).otherwise(0.0)
    return requests.withColumns({"tpot": tpot, "tokens_per_second": micros(rate)})


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """How often each value occurs: the counts that exact quantiles need, combined before the shuffle."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def linear_quantiles(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation from value counts (by, value, n).

    A group's values are ranked by running sums over its distinct values, so equal values are one row, however many.
    """
    w = Window.partitionBy(*by).orderBy("value")
    ranked = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    aggs = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * F.lit(share)
        low, high = F.floor(at), F.ceil(at)
        low_value = F.min(F.when(F.col("upto") > low, F.col("value")))
        high_value = F.min(F.when(F.col("upto") > high, F.col("value")))
        part = F.max(at - low)
        aggs.append(F.round(low_value + (high_value - low_value) * part, 6).alias(name))
    return ranked.groupBy(*by).agg(*aggs)


def ranked_quantiles(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact nearest-rank quantiles from value counts: the least value that at least the share of all values does not exceed."""
    w = Window.partitionBy(*by).orderBy("value")
    ranked = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(share)), F.col("value"))).alias(name) for name, share in shares.items()])


def replay(requests: DataFrame, by: str) -> DataFrame:
    """Replay metrics per profile (none is ``default``): counts, rates, tokens, and mean, median and p95 of every series.

    Wall time is the sum of durations; the rate counts valid requests over it.
    """
    named = requests.withColumn(by, F.coalesce(by, F.lit("default")))
    total = F.coalesce(F.sum("duration"), F.lit(0.0))
    evaluated, ok = F.count_if("xml_evaluated"), F.count_if("valid")
    out = named.groupBy(by).agg(
        F.count("*").alias("requests"), ok.alias("n_valid"), (F.count("*") - ok).alias("n_invalid"), ratio(ok, F.count("*")).alias("success_rate"), F.sum(F.coalesce("completion_tokens", F.lit(0))).cast("long").alias("completion_tokens_total"),
        F.round(total, 6).alias("wall_seconds"), F.round(F.coalesce(F.try_divide(ok, total), F.lit(0.0)), 6).alias("requests_per_second"), evaluated.alias("xml_samples"), ratio(F.count_if(F.col("xml_evaluated") & F.col("xml_valid")), evaluated).alias("xml_valid_rate"),
        *[F.round(F.avg(s), 6).alias(f"{s}_mean") for s in SERIES],
    )
    for s in SERIES:
        out = out.join(linear_quantiles(value_counts(named, [by], s), [by], {f"{s}_p50": 0.5, f"{s}_p95": 0.95}), by, "left")
    return out


def generation_metrics(generations: DataFrame, by: str) -> DataFrame:
    """Generations, valid ones, reviews, repairs, tokens, and the mean of the latencies that are not zero."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.nullif(F.col(c), F.lit(0.0))), F.lit(0.0)), 6)
    return generations.groupBy(by).agg(F.count("*").alias("generations"), F.count_if("valid").alias("n_valid"), F.count_if("needs_review").alias("n_review"), F.coalesce(F.sum("repairs"), F.lit(0)).alias("n_repairs"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).cast("long").alias("prompt_tokens"), mean("latency").alias("mean_latency"), mean("repair_latency").alias("mean_repair_latency"))


def correction_counts(corrections: DataFrame) -> DataFrame:
    """(dimension, key, n) of guardrail corrections by argument and by source; a missing key is ``unknown``."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    pairs = F.array(F.struct(F.lit("arg").alias("dimension"), named("arg").alias("key")), F.struct(F.lit("source").alias("dimension"), named("source").alias("key")))
    return corrections.select(F.inline(pairs)).groupBy("dimension", "key").agg(F.count("*").alias("n"))


def ranked_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenarios by requests per second, fastest first, ties by name; missing figures are 0."""
    filled = scenarios.select("name", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("requests_per_second", "ttft_p95", "tokens_per_second")])
    # A handful of scenarios: the ranking is of a report, not of the corpus.
    return filled.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("requests_per_second"), "name")))


def acceptance(results: DataFrame, by: str) -> DataFrame:
    """Results by status per group."""
    return results.groupBy(by).agg(F.count("*").alias("scenarios"), *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "blocked", "dry_run")])


def failed_samples(checks: DataFrame, by: str, limit: int = 30) -> DataFrame:
    """The first ``limit`` failures of each group, pipeline steps before checks (a report's excerpt)."""
    w = Window.partitionBy(by).orderBy(F.when(F.col("stage") == "pipeline", 0).otherwise(1), "ord")
    return checks.filter("not passed").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(by, "rank", "stage", "name")


def quality_warnings(runs: DataFrame, least: int) -> DataFrame:
    """Per run (iterations, warmups, n_timeout, n_failed) the warnings that its figures deserve."""
    said = [
        (F.col("iterations") < least, F.concat(F.lit("measured_iterations "), F.col("iterations").cast("string"), F.lit(f" is below recommended minimum {least}"))),
        (F.col("warmups") <= 0, F.lit("warmup_iterations is 0; first-sample cold effects may affect metrics")),
        (F.col("n_timeout") > 0, F.lit("one or more samples timed out")),
        (F.col("n_failed") > 0, F.lit("one or more samples failed")),
    ]
    return runs.withColumn("warnings", F.array_compact(F.array(*[F.when(c, s) for c, s in said])))


def stdout_series(samples: DataFrame, by: str) -> DataFrame:
    """(by, key, n, mean, min, max) of the numbers in each sample's JSON output; text, nulls and true/false do not count."""
    each = samples.select(by, F.explode(F.from_json("stdout", "map<string,string>")).alias("key", "raw"), F.regexp_replace("stdout", r"\s*:\s*", ":").alias("tight"))
    # A quoted number is text.
    quoted = F.contains("tight", F.concat(F.lit('"'), "key", F.lit('":"')))
    numbers = each.filter(F.col("raw").try_cast("double").isNotNull() & ~quoted).select(by, F.concat(F.lit("stdout_"), "key").alias("key"), F.col("raw").cast("double").alias("v"))
    return numbers.groupBy(by, "key").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))


def observability(deltas: DataFrame, after: DataFrame) -> DataFrame:
    """Metric rows named ``delta_…`` and ``after_…``, names reduced to letters, digits and underscores."""
    safe = F.regexp_replace(F.regexp_replace("name", r"[^a-zA-Z0-9_]+", "_"), "^_+|_+$", "")
    one = lambda d, mark, c: d.select(F.concat(F.lit(mark), safe).alias("metric"), F.col(c).alias("value"))
    return one(deltas, "delta_", "delta").unionByName(one(after, "after_", "value"))


def source_presence(operations: DataFrame, source: str) -> DataFrame:
    """Operations (op, source, hybrid_sources, n_trace) that ``source`` contributed to by match, hybrid match or trace."""
    hybrid = F.exists(F.coalesce("hybrid_sources", F.array().cast("array<string>")), lambda s: F.lower(s) == source)
    hit = (F.lower(F.coalesce("source", F.lit(""))) == source) | hybrid | (F.coalesce("n_trace", F.lit(0)) > 0)
    return operations.groupBy("op").agg(F.bool_or(hit).alias("present"))


def mean_latency(operations: DataFrame, by: str) -> DataFrame:
    return operations.groupBy(by).agg(F.round(F.coalesce(F.avg("latency"), F.lit(0.0)), 6).alias("mean_latency"))


def chain_metrics(nodes: DataFrame, by: str) -> DataFrame:
    """Coverage ratios of an evidence-chain report (n_kept, n_decisions, document, has_reference, flowchart_status)."""
    known = ~F.coalesce("document", F.lit("")).isin("", "not_found", "not_available", "not_applicable")
    reference, found = F.count_if("has_reference"), F.count_if(F.col("has_reference") & (F.col("flowchart_status") == "found"))
    n = F.count("*")
    return nodes.groupBy(by).agg(n.alias("nodes"), ratio(F.count_if(F.col("n_kept") > 0), n).alias("kept_coverage"), ratio(found, reference).alias("reference_rate"), ratio(F.count_if(known), n).alias("document_coverage"), ratio(F.count_if(F.col("n_decisions") > 0), n).alias("trace_coverage"))


def status_counts(items: DataFrame, by: str, status: str, known: list[str]) -> DataFrame:
    """One row per group with a count for each known status."""
    return items.groupBy(by).agg(*[F.count_if(F.col(status) == s).alias(s) for s in known])


def latest_routes(decisions: DataFrame, by: str, n: int = 256) -> DataFrame:
    """The latest ``n`` routing decisions of each endpoint, newest first."""
    w = Window.partitionBy(by).orderBy(F.desc("at"), F.desc("request_id"))
    return decisions.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def budgeted_paths(paths: DataFrame, limit: int) -> DataFrame:
    """Distinct graph paths of each node in order of first mention, at most ``limit`` (a prompt's budget), with counts before and after."""
    first = paths.groupBy("node", "path").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    w = Window.partitionBy("node").orderBy("ord", "path")
    kept = first.withColumn("rank", F.row_number().over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= limit, F.struct("rank", "path")))), lambda x: x["path"]), " | ")
    return kept.groupBy("node").agg(F.sum("n").alias("original_paths"), F.count_if(F.col("rank") <= limit).alias("kept_paths"), joined.alias("paths"))
