"""Series metrics, thresholds, deltas, replay aggregates, routing and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens_ceil
from quarry.operators.measures import linear_quantiles, ranked_quantiles, value_counts


def series_nearest_rank(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, min, max, mean, nearest-rank p50/p90/p95/p99, sample deviation and its ratio to the mean.

    Quantiles come from value counts, which combine before the shuffle, so a hot group costs its distinct values only.
    """
    dev = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    plain = df.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"), F.round(dev, 6).alias("stdev"), F.round(F.coalesce(F.try_divide(dev, F.avg(value)), F.lit(0.0)), 6).alias("cv"))
    ranks = ranked_quantiles(value_counts(df, [by], value), [by], {f"p{p}": p / 100 for p in (50, 90, 95, 99)})
    return plain.join(ranks, by).select(by, "n", "min", "max", "mean", "p50", "p90", "p95", "p99", "stdev", "cv")


def series_linear(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median and p95 with linear interpolation, from value counts."""
    plain = df.groupBy(by).agg(F.count(value).alias("n"))
    return plain.join(linear_quantiles(value_counts(df, [by], value), [by], {"p50": 0.5, "p95": 0.95}), by)


def replay_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Valid and failed requests, rate of valid ones, and valid requests per second of summed duration."""
    ok = F.count_if("valid")
    return df.groupBy(*by).agg(F.count("*").alias("requests"), ok.alias("n_valid"), (F.count("*") - ok).alias("n_invalid"), F.round(F.coalesce(F.try_divide(ok, F.count("*")), F.lit(0.0)), 6).alias("valid_rate"), F.round(F.coalesce(F.try_divide(ok, F.sum("duration")), F.lit(0.0)), 6).alias("per_second"))


def endpoint_throughput(df: DataFrame, by: str, at: str) -> DataFrame:
    """Requests, wall seconds between the first and the last, and requests per second (0 where no time passed)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    wall = (micros(F.max(at)) - micros(F.min(at))) / 1e6
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(wall, 3).alias("wall_s"), F.round(F.coalesce(F.try_divide(F.count("*"), wall), F.lit(0.0)), 9).alias("per_second"))


def most_frequent(df: DataFrame, items: Column, n: int) -> DataFrame:
    """item and count of the ``n`` most frequent array elements, ties by item."""
    return df.select(F.explode(items).alias("item")).groupBy("item").count().orderBy(F.desc("count"), "item").limit(n)


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """name and after - before (0 where a metric is new); values of one name are summed first."""
    total = lambda d, c: d.groupBy("name").agg(F.sum("value").alias(c))
    return total(after, "a").join(total(before, "b"), "name", "left").select("name", F.round(F.col("a") - F.coalesce("b", F.lit(0.0)), 6).alias("delta"))


def threshold_checks(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rules named ``x_max``, ``x_min`` or ``x`` against metric x; a missing metric fails."""
    key = F.regexp_replace("rule", "_(max|min)$", "")
    joined = thresholds.withColumn("name", key).join(metrics, "name", "left")
    passed = F.when(F.endswith("rule", F.lit("_max")), F.col("value") <= F.col("expected")).when(F.endswith("rule", F.lit("_min")), F.col("value") >= F.col("expected")).otherwise(F.col("value") == F.col("expected"))
    return joined.select("rule", "value", "expected", F.coalesce(passed, F.lit(False)).alias("passed"))


def eligible_endpoints(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Range join of requests (profile, n_tokens) with the endpoint table; unmatched requests go to the default ones.

    The endpoint table is a handful of configuration rows.
    """
    fits = (F.col("n_tokens") >= F.col("min_tokens")) & (F.col("n_tokens") <= F.col("max_tokens")) & (F.col("profile") == F.col("serves"))
    hit = requests.join(endpoints.filter("not is_default"), fits).select(*requests.columns, "endpoint")
    rest = requests.join(hit.select("request_id").distinct(), "request_id", "left_anti")
    return hit.unionByName(rest.join(endpoints.filter("is_default").select("endpoint", F.lit(1).alias("_k")), F.lit(1) == F.col("_k")).select(*requests.columns, "endpoint"))


def round_robin(requests: DataFrame, slots: list[str], by: str, order: str) -> DataFrame:
    """The slot that a weighted rotation gives each request, counted within ``by``."""
    turn = (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) % len(slots)
    return requests.withColumn("endpoint", F.element_at(F.array(*map(F.lit, slots)), turn + 1))


def failure_runs(events: DataFrame, by: str, order: str, failed: Column, limit: int = 2) -> DataFrame:
    """Requests at which a breaker with ``limit`` consecutive failures would open: run length by gaps and islands."""
    w = Window.partitionBy(by).orderBy(order)
    island = F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = events.withColumn("_island", island).withColumn("_failed", failed)
    nth = F.row_number().over(Window.partitionBy(by, "_island", "_failed").orderBy(order))
    return runs.filter("_failed").withColumn("run", nth).withColumn("opens", F.col("run") == limit).drop("_island", "_failed")


def token_budget(matches: DataFrame, by: str, budget: int, max_items: int = 8, min_score: float = 0.0) -> DataFrame:
    """Greedy packing per group: score order, duplicates of kept ids and low scores dropped, oversized items skipped.

    ``matches`` has id, score and text. Items of one group are folded in order; the first kept item always fits.
    """
    item = F.struct((-F.col("score")).alias("neg"), "id", tokens_ceil(F.col("text")).alias("cost"), "score")
    rows = matches.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("long").alias("used"))

    def step(a: Column, x: Column) -> Column:
        known = F.array_contains(a["kept"], x["id"].cast("string"))
        full = (F.size(a["kept"]) >= max_items) | ((F.size(a["kept"]) > 0) & (a["used"] + x["cost"] > budget))
        return F.when(known | (x["score"] < min_score) | full, a).otherwise(F.struct(F.concat(a["kept"], F.array(x["id"].cast("string"))).alias("kept"), (a["used"] + x["cost"]).alias("used")))

    folded = rows.select(by, F.size("items").alias("n"), F.aggregate("items", start, step).alias("a"))
    return folded.select(by, F.array_join("a.kept", ",").alias("kept"), F.col("a.used").alias("used_tokens"), (F.col("n") - F.size("a.kept")).cast("long").alias("n_dropped"))
