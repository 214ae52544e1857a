"""Quality rules: surface statistics plus a hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over ``n_buckets`` hash buckets are fitted: one on trusted labelled documents, one on the whole raw
corpus. With E the count that a bucket's raw share would give in the trusted text and g the count there, its weight is
``log((g + smoothing) / (E + smoothing))`` (both smoothed by the same mass), and zero unless g lies ``significance`` or more
standard deviations from E and the weight's size is ``effect`` or more: what rare words happen to do, and what copies do
to common ones, is noise, which summed over a document hid the words that trusted text really avoids. A document's score is the mean weight of its n-grams. The threshold is one number, the score
that ``keep_percent`` of the trusted documents which pass the base rules reach; every document is judged by it, so a
verdict never depends on partitioning.

Everything is a DataFrame expression. Counting is one map-side-combined aggregate into at most ``n_buckets`` rows;
scoring is narrow (no shuffle of texts): the fitted weights, ``n_buckets`` doubles, are a scalar subquery of the scoring plan.

Defined results: a null text has no words (all counts 0, ``base_failed``); a text without n-grams has a null score and
is judged by the base rules alone, and so is every document when no trusted row exists; repeated rows and equal ids are
judged row by row; extra columns of the input are ignored by name and never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WHITE, free_name, let, materialized, words


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    orders: tuple[int, ...] = (1, 2)
    n_buckets: int = 1 << 18
    smoothing: float = 1.0
    significance: float = 6.0
    effect: float = 0.7
    keep_percent: int = 98
    #: Most trusted documents that weights and threshold are fitted on; the lowest hashes of the id are taken.
    trusted_bound: int = 20_000


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    shingles = F.when(
        F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(pairs: Column) -> Column:
        twin = F.filter(
            pairs,
            lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)),
        )
        starts = F.array_sort(F.transform(twin, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    def count(sh: Column) -> Column:
        pairs = F.sort_array(F.transform(sh, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(sh)) == F.size(sh), F.lit(0)).otherwise(let(pairs, covered))

    return let(shingles, count)


def base_features(text: Column, w: Column, p: QualityParams) -> dict[str, Column]:
    """Surface statistics of one text; ``w`` are its words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    bare = t
    for symbol in "#*$%&|<>":
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(bare)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(w).cast("long"),
    }


def ngram_buckets(w: Column, p: QualityParams) -> Column:
    """Hash buckets of the n-grams of all orders, repeats included."""
    slot = lambda *cs: F.pmod(F.xxhash64(*cs), F.lit(p.n_buckets)).cast("int")

    def of_order(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(w, lambda x: slot(x)) if n == 1 else F.transform(starts, lambda i: slot(*(w[i + k] for k in range(n))))

    return F.concat(*map(of_order, p.orders))


def trusted_documents(docs: DataFrame, labels: DataFrame, p: QualityParams) -> DataFrame:
    """Texts of the labelled documents of quality 1 and toxic 0, at most ``trusted_bound`` ids."""
    ids = (
        labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull())
        .select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.trusted_bound)
    )
    return materialized(docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text"), "quality-trusted")


def fit_weights(docs: DataFrame, trusted: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """One row ``weights array<double>`` (null without trusted text): log-ratio of every bucket. The raw counts cover all documents."""
    bucket = F.explode(ngram_buckets(F.col("w"), p)).alias("bucket")
    tokens = lambda d: d.select(words(F.col("text")).alias("w")).select(bucket).groupBy("bucket").count()
    raw = tokens(docs).select("bucket", F.col("count").alias("raw"), F.lit(0).cast("long").alias("good"))
    good = tokens(trusted).select("bucket", F.lit(0).cast("long").alias("raw"), F.col("count").alias("good"))
    counts = materialized(raw.unionByName(good).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")), "quality-counts")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")).first()
    share = total["g"] / total["r"] if total["r"] else 0.0
    expected = F.col("raw") * F.lit(share)
    ratio = F.log((F.col("good") + F.lit(p.smoothing)) / (expected + F.lit(p.smoothing)))
    sure = (F.abs(F.col("good") - expected) >= p.significance * F.sqrt(expected + 1)) & (F.abs(ratio) >= p.effect)
    every = counts.sparkSession.range(p.n_buckets).select(F.col("id").cast("int").alias("bucket"))
    weighed = counts.select("bucket", F.when(sure, ratio).otherwise(0.0).alias("w"))
    filled = every.join(weighed, "bucket", "left").select("bucket", F.coalesce("w", F.lit(0.0)).alias("w"))
    packed = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "w"))), lambda x: F.round(x["w"], 6)).alias("weights"))
    return materialized(packed if total["g"] else packed.select(F.lit(None).cast("array<double>").alias("weights")), "quality-weights")


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")


def judge(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept added.

    Columns of those names in the input are replaced.
    """
    trusted = trusted_documents(docs, labels, p)
    fitted_weights, wt_name = fit_weights(docs, trusted, p), free_name(docs, "weights")

    def seen(w: Column) -> Column:
        mean = let(F.col(wt_name), lambda wt: let(ngram_buckets(w, p), lambda gs: F.when((F.size(gs) > 0) & F.isnotnull(wt), F.aggregate(gs, F.lit(0.0), lambda acc, g: acc + wt[g]) / F.size(gs))))
        return F.struct(*[c.alias(n) for n, c in (base_features(F.col("text"), w, p) | {"score": mean}).items()])

    def verdict(f: Column) -> Column:
        failed = (f["n_words"] < p.min_words) | (100 * f["n_repeat_words"] > p.max_repeat_percent * f["n_words"])
        return let(failed, lambda b: F.struct(*[f[n].alias(n) for n in FEATURES], b.alias("base_failed"), (~b & F.coalesce(f["score"] >= threshold, F.lit(True))).alias("kept")))

    def judged(rows: DataFrame, name: str) -> DataFrame:
        # The weights are a scalar subquery: one row of ``n_buckets`` doubles, which no plan spells out. The optimiser moves it
        # into the one expression that reads it, so it is no column of the rows. All bindings stand inside that expression:
        # pushing a filter on the verdict down cannot repeat its parts.
        return rows.withColumn(wt_name, fitted_weights.scalar()).withColumn(name, let(let(words(F.col("text")), seen), verdict)).drop(wt_name)

    threshold = F.lit(None).cast("double")
    fitted = judged(trusted, "v").filter("not v.base_failed").agg(F.percentile("v.score", F.lit(1 - p.keep_percent / 100))).first()[0]
    threshold = F.lit(fitted).cast("double")
    name = free_name(docs, "verdict")
    return judged(docs, name).withColumns({n: F.col(name)[n] for n in (*FEATURES, "base_failed", "kept")}).drop(name)
