"""Batch retrieval: BM25 with boosts, exact vector search, hybrid merging and evaluation, over all queries at once.

Corpus statistics are aggregates of the (filtered) candidate set; query and statistics sides are joined by key. The
per-query top-k is a ranked window, which Spark limits before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import normalised, tokens
from quarry.operators.nearest import nearest
from quarry.sources.workspace import written

K1, B = 1.5, 0.75


def top_k(scored: DataFrame, k: int, by: str = "query_id", id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows of each query under the total order (score down, id up), with their rank."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, filters: Column | None = None, phrase_boost: float = 0.0) -> DataFrame:
    """query_id, rank, doc_id, score: BM25 over the filtered candidates; a repeated query term counts again.

    ``docs`` has doc_id and text, ``queries`` query_id and query. Only terms that some query asks for are joined, so what
    is shuffled is proportional to the matching postings.
    """
    pool = (docs.filter(filters) if filters is not None else docs).select("doc_id", "text")
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    phrases = queries.select("query_id", normalised(F.col("query")).alias("phrase")).filter("phrase <> ''")
    # The queries are a batch of bounded size: what they ask for is one row, so that each text is cut into tokens once and
    # only its length, its asked terms and the phrases that it holds are kept.
    wanted = asked.agg(F.collect_set("term").alias("wanted")).join(phrases.agg(F.collect_list(F.struct("query_id", "phrase")).alias("phrases")), F.lit(True))
    cut = pool.select("doc_id", tokens(F.col("text")).alias("ts")).join(F.broadcast(wanted), F.lit(True))
    held = F.filter("phrases", lambda p: F.contains(F.col("body"), p["phrase"])) if phrase_boost else F.slice("phrases", 1, 0)
    kept = cut.select("doc_id", F.size("ts").alias("n_tokens"), F.filter("ts", lambda t: F.array_contains("wanted", t)).alias("ts"), F.array_join("ts", " ").alias("body"), "phrases")
    sized = written(kept.select("doc_id", "n_tokens", "ts", F.transform(held, lambda p: p["query_id"]).alias("held")), "bm25-texts")
    # One row, joined to the matching postings: the statistics are part of the plan.
    stats = F.broadcast(sized.agg(F.count("*").alias("n"), F.greatest(F.avg("n_tokens"), F.lit(1.0)).alias("avg_len")))
    postings = sized.select("doc_id", F.greatest("n_tokens", F.lit(1)).alias("len"), F.explode("ts").alias("term"))
    tf = postings.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = tf.join(df, "term").join(asked, "term").join(stats, F.lit(True)).groupBy("query_id", "doc_id").agg(F.sum(part * F.col("qtf")).alias("score"))
    if phrase_boost:
        hits = sized.select(F.explode("held").alias("query_id"), "doc_id", F.lit(phrase_boost).alias("score"))
        scored = scored.unionByName(hits).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return top_k(scored.withColumn("score", F.round("score", 6)).filter("score > 0"), k).select("query_id", "rank", "doc_id", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str, norms: tuple[Column, Column] | None = None) -> Column:
    """COSINE (0 for a zero vector), IP, or L2 as 1 / (1 + distance), to six decimals; ``norms`` are the vectors' lengths if known."""
    if metric == "L2":
        gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
        return F.round(1 / (1 + F.sqrt(gap)), 6)
    if metric == "IP":
        return F.round(dot(a, b), 6)
    left, right = norms or (F.sqrt(dot(a, a)), F.sqrt(dot(b, b)))
    return F.round(F.when(left * right == 0, 0.0).otherwise(dot(a, b) / (left * right)), 6)


#: Bytes of query vectors that are sent to every task at once.
QUERY_BLOCK = 32 << 20
#: Tasks of a search for each core.
TASKS = 2


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", filters: Column | None = None, source: str | None = None) -> DataFrame:
    """Exact top k per query: filters first, then (score down, id up), the first of each ``source``, then the cut.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and q. Vectors are dealt over the tasks; queries are broadcast in
    blocks of at most ``QUERY_BLOCK`` bytes (counted, not assumed), and each task cuts a block's best rows before a shuffle.
    """
    pool = vectors.filter(filters) if filters is not None else vectors
    # A table of vectors is small beside its work: few splits of its files would keep few cores busy.
    pool = pool.repartition(TASKS * pool.sparkSession.sparkContext.defaultParallelism)
    size = queries.agg(F.coalesce(F.sum(F.size("q") * 8 + 64), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // QUERY_BLOCK))
    found = None
    for i in range(n_blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i) if n_blocks > 1 else queries
        scored = nearest(pool, block.select("query_id", "q"), k, metric, source, carry=[source] if source else [])
        if source:
            first = Window.partitionBy("query_id", source).orderBy(F.col("score").desc(), F.col("vec_id"))
            scored = scored.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
        best = top_k(scored, k, id_col="vec_id").select("query_id", "rank", "vec_id", *([source] if source else []), "score")
        found = best if found is None else found.unionByName(best)
    return found


def min_max(score: str, by: str) -> Column:
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, 1.0).otherwise((F.col(score) - lo) / (hi - lo))


def hybrid_merge(sparse: DataFrame, dense: DataFrame, k: int, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Weighted sum of min-max scores by (query_id, doc_id); a query with one empty side keeps the other's raw scores."""
    side = lambda d, name, w: d.select("query_id", "doc_id", "score", (w * min_max("score", "query_id")).alias("part"), F.lit(name).alias("src"))
    both = side(sparse, "sparse", weights[0]).unionByName(side(dense, "dense", weights[1]))
    merged = both.groupBy("query_id", "doc_id").agg(F.sum("part").alias("mixed"), F.max("score").alias("raw"), F.array_join(F.array_sort(F.collect_set("src")), "+").alias("found"))
    w = Window.partitionBy("query_id")
    both_sides = F.max((F.col("found").contains("sparse")).cast("int")).over(w) + F.max((F.col("found").contains("dense")).cast("int")).over(w) == 2
    scored = merged.withColumn("exact", F.when(both_sides, F.col("mixed")).otherwise(F.col("raw")))
    label = F.when(F.col("found") == "dense+sparse", "hybrid").otherwise(F.col("found"))
    return top_k(scored, k, score="exact").select("query_id", "rank", "doc_id", F.round("exact", 6).alias("score"), label.alias("source"))


def fuse_graph(graph: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """100 * (0.65 graph + 0.35 retrieval) over min-max scores; a candidate with both parts 0 keeps its raw score."""
    g = graph.select("query_id", "doc_id", F.col("score").alias("g_raw"), min_max("score", "query_id").alias("g"))
    r = found.select("query_id", "doc_id", F.col("score").alias("r_raw"), min_max("score", "query_id").alias("r"))
    both = g.join(r, ["query_id", "doc_id"], "full").fillna({"g": 0.0, "r": 0.0})
    mixed = F.when((F.col("g") == 0) & (F.col("r") == 0), F.coalesce("g_raw", "r_raw")).otherwise(100 * (0.65 * F.col("g") + 0.35 * F.col("r")))
    return top_k(both.withColumn("score", F.round(mixed, 6)), k).select("query_id", "rank", "doc_id", "score")


def recall_mrr(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """queries, recall_at_k and mrr; ranks beyond k count for the reciprocal rank only."""
    first = ranked.join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    all_q = relevant.select("query_id").distinct().join(first, "query_id", "left")
    return all_q.agg(
        F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def recall_by_label(ranked: DataFrame, queries: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The same where a row is relevant that shares the query's label: only ranked rows are looked up, never pairs of a label.

    ``ranked`` has query_id, rank and doc_id, ``queries`` query_id, ``labels`` doc_id and label. Queries whose label no other
    row has do not count.
    """
    shared = labels.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
    asked = queries.join(labels.select(F.col("doc_id").alias("query_id"), "label"), "query_id").join(shared.select("label"), "label", "left_semi")
    hit = ranked.filter("query_id <> doc_id").join(labels.select("doc_id", F.col("label").alias("of_doc")), "doc_id").join(asked, "query_id").filter(F.col("label") == F.col("of_doc"))
    first = asked.select("query_id").join(hit.groupBy("query_id").agg(F.min("rank").alias("first")), "query_id", "left")
    return first.agg(
        F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )
