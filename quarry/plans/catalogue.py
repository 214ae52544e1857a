"""All registered queries of the engine on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import audit, chunking, graph, reporting, retrieval
from quarry.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ASKED = [(1, "the tion of that"), (2, "reading the engine of the"), (3, "verkeit und die lich")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A table of few files dealt over the cores, for rows that bring much work each; larger tables keep their splits."""
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _tok(column: str) -> str:
    """SQL list of the tokens of a column."""
    return f"list_filter(list_transform(regexp_extract_all(coalesce({column}, ''), '{T.TOKEN}'), lambda t: regexp_replace(lower(t), '^0x', '')), lambda t: t <> '')"


_ASKED_SQL = f"asked(query_id, query) AS (VALUES {_values(ASKED)})"


def _bm25_sql(where: str = "true", boost: float = 0.0, k: int = 8) -> str:
    phrase = f"""UNION ALL SELECT query_id, doc_id, {boost}e0 FROM pool, asked
      WHERE array_to_string({_tok('query')}, ' ') <> '' AND contains(array_to_string(ts, ' '), array_to_string({_tok('query')}, ' '))""" if boost else ""
    return f"""
WITH {_ASKED_SQL},
pool AS (SELECT doc_id, {_tok('text')} AS ts FROM documents WHERE {where}),
stats AS (SELECT count(*) AS n, greatest(avg(len(ts)), 1e0) AS avg_len FROM pool),
tf AS (SELECT doc_id, greatest(len(ts), 1) AS dl, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM pool) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, unnest({_tok('query')}) AS term FROM asked),
parts AS (
  SELECT query_id, doc_id, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avg_len)) AS s
  FROM q JOIN tf USING (term) JOIN df USING (term), stats {phrase}),
scored AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM parts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


@query(_bm25_sql())
def bm25_topk(spark, d):
    return retrieval.bm25(_t(spark, d, "documents"), _asked(spark), 8)


@query(_bm25_sql("lang = 'en' AND source = 'src3'"))
def bm25_filtered(spark, d):
    return retrieval.bm25(_t(spark, d, "documents"), _asked(spark), 8, filters=(F.col("lang") == "en") & (F.col("source") == "src3"))


@query(_bm25_sql(boost=5.0))
def phrase_boost_rank(spark, d):
    return retrieval.bm25(_t(spark, d, "documents"), _asked(spark), 8, phrase_boost=5.0)


@query(f"SELECT lang, count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_tokens, round(avg(len(ts)), 6) AS avg_tokens FROM (SELECT lang, {_tok('text')} AS ts FROM documents) GROUP BY lang")
def corpus_stats(spark, d):
    sized = _t(spark, d, "documents").select("lang", F.size(T.tokens(F.col("text"))).alias("n"))
    return sized.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_tokens"), F.round(F.avg("n"), 6).alias("avg_tokens"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def unit_summary(spark, d):
    return _t(spark, d, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select("lang", "source", "n", "chars")




def _ids(pattern: str, keep: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{T.WORD_SPLIT}'), lambda w: upper(regexp_extract(w, '{pattern}', 1))), lambda w: {keep}))"


_KNOWN = ", ".join(f"'{s}'" for s in T.SERVICE_IDS)


@query("SELECT doc_id, array_to_string(list_sort(" + _ids("^(?:DID|did)?([0-9A-Fa-f]{4})$", "w <> ''") + "), ',') AS data_ids, array_to_string(list_sort(" + _ids("^(?:0x)?([0-9A-Fa-f]{2})$", f"w IN ({_KNOWN})") + "), ',') AS service_ids FROM documents")
def id_extraction(spark, d):
    text = F.col("text")
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.data_ids(text)), ",").alias("data_ids"), F.array_join(F.array_sort(T.service_ids(text)), ",").alias("service_ids"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def first_wins_dedupe(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def _similar_sql(expr: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, label, vec_id, CAST(embedding AS DOUBLE[]) AS e, q FROM embeddings, q WHERE len(embedding) = len(q)),
r AS (SELECT query_id, label, vec_id, round({expr}, 6) AS score FROM s)"""


_COS = "list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))"
_L2 = "1 / (1 + list_distance(e, q))"
_TOP = " SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r) WHERE rank <= 8"


def _search(metric: str):
    def run(spark, d, **more):
        v = _t(spark, d, "embeddings")
        return retrieval.vector_search(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 8, metric, **more)

    return run


@query(_similar_sql(_COS) + _TOP)
def cosine_topk(spark, d):
    return _search("COSINE")(spark, d)


@query(_similar_sql("list_dot_product(e, q)") + _TOP)
def ip_topk(spark, d):
    return _search("IP")(spark, d)


@query(_similar_sql(_L2) + _TOP)
def l2_topk(spark, d):
    return _search("L2")(spark, d)


@query(_similar_sql(_COS) + ", f AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS nth FROM r WHERE vec_id % 2 = 1) SELECT query_id, rank, vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f WHERE nth = 1) WHERE rank <= 8")
def dense_filtered_dedupe(spark, d):
    return _search("COSINE")(spark, d, filters=F.col("vec_id") % 2 == 1, source="label")


_SIDES = """sparse AS (SELECT l_orderkey % 20 AS query_id, l_partkey AS doc_id, max(l_quantity) AS score FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 20 < 6 GROUP BY ALL),
dense AS (SELECT l_orderkey % 20 AS query_id, l_partkey AS doc_id, round(max(l_extendedprice), 2) AS score FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey % 20 BETWEEN 3 AND 9 GROUP BY ALL)"""


def _sides(spark, d):
    li = _t(spark, d, "lineitem").withColumn("query_id", F.col("l_orderkey") % 20)
    side = lambda flag, lo, hi, score: li.filter((F.col("l_returnflag") == flag) & F.col("query_id").between(lo, hi)).groupBy("query_id", F.col("l_partkey").alias("doc_id")).agg(score.alias("score"))
    return side("R", 0, 5, F.max("l_quantity")), side("A", 3, 9, F.round(F.max("l_extendedprice"), 2))


_NORM = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1e0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


@query(f"""WITH {_SIDES},
p AS (SELECT *, 0.6e0 * {_NORM} AS part, 'sparse' AS src FROM sparse WINDOW w AS (PARTITION BY query_id) UNION ALL SELECT *, 0.4e0 * {_NORM}, 'dense' FROM dense WINDOW w AS (PARTITION BY query_id)),
m AS (SELECT query_id, doc_id, sum(part) AS mixed, max(score) AS raw, count(DISTINCT src) AS n, min(src) AS src FROM p GROUP BY ALL),
b AS (SELECT query_id, count(DISTINCT src) AS sides FROM p GROUP BY query_id),
s AS (SELECT query_id, doc_id, CASE WHEN sides = 2 THEN mixed ELSE raw END AS exact, CASE WHEN n = 2 THEN 'hybrid' ELSE src END AS source FROM m JOIN b USING (query_id))
SELECT query_id, rank, doc_id, round(exact, 6) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def hybrid_merge(spark, d):
    return retrieval.hybrid_merge(*_sides(spark, d), 10)


@query(f"""WITH {_SIDES},
g AS (SELECT *, {_NORM} AS part FROM sparse WINDOW w AS (PARTITION BY query_id)), r AS (SELECT *, {_NORM} AS part FROM dense WINDOW w AS (PARTITION BY query_id)),
j AS (SELECT query_id, doc_id, coalesce(g.part, 0) AS a, coalesce(r.part, 0) AS b, coalesce(g.score, r.score) AS raw FROM g FULL JOIN r USING (query_id, doc_id)),
s AS (SELECT query_id, doc_id, round(CASE WHEN a = 0 AND b = 0 THEN raw ELSE 100 * (0.65e0 * a + 0.35e0 * b) END, 6) AS score FROM j)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def fusion_65_35(spark, d):
    return retrieval.fuse_graph(*_sides(spark, d), 10)


@query(_similar_sql(_COS) + """, k AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r),
l AS (SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
f AS (SELECT l.query_id, min(rank) AS first FROM l LEFT JOIN (SELECT * FROM k WHERE rank <= 20) k USING (query_id, vec_id) GROUP BY l.query_id)
SELECT count(*) AS queries, round(avg(CASE WHEN first <= 8 THEN 1e0 ELSE 0e0 END), 6) AS recall_at_k, round(avg(coalesce(1e0 / first, 0e0)), 6) AS mrr FROM f""")
def recall_mrr_at_k(spark, d):
    v = _t(spark, d, "embeddings")
    asked = v.filter("vec_id % 50 = 0")
    ranked = retrieval.vector_search(v, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 20).withColumnRenamed("vec_id", "doc_id")
    return retrieval.recall_by_label(ranked, asked.select(F.col("vec_id").alias("query_id")), v.select(F.col("vec_id").alias("doc_id"), "label"), 8)


@query("""SELECT page_id, position, text FROM (
  SELECT page_id, pos - 1 AS position, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, unnest(x) AS raw, generate_subscripts(x, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS x FROM pages))) WHERE text <> ''""")
def page_blocks(spark, d):
    return chunking.page_blocks(_t(spark, d, "pages"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def page_link_edges(spark, d):
    return chunking.page_links(_t(spark, d, "pages"))


@query("""WITH f AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS paragraph FROM f)
SELECT conv_id, CAST(paragraph AS BIGINT) AS paragraph, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_blocks FROM n GROUP BY ALL""")
def paragraph_merge(spark, d):
    from pyspark.sql import Window

    new = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")) != F.col("role")
    return chunking.paragraphs(_t(spark, d, "conversations"), "conv_id", "turn", new, "text")


# Documents with headings before, after and around their text, or without any.
_MARKDOWN = "CASE doc_id % 4 WHEN 0 THEN concat('intro', chr(10), '# First part ', doc_id, chr(10), text, chr(10), '##  Second', chr(10), 'line c') WHEN 1 THEN text WHEN 2 THEN concat('# Only ', lang, chr(10)) ELSE concat('### Deep', chr(10), '#no heading', chr(10), text) END"


@query(f"""WITH docs AS (SELECT doc_id, {_MARKDOWN} AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM docs),
n AS (SELECT *, regexp_matches(raw, '^#{{1,6}}\\s+\\S') AS h FROM l),
s AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM n)
SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(max(CASE WHEN h THEN trim(regexp_replace(raw, '^#{{1,6}}\\s+', '')) END), 'document') AS title,
  coalesce(trim(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT h)), '') AS body, min(line) AS first_line, max(line) AS last_line
FROM s GROUP BY doc_id, section""")
def markdown_sections(spark, d):
    return chunking.markdown_sections(_t(spark, d, "documents").selectExpr("doc_id", f"{_MARKDOWN} AS text"))


_SERIES = "SELECT event_type, value FROM events"


@query("SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(coalesce(stddev_samp(value), 0), 6) AS stdev, round(coalesce(stddev_samp(value) / nullif(avg(value), 0), 0), 6) AS cv FROM events GROUP BY event_type")
def series_nearest_rank(spark, d):
    return reporting.series_nearest_rank(_t(spark, d, "events"), "event_type", "value")


@query("SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def series_linear(spark, d):
    return reporting.series_linear(_t(spark, d, "events"), "event_type", "value")


@query("SELECT event_type AS profile, count(*) AS requests, count(*) FILTER (value >= 10) AS n_valid, count(*) FILTER (value < 10) AS n_invalid, round(count(*) FILTER (value >= 10) / count(*), 6) AS valid_rate, round(count(*) FILTER (value >= 10) / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def replay_by_profile(spark, d):
    runs = _t(spark, d, "events").select(F.col("event_type").alias("profile"), F.col("value").alias("duration"), (F.col("value") >= 10).alias("valid"))
    return reporting.replay_metrics(runs, ["profile"])


@query("SELECT event_type AS name, round(sum(value) FILTER (ts >= TIMESTAMP '2024-01-15') - coalesce(sum(value) FILTER (ts < TIMESTAMP '2024-01-15'), 0), 6) AS delta FROM events GROUP BY event_type HAVING count(*) FILTER (ts >= TIMESTAMP '2024-01-15') > 0")
def metric_delta(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("name"), "value", (F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).alias("late"))
    return reporting.metric_delta(e.filter("not late"), e.filter("late"))


RULES = [("click_max", 1e9), ("click_min", 1e9), ("view_min", 1.0), ("absent_max", 5.0), ("purchase", -1.0)]


@query(f"""WITH r(rule, expected) AS (VALUES {_values(RULES)}), m AS (SELECT event_type AS name, round(sum(value), 6) AS value FROM events GROUP BY event_type)
SELECT rule, value, CAST(expected AS DOUBLE) AS expected, coalesce(CASE WHEN rule LIKE '%\\_max' ESCAPE '\\' THEN value <= expected WHEN rule LIKE '%\\_min' ESCAPE '\\' THEN value >= expected ELSE value = expected END, false) AS passed
FROM r LEFT JOIN m ON m.name = regexp_replace(rule, '_(max|min)$', '')""")
def threshold_checks(spark, d):
    metrics = _t(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.sum("value"), 6).alias("value"))
    return reporting.threshold_checks(metrics, spark.createDataFrame(RULES, "rule string, expected double"))


@query("SELECT conv_id, CASE WHEN n <= 64 THEN 'a' ELSE 'b' END AS band, CASE WHEN n <= 4096 THEN 'short' WHEN n <= 32768 THEN 'standard' WHEN n <= 65536 THEN 'extended' WHEN n <= 131072 THEN 'extreme' ELSE 'overflow' END AS tier FROM (SELECT conv_id, CAST(sum(length(text)) * 20 AS BIGINT) AS n FROM conversations GROUP BY conv_id)")
def context_tier_route(spark, d):
    sized = _t(spark, d, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) * 20).alias("n"))
    return sized.select("conv_id", F.when(F.col("n") <= 64, "a").otherwise("b").alias("band"), T.context_tier(F.col("n")).alias("tier"))


ENDPOINTS = [("e1", "en", 0, 200, False), ("e2", "en", 100, 1000, False), ("e3", "de", 0, 400, False), ("e0", "any", 0, 0, True)]


@query(f"""WITH e(endpoint, serves, lo, hi, d) AS (VALUES {_values(ENDPOINTS).replace('False', 'false').replace('True', 'true')}),
r AS (SELECT doc_id AS request_id, lang AS profile, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS n_tokens FROM documents),
h AS (SELECT r.*, endpoint FROM r JOIN e ON n_tokens BETWEEN lo AND hi AND profile = serves AND NOT d)
SELECT * FROM h UNION ALL SELECT r.*, endpoint FROM r, e WHERE d AND NOT EXISTS (SELECT 1 FROM h WHERE h.request_id = r.request_id)""")
def endpoint_range_join(spark, d):
    requests = _t(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.col("lang").alias("profile"), T.tokens_floor(F.col("text")).alias("n_tokens"))
    return reporting.eligible_endpoints(requests, spark.createDataFrame(ENDPOINTS, "endpoint string, serves string, min_tokens long, max_tokens long, is_default boolean"))


@query("SELECT conv_id, turn, ['a', 'a', 'b'][(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 + 1] AS endpoint FROM conversations")
def round_robin(spark, d):
    return reporting.round_robin(_t(spark, d, "conversations").select("conv_id", "turn"), ["a", "a", "b"], "conv_id", "turn").select("conv_id", "turn", "endpoint")


@query("""WITH i AS (SELECT event_id, user_id, value < 10 AS bad, sum(CASE WHEN value < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
SELECT event_id, user_id, run, run = 2 AS opens FROM (SELECT *, row_number() OVER (PARTITION BY user_id, g, bad ORDER BY event_id) AS run FROM i) WHERE bad""")
def circuit_breaker(spark, d):
    return reporting.failure_runs(_t(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "event_id", F.col("value") < 10).select("event_id", "user_id", "run", "opens")


@query("""WITH RECURSIVE m AS (SELECT conv_id, CAST(turn AS VARCHAR) AS id, CAST(turn % 3 AS DOUBLE) AS score, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS cost FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, id, cost) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM m),
f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS kept, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL SELECT o.conv_id, o.pos, CASE WHEN ok THEN list_append(kept, id) ELSE kept END, CASE WHEN ok THEN used + cost ELSE used END, o.n
  FROM (SELECT f.conv_id AS c, f.kept, f.used, o.*, NOT list_contains(f.kept, o.id) AND o.score >= 0 AND len(f.kept) < 8 AND (len(f.kept) = 0 OR f.used + o.cost <= 200) AS ok FROM f JOIN o ON o.conv_id = f.conv_id AND o.pos = f.pos + 1) o)
SELECT conv_id, array_to_string(kept, ',') AS kept, used AS used_tokens, CAST(n - len(kept) AS BIGINT) AS n_dropped FROM f WHERE pos = n AND pos > 0""")
def prompt_budget_matches(spark, d):
    m = _t(spark, d, "conversations").select("conv_id", F.col("turn").cast("string").alias("id"), (F.col("turn") % 3).cast("double").alias("score"), "text")
    return reporting.token_budget(m, "conv_id", 200)


_STATUS = """CASE WHEN plan_value IS NULL THEN CASE WHEN required AND fused_value IS NULL THEN 'workflow_changed_without_plan' WHEN base_value IS NOT DISTINCT FROM fused_value THEN 'base_only_unchanged' ELSE 'workflow_changed_without_plan' END
WHEN fused_value IS NULL THEN CASE WHEN required THEN 'plan_arg_missing_in_fused' ELSE 'extra_plan_arg_ignored' END
WHEN required AND fused_value = '' AND plan_value <> '' THEN 'plan_arg_missing_in_fused'
WHEN base_value IS NULL THEN CASE WHEN fused_value = plan_value THEN 'appended_from_plan' ELSE 'plan_conflict_fused_diff' END
WHEN base_value = '' THEN CASE WHEN fused_value = plan_value THEN 'filled_from_plan' WHEN fused_value = '' THEN 'plan_not_applied' ELSE 'plan_conflict_fused_diff' END
WHEN fused_value = base_value THEN CASE WHEN plan_value = base_value THEN 'confirmed_by_plan' ELSE 'plan_conflict_kept_base' END
WHEN fused_value = plan_value THEN 'overwritten_from_plan' ELSE 'plan_conflict_fused_diff' END"""
_REVIEW = ", ".join(f"'{s}'" for s in audit.REVIEW)
_VALUE = {"plan": "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END", "base": "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END", "fused": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN 'x' ELSE o_orderstatus END"}


@query(f"""WITH j AS (SELECT CAST(o_orderkey AS VARCHAR) AS node, 'status' AS arg, {', '.join(f'{v} AS {k}_value' for k, v in _VALUE.items())}, o_orderkey % 2 = 0 AS required FROM orders),
s AS (SELECT *, {_STATUS} AS status FROM j) SELECT *, status IN ({_REVIEW}) AS needs_review FROM s""")
def audit_three_way(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").cast("string").alias("node"), F.lit("status").alias("arg"))
    side = lambda k: o.select("node", "arg", F.expr(_VALUE[k]).alias("value"))
    return audit.audit(side("plan"), side("base"), side("fused"), o.filter("o_orderkey % 2 = 0"))


@query(f"""WITH j AS (SELECT CAST(o_orderkey AS VARCHAR) AS node, 'status' AS arg, {_VALUE['plan']} AS p, {_VALUE['base']} AS b FROM orders),
x AS (SELECT node, arg, CASE WHEN coalesce(b, '') <> '' THEN b ELSE coalesce(p, b) END AS value, false AS appended FROM j) SELECT * FROM x""")
def fuse_fill_missing(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").cast("string").alias("node"), F.lit("status").alias("arg"))
    side = lambda k: o.select("node", "arg", F.expr(_VALUE[k]).alias("value"))
    return audit.fuse(side("plan"), side("base"))


@query("""WITH t AS (SELECT o_orderpriority AS class, o_orderkey AS template, l_returnflag AS arg FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
n AS (SELECT class, count(DISTINCT template) AS total FROM t GROUP BY class), s AS (SELECT class, arg, count(DISTINCT template) AS seen FROM t GROUP BY ALL)
SELECT class, arg, seen, total, seen >= total * 0.8e0 AS required FROM s JOIN n USING (class)""")
def contract_inference(spark, d):
    t = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("class"), F.col("o_orderkey").alias("template"), F.col("l_returnflag").alias("arg"))
    return audit.contracts(t, 0.8)


# A plan per customer, a step per order.
STEPS = [("10 03", "50 03"), ("27 01", "67 01"), ("27 02 AA", "67 02"), ("27 02", "67 02"), ("22 F1 90", "63 F1 90"), ("3E 00", "7E 00"), ("27 01", None), ("31 01 02", "7F 31")]
_SENT = {k: "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN " + ("NULL" if x[j] is None else f"'{x[j]}'") for i, x in enumerate(STEPS)) + " END" for j, k in enumerate(("send", "expect"))}


@query(f"""WITH s AS (SELECT o_custkey AS plan, o_orderkey AS step, {_SENT['send']} AS send, {_SENT['expect']} AS expect FROM orders),
b AS (SELECT *, string_split(send, ' ')[1] AS sid, string_split(send, ' ')[2] AS sub, coalesce(string_split(expect, ' ')[1], '') AS got FROM s),
w AS (SELECT *, coalesce(max(CASE WHEN sid = '10' THEN 1 ELSE 0 END) OVER p, 0) AS ses, coalesce(max(CASE WHEN sid = '27' AND sub = '01' THEN 1 ELSE 0 END) OVER p, 0) AS seed FROM b WINDOW p AS (PARTITION BY plan ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT plan, step, 'response_mismatch' AS code FROM w WHERE got <> '' AND got <> printf('%X', CAST('0x' || sid AS INTEGER) + 64)
UNION ALL SELECT plan, step, 'security_without_session' FROM w WHERE sid = '27' AND ses = 0
UNION ALL SELECT plan, step, 'key_without_seed' FROM w WHERE sid = '27' AND sub = '02' AND seed = 0""")
def uds_rule_validation(spark, d):
    return audit.service_rules(_t(spark, d, "orders").selectExpr("o_custkey AS plan", "o_orderkey AS step", *[f"{v} AS {k}" for k, v in _SENT.items()]))


_EDGES = """e AS (SELECT 'n' || n_nationkey AS source, 'in' AS relation, 'r' || n_regionkey AS target FROM nation
UNION ALL SELECT 'c' || c_custkey, 'of', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'of', 'n' || s_nationkey FROM supplier)"""


def _edges(spark, d):
    e = lambda t, a, k, rel, b, k2: _t(spark, d, t).select(F.concat(F.lit(a), k).alias("source"), F.lit(rel).alias("relation"), F.concat(F.lit(b), k2).alias("target"))
    return e("nation", "n", "n_nationkey", "in", "r", "n_regionkey").unionByName(e("customer", "c", "c_custkey", "of", "n", "c_nationkey")).unionByName(e("supplier", "s", "s_suppkey", "of", "n", "s_nationkey"))


@query(f"WITH {_EDGES} SELECT source, relation, target, count(*) AS n, substr(sha1(source || chr(0) || relation || chr(0) || target), 1, 20) AS edge_id FROM e GROUP BY ALL")
def kg_build(spark, d):
    return graph.merge_edges(_edges(spark, d))


@query(f"""WITH k AS (SELECT p_partkey AS node_id, array_to_string(list_sort(list_distinct({_tok('p_name')})), ' ') AS key FROM part),
l AS (SELECT key, min(node_id) AS canonical_id FROM k WHERE key <> '' GROUP BY key HAVING count(*) > 1) SELECT node_id, canonical_id FROM k JOIN l USING (key) WHERE node_id <> canonical_id""")
def same_as(spark, d):
    return graph.same_as(_t(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name")))


@query(f"""WITH {_EDGES},
p1 AS (SELECT source AS start, 1 AS depth, source || ' > ' || target AS path, target AS spot FROM e),
p2 AS (SELECT start, 2, path || ' > ' || target, target FROM p1 JOIN e ON spot = source),
r AS (SELECT start, depth, path, row_number() OVER (PARTITION BY start ORDER BY depth, path) AS n FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2))
SELECT start, depth, path FROM r WHERE n <= 5""")
def bfs_paths(spark, d):
    e = _edges(spark, d)
    return graph.paths(e, e.select(F.col("source").alias("node")).distinct(), 2, 5)


@query(f"""WITH r AS (SELECT p_partkey AS ref_id, {_tok("p_name || ' ' || p_type")} AS ts FROM part WHERE p_partkey % 50 = 0), q AS (SELECT ref_id, list_distinct(ts) AS ts FROM r),
t AS (SELECT p_partkey AS target_id, unnest(list_distinct({_tok("p_name || ' ' || p_type")})) AS token FROM part),
c AS (SELECT ref_id, target_id, count(*) AS shared, any_value(len(ts)) AS size FROM (SELECT ref_id, ts, unnest(ts) AS token FROM q) JOIN t USING (token) GROUP BY ref_id, target_id)
SELECT ref_id, target_id, round(shared / size, 6) AS score FROM c WHERE round(shared / size, 6) >= 0.75e0""")
def reference_resolve(spark, d):
    p = _spread(_t(spark, d, "part")).withColumn("title", F.concat_ws(" ", "p_name", "p_type"))
    return graph.resolve_by_tokens(p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("ref_id"), F.col("title").alias("reference")), p.select(F.col("p_partkey").alias("target_id"), "title"), 0.75)


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def arg_selection(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    best = F.max(F.struct("l_quantity", (-F.col("l_linenumber")).alias("back"))).alias("b")
    return li.groupBy("l_orderkey", "l_returnflag").agg(best).select("l_orderkey", (-F.col("b.back")).alias("l_linenumber"), "b.l_quantity", "l_returnflag")


@query("SELECT l_orderkey, count(*) AS n_near FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) WHERE l_quantity >= top - 3 GROUP BY l_orderkey HAVING count(*) >= 2")
def ambiguous_rows(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    top = li.groupBy("l_orderkey").agg(F.max("l_quantity").alias("top"))
    return li.join(top, "l_orderkey").filter("l_quantity >= top - 3").groupBy("l_orderkey").agg(F.count("*").alias("n_near")).filter("n_near >= 2")


# A line per supplier: comments, labels, buckets, plain values, and text that is no metric.
_METRIC = "CASE s_suppkey % 6 WHEN 0 THEN '# HELP x' WHEN 1 THEN concat('hits_total{a=\"', s_suppkey, '\"} ', s_nationkey) WHEN 2 THEN concat('lat_bucket{le=\"1\"} ', s_suppkey) WHEN 3 THEN concat('  up ', s_nationkey) WHEN 4 THEN concat('ratio_', s_nationkey, ' 0.5') ELSE 'not a metric' END"


@query("""SELECT name, round(sum(v), 6) AS value FROM (SELECT CASE s_suppkey % 6 WHEN 1 THEN 'hits_total' WHEN 3 THEN 'up' ELSE 'ratio_' || s_nationkey END AS name, CASE WHEN s_suppkey % 6 = 4 THEN 0.5e0 ELSE CAST(s_nationkey AS DOUBLE) END AS v FROM supplier WHERE s_suppkey % 6 IN (1, 3, 4)) GROUP BY name""")
def prometheus_metrics(spark, d):
    return readers.parse_prometheus(_t(spark, d, "supplier").selectExpr(f"{_METRIC} AS value"))


@query("SELECT CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS covered, count(*) AS total, round(avg(CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END), 6) AS ratio FROM documents JOIN labels USING (doc_id)")
def coverage_ratios(spark, d):
    j = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id")
    return j.agg(F.count_if(F.col("quality") == 1).alias("covered"), F.count("*").alias("total"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("quality") == 1), F.count("*")), F.lit(0.0)), 6).alias("ratio"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
