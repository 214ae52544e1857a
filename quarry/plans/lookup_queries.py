"""Registered queries over lookups, context joins, filters and boosts; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import filters, lookups, retrieval
from quarry.plans.catalogue import _t, _tok, query

# Line items as evidence rows: the first line of an order is its table, the others are its rows.
_EVIDENCE = {
    "evidence_id": "concat(CASE WHEN l_orderkey % 3 = 0 THEN 'md_' ELSE '' END, 'o', l_orderkey, '_', l_linenumber)",
    "block_role": "CASE WHEN l_linenumber > 1 THEN 'table_row' ELSE 'table' END",
    "parent_evidence_id": "CASE WHEN l_linenumber = 1 THEN '' ELSE concat(CASE WHEN l_orderkey % 2 = 0 THEN 'md_' ELSE '' END, 'o', l_orderkey, '_1') END",
    "row_index": "10 - l_linenumber",
    "node": "concat('n', l_suppkey % 100)",
    "score": "cast(l_quantity AS double) / 8",
}
_E = f"e AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _EVIDENCE.items())} FROM lineitem)"
_BARE = "regexp_replace(trim({c}), '^md_', '')"


def _evidence(spark, d):
    return _t(spark, d, "lineitem").select(*[F.expr(v).alias(k) for k, v in _EVIDENCE.items()])


_PARENTS = f"""asked AS (SELECT evidence_id, trim(parent_evidence_id) AS named FROM e WHERE trim(parent_evidence_id) <> ''),
ways AS (SELECT evidence_id, 0 AS r, named AS id FROM asked UNION ALL SELECT evidence_id, 1, {_BARE.format(c='named')} FROM asked UNION ALL SELECT evidence_id, 2, 'md_' || {_BARE.format(c='named')} FROM asked),
up AS (SELECT w.evidence_id, arg_min(w.id, w.r) AS parent_id FROM ways w JOIN e ON e.evidence_id = w.id GROUP BY w.evidence_id)"""
_SIBLINGS = f"""side AS (SELECT * FROM (SELECT a.evidence_id, b.evidence_id AS sibling_id, row_number() OVER (PARTITION BY a.evidence_id ORDER BY b.row_index, b.evidence_id) AS rank
  FROM e a JOIN e b ON {_BARE.format(c='a.parent_evidence_id')} = {_BARE.format(c='b.parent_evidence_id')} WHERE a.parent_evidence_id <> '' AND b.block_role = 'table_row' AND a.evidence_id <> b.evidence_id) WHERE rank <= {lookups.SIBLINGS})"""


@query(f"WITH {_E}, {_PARENTS} SELECT evidence_id, parent_id FROM up")
def parent_context(spark, d):
    rows = _evidence(spark, d)
    return lookups.parents(rows, rows)


@query(f"WITH {_E}, {_SIBLINGS} SELECT evidence_id, sibling_id, rank FROM side")
def sibling_rows(spark, d):
    rows = _evidence(spark, d)
    return lookups.siblings(rows, rows)


@query(f"""WITH {_E}, {_PARENTS}, {_SIBLINGS}, c AS (SELECT * FROM e WHERE score > 5.6),
alls AS (SELECT node, evidence_id, score, 'candidate' AS source, 0 AS way FROM c
  UNION ALL SELECT node, parent_id, greatest(score + 0.05, 0), 'parent_context', 1 FROM c JOIN up USING (evidence_id)
  UNION ALL SELECT node, sibling_id, greatest(score - 0.02, 0), 'sibling_table_context', 2 FROM c JOIN side USING (evidence_id))
SELECT node, evidence_id, round(arg_min(score, (way, -score)), 6) AS score, arg_min(source, (way, -score)) AS source FROM alls GROUP BY node, evidence_id""")
def context_candidates(spark, d):
    rows = _evidence(spark, d)
    return lookups.with_context(rows.filter("score > 5.6"), rows)


@query(f"WITH {_E}, c AS (SELECT node, evidence_id FROM e WHERE score > 3) SELECT node, evidence_id, score FROM e ANTI JOIN c USING (node, evidence_id)")
def unmatched_evidence(spark, d):
    rows = _evidence(spark, d)
    return lookups.unmatched(rows.select("node", "evidence_id", "score"), rows.filter("score > 3"))


@query(f"""WITH {_E}, ps AS (SELECT p_partkey, unnest(['o' || p_partkey || '_1', 'md_o' || p_partkey || '_1', 'none']) AS evidence_id FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS node, 'DID' AS arg, evidence_id FROM ps ANTI JOIN e USING (evidence_id)""")
def unknown_evidence_ids(spark, d):
    args = _t(spark, d, "part").selectExpr("cast(p_partkey as string) AS node", "'DID' AS arg", "array(concat('o', p_partkey, '_1'), concat('md_o', p_partkey, '_1'), 'none') AS evidence_ids")
    return lookups.unknown_evidence(args, _evidence(spark, d))


@query(f"""WITH {_E}, f AS (SELECT 'n' || s_suppkey AS node, s_name FROM supplier), b AS (SELECT node, count(*) AS n, round(max(score), 6) AS best FROM e WHERE score > 5.9 GROUP BY node)
SELECT node, s_name, coalesce(n, 0) AS n_evidence, best, CASE WHEN n IS NULL THEN 'not_found' ELSE 'found' END AS status FROM f LEFT JOIN b USING (node)""")
def flow_with_bundles(spark, d):
    flow = _t(spark, d, "supplier").selectExpr("concat('n', s_suppkey) AS node", "s_name")
    return lookups.with_bundles(flow, _evidence(spark, d).filter("score > 5.9"))


_STEPS = "SELECT l_orderkey AS flow, (l_linenumber + 1) {div} 2 AS step, l_linenumber AS node FROM lineitem"


@query(f"WITH f AS ({_STEPS.format(div='//')}) SELECT a.flow, a.node AS source, b.node AS target FROM f a JOIN f b ON a.flow = b.flow AND b.step = a.step + 1")
def next_step_pairs(spark, d):
    return lookups.next_steps(_t(spark, d, "lineitem").selectExpr("l_orderkey AS flow", "(l_linenumber + 1) div 2 AS step", "l_linenumber AS node"))


@query(f"""WITH c AS (SELECT 'md_' || o_orderkey AS chunk_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 0 THEN '' END AS source_id FROM orders),
v AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'md_' ELSE '' END || c_custkey AS evidence_id, c_name FROM customer)
SELECT evidence_id, chunk_id, source_id, c_name FROM (SELECT *, coalesce(nullif(source_id, ''), chunk_id) AS named FROM c) JOIN v ON v.evidence_id = named""")
def evidence_of_chunks(spark, d):
    chunks = _t(spark, d, "orders").selectExpr("concat('md_', o_orderkey) AS chunk_id", "CASE WHEN o_orderkey % 2 = 0 THEN cast(o_custkey AS string) WHEN o_orderkey % 3 = 0 THEN '' END AS source_id")
    evidence = _t(spark, d, "customer").selectExpr("concat(CASE WHEN c_custkey % 5 = 0 THEN 'md_' ELSE '' END, c_custkey) AS evidence_id", "c_name")
    return lookups.find_evidence(chunks, evidence)


@query(f"""WITH t AS (SELECT item_id AS title_id, list_distinct({_tok("array_to_string(string_split(text, ' ')[1:6], ' ')")}) AS a FROM benchmark),
i AS (SELECT doc_id AS image_id, list_distinct({_tok("array_to_string(string_split(text, ' ')[1:40], ' ')")}) AS b FROM documents)
SELECT title_id, image_id, round(len(list_intersect(a, b)) / len(a), 6) AS overlap FROM t, i WHERE len(a) > 0 AND len(list_intersect(a, b)) / len(a) >= 0.5""")
def title_image_links(spark, d):
    first = lambda c, n: F.array_join(F.slice(F.split(c, " "), 1, n), " ")
    titles = _t(spark, d, "benchmark").select(F.col("item_id").alias("title_id"), first("text", 6).alias("title"))
    images = _t(spark, d, "documents").select(F.col("doc_id").alias("image_id"), first("text", 40).alias("name"))
    return lookups.title_images(titles, images)


_RESULTS = "SELECT l_suppkey % 50 AS node, l_partkey % 40 AS evidence_id, CAST(l_quantity AS DOUBLE) AS score, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS ord, CASE l_linenumber % 3 WHEN 0 THEN 'anchor' WHEN 1 THEN 'ecu_doc' ELSE 'template' END AS query_type FROM lineitem"


@query(f"""WITH r AS ({_RESULTS}), t AS (SELECT node, evidence_id, query_type, min(ord) AS o FROM r GROUP BY ALL), q AS (SELECT node, evidence_id, string_agg(query_type, ',' ORDER BY o) AS query_types FROM t GROUP BY ALL)
SELECT node, evidence_id, max(score) AS score, arg_max(query_type, (score, -ord)) AS query_type, any_value(query_types) AS query_types FROM r JOIN q USING (node, evidence_id) GROUP BY node, evidence_id""")
def multi_query_best(spark, d):
    r = _t(spark, d, "lineitem").selectExpr("l_suppkey % 50 AS node", "l_partkey % 40 AS evidence_id", "CAST(l_quantity AS DOUBLE) AS score", "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS ord", "CASE l_linenumber % 3 WHEN 0 THEN 'anchor' WHEN 1 THEN 'ecu_doc' ELSE 'template' END AS query_type")
    return lookups.best_per_evidence(r)


@query(f"WITH r AS (SELECT node, evidence_id % 7 AS chunk_id, 'hybrid' AS source, query_type, ord, score FROM ({_RESULTS})) SELECT node, chunk_id, source, query_type, min(ord) AS ord, arg_min(score, ord) AS score FROM r GROUP BY node, chunk_id, source, query_type")
def trace_results(spark, d):
    r = _t(spark, d, "lineitem").selectExpr("l_suppkey % 50 AS node", "l_partkey % 40 % 7 AS chunk_id", "'hybrid' AS source", "CASE l_linenumber % 3 WHEN 0 THEN 'anchor' WHEN 1 THEN 'ecu_doc' ELSE 'template' END AS query_type", "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS ord", "CAST(l_quantity AS DOUBLE) AS score")
    return lookups.distinct_trace(r)


# Documents as knowledge units: identifiers and fields follow from the id.
_UNIT = {
    "chunk_id": "concat(CASE WHEN doc_id % 9 = 0 THEN 'md_' ELSE '' END, source, '_', doc_id)",
    "unit_type": "CASE doc_id % 4 WHEN 0 THEN 'table_chunk' WHEN 1 THEN 'image_region' ELSE 'text_chunk' END",
    "protocol": "CASE doc_id % 3 WHEN 0 THEN 'UDS' WHEN 1 THEN 'uds' ELSE 'CAN' END",
    "module": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ecu_parameter' ELSE 'Treg' END",
    "ecu": "CASE doc_id % 7 WHEN 0 THEN 'BCM' WHEN 1 THEN 'ecm1' END",
    "content": "text",
}
_LISTS = {"service_ids": ["'22'", "'2e'", "'31'"], "dids": ["concat('F', 100 + doc_id % 30)", "concat('0xd', 200 + doc_id % 11)"], "sessions": ["concat('0', doc_id % 4)"], "security_levels": ["concat('1', doc_id % 3)"]}
_ARRAYS = {k: f"CASE WHEN doc_id % {3 + i} > 0 THEN {{a}}({', '.join(v)}) END" for i, (k, v) in enumerate(_LISTS.items())}
_U = "u AS (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in (_UNIT | {k: v.format(a="list_value") for k, v in _ARRAYS.items()}).items()) + ", n_chars FROM documents)"


def _units(spark, d):
    return _t(spark, d, "documents").select("doc_id", *[F.expr(v).alias(k) for k, v in (_UNIT | {k: v.format(a="array") for k, v in _ARRAYS.items()}).items()], "n_chars")


_HEX = "list_transform(coalesce({c}, []), lambda x: regexp_replace(upper(x), '^0X', ''))"
FILTERS = filters.RetrievalFilters(doc_ids=("src1", "src3", "src12"), unit_types=("text_chunk", "table_chunk"), protocol="Uds", module="TREG", dids=("f101", "0xD204", "F109", "F112"), service_ids=("2E",))
DENSE = filters.RetrievalFilters(ecu="bcm", sessions=("02", "00"), security_levels=("0x11", "12"))


@query(f"""WITH {_U} SELECT doc_id, chunk_id FROM u WHERE (starts_with(chunk_id, 'src1_') OR starts_with(chunk_id, 'src3_') OR starts_with(chunk_id, 'src12_')) AND unit_type IN ('text_chunk', 'table_chunk') AND lower(protocol) = 'uds'
  AND lower(coalesce(module, '')) = 'treg' AND list_has_any({_HEX.format(c='dids')}, ['F101', 'D204', 'F109', 'F112']) AND list_has_any({_HEX.format(c='service_ids')}, ['2E'])""")
def unit_filters(spark, d):
    return _units(spark, d).filter(FILTERS.condition()).select("doc_id", "chunk_id")


@query(f"WITH {_U} SELECT doc_id, ecu FROM u WHERE lower(coalesce(ecu, '')) = 'bcm' AND list_has_any({_HEX.format(c='sessions')}, ['02', '00']) AND list_has_any({_HEX.format(c='security_levels')}, ['11', '12'])")
def record_filters(spark, d):
    return _units(spark, d).filter(DENSE.condition(by_prefix=False)).select("doc_id", "ecu")


_QUERIES = [(1, "read F101 service 22 in session 02"), (2, "the tion of"), (3, "0xd204 2e 11")]
_UP = "list_transform(coalesce({c}, []), lambda x: upper(x))"
_Q = "q(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in _QUERIES) + ")"
_VALUES_SQL = f"list_distinct(list_transform({_tok('query')}, lambda x: upper(x)))"
_BOOST = " + ".join(f"{w}e0 * len(list_intersect({_VALUES_SQL}, {_UP.format(c=c)}))" for c, w in filters.BOOSTS.items())
_SCORED = f"""{_U}, {_Q}, s AS (SELECT query_id, doc_id, chunk_id, content, CASE WHEN array_to_string({_tok('query')}, ' ') <> '' AND contains(array_to_string({_tok('content')}, ' '), array_to_string({_tok('query')}, ' ')) THEN {filters.PHRASE}e0 ELSE 0 END + {_BOOST} AS score, n_chars FROM u, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)"""


def _boosted(spark, d, k):
    asked = spark.createDataFrame(_QUERIES, "query_id int, query string")
    #: A stated handful of queries against all units.
    met = _units(spark, d).join(F.broadcast(asked), F.lit(True)).withColumn("score", filters.exact_boost(F.col("query"), F.col("content"))).filter("score > 0")
    return retrieval.top_k(met, k)


@query(f"WITH {_SCORED} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 20")
def exact_boosts(spark, d):
    return _boosted(spark, d, 20).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {_SCORED}, c AS (SELECT *, CASE WHEN starts_with(chunk_id, 'md_') THEN substr(chunk_id, 4) ELSE '' END AS source_evidence_id FROM r WHERE rank <= 5),
b AS (SELECT query_id, rank, concat('[', rank, '] chunk_id=', chunk_id, ' source=sparse score=', CAST(score AS VARCHAR), chr(10), 'source=', source_evidence_id, ' page_idx=', CAST(n_chars % 10 AS VARCHAR), chr(10), content) AS block FROM c)
SELECT query_id, count(*) AS n_chunks, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY query_id""")
def packed_context(spark, d):
    chunks = filters.as_chunks(_boosted(spark, d, 5), "sparse").withColumn("source_path", F.col("source_evidence_id")).withColumn("page", F.col("n_chars") % 10)
    return filters.pack_context(chunks)


@query(f"""WITH {_U}, s AS (SELECT doc_id, concat_ws(' ', content, coalesce(protocol, ''), coalesce(module, ''), coalesce(ecu, ''), coalesce(array_to_string(service_ids, ' '), ''), coalesce(array_to_string(dids, ' '), ''), coalesce(array_to_string(sessions, ' '), ''), coalesce(array_to_string(security_levels, ' '), '')) AS t FROM u)
SELECT doc_id, len({_tok('t')}) AS n_tokens, md5(array_to_string({_tok('t')}, ' ')) AS digest FROM s""")
def searchable_text(spark, d):
    units = _units(spark, d)
    units = units.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in _LISTS})
    return units.select("doc_id", F.size(T.tokens(filters.searchable())).alias("n_tokens"), F.md5(T.normalised(filters.searchable())).alias("digest"))


@query(f"""WITH x AS (SELECT doc_id, ['the ', 'TION', 'bcm', source, ' '] AS terms, lower(text) AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(terms, lambda s: lower(trim(s))), lambda s: s <> '' AND contains(t, s)))), ',') AS terms FROM x""")
def matched_query_terms(spark, d):
    terms = F.array(F.lit("the "), F.lit("TION"), F.lit("bcm"), F.col("source"), F.lit(" "))
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(lookups.matched_terms(terms, F.col("text"))), ",").alias("terms"))
