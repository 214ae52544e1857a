"""Registered queries that build evidence from layout blocks; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import blocks as B
from quarry.plans.catalogue import _t, _values, query

_TABLE = "concat('<table><tr><td>Name</td><th>DID </th><td></td></tr><tr><td>', {raw}, '</td><td>F1', lpad(cast({i} % 100 as string), 2, '0'), '</td><td>x</td></tr><tr><td> </td></tr><tr><td></td><td>D134</td></tr></table>')"
#: Every line of a document is one block; its kind, page and place follow from its number.
_SPARK = {
    "type": "CASE WHEN i % 11 = 4 THEN 'table' WHEN i % 11 = 7 THEN 'image' WHEN i % 11 = 9 THEN 'equation' ELSE 'text' END",
    "page": "cast(i div 6 as int)",
    "bbox": "CASE WHEN i % 5 = 3 THEN cast(array() as array<int>) ELSE array(10, cast(i * 20 + (i % 3) * 30 as int), 90 + cast(i as int), cast(i * 20 + 15 as int)) END",
    "text": "CASE WHEN i % 8 = 2 THEN concat('3.', i, ' ', raw) WHEN i % 13 = 5 THEN concat('Req: 22 F190 Res: 62 failed, level ', i % 9, ' extended session ', raw) ELSE raw END",
    "caption": "CASE WHEN i % 2 = 0 THEN array('Flow of ', raw) ELSE array(raw) END",
    "footnote": "CASE WHEN i % 3 = 0 THEN array('a &lt;note&gt;') ELSE cast(array() as array<string>) END",
    "body": "CASE WHEN i % 11 = 4 THEN " + _TABLE.format(raw="raw", i="i") + " END",
    "img_path": "CASE WHEN i % 11 = 7 THEN concat('img/', i, '.png') ELSE '' END",
}


def _duck(expr: str) -> str:
    return expr.replace("cast(array() as array<int>)", "CAST([] AS INT[])").replace("cast(array() as array<string>)", "CAST([] AS VARCHAR[])").replace("array(", "list_value(").replace(" div ", " // ").replace("as string)", "as varchar)").replace("'3.', i,", "'3.', cast(i as varchar),")


_WORDS = f"regexp_split_to_array(coalesce(content, ''), '{T.WORD_SPLIT}')"
_IDS_SQL = {
    "service_ids": f"list_sort(list_distinct(list_filter(list_transform({_WORDS}, lambda w: upper(regexp_extract(w, '^(?:0x)?([0-9A-Fa-f]{{2}})$', 1))), lambda w: w IN ({', '.join(repr(s) for s in T.SERVICE_IDS)}))))",
    "dids": f"list_sort(list_distinct(list_filter(list_transform({_WORDS}, lambda w: upper(regexp_extract(w, '^(?:DID|did)?([0-9A-Fa-f]{{4}})$', 1))), lambda w: w <> '')))",
    "sessions": "list_filter([" + ", ".join(f"CASE WHEN contains(lower(content), '{p}') THEN '{c}' END" for p, c in T.SESSIONS.items()) + "], lambda x: x IS NOT NULL)",
    "security_levels": "list_sort(list_distinct(list_transform(regexp_extract_all(content, '(?i)(?:security\\s*access|level)\\s*0?(\\d{1,2})', 1), lambda d: lpad(CAST(CAST(d AS INT) AS VARCHAR), 2, '0'))))",
}
_CLEAN = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_IDS = ", ".join(f"array_to_string({v}, ',') AS {k}" for k, v in _IDS_SQL.items())
_PARTS = "concat_ws(' ', array_to_string(caption, ' '), CASE WHEN type = 'table' THEN coalesce(body, '') END, array_to_string(footnote, ' '))"
_BODY = " + ".join(f"CAST(regexp_matches(lower(content), '{s}') AS INT)" for s in B.BODY_SIGNALS)
_FLOW = B.FLOW_IMAGE
_BASE = f"""raws AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
blocks AS (SELECT doc_id, i AS ord, {', '.join(f'{_duck(v)} AS {k}' for k, v in _SPARK.items())} FROM raws),
filled AS (SELECT *, {_CLEAN.format(c=f"CASE WHEN type IN ('text', 'equation') THEN coalesce(text, '') ELSE {_PARTS} END")} AS content FROM blocks)"""


def _code(value: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{otherwise}' END"


def _blocks(spark, d, *by):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    lines = (docs.repartition(*by) if by else docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i0", "raw")).select("doc_id", "raw", (F.col("i0") + 1).cast("long").alias("i"))
    return lines.select("doc_id", F.col("i").alias("ord"), *[F.expr(v).alias(k) for k, v in _SPARK.items()])


def _flat(df):
    """Identifier lists as sorted text, so that rows compare."""
    return df.withColumns({c: F.array_join(F.array_sort(c) if c != "sessions" else F.col(c), ",") for c in ("service_ids", "dids", "sessions", "security_levels")})


@query(f"WITH {_BASE} SELECT concat(doc_id, '_', lpad(CAST(ord AS VARCHAR), 4, '0')) AS chunk_id, {_code('type', B.UNIT_TYPES, 'text_chunk')} AS unit_type, content, {_IDS}, page FROM filled WHERE content <> ''")
def block_knowledge_units(spark, d):
    return _flat(B.knowledge_units(_blocks(spark, d))).drop("bbox")


@query(f"""WITH {_BASE},
kept AS (SELECT * REPLACE (CASE WHEN content = '' AND type = 'image' THEN img_path ELSE content END AS content) FROM filled),
typed AS (SELECT *, type = 'image' AND regexp_matches(concat_ws(' ', content, img_path), '{_FLOW}') AS flow FROM kept WHERE content <> '')
SELECT concat(doc_id, '_', lpad(CAST(ord AS VARCHAR), 4, '0')) AS evidence_id, doc_id, CASE WHEN flow THEN 'flowchart' ELSE type END AS evidence_type,
  CASE WHEN {_BODY} >= 3 THEN 'flowchart_body' WHEN flow THEN 'flowchart_image' WHEN type = 'table' THEN 'table' ELSE 'section_text' END AS block_role, content, {_IDS}, page FROM typed""")
def block_evidence(spark, d):
    return _flat(B.evidence_units(_blocks(spark, d))).drop("bbox")


_CELL = _CLEAN.format(c="c")
_GAP = "CASE WHEN len(pb) >= 4 AND len(bbox) >= 4 THEN greatest(0, bbox[2] - pb[4]) ELSE 0 END"
_CHUNKS = f"""{_BASE},
kept AS (SELECT * REPLACE (CASE WHEN content = '' AND type = 'image' THEN img_path ELSE content END AS content) FROM filled),
seen AS (SELECT *, lag(type) OVER w AS pt, lag(page) OVER w AS pp, lag(content) OVER w AS pc, lag(bbox) OVER w AS pb FROM kept WHERE content <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
islands AS (SELECT *, sum(CASE WHEN type IN ('table', 'image') OR pt IS NULL OR pt <> type OR pp <> page OR (regexp_matches(content, '{B.HEADING}') AND NOT regexp_matches(pc, '{B.HEADING}')) OR {_GAP} > {B.GAP} THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY ord) AS element FROM seen),
elements AS (SELECT doc_id, element, min(ord) AS ord, any_value(type) AS type, string_agg(content, ' ' ORDER BY ord) AS joined, list(bbox ORDER BY ord) FILTER (len(bbox) >= 4) AS boxes, any_value(img_path) AS img_path, min(page) AS page,
  string_agg(concat(doc_id, '_block_', lpad(CAST(ord AS VARCHAR), 4, '0')), ',' ORDER BY ord) AS sources, count(*) AS n_blocks FROM islands GROUP BY doc_id, element),
trs AS (SELECT doc_id, ord, unnest(rs) AS row, generate_subscripts(rs, 1) - 1 AS k FROM (SELECT doc_id, ord, regexp_extract_all(body, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1) AS rs FROM blocks WHERE type = 'table')),
cells AS (SELECT doc_id, ord, k, list_transform(regexp_extract_all(row, '(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>', 1), lambda c: {_CELL}) AS cs FROM trs),
solid AS (SELECT doc_id, ord, cs, row_number() OVER (PARTITION BY doc_id, ord ORDER BY k) - 1 AS k FROM cells WHERE len(list_filter(cs, lambda c: c <> '')) > 0),
heads AS (SELECT doc_id, ord, list_transform(cs, lambda c: upper(c)) AS hs FROM solid WHERE k = 0),
rows_ AS (SELECT doc_id, ord, k, list_filter(list_transform(generate_series(1, len(hs)), lambda j: CASE WHEN hs[j] <> '' AND coalesce(cs[j], '') <> '' THEN hs[j] || ': ' || cs[j] END), lambda x: x IS NOT NULL) AS fields FROM solid JOIN heads USING (doc_id, ord) WHERE k > 0),
kept_rows AS (SELECT * FROM rows_ WHERE len(fields) > 0),
n AS (SELECT doc_id, ord, count(*) AS n_rows FROM kept_rows GROUP BY doc_id, ord),
placed AS (SELECT e.*, 1 + coalesce(sum(1 + coalesce(n_rows, 0)) OVER (PARTITION BY e.doc_id ORDER BY element ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ordinal FROM elements e LEFT JOIN n USING (doc_id, ord)),
named AS (SELECT *, concat(doc_id, '_sem_', lpad(CAST(CAST(ordinal AS INT) AS VARCHAR), 4, '0')) AS id, type IN ('text', 'equation') AS flows,
  CASE WHEN type = 'equation' THEN 'equation' WHEN type = 'text' THEN 'paragraph' WHEN type = 'table' THEN 'table' WHEN {' OR '.join(f"contains(lower(concat_ws(' ', joined, img_path)), '{s}')" for s in B.FLOW_CHUNK)} THEN 'flowchart' ELSE 'image' END AS kind FROM placed),
texts AS (SELECT *, CASE WHEN flows THEN {_CLEAN.format(c='joined')} ELSE joined END AS content FROM named),
chunks AS (
  SELECT doc_id, id AS chunk_id, kind AS chunk_type, content, page, CASE WHEN len(boxes) > 0 THEN concat_ws(',', list_min(list_transform(boxes, lambda b: b[1])), list_min(list_transform(boxes, lambda b: b[2])), list_max(list_transform(boxes, lambda b: b[3])), list_max(list_transform(boxes, lambda b: b[4]))) ELSE '' END AS bbox,
    sources AS source_block_ids, '' AS parent_chunk_id, CASE WHEN kind = 'paragraph' AND regexp_matches(content, '{B.HEADING}') THEN substr(content, 1, 160) ELSE '' END AS section_title, n_blocks FROM texts
  UNION ALL
  SELECT r.doc_id, concat(id, '_tbl_1_', CAST(k AS VARCHAR)), 'table_row', array_to_string(fields, ' '), page, CASE WHEN len(boxes) > 0 THEN array_to_string(boxes[1], ',') ELSE '' END, sources, id, '', 1 FROM kept_rows r JOIN texts t ON r.doc_id = t.doc_id AND r.ord = t.ord)"""


def _chunks(spark, d):
    # Dealt by document before the lines are told apart: the texts are shuffled once, and not the blocks with what they repeat.
    return B.semantic_chunks(_blocks(spark, d, F.col("doc_id")))


@query(f"WITH {_CHUNKS} SELECT * FROM chunks")
def semantic_chunks(spark, d):
    made = _chunks(spark, d)
    return made.withColumns({"bbox": F.array_join(F.transform("bbox", lambda x: x.cast("string")), ","), "source_block_ids": F.array_join("source_block_ids", ",")}).drop("fields", "ord")


@query(f"WITH {_CHUNKS}, t AS (SELECT * REPLACE (trim(content) AS content) FROM chunks) SELECT chunk_id, {_code('chunk_type', B.CHUNK_UNITS, 'text_chunk')} AS unit_type, content, {_IDS}, page FROM t WHERE content <> ''")
def chunk_knowledge_units(spark, d):
    return _flat(B.units_from_chunks(_chunks(spark, d))).drop("bbox")


@query(f"""WITH {_CHUNKS}, t AS (SELECT * REPLACE (trim(content) AS content) FROM chunks)
SELECT chunk_id AS evidence_id, doc_id, {_code('chunk_type', B.CHUNK_EVIDENCE, 'text')} AS evidence_type, {_code('chunk_type', B.CHUNK_ROLES, 'paragraph')} AS block_role, content, parent_chunk_id AS parent_evidence_id, source_block_ids, section_title, {_IDS} FROM t WHERE content <> ''""")
def chunk_evidence(spark, d):
    made = _flat(B.evidence_from_chunks(_chunks(spark, d)))
    return made.withColumn("source_block_ids", F.array_join("source_block_ids", ",")).drop("fields", "page", "bbox")


@query(f"""WITH {_BASE},
e AS (SELECT doc_id, ord, content, CASE WHEN type = 'image' THEN 'flowchart' ELSE type END AS evidence_type, CASE WHEN ord % 3 = 0 THEN NULL WHEN type = 'table' THEN 'table_row' WHEN type = 'text' THEN 'flowchart_title' ELSE 'section_text' END AS role FROM filled WHERE content <> '')
SELECT concat('md_', doc_id, '_', ord) AS chunk_id, concat(doc_id, '_', ord) AS source_evidence_id, content, coalesce(role, evidence_type) AS block_role,
  CASE WHEN role = 'table_row' THEN 'table_row' WHEN role = 'flowchart_title' OR evidence_type = 'flowchart' THEN 'flowchart' WHEN evidence_type IN ('table', 'image', 'equation') THEN evidence_type ELSE 'section' END AS chunk_type FROM e""")
def evidence_chunks(spark, d):
    made = _blocks(spark, d).withColumn("content", B.content()).filter("content <> ''")
    role = F.expr("CASE WHEN ord % 3 = 0 THEN NULL WHEN type = 'table' THEN 'table_row' WHEN type = 'text' THEN 'flowchart_title' ELSE 'section_text' END")
    return B.chunks_from_evidence(made.select(F.concat_ws("_", "doc_id", "ord").alias("evidence_id"), F.when(F.col("type") == "image", F.lit("flowchart")).otherwise(F.col("type")).alias("evidence_type"), role.alias("block_role"), "content"))


_ITEMS = [
    (1, 1, "text", 0, [1.5, 2.4, 3.0, 4.0], " ", "from content", None, None, None, None, None, None, None),
    (1, 2, "code", 1, [1.0, 2.0, 3.0], None, None, "code here", None, None, None, None, None, None),
    (1, 3, "text", None, None, "", None, None, None, None, None, None, None, None),
    (1, 4, "table", 2, [0.0, 0.0, 9.9, 9.2], None, "plain", None, "<table></table>", ["cap", ""], ["foot"], None, None, None),
    (1, 5, "image", 3, None, None, None, None, None, None, None, ["pic"], None, "a.png"),
    (1, 6, "equation", 3, None, None, None, None, None, None, None, None, None, "e.png"),
    (1, 7, "equation", 3, None, " ", None, None, None, None, None, None, None, None),
]


_BLOCKS = "(VALUES (1, 'text', 0, '2,2,3,4', 'from content', '', '', NULL, ''), (2, 'text', 1, '', 'code here', '', '', NULL, ''), (4, 'table', 2, '0,0,10,9', NULL, 'cap', 'foot', '<table></table>', ''), (5, 'image', 3, '', NULL, 'pic', '', NULL, 'a.png'), (6, 'equation', 3, '', '', '', '', NULL, 'e.png')) AS t(ord, type, page, bbox, text, caption, footnote, body, img_path)"


@query(f"SELECT CAST(d.doc_id AS INT) AS doc_id, t.* FROM documents d JOIN {_BLOCKS} ON t.ord = d.doc_id % 7 + 1")
def parser_items(spark, d):
    schema = "doc_id int, ord int, type string, page_idx int, bbox array<double>, text string, content string, code_body string, table_body string, table_caption array<string>, table_footnote array<string>, image_caption array<string>, image_footnote array<string>, img_path string"
    # One parser item a document, of the kind that its id says.
    items = F.broadcast(spark.createDataFrame(_ITEMS, schema).drop("doc_id"))
    made = B.blocks_from_items(_t(spark, d, "documents").selectExpr("cast(doc_id AS int) AS doc_id", "cast(doc_id % 7 + 1 AS int) AS ord").join(items, "ord"))
    return made.withColumns({"bbox": F.array_join(F.transform("bbox", lambda x: x.cast("string")), ","), "caption": F.array_join("caption", ","), "footnote": F.array_join("footnote", ",")})
