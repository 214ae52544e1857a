"""DuckDB SQL for the queries that SQL can express."""

from quarry.llm import chat, licenses, line_dedup

_plain_re = lambda t: "".join("\\" + c if c in "<|>[]/()*+?." else c for c in t)
_CONTROL = "|".join(_plain_re(t[0]) + r"\\*" + _plain_re(t[1:]) for t in chat.CONTROL)
OP2 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum({len(chat.START)} + length(role) + 1 + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + {len(chat.END)}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_KNOWN = ", ".join(f"('{s}', '{i}')" for s, i in licenses.dictionary().items())
_RULES = ", ".join(f"('{n}', '{k}', {i})" for i, (n, k) in enumerate(licenses.rule_keys(licenses.all_rules()), 1))


def _plain(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.]+', ' ', 'g'), '\.( |$)', '\1', 'g'), '(^| )\.', '\1', 'g'))"


# \x1e stands for a cut (no text holds it); the rules are tried one after the other, longest first.
OP4 = rf"""
WITH RECURSIVE known(s, id) AS (VALUES {_KNOWN}), rule(n, k, r) AS (VALUES {_RULES}),
cut AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)({licenses.SPDX})[ \t]+', '\1', 'g'),
    '([.!?:;])[ \t-\r]+', '\1' || chr(30), 'g'), '\n([^A-Za-z0-9\n]*\n)+', chr(30), 'g'), chr(30)) AS ps FROM documents),
pieces AS (SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS pos FROM cut),
plain AS (SELECT *, {_plain("raw")} AS s FROM pieces),
whole AS (SELECT doc_id, pos, 0 AS k, id FROM plain JOIN known USING (s)),
open_ AS (SELECT doc_id, pos, string_split(raw, chr(10)) AS ls FROM plain ANTI JOIN known USING (s) WHERE contains(raw, chr(10))),
ends AS (SELECT doc_id, pos, ls, unnest(range(2, len(ls))) AS k FROM open_),
tails AS (SELECT doc_id, pos, k, {_plain("array_to_string(ls[k:], ' ')")} AS s FROM ends),
tail AS (SELECT doc_id, pos, min(k) AS k, arg_min(id, k) AS id FROM tails JOIN known USING (s) GROUP BY doc_id, pos),
lines AS (SELECT doc_id, pos, unnest(ls) AS raw, generate_subscripts(ls, 1) AS k FROM open_),
alone AS (
  SELECT doc_id, l.pos, l.k, id FROM (SELECT *, {_plain("raw")} AS s FROM lines) l JOIN known USING (s)
  WHERE NOT EXISTS (SELECT 1 FROM tail t WHERE t.doc_id = l.doc_id AND t.pos = l.pos AND t.k <= l.k)),
seen AS (SELECT doc_id, string_agg(id, ',' ORDER BY pos, k) AS ids FROM (FROM whole UNION ALL FROM tail UNION ALL FROM alone) GROUP BY doc_id),
steps AS (
  SELECT doc_id, ids, ',' || replace(ids, ',', ',,') || ',' AS chain, CAST([] AS VARCHAR[]) AS hits, 0 AS r FROM seen
  UNION ALL
  SELECT doc_id, ids, replace(chain, rule.k, ',-,'), CASE WHEN contains(chain, rule.k) THEN list_append(hits, rule.n) ELSE hits END, rule.r FROM steps JOIN rule ON rule.r = steps.r + 1),
ruled AS (SELECT doc_id, ids, list_sort(hits) AS rules FROM steps WHERE r = (SELECT max(r) FROM rule))
SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(rules, ','), '') AS rules,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(rules, lambda r: split_part(r, '#', 1)))), ','), '') AS licences
FROM documents d LEFT JOIN ruled USING (doc_id)
"""

# Sentences end after [.!?] and white space, wide marks, or a line end; \x1e stands for a border (no text holds it).
OP10 = rf"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?][ \t-\r]+|\n|[。！？…])', '\1' || chr(30), 'g'), chr(30)) AS ps FROM documents),
parts AS (SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM cut),
placed AS (
  SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
    trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+', ' ', 'g')) AS n
  FROM parts),
sized AS (
  SELECT *, CASE WHEN n = '' THEN 0 ELSE greatest(length(n) - length(replace(n, ' ', '')) + 1, ceil(len(regexp_extract_all(n, '[\x{{0E00}}-\x{{0FFF}}\x{{1780}}-\x{{17FF}}\x{{3000}}-\x{{DFFF}}\x{{20000}}-\x{{2FFFF}}]')) / {line_dedup.CHARS}.0)) END AS words FROM placed),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM sized),
docs AS (SELECT doc_id, list(n ORDER BY i) AS ns, list(upto ORDER BY i) AS sums FROM summed GROUP BY doc_id),
stops AS (
  SELECT s.doc_id, s.i, ns, len(list_filter(sums, lambda x: x < upto - words + {line_dedup.MIN_WORDS})) + 1 AS j
  FROM summed s JOIN docs d USING (doc_id) WHERE words > 0 AND sums[-1] - upto + words >= {line_dedup.MIN_WORDS}),
units AS (SELECT doc_id, i, j, array_to_string(list_filter(ns[i:j], lambda x: x <> ''), ' ') AS unit FROM stops),
later AS (SELECT * FROM (SELECT doc_id, i, j, row_number() OVER (PARTITION BY unit ORDER BY doc_id, i) AS r FROM units) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, j)) AS i FROM later),
marked AS (
  SELECT p.doc_id, p.i, p.s, p.raw, g.i IS NOT NULL AS gone, g.i IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM gone h WHERE h.doc_id = p.doc_id AND h.i = p.i - 1) AS opens
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i),
spans AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
span AS (SELECT doc_id, k, min(s) AS a, max(s + length(raw)) AS b FROM spans WHERE gone GROUP BY doc_id, k),
listed AS (SELECT doc_id, string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(b AS BIGINT) AS VARCHAR), ',' ORDER BY a) AS removed_spans, count(*) AS n FROM span GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id)
SELECT m.doc_id, coalesce(any_value(n_units), 0) AS n_units, coalesce(any_value(listed.n), 0) AS n_removed,
  CAST(coalesce(sum(length(raw)) FILTER (gone), 0) AS BIGINT) AS n_removed_chars, coalesce(any_value(removed_spans), '') AS removed_spans,
  length(coalesce(string_agg(raw, '' ORDER BY i) FILTER (NOT gone), '')) AS kept_chars,
  sha256(coalesce(string_agg(raw, '' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked m LEFT JOIN listed ON m.doc_id = listed.doc_id LEFT JOIN counted ON m.doc_id = counted.doc_id GROUP BY m.doc_id
"""

OP7 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
b AS (
  SELECT page_id, url, list_filter(list_transform(string_split_regex(regexp_replace(body, '<br>', ' ', 'g'), '</?(p|h1)>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '&(amp|lt|gt|quot)([^;]|$)', '&\1;\2', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks
  FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM b
"""

OP13 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

SQL = {"op2_chat_formatting": OP2, "op4_license_scan": OP4, "op7_html_extraction": OP7, "op10_line_dedup": OP10, "op13_exact_dedup": OP13}
