"""Registered queries over model replies made from ``documents``; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import recovery as R
from quarry.plans.catalogue import _t, query

# One expression for both engines. A reply quotes its document as a JSON string; by the id it is whole, fenced, inside prose
# with braces, doubled, cut off inside the quotation, an array, or no JSON.
_ESC = "coalesce(text, '')"
for _a, _b in (("chr(92)", "concat(chr(92), chr(92))"), ("chr(34)", "concat(chr(92), chr(34))"), ("chr(10)", "concat(chr(92), 'n')"), ("chr(13)", "concat(chr(92), 'r')"), ("chr(9)", "concat(chr(92), 't')")):
    _ESC = f"replace({_ESC}, {_a}, {_b})"
_HEAD = """concat('{"node_name": "n', doc_id, CASE WHEN doc_id % 2 = 0 THEN '", "class_name": "C{' ELSE '", "class": "' END, doc_id % 9, '", "args": [{"name": "DID", "value": "}"}], "xml": "&lt;ScriptNode Name=&quot;', doc_id, '&quot;></ScriptNode>", "confidence": 0.', doc_id % 9, ', "needs_review": ', CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END, ', "missing_or_conflict_reason": "')"""
_WHOLE = f"concat({_HEAD}, {_ESC}, '\"}}')"
_REPLY = f"""CASE doc_id % 7 WHEN 0 THEN concat('  ', {_WHOLE}, chr(10)) WHEN 1 THEN concat('```json', chr(10), {_WHOLE}, chr(10), '```') WHEN 2 THEN concat('Here it is: ', {_WHOLE}, ' as asked.')
 WHEN 3 THEN concat('First ', {_WHOLE}, ' and then {{', {_WHOLE}) WHEN 4 THEN concat({_HEAD}, {_ESC}) WHEN 5 THEN concat('[', {_WHOLE}, ']') ELSE 'no object {{here' END""".replace("{{", "{")
_V = _REPLY.replace("STRING", "VARCHAR")
_W = f"w AS (SELECT doc_id, {_WHOLE} AS whole FROM documents)"


@query(f"WITH {_W} SELECT doc_id, CASE WHEN doc_id % 7 < 4 OR doc_id % 7 = 5 THEN sha256(whole) END AS object_sha256, CASE doc_id % 7 WHEN 0 THEN 'whole' WHEN 1 THEN 'whole' WHEN 2 THEN 'span' WHEN 3 THEN 'balanced' WHEN 5 THEN 'span' END AS found_by FROM w")
def recovered_objects(spark, d):
    """An array is no object; the span inside it is one."""
    made = R.json_object(_t(spark, d, "documents").selectExpr("doc_id", f"{_REPLY} AS reply"), "reply")
    return made.select("doc_id", F.sha2("object", 256).alias("object_sha256"), "found_by")


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 4 THEN 'recovered' WHEN 6 THEN 'failed' ELSE 'parsed' END AS status, CASE WHEN doc_id % 7 = 6 THEN 'default' ELSE 'n' || doc_id END AS node_name,
  CASE WHEN doc_id % 7 < 6 AND doc_id % 2 = 0 THEN 'C{' || (doc_id % 9) ELSE 'class' END AS class_name, CASE WHEN doc_id % 7 < 6 THEN '<ScriptNode Name="' || doc_id || '"></ScriptNode>' ELSE '' END AS xml,
  CASE WHEN doc_id % 7 < 6 THEN CAST('0.' || (doc_id % 9) AS DOUBLE) ELSE 0.75e0 END AS confidence, doc_id % 7 < 6 AND doc_id % 3 = 0 AS needs_review,
  CASE WHEN doc_id % 7 IN (4, 6) THEN sha256('') ELSE sha256(trim(coalesce(text, ''))) END AS reason_sha256 FROM documents""")
def recovered_replies(spark, d):
    replies = _t(spark, d, "documents").selectExpr("doc_id", f"{_REPLY} AS reply", "'default' AS default_name", "'class' AS default_class")
    return R.recovered(replies, "reply").select("doc_id", "status", "node_name", "class_name", "xml", "confidence", "needs_review", F.sha2("reason", 256).alias("reason_sha256"))
