"""Registered queries that choose plan arguments; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import arguments as A
from quarry.plans.catalogue import _t, _values, query

# Orders as flow nodes, their lines as evidence sources with three fields each.
_NODE = {
    "node": "concat(CASE o_orderkey % 4 WHEN 0 THEN 'BCM' WHEN 1 THEN 'ecm2' WHEN 2 THEN 'Usage' ELSE 'GEEA30' END, '_mode_change_', o_orderkey)",
    "template": "CASE o_orderkey % 6 WHEN 0 THEN 'DTC_Read_Type1' WHEN 1 THEN 'DTC Clear-Type2' WHEN 2 THEN 'TCAM_Write' WHEN 3 THEN 'Usage Mode Change' ELSE 'GEEA30_VMM_Change' END",
}
_SRC = {
    "o_orderkey": "l_orderkey",
    "evidence_id": "concat(l_orderkey, '_', l_linenumber)",
    "score": "cast(l_quantity AS double)",
    "role": "CASE l_linenumber % 3 WHEN 0 THEN 'table_row' WHEN 1 THEN 'section_text' ELSE 'table' END",
    "unit": "CASE l_partkey % 5 WHEN 0 THEN 'BCM-2 rear' WHEN 1 THEN ' ' WHEN 2 THEN 'ECM2' WHEN 3 THEN 'front BCM' END",
}
_FIELDS = [
    ("'DID'", "CASE WHEN l_partkey % 3 = 0 THEN concat('see ', substr('f1d203e4a5', 1 + l_partkey % 5, 4)) WHEN l_partkey % 3 = 1 THEN 'F190 and F191' ELSE '' END"),
    ("CASE WHEN l_suppkey % 2 = 0 THEN ' Request-Parameter' ELSE 'chec k method' END", "CASE l_partkey % 4 WHEN 0 THEN '0x01: normal; 0x0b: Active, 0x3 : x' WHEN 1 THEN 'na' WHEN 2 THEN '7' ELSE '0xab' END"),
    ("CASE WHEN l_linenumber = 1 THEN 'Flowchart title' ELSE 'other' END", "concat('Type ', l_suppkey % 9)"),
]
_SPARK_FIELDS = "array(" + ", ".join(f"struct({h} AS header, {c} AS cell)" for h, c in _FIELDS) + ")"
_DUCK_FIELDS = "list_value(" + ", ".join(f"{{'header': {h}, 'cell': {c}}}" for h, c in _FIELDS) + ")"
_KEY = "upper(trim(regexp_replace({c}, '[^0-9A-Za-z]+', '_', 'g'), '_'))"
_IS = "(NOT starts_with(upper({c}), 'GEEA') AND (" + " OR ".join(f"starts_with(upper({{c}}), '{u}')" for u in A.UNITS) + "))"
_OWN = "CASE WHEN {a} THEN upper(split_part(node, '_', 1)) WHEN {b} THEN upper(split_part(template, '_', 1)) ELSE '' END".format(a=_IS.format(c="split_part(node, '_', 1)"), b=_IS.format(c="split_part(template, '_', 1)"))
_FIT = f"(starts_with(upper(unit), own) OR list_contains(regexp_split_to_array(upper(unit), '[^0-9A-Z]+'), {_KEY.format(c='own')}))"
_BASE = f"""n AS (SELECT o_orderkey, node, template, {_OWN} AS own FROM (SELECT o_orderkey, {', '.join(f'{v} AS {k}' for k, v in _NODE.items())} FROM orders)),
s AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _SRC.items())}, {_DUCK_FIELDS} AS fields FROM lineitem)"""


def _nodes(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", *[F.expr(v).alias(k) for k, v in _NODE.items()])


def _sources(spark, d):
    made = _t(spark, d, "lineitem").select(*[F.expr(v).alias(k) for k, v in _SRC.items()], F.expr(_SPARK_FIELDS).alias("fields"))
    return made.join(_nodes(spark, d).select("o_orderkey", "node"), "o_orderkey").drop("o_orderkey")


@query(f"""WITH {_BASE},
m AS (SELECT node, own, trim(unit) AS unit, score, role FROM s JOIN n USING (o_orderkey) WHERE trim(coalesce(unit, '')) <> ''),
f AS (SELECT node, score + CASE WHEN own <> '' THEN {A.UNIT_BONUS}e0 ELSE 0 END AS score, CASE WHEN own <> '' AND list_contains(regexp_split_to_array(upper(unit), '[^0-9A-Z]+'), {_KEY.format(c='own')}) THEN own ELSE unit END AS value, 'ecu_from_' || role AS note FROM m WHERE own = '' OR {_FIT}),
b AS (SELECT node, arg_max({{'v': value, 's': score, 'n': note}}, (score, value, note)) AS x FROM f GROUP BY node)
SELECT node, CASE WHEN x IS NOT NULL THEN x.v ELSE own END AS value, round(CASE WHEN x IS NOT NULL THEN x.s ELSE {A.UNIT_PRIOR}e0 END, 6) AS score, CASE WHEN x IS NOT NULL THEN x.n ELSE 'node_ecu_fallback' END AS note FROM n LEFT JOIN b USING (node) WHERE x IS NOT NULL OR own <> ''""")
def unit_selection(spark, d):
    return A.unit_argument(_nodes(spark, d), _sources(spark, d))


_DEF_SQL = f"""d AS (SELECT node, 'DID' AS argument, '{A.READ_DID_TYPE1}' AS implied, true AS overrides FROM k WHERE key = 'DTC_READ_TYPE1'
  UNION ALL SELECT node, 'Position', '', false FROM k WHERE starts_with(key, 'DTC_READ_TYPE') OR starts_with(key, 'DTC_CLEAR_TYPE') UNION ALL SELECT node, 'ServiceID', '{A.CLEAR_SERVICE}', false FROM k WHERE starts_with(key, 'DTC_CLEAR'))"""
_K = f"k AS (SELECT node, {_KEY.format(c='template')} AS key FROM n)"


@query(f"WITH {_BASE}, {_K}, {_DEF_SQL} SELECT node, argument, implied AS value, overrides FROM d")
def semantic_defaults(spark, d):
    return A.semantic_defaults(_nodes(spark, d))


_CLEAN = "trim(regexp_replace(regexp_replace(cell, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_ARG = "CASE " + " ".join(f"WHEN {_KEY.format(c='header')} IN ({', '.join(repr(h) for h in hs)}) THEN '{a}'" for a, hs in A.HEADERS.items()) + " ELSE '' END"
_HEX = "CASE WHEN regexp_matches({b}, '^[0-9A-F]+$') THEN '0x' || CASE WHEN length({b}) >= {w} THEN {b} ELSE lpad({b}, {w}, '0') END ELSE {b} END"
_BARE = "regexp_replace(upper(trim({c})), '^0X', '')"
_CODES = "regexp_extract_all({c}, '(0x[0-9A-Fa-f]{{2,8}})\\s*:', 1)"
_LABELS = "regexp_split_to_array({c}, '0x[0-9A-Fa-f]{{2,8}}\\s*:')"
_TASK = "replace(lower(concat_ws(' ', node, template)), '_', ' ')"
_WORD = f"CASE WHEN contains({_TASK}, 'usage mode change') THEN 'active' WHEN contains({_TASK}, 'car mode change') THEN 'normal' ELSE '!' END"
_PICK = f"coalesce(list_filter(list_transform(generate_series(1, len({_CODES.format(c='v')})), lambda j: CASE WHEN list_contains(regexp_split_to_array(lower(({_LABELS.format(c='v')})[j + 1]), '[^0-9a-z_]+'), {_WORD}) THEN ({_CODES.format(c='v')})[j] END), lambda x: x IS NOT NULL)[1], ({_CODES.format(c='v')})[1])"
_REQ = f"CASE WHEN upper(v) = 'NA' THEN 'NA' WHEN regexp_matches(trim(v), '^(?:0x)?[0-9A-Fa-f]{{2,8}}$') THEN {_HEX.format(b=_BARE.format(c='v'), w=2)} WHEN len({_CODES.format(c='v')}) = 0 THEN v ELSE {_HEX.format(b=_BARE.format(c=_PICK), w=2)} END"
_IDS = "regexp_extract_all(v, '\\b(?:0x)?[0-9A-Fa-f]{4,8}\\b')"
_WEIGHT = "CASE argument " + " ".join(f"WHEN '{a}' THEN {w}e0" for a, w in A.WEIGHTS.items()) + " ELSE 1e0 END + CASE role WHEN 'table_row' THEN 2e0 WHEN 'section_text' THEN 1e0 ELSE 0e0 END"
_WIDTH = "CASE argument " + " ".join(f"WHEN '{a}' THEN {w}" for a, w in A.WIDTHS.items()) + " END"


@query(f"""WITH {_BASE}, {_K}, {_DEF_SQL},
m AS (SELECT node, template, score, role, unnest(fields) AS f FROM s JOIN n USING (o_orderkey) WHERE own = '' OR trim(coalesce(unit, '')) = '' OR {_FIT.replace('upper(unit)', 'upper(trim(unit))')}),
a AS (SELECT node, template, score, role, {_ARG} AS argument, {_CLEAN} AS v FROM (SELECT *, f.header AS header, f.cell AS cell FROM m)),
p AS (SELECT *, CASE WHEN v = '' THEN v WHEN argument = 'RequestParameter' THEN {_REQ} WHEN argument IN ({', '.join(repr(x) for x in A.IDENTIFIERS)}) AND len({_IDS}) = 1 THEN ({_IDS})[1] ELSE v END AS value
  FROM a WHERE argument <> '' AND (NOT regexp_matches({_KEY.format(c='template')}, 'DTC_(READ|CLEAR)_TYPE') OR argument = 'FlowchartTitle')),
b AS (SELECT node, argument, arg_max({{'s': score + {_WEIGHT}, 'v': value}}, (score + {_WEIGHT}, value)) AS x FROM p WHERE value <> '' GROUP BY node, argument),
u AS (SELECT coalesce(b.node, d.node) AS node, coalesce(b.argument, d.argument) AS argument, CASE WHEN implied IS NOT NULL AND (x IS NULL OR overrides) THEN implied ELSE x.v END AS raw, round(CASE WHEN implied IS NOT NULL AND (x IS NULL OR overrides) THEN {A.DEFAULT_SCORE}e0 ELSE x.s END, 6) AS score
  FROM b FULL JOIN d ON b.node = d.node AND b.argument = d.argument),
o(argument, place) AS (VALUES {_values([(a, i) for i, a in enumerate(A.ORDER, 1)])})
SELECT node, u.argument, CASE WHEN {_WIDTH.replace('argument', 'u.argument')} IS NULL THEN raw ELSE {_HEX.format(b=_BARE.format(c='raw'), w='(' + _WIDTH.replace('argument', 'u.argument') + ')')} END AS value, score,
  row_number() OVER (PARTITION BY node ORDER BY coalesce(place, {len(A.ORDER) + 1}), u.argument) AS position FROM u LEFT JOIN o ON u.argument = o.argument""")
def plan_arguments(spark, d):
    return A.plan_arguments(_nodes(spark, d), _sources(spark, d))


@query(f"""WITH {_BASE}, c AS (SELECT node, evidence_id, score FROM s JOIN n USING (o_orderkey) WHERE score > 30), m AS (SELECT node, evidence_id, score FROM s JOIN n USING (o_orderkey) WHERE score <= 30)
SELECT *, false AS legacy FROM c UNION ALL SELECT *, true FROM m WHERE node NOT IN (SELECT node FROM c)""")
def plan_sources(spark, d):
    s = _sources(spark, d).select("node", "evidence_id", "score")
    return A.chosen_sources(s.filter("score > 30"), s.filter("score <= 30"))


@query("""SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE) / 3, 6) AS kept, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END + 1 AS n FROM lineitem""")
def numeric_breakdown(spark, d):
    scores = F.expr("map('a', cast(cast(l_quantity AS double) / 3 AS string), 'b', CASE WHEN l_suppkey % 2 = 0 THEN '7' ELSE 'n/a' END, 'c', cast(null AS string))")
    found = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", A.numeric_scores(scores).alias("m"))
    return found.select("l_orderkey", "l_linenumber", F.col("m")["a"].alias("kept"), F.size(F.map_keys("m")).alias("n"))
