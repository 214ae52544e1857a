"""Registered queries that find evidence for flow nodes; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import arguments as A
from quarry.operators import candidates as C
from quarry.plans.argument_queries import _IS, _KEY
from quarry.plans.catalogue import _t, _tok, _values, query

NODES = [
    ("BCM_DTC_Read_1", "DTC_Read_Type1", "BCM DTC Read"), ("TCAM_IMMO_Key_Write_02", "Information Write-Type3", "IMMO (secret key) write"), ("Change_VMM_3", "GEEA30_VMM_Change", "Change VMM(GEEA30_VMM_Change)"),
    ("ECM2_DTC_Clear", "DTC_Clear_Type7", "x"), ("request_open_HV_battery", "GEEA 30 Open Type 4", ""), ("the_tion_of", "reading_engine", "the tion (of it all) that"),
]
ALIASES = {"BCM_DTC_Read_1": ["DTC Read", "BCM read", "of the"], "TCAM_IMMO_Key_Write_02": ["IMMO Secret Key", "with that and for"], "Change_VMM_3": ["Change VMM", "VMM Change"], "ECM2_DTC_Clear": ["DTC Clear", ""], "request_open_HV_battery": ["Open HV Battery"], "the_tion_of": ["the tion of", "tion of", "the of that this", "be to are"]}
_N = f"n(name, template, raw) AS (VALUES {_values(NODES)})"


# A node for each supplier, numbered by its key.
_NS = f"n(name, template, raw) AS (SELECT nm.name || '_' || s_suppkey, template, raw FROM supplier JOIN (VALUES {_values([(i, *x) for i, x in enumerate(NODES)])}) nm(i, name, template, raw) ON nm.i = s_suppkey % {len(NODES)})"


def _nodes(spark, d):
    known = F.broadcast(spark.createDataFrame([(i, *x) for i, x in enumerate(NODES)], "i int, name string, template string, raw string"))
    return _t(spark, d, "supplier").selectExpr("s_suppkey", f"cast(s_suppkey % {len(NODES)} as int) AS i").join(known, "i").select(F.concat("name", F.lit("_"), F.col("s_suppkey").cast("string")).alias("name"), "template", "raw")


def _gt(c: str) -> str:
    return f"list_transform({_tok(c)}, lambda t: CASE WHEN t = 'immo' THEN 'immobilizer' ELSE t END)"


_SP = "trim(regexp_replace(replace({c}, '_', ' '), '\\s+', ' ', 'g'))"
_SHORT = "trim(regexp_replace(regexp_replace(replace(template, '_', ' '), '(?i)\\bGEEA\\s*30\\b', '', 'g'), '\\s+', ' ', 'g'))"
_BARE = "regexp_replace(name, '_\\d+$', '')"
_ACT = f"replace(CASE WHEN contains({_BARE}, '_') AND {_IS.format(c='split_part(' + _BARE + ", '_', 1)")} THEN regexp_replace({_BARE}, '^[^_]*_', '') ELSE {_BARE} END, '_', ' ')"
_MORE = [(["vmm"], "['Change VMM', 'VMM Change', 'Change VMM Type1']"), (["dtc clear"], "['DTC Clear', replace(template, '_', ' ')]"), (["dtc read"], "['DTC Read', replace(template, '_', ' '), 'Read Snapshot', 'No Snapshot']"), (["immobilizer", "secret key"], "['IMMO Secret Key Write', 'Secret Key for Immobilizer Target Write', 'Secret Key for Immobilizer', 'Immobilizer Secret Key', 'TCAM IMMO Secret Key Write Check and Upload', 'Remote Vehicle Immobilization Secret Key']"), (["request open hv battery"], "['Request Open HV Battery', 'Open HV Battery', 'Request BECM to Open HV Battery']")]
_ADD = " || ".join(f"CASE WHEN {' OR '.join(f"contains(words, '{h}')" for h in hs)} THEN {names} ELSE [] END" for hs, names in _MORE)


@query(f"""WITH {_NS}, b AS (SELECT *, {_SHORT} AS short, {_ACT} AS does FROM n), l AS (SELECT *, [name, template, raw, does, short, short || ' ' || does, does || ' ' || short] AS base FROM b),
w AS (SELECT *, array_to_string({_gt("array_to_string(base, ' ')")}, ' ') AS words FROM l), f AS (SELECT name, base || {_ADD} AS a FROM w)
SELECT DISTINCT name, alias FROM (SELECT name, unnest(list_transform(a, lambda x: {_SP.format(c='x')})) AS alias FROM f) WHERE alias <> ''""")
def node_aliases(spark, d):
    return _nodes(spark, d).select("name", F.explode(C.aliases(F.col("name"), F.col("template"), F.col("raw"))).alias("alias"))


_BOTH = "concat_ws(' ', name, template, raw)"
_FIRST_UNIT = f"coalesce(list_filter(list_transform(regexp_extract_all({_BOTH}, '0x[0-9a-fA-F]+|[A-Za-z]+[A-Za-z0-9-]*|[0-9a-fA-F]{{2,8}}'), lambda t: upper(t)), lambda t: {_IS.format(c='t')})[1], '')"
_PARTS = "list_filter(regexp_split_to_array(regexp_replace(concat_ws(' ', name, template), '\\([^)]*\\)', ' ', 'g'), '[_\\s-]+'), lambda p: p <> '')"
_KEEP = f"list_filter({_PARTS}, lambda p: NOT (regexp_matches(p, '^[0-9]+$') OR starts_with(upper(p), 'GEEA') OR {_IS.format(c='p')} OR regexp_matches(p, '(?i)^Type\\d+$') OR upper(p) = upper(hint)))"
_ASK = "{{'t': '{t}', 'q': {sp}}}"
_Q = [("anchor", "[name, template, raw, replace(name, '_', ' '), replace(template, '_', ' ')]"), ("ecu_doc", "[unit, 'TREG Parameter', phrase, hint]"), ("ecu_doc", "[unit, phrase, hint]"), ("public_process", "['EOL process', phrase, hint, notes]"), ("public_process", "[phrase, hint, 'flow']"), ("template", "[template, 'XML ScriptNode Args']")]
_ASKS = ", ".join(_ASK.format(t=t, sp=_SP.format(c=f"array_to_string(list_filter({ps}, lambda x: x <> ''), ' ')")) for t, ps in _Q)


@query(f"""WITH {_NS}, h AS (SELECT *, {_FIRST_UNIT} AS unit, CASE WHEN regexp_extract({_BOTH}, '(?i)\\bType\\s*_?\\s*(\\d+)\\b', 1) <> '' THEN 'Type' || regexp_extract({_BOTH}, '(?i)\\bType\\s*_?\\s*(\\d+)\\b', 1) ELSE '' END AS hint,
  array_to_string(list_distinct(regexp_extract_all({_BOTH}, '\\(([^)]{{3,120}})\\)', 1)), ' ') AS notes FROM n),
k AS (SELECT *, {_KEEP} AS ps FROM h), p AS (SELECT *, list_filter(ps, lambda x, i: list_position(list_transform(ps, lambda y: upper(y)), upper(x)) = i)[1:6] AS fs FROM k),
r AS (SELECT *, CASE WHEN len(fs) = 0 THEN replace(name, '_', ' ') ELSE array_to_string(fs, ' ') END AS phrase FROM p), a AS (SELECT name, [{_ASKS}] AS qs FROM r),
u AS (SELECT name, unnest(qs) AS x, generate_subscripts(qs, 1) - 1 AS ord FROM a)
SELECT name, min(ord) AS ord, arg_min(x.t, ord) AS query_type, x.q AS query FROM u WHERE x.q <> '' GROUP BY name, x.q""")
def typed_queries(spark, d):
    return C.query_plan(_nodes(spark, d))


# Documents as evidence: titles, units, modules, roles, flowchart names and fields follow from the id.
_E = {
    "evidence_id": "doc_id",
    "content": "concat(CASE doc_id % 9 WHEN 0 THEN 'DTC Read Type 1 (Snap) ' WHEN 1 THEN 'IO  Control Type21 (x) VMM ' WHEN 2 THEN 'BCM DTC Clear, IMMO secret key. ' WHEN 3 THEN 'Requirements Change Log ' WHEN 4 THEN 'see DID: 0xF190, details refer to the file DTC process list; PARAMETER NA ' ELSE '' END, text)",
    "title": "CASE doc_id % 8 WHEN 0 THEN 'Contents' WHEN 1 THEN 'The tion' WHEN 2 THEN 'DTC read' WHEN 3 THEN '3 Revision History' END",
    "unit": "CASE doc_id % 5 WHEN 0 THEN ' BCM2' WHEN 1 THEN 'ECM' WHEN 2 THEN '' WHEN 3 THEN 'rear ECM2' END",
    "module": "CASE doc_id % 3 WHEN 0 THEN 'ecu_parameter' WHEN 1 THEN 'treg' END",
    "role": "CASE doc_id % 4 WHEN 0 THEN 'table_row' WHEN 1 THEN 'section_text' WHEN 2 THEN 'flowchart_title' ELSE 'flowchart_image' END",
}
_F = "CASE doc_id % 6 WHEN 0 THEN {a}({s0}) WHEN 1 THEN {a}({s1}, {s0}) ELSE {a}() END"
_SF = _F.format(a="array", s0="struct('Read  did' AS header, 'F1' AS cell)", s1="struct('Note' AS header, 'dtc clear' AS cell)").replace("array()", "cast(array() AS array<struct<header:string,cell:string>>)")
_DF = _F.format(a="list_value", s0="{'header': 'Read  did', 'cell': 'F1'}", s1="{'header': 'Note', 'cell': 'dtc clear'}").replace("list_value()", "CAST([] AS STRUCT(header VARCHAR, cell VARCHAR)[])")
_ES = f"e AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _E.items())}, {_DF} AS fields FROM documents)"
_CLEAN = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_NOISE = f"(head IN ('document', 'contents') OR {' OR '.join(f"contains(head, '{s}')" for s in C.NOISE_PARTS)} OR {' OR '.join(f"contains(flat, '{s}')" for s in C.NOISE_TEXT)} OR (contains(flat, 'document release status') AND (contains(flat, 'document no') OR contains(flat, 'page no'))))"
_FLOW = f"regexp_replace(regexp_replace(regexp_extract({_CLEAN.format(c='content')}, '{C.TITLE}'), '(?i)\\bLevel\\s+(\\d+)', 'Level\\1', 'g'), '(?i)Type\\s+(\\d+)', 'Type\\1', 'g')"


def _evidence(spark, d):
    return _t(spark, d, "documents").select(*[F.expr(v).alias(k) for k, v in _E.items()], F.expr(_SF).alias("fields"))


@query(f"WITH {_ES} SELECT evidence_id, {_NOISE} AS noise, {_FLOW} AS flow FROM (SELECT *, lower(trim(coalesce(title, ''))) AS head, lower({_CLEAN.format(c='content')}) AS flat FROM e)")
def evidence_noise(spark, d):
    return _evidence(spark, d).select("evidence_id", C.noise(F.col("title"), F.col("content")).alias("noise"), C.flowchart_title(F.col("content")).alias("flow"))


_REF = f"list_transform(regexp_extract_all({_CLEAN.format(c='content')}, '{C.REFERENCE}', 1), lambda v: trim(substr(regexp_replace(trim(regexp_replace(v, '\\s+', ' ', 'g'), ' :：,，-'), '(?i)^(?:file|chapter)\\s+', ''), 1, 160)))"
_USEFUL = f"length(array_to_string({_gt('v')}, ' ')) >= 3 AND list_has_any({_gt('v')}, [{', '.join(repr(s) for s in C.SIGNALS)}])"


@query(f"WITH {_ES}, r AS (SELECT evidence_id, unnest({_REF}) AS v FROM e) SELECT DISTINCT evidence_id, v AS reference FROM r WHERE {_USEFUL}")
def reference_texts(spark, d):
    return _evidence(spark, d).select("evidence_id", F.explode(C.references(F.col("content"))).alias("reference"))


_RULES = {"DID": r"(?i)\bDID\b[:\s]*((?:0x)?[0-9A-Fa-f]{4,6})", "PARAMETER": r"(?i)\bPARAMETER\b[:\s]*((?:0x)?[0-9A-Fa-f]{2,8}|NA)\b"}


@query(f"WITH {_ES} " + " UNION ALL ".join(f"SELECT evidence_id, '{k}' AS header, regexp_extract({_CLEAN.format(c='content')}, '{p}', 1) AS cell FROM e WHERE regexp_extract({_CLEAN.format(c='content')}, '{p}', 1) <> ''" for k, p in _RULES.items()))
def text_fields(spark, d):
    return _evidence(spark, d).select("evidence_id", F.inline(C.fallback_fields(F.col("content"))))


_FAMILY = "CASE WHEN key = '' OR shown = '' THEN false " + " ".join(f"WHEN contains(key, '{k}') THEN {' AND '.join(f"contains(shown, '{p}')" for p in ps)}" for k, ps in C.FAMILIES.items()) + " WHEN contains(key, 'GEEA30_VMM_CHANGE') THEN contains(shown, 'io control') AND contains(shown, 'type21') ELSE true END"
_NEEDS = "(" + " OR ".join(f"contains(key, '{k}')" for k in (*C.FAMILIES, "GEEA30_VMM_CHANGE")) + ")"
_AL = f"al(name, alias) AS (VALUES {_values([(n, a) for n, xs in ALIASES.items() for a in xs])})"
_OWN = "CASE WHEN {a} THEN upper(split_part(name, '_', 1)) WHEN {b} THEN upper(split_part(template, '_', 1)) ELSE '' END".format(a=_IS.format(c="split_part(name, '_', 1)"), b=_IS.format(c="split_part(template, '_', 1)"))
_TA = f"list_distinct({_gt(_SHORT)})"


@query(f"""WITH {_N}, {_ES}, {_AL}, plan AS (SELECT s_suppkey AS node, nm.name FROM supplier JOIN (VALUES {_values([(i, n) for i, (n, _, _) in enumerate(NODES)])}) nm(i, name) ON nm.i = (s_suppkey // 50) % {len(NODES)} WHERE s_suppkey % 50 = 0),
m AS (SELECT n.*, {_OWN} AS own, {_KEY.format(c='template')} AS key, {_TA} AS ta FROM n),
v AS (SELECT *, trim(coalesce(unit, '')) AS u, lower(trim(coalesce(title, ''))) AS head, lower({_CLEAN.format(c='content')}) AS flat, {_FLOW} AS flow,
  {_gt("concat_ws(' ', content, coalesce(title, ''), trim(coalesce(unit, '')), coalesce(module, ''), array_to_string(list_transform(fields, lambda f: f.header || ' ' || f.cell), ' '))")} AS words FROM e),
z AS (SELECT *, array_to_string(words, ' ') AS text, array_to_string({_gt('flow')}, ' ') AS shown, list_distinct({_gt("coalesce(title, '')")}) AS tt FROM v),
s AS (SELECT al.name, evidence_id, CASE WHEN len(own) = 0 THEN 0e0 WHEN contains(text, phrase) THEN {C.MIN_OVERLAP}e0 WHEN len(list_intersect(own, words)) / len(own) >= {C.NEAR} THEN 4 + 6 * len(list_intersect(own, words)) / len(own) + len(list_intersect(own, words)) ELSE 0e0 END AS a,
  len(own) > 0 AND len(list_intersect(own, tt)) / greatest(len(own), 1) >= {C.NEAR} AS titled FROM (SELECT name, list_distinct({_gt('alias')}) AS own, array_to_string({_gt('alias')}, ' ') AS phrase FROM al) al, z),
b AS (SELECT name, evidence_id, list_sum(list_sort(list(a), 'DESC')[1:3]) AS best, bool_or(titled) AS titled FROM s GROUP BY name, evidence_id),
p AS (SELECT m.name, template, own, key, ta, z.*, best, titled, coalesce(module = 'ecu_parameter', false) AS param, u <> '' AND (starts_with(upper(u), own) OR list_contains({_tok('u')}, lower(own))) AS fits FROM b JOIN m USING (name) JOIN z USING (evidence_id)),
t AS (SELECT *, {_NOISE} AS bad, {_FAMILY} AS family, {_NEEDS} AS needs FROM p),
o AS (SELECT name, evidence_id, role, round(CASE WHEN bad THEN 0 ELSE best
  + CASE WHEN own <> '' AND u <> '' THEN CASE WHEN fits THEN 16 WHEN param THEN -35 ELSE 0 END WHEN own <> '' AND list_contains(words, lower(own)) THEN 8 ELSE 0 END
  + CASE WHEN coalesce(title, '') <> '' AND titled THEN 5 ELSE 0 END + CASE role WHEN 'table_row' THEN 3 WHEN 'section_text' THEN 2 WHEN 'flowchart_title' THEN 1 ELSE 0 END
  + CASE WHEN param THEN 2 ELSE 0 END + CASE WHEN len(fields) > 0 THEN 2 ELSE 0 END
  + CASE WHEN len(list_filter(fields, lambda f: upper(trim(regexp_replace(f.header, '\\s+', ' ', 'g'))) IN ({', '.join(repr(x) for x in C.CORE)}))) > 0 THEN 25 WHEN role IN ('section_text', 'table_row') AND flow = '' THEN -12 ELSE 0 END
  + CASE WHEN flow = '' THEN 0 WHEN family THEN 8 WHEN needs THEN -35 ELSE 1 END
  + CASE WHEN template = 'GEEA30_VMM_Change' THEN CASE WHEN contains(shown, 'type21') THEN 6 ELSE 0 END - CASE WHEN contains(shown, 'type22') OR contains(text, 'ignore nrc') THEN 6 ELSE 0 END ELSE 0 END
  + CASE WHEN template <> '' AND len(ta) > 0 AND len(list_intersect(ta, words)) / greatest(len(ta), 1) >= {C.NEAR} THEN 3 ELSE 0 END END, 6) AS score FROM t)
SELECT node, name, evidence_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, CASE role WHEN 'table_row' THEN 0 WHEN 'section_text' THEN 1 WHEN 'flowchart_title' THEN 2 WHEN 'flowchart_image' THEN 3 ELSE 9 END, evidence_id) AS rank FROM o WHERE score > 0) JOIN plan USING (name) WHERE rank <= 25""")
def task_candidates(spark, d):
    """Every fiftieth supplier is a node of a flow plan."""
    known = spark.createDataFrame([(i, n, t, ALIASES[n]) for i, (n, t, _) in enumerate(NODES)], "i int, name string, template string, aliases array<string>")
    plan = _t(spark, d, "supplier").filter("s_suppkey % 50 = 0").selectExpr("s_suppkey AS node", f"cast(s_suppkey / 50 as int) % {len(NODES)} AS i")
    return C.task_candidates(plan.join(F.broadcast(known), "i"), _evidence(spark, d), 25).drop("role")
