"""Registered queries over the knowledge graph of evidence; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import knowledge as K
from quarry.sources import snapshots
from quarry.sources.workspace import folder
from quarry.plans.catalogue import _t, _tok, query

# Orders as evidence rows of every role.
_E = {
    "ord": "o_orderkey",
    "evidence_id": "concat('e ', o_orderkey)",
    "doc_id": "concat('doc-', o_custkey % 50)",
    "evidence_type": "CASE o_custkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'flowchart' WHEN 2 THEN 'image' ELSE 'text' END",
    "block_role": "CASE o_orderkey % 7 WHEN 0 THEN 'table_row' WHEN 1 THEN 'flowchart_body' WHEN 2 THEN 'flowchart_image' WHEN 3 THEN 'flowchart_title' WHEN 4 THEN 'section_text' WHEN 5 THEN '' END",
    "content": "concat('Text  of ', o_orderpriority, repeat(' more words', cast(o_custkey % 60 AS int)))",
    "section_title": "CASE WHEN o_custkey % 3 > 0 THEN concat('3.', o_custkey % 20, ' Type21 / immo of ', o_orderpriority) END",
    "parent_evidence_id": "CASE WHEN o_custkey % 2 = 0 THEN concat('sec ', o_custkey % 30) END",
    "ecu": "CASE o_custkey % 5 WHEN 0 THEN ' BCM ' WHEN 1 THEN '' WHEN 2 THEN 'ECM 1' END",
    "module": "CASE o_orderkey % 3 WHEN 0 THEN 'treg' WHEN 1 THEN '' END",
    "img_path": "CASE WHEN o_custkey % 2 = 0 THEN 'img/x.png' ELSE '' END",
}
_SERVICES = "CASE WHEN o_custkey % 3 > 0 THEN {a}('22', CASE WHEN o_custkey % 4 = 0 THEN ' ' ELSE '2E' END) END"
_FIELDS = [("'DID'", "CASE WHEN o_custkey % 3 = 0 THEN concat('see f1', 10 + o_custkey % 80) ELSE '0xd134' END"), ("'RID'", "CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'none' END"), ("'Flowchart title'", "concat('DTC Read Type ', o_custkey % 6)"), ("'Data  info'", "repeat('long value ', cast(o_custkey % 20 AS int))")]
_SF = "array(" + ", ".join(f"struct({h} AS header, {c} AS cell)" for h, c in _FIELDS) + ")"
_DF = "list_value(" + ", ".join(f"{{'header': {h}, 'cell': {c}}}" for h, c in _FIELDS) + ")"


def _frag(c: str, limit: int = K.FRAGMENT) -> str:
    return f"coalesce(nullif(trim(substr(trim(regexp_replace(regexp_replace(trim(coalesce({c}, '')), '[^0-9A-Za-z_.=-]+', '_', 'g'), '_+', '_', 'g'), '_'), 1, {limit}), '_'), ''), 'value')"


def _id(kind: str, c: str) -> str:
    return f"'{kind}:' || {_frag(c)}"


_RAW = "upper(regexp_extract({c}, '\\b(?:0x)?[0-9A-Fa-f]{{4,8}}\\b'))"
_IDENT = "CASE WHEN " + _RAW.format(c="cell") + " = '' THEN cell ELSE '0x' || regexp_replace(" + _RAW.format(c="cell") + ", '^0X', '') END"
_CONTAINS = "CASE role_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CONTAINS.items()) + " ELSE 'contains_evidence' END"
_BASE = f"""b AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _E.items()).replace('cast(o_custkey % 60 AS int)', 'o_custkey % 60')}, {_SERVICES.format(a='list_value')} AS service_ids, {_DF.replace('cast(o_custkey % 20 AS int)', 'o_custkey % 20')} AS fields FROM orders),
t AS (SELECT *, CASE WHEN coalesce(block_role, '') IN ('flowchart_body', 'flowchart_image') THEN 'FlowchartImage' WHEN block_role = 'table_row' THEN 'TableRow' WHEN block_role = 'flowchart_title' OR evidence_type = 'flowchart' THEN 'FlowchartTitle' WHEN evidence_type = 'table' THEN 'Table' ELSE 'Section' END AS role_type FROM b),
v AS (SELECT *, CASE role_type WHEN 'FlowchartImage' THEN coalesce(nullif(img_path, ''), nullif(content, ''), evidence_id) WHEN 'FlowchartTitle' THEN coalesce(nullif(section_title, ''), nullif(content, ''), evidence_id) WHEN 'Section' THEN coalesce(nullif(section_title, ''), evidence_id) ELSE evidence_id END AS role_name,
  {_id('Document', 'doc_id')} AS document, {_id('Evidence', 'evidence_id')} AS evidence, trim(coalesce(ecu, '')) AS unit, coalesce(parent_evidence_id, '') AS parent, coalesce(block_role, '') <> 'flowchart_body' AS open FROM t),
e AS (SELECT *, role_type || ':' || CASE WHEN role_type = 'FlowchartTitle' THEN {_frag('role_name')} ELSE {_frag('evidence_id')} END AS role FROM v),
s AS (SELECT * FROM (SELECT *, unnest(service_ids) AS sid FROM e WHERE open) WHERE trim(sid) <> ''),
f0 AS (SELECT *, f.header AS header, f.cell AS cell FROM (SELECT *, unnest(fields) AS f, generate_subscripts(fields, 1) AS fi FROM e WHERE open) WHERE trim(f.cell) <> ''),
f AS (SELECT *, upper(trim(regexp_replace(header, '[^0-9A-Za-z]+', '_', 'g'), '_')) AS key, {_IDENT} AS ident, 'ParameterField:' || {_frag('(' + _frag('header') + " || '=' || " + _frag('cell', 100) + ')')} AS field FROM f0)"""
_NODES = f"""n AS (SELECT ord, 0 AS place, evidence_id, module, ecu, block_role, document AS node_id, 'Document' AS node_type, doc_id AS name FROM e
  UNION ALL SELECT ord, 1, evidence_id, module, ecu, block_role, evidence, 'Evidence', evidence_id FROM e UNION ALL SELECT ord, 2, evidence_id, module, ecu, block_role, role, role_type, role_name FROM e
  UNION ALL SELECT ord, 3, evidence_id, module, ecu, block_role, {_id('Section', 'parent')}, 'Section', parent FROM e WHERE parent <> '' AND role_type = 'TableRow'
  UNION ALL SELECT ord, 4, evidence_id, module, ecu, block_role, {_id('Table', "(doc_id || ':' || parent)")}, 'Table', parent || ':table' FROM e WHERE parent <> '' AND role_type = 'TableRow'
  UNION ALL SELECT ord, 5, evidence_id, module, ecu, block_role, {_id('ECU', 'unit')}, 'ECU', unit FROM e WHERE unit <> '' UNION ALL SELECT ord, 6, evidence_id, module, ecu, block_role, {_id('Service', 'sid')}, 'Service', sid FROM s
  UNION ALL SELECT ord, 10 * fi, evidence_id, module, ecu, block_role, {_id('FlowchartTitle', 'cell')}, 'FlowchartTitle', cell FROM f WHERE key = 'FLOWCHART_TITLE' UNION ALL SELECT ord, 10 * fi, evidence_id, module, ecu, block_role, field, 'ParameterField', header || '=' || cell FROM f WHERE key <> 'FLOWCHART_TITLE'
  UNION ALL SELECT ord, 10 * fi + 1, evidence_id, module, ecu, block_role, key || ':' || {_frag('ident')}, key, ident FROM f WHERE key IN ('DID', 'RID'))"""
_EDGES = f"""r AS (SELECT evidence_id, document AS source, {_CONTAINS} AS relation, role AS target FROM e UNION ALL SELECT evidence_id, role, 'backed_by_evidence', evidence FROM e
  UNION ALL SELECT evidence_id, {_id('Section', 'parent')}, 'contains_table', {_id('Table', "(doc_id || ':' || parent)")} FROM e WHERE parent <> '' AND role_type = 'TableRow' UNION ALL SELECT evidence_id, {_id('Table', "(doc_id || ':' || parent)")}, 'contains_row', role FROM e WHERE parent <> '' AND role_type = 'TableRow'
  UNION ALL SELECT evidence_id, document, 'document_for_ecu', {_id('ECU', 'unit')} FROM e WHERE unit <> '' UNION ALL SELECT evidence_id, role, 'mentions_ecu', {_id('ECU', 'unit')} FROM e WHERE unit <> '' UNION ALL SELECT evidence_id, role, 'mentions_service', {_id('Service', 'sid')} FROM s
  UNION ALL SELECT evidence_id, role, 'refers_to', {_id('FlowchartTitle', 'cell')} FROM f WHERE key = 'FLOWCHART_TITLE' UNION ALL SELECT evidence_id, role, 'has_field', field FROM f WHERE key <> 'FLOWCHART_TITLE'
  UNION ALL SELECT evidence_id, role, 'mentions_' || lower(key), key || ':' || {_frag('ident')} FROM f WHERE key IN ('DID', 'RID') UNION ALL SELECT evidence_id, field, 'normalizes_to', key || ':' || {_frag('ident')} FROM f WHERE key IN ('DID', 'RID'))"""
_GRAPH_TOKENS = f"flatten(list_transform(list_transform({_tok('name')}, lambda t: CASE WHEN t = 'immo' THEN 'immobilizer' ELSE t END), lambda t: CASE WHEN regexp_matches(t, '^[a-z]+[0-9]+$') THEN [t, regexp_extract(t, '^[a-z]+'), regexp_extract(t, '[0-9]+$')] ELSE [t] END))"


def _evidence(spark, d):
    return _t(spark, d, "orders").select(*[F.expr(v).alias(k) for k, v in _E.items()], F.expr(_SERVICES.format(a="array")).alias("service_ids"), F.expr(_SF).alias("fields"))


@query(f"""WITH {_BASE}, {_NODES}, m AS (SELECT node_id, arg_min({{'t': node_type, 'n': name}}, (ord, place)) AS x, count(DISTINCT evidence_id) AS n_evidence, arg_max(module, ord) FILTER (coalesce(module, '') <> '') AS module, arg_max(ecu, ord) FILTER (coalesce(ecu, '') <> '') AS ecu, arg_max(block_role, ord) FILTER (coalesce(block_role, '') <> '') AS block_role FROM n GROUP BY node_id)
SELECT node_id, x.t AS node_type, x.n AS name, array_to_string({_GRAPH_TOKENS.replace('coalesce(name,', 'coalesce(x.n,')}, ' ') AS canonical_name, n_evidence, module, ecu, block_role FROM m""")
def knowledge_nodes(spark, d):
    return K.graph_nodes(_evidence(spark, d))


@query(f"WITH {_BASE}, {_EDGES} SELECT 'Edge:' || substr(sha1(source || chr(0) || relation || chr(0) || target), 1, 20) AS edge_id, source, relation, target, count(DISTINCT evidence_id) AS n_evidence FROM r GROUP BY source, relation, target")
def knowledge_edges(spark, d):
    return K.graph_edges(_evidence(spark, d))


@query(f"WITH {_BASE}, {_NODES}, {_EDGES} SELECT DISTINCT node_id AS graph_id, 'node' AS kind, evidence_id FROM n UNION ALL SELECT DISTINCT 'Edge:' || substr(sha1(source || chr(0) || relation || chr(0) || target), 1, 20), 'edge', evidence_id FROM r")
def knowledge_memberships(spark, d):
    """The evidence of every node and edge, as rows."""
    return K.memberships(_evidence(spark, d))


@query(f"""WITH {_BASE}, x AS (SELECT *, sha256(content) AS h, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS c FROM b)
SELECT concat('prov:', evidence_id, ':', substr(h, 1, 12)) AS provenance_id, evidence_id, doc_id, h AS content_hash, CASE WHEN length(c) <= {K.EXCERPT} THEN c ELSE rtrim(substr(c, 1, {K.EXCERPT})) || '...' END AS content_excerpt FROM x""")
def knowledge_provenance(spark, d):
    return K.provenance(_evidence(spark, d))


@query("""SELECT l_orderkey, concat('Order:', l_orderkey, ' --has--> Line:', min(l_linenumber), ' --of--> Part:', min(l_partkey)) AS path FROM lineitem GROUP BY l_orderkey""")
def rendered_paths(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l"), F.min("l_partkey").alias("p"))
    nodes = F.array(F.concat(F.lit("Order:"), "l_orderkey"), F.concat(F.lit("Line:"), "l"), F.concat(F.lit("Part:"), "p"))
    return g.select("l_orderkey", K.rendered(nodes, F.array(F.lit("has"), F.lit("of"))).alias("path"))


@query("""WITH c AS (SELECT l_suppkey AS node, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS evidence_id, l_partkey % 20 AS role_id FROM lineitem), p AS (SELECT s_suppkey AS node, 'p' || s_suppkey AS path, unnest(list_distinct([s_suppkey % 20, s_nationkey % 20, 3])) AS role_id FROM supplier)
SELECT node, evidence_id, path FROM c JOIN p USING (node, role_id)""")
def candidate_path_links(spark, d):
    c = _t(spark, d, "lineitem").selectExpr("l_suppkey AS node", "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS evidence_id", "l_partkey % 20 AS role_id")
    p = _t(spark, d, "supplier").selectExpr("s_suppkey AS node", "concat('p', s_suppkey) AS path", "array(s_suppkey % 20, cast(s_nationkey % 20 AS bigint), 3L) AS nodes")
    return K.mentioned_paths(c, p)


_EDGE_SQL = f"WITH {_BASE}, {_EDGES}, g AS (SELECT 'Edge:' || substr(sha1(source || chr(0) || relation || chr(0) || target), 1, 20) AS edge_id, source, relation, target, count(DISTINCT evidence_id) AS n_evidence FROM r GROUP BY source, relation, target)"


def _bare_edges(evidence):
    """Edges by their source, relation and target, of which their id follows."""
    return K.graph_edges(evidence).drop("edge_id")


def _grown(spark, d):
    """A snapshot of the edges of two thirds of the evidence, and a delta for the rest."""
    evidence, root = _evidence(spark, d), folder(spark, "graph-snapshot")
    snapshots.write(_bare_edges(evidence.filter("ord % 3 <> 0")), root, "edges", ["source", "relation", "target"])
    snapshots.apply(_bare_edges(evidence.filter("coalesce(ord % 3, 0) = 0")), root, "edges", added=("n_evidence",))
    return root


@query(f"{_EDGE_SQL} SELECT * FROM g")
def graph_snapshot(spark, d):
    """Base and delta together equal a build from all evidence."""
    keys = ["source", "relation", "target"]
    return snapshots.read(spark, _grown(spark, d), "edges").select(K.edge_id(F.concat_ws("\0", *keys)).alias("edge_id"), *keys, "n_evidence")


@query(f"{_EDGE_SQL} SELECT 2 AS version, 'delta' AS kind, count(*) AS n_rows, true AS same_content FROM g")
def graph_snapshot_manifest(spark, d):
    """The manifest's hash, kept up by the delta, equals that of a full build, whose rows come in another order."""
    root = _grown(spark, d)
    whole = snapshots.content_hash(_bare_edges(_evidence(spark, d))).select(F.col("total").alias("t"), F.col("parity").alias("p"))
    noted = snapshots.manifest(spark, root).filter("version = 2")
    return noted.join(F.broadcast(whole), F.lit(True)).select("version", "kind", "n_rows", ((F.col("total") == F.col("t")) & (F.col("parity") == F.col("p"))).alias("same_content"))
