"""Knowledge graph of evidence: every row becomes document, evidence, role, unit, service and field nodes with typed edges.

Nodes and edges are told apart and exploded per evidence row (narrow); only those that several rows can make are merged by key with
map-side-combined aggregates. A node named everywhere keeps counts and its last non-empty metadata, not an array of all its evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.sources.workspace import written

# Relations of a document to the node of each role, and separators of ids.
CONTAINS = {"Section": "contains_section", "Table": "contains_table", "TableRow": "contains_row", "FlowchartTitle": "contains_flowchart_title", "FlowchartImage": "contains_flowchart_image"}
FRAGMENT, EXCERPT = 140, 500


def fragment(value: Column, limit: int = FRAGMENT) -> Column:
    """A value as part of an id: other characters than ``[0-9A-Za-z_.=-]`` to one underscore, ends stripped, at most ``limit`` long."""
    # The value stands once in each step: where a step names it twice, steps around steps are evaluated again for every mention.
    # Joining the runs of kept characters strips the ends at once, and is much cheaper than replacing a negated class.
    slug = F.array_join(F.regexp_extract_all(F.coalesce(value.cast("string"), F.lit("")), F.lit("[0-9A-Za-z.=-]+"), F.lit(0)), "_")
    return F.regexp_replace(shorter(slug, limit), "^$", "value")


def shorter(part: Column, limit: int) -> Column:
    """A fragment, or fragments joined by other characters than underscores, as the fragment of at most ``limit`` characters."""
    return F.regexp_extract(part, f"^.{{0,{limit - 1}}}[^_]", 0)


def node_id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), fragment(value))


def identifier(value: Column) -> Column:
    """The first stand-alone identifier of 4 to 8 hexadecimal digits as ``0x`` and upper-case digits, else the value."""
    raw = F.upper(F.regexp_extract(value, r"\b(?:0x)?[0-9A-Fa-f]{4,8}\b", 0))
    return F.when(raw == "", value).otherwise(F.concat(F.lit("0x"), F.regexp_replace(raw, "^0X", "")))


def field_key(value: Column) -> Column:
    return F.upper(F.array_join(F.regexp_extract_all(value, F.lit("[0-9A-Za-z]+"), F.lit(0)), "_"))


def graph_tokens(text: Column) -> Column:
    """Tokens, ``immo`` as ``immobilizer``, and words that end in digits also in two parts."""
    full = F.transform(tokens(text), lambda t: F.when(t == "immo", F.lit("immobilizer")).otherwise(t))
    split = lambda t: F.when(t.rlike("^[a-z]+[0-9]+$"), F.array(t, F.regexp_extract(t, "^[a-z]+", 0), F.regexp_extract(t, "[0-9]+$", 0))).otherwise(F.array(t))
    return F.flatten(F.transform(full, split))


def canonical(name: Column) -> Column:
    return F.array_join(graph_tokens(name), " ")


def role_node(e: DataFrame) -> DataFrame:
    """Adds role_type, role_id and role_name: the node that an evidence row is; and ``part``, its own id as a fragment."""
    full = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    role, kind = F.coalesce("block_role", F.lit("")), F.col("evidence_type")
    image = role.isin("flowchart_body", "flowchart_image")
    title = (role == "flowchart_title") | (kind == "flowchart")
    type_ = F.when(image, F.lit("FlowchartImage")).when(role == "table_row", F.lit("TableRow")).when(title, F.lit("FlowchartTitle")).when(kind == "table", F.lit("Table")).otherwise(F.lit("Section"))
    name = F.when(image, full("img_path", "content", "evidence_id")).when((role == "table_row") | ((kind == "table") & ~title), F.col("evidence_id")).when(title, full("section_title", "content", "evidence_id")).otherwise(full("section_title", "evidence_id"))
    made = e.withColumns({"role_type": type_, "role_name": name, "part": fragment(F.col("evidence_id"))})
    return made.withColumn("role_id", F.concat("role_type", F.lit(":"), F.when(F.col("role_type") == "FlowchartTitle", fragment(F.col("role_name"))).otherwise(F.col("part"))))


def provenance(e: DataFrame) -> DataFrame:
    """Where each evidence row comes from: content hash, an id made of it, and an excerpt."""
    digest = F.sha2("content", 256)
    flat = F.trim(F.regexp_replace("content", r"\s+", " "))
    cut = F.when(F.length(flat) <= EXCERPT, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, EXCERPT)), F.lit("...")))
    return e.select(F.concat(F.lit("prov:"), "evidence_id", F.lit(":"), F.substring(digest, 1, 12)).alias("provenance_id"), "evidence_id", "doc_id", digest.alias("content_hash"), cut.alias("content_excerpt"))


def _things(e: DataFrame, shared: bool = False) -> DataFrame:
    """An evidence row with the ids that nodes and edges are made of, each made once; ``shared`` leaves out fields that only the row's own statements name.

    ``part`` is its own id as a fragment. ``services`` (value, id) and ``named`` (header, value, key, ident, title_id, field_id,
    ident_id), one for each field, are arrays; an id that a row, service or field does not have is null.
    """
    c, n = F.col, F.lit(None).cast("string")
    row = (c("parent") != "") & (c("role_type") == "TableRow")
    open_ = F.coalesce("block_role", F.lit("")) != "flowchart_body"
    made = e.withColumns({"unit": F.trim(F.coalesce("ecu", F.lit(""))), "parent": F.coalesce("parent_evidence_id", F.lit(""))}).withColumns({
        "document": node_id("Document", c("doc_id")), "evidence": F.concat(F.lit("Evidence:"), "part"), "unit_id": F.when(c("unit") != "", node_id("ECU", c("unit"))),
        "section": F.when(row, node_id("Section", c("parent"))), "table": F.when(row, node_id("Table", F.concat("doc_id", F.lit(":"), "parent"))),
        "services": F.transform(F.filter(F.when(open_, c("service_ids")), lambda s: F.trim(s) != ""), lambda s: F.struct(s.alias("value"), node_id("Service", s).alias("id"))),
    })
    # Step by step, since what a lambda names twice is evaluated twice.
    held = F.filter(F.when(open_, c("fields")), lambda f: F.trim(f["cell"]) != "")
    keyed = F.transform(held, lambda f: F.struct(f["header"].alias("header"), f["cell"].alias("value"), field_key(f["header"]).alias("key")))
    if shared:
        keyed = F.filter(keyed, lambda f: f["key"].isin("DID", "RID") | (c("role_type") == "FlowchartTitle"))
    told = F.transform(keyed, lambda f: F.struct(f["header"].alias("header"), f["value"].alias("value"), f["key"].alias("key"), fragment(f["value"]).alias("part"), F.when(f["key"].isin("DID", "RID"), identifier(f["value"])).alias("ident")))
    is_title = lambda f: f["key"] == "FLOWCHART_TITLE"
    field_id = lambda f: F.concat(F.lit("ParameterField:"), shorter(F.concat(fragment(f["header"]), F.lit("="), shorter(f["part"], 100)), FRAGMENT))
    ids = lambda f: F.struct(
        f["header"].alias("header"), f["value"].alias("value"), f["key"].alias("key"), f["ident"].alias("ident"), F.when(is_title(f), F.concat(F.lit("FlowchartTitle:"), f["part"])).otherwise(n).alias("title_id"),
        F.when(~is_title(f), field_id(f)).alias("field_id"), F.when(f["ident"].isNotNull(), F.concat(f["key"], F.lit(":"), fragment(f["ident"]))).alias("ident_id"),
    )
    return made.withColumn("named", F.transform(told, ids)).drop("service_ids", "fields")


def _listed(*parts: Column) -> Column:
    """Arrays of one type as one; null is empty."""
    return F.flatten(F.array_compact(F.array(*parts)))


def _nodes() -> Column:
    """The nodes (node_id, node_type, name) that an evidence row mentions, in their order."""
    c = F.col
    n = lambda i, t, name: F.when(i.isNotNull(), F.struct(i.alias("node_id"), (F.lit(t) if isinstance(t, str) else t).alias("node_type"), name.alias("name")))
    rows = F.array_compact(F.array(n(c("document"), "Document", c("doc_id")), n(c("evidence"), "Evidence", c("evidence_id")), n(c("role_id"), c("role_type"), c("role_name")), n(c("section"), "Section", c("parent")), n(c("table"), "Table", F.concat("parent", F.lit(":table"))), n(c("unit_id"), "ECU", c("unit"))))
    services = F.transform("services", lambda s: n(s["id"], "Service", s["value"]))
    fields = F.transform("named", lambda f: F.array_compact(F.array(n(f["title_id"], "FlowchartTitle", f["value"]), n(f["field_id"], "ParameterField", F.concat(f["header"], F.lit("="), f["value"])), n(f["ident_id"], f["key"], f["ident"]))))
    return _listed(rows, services, F.flatten(fields))


def _node_ids() -> Column:
    """The distinct ids of the nodes that an evidence row mentions."""
    fields = F.flatten(F.transform("named", lambda f: F.array(f["title_id"], f["field_id"], f["ident_id"])))
    return F.array_distinct(F.array_compact(_listed(F.array("document", "evidence", "role_id", "section", "table", "unit_id"), F.transform("services", lambda s: s["id"]), fields)))


def _edge(source: Column, relation: Column | str, target: Column) -> Column:
    """A statement as one string, null if it lacks a part; ids and relations hold no NUL."""
    return F.concat(source, F.lit("\0"), F.lit(relation) if isinstance(relation, str) else relation, F.lit("\0"), target)


def _statements() -> tuple[Column, Column]:
    """The distinct statements of an evidence row: those that name a node of its own id, which no row of another ``part`` makes, and the rest.

    A flowchart title is a node of its name and not of the row's id.
    """
    c = F.col
    contains = reduce(lambda a, kv: a.when(c("role_type") == kv[0], F.lit(kv[1])), CONTAINS.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.lit("contains_evidence"))
    role, titled = c("role_id"), c("role_type") == "FlowchartTitle"
    of_role = F.array(_edge(c("document"), contains, role), _edge(role, "mentions_ecu", c("unit_id")))
    of_services = F.transform("services", lambda s: _edge(role, "mentions_service", s["id"]))
    of_fields = F.flatten(F.transform("named", lambda f: F.array(_edge(role, "refers_to", f["title_id"]), _edge(role, "has_field", f["field_id"]), _edge(role, F.concat(F.lit("mentions_"), F.lower(f["key"])), f["ident_id"]))))
    about_role = [of_role, of_services, of_fields]
    backed = F.array(_edge(role, "backed_by_evidence", c("evidence")), _edge(c("table"), "contains_row", role))
    shared = [F.array(_edge(c("section"), "contains_table", c("table")), _edge(c("document"), "document_for_ecu", c("unit_id"))), F.transform("named", lambda f: _edge(f["field_id"], "normalizes_to", f["ident_id"]))]
    once = lambda *parts: F.array_distinct(F.array_compact(_listed(*parts)))
    return once(backed, *[F.when(~titled, x) for x in about_role]), once(*shared, *[F.when(titled, x) for x in about_role])


def _by_part(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence rows whose id has a fragment of its own, and those that share theirs with others.

    What a row of the first kind says is told apart within the row; only ids are shuffled to find the second kind, which is
    a small table as a rule, read from a file so that Spark knows its size.
    """
    rows = role_node(e)
    crowded = written(rows.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part"), "graph-crowded")
    return rows.join(crowded, "part", "left_anti"), rows.join(crowded, "part", "left_semi")


def graph_nodes(e: DataFrame) -> DataFrame:
    """node_id, type, name of the first mention, canonical name, evidence count, and the last non-empty module, unit and role."""
    own = ["ord", "evidence_id", "module", "ecu", "block_role"]
    made = _things(role_node(e)).select(*own, F.posexplode(_nodes()).alias("place", "n")).select(*own, "place", "n.*")
    last = lambda c: F.max(F.when(F.coalesce(c, F.lit("")) != "", F.struct("ord", c)))[c].alias(c)
    merged = made.groupBy("node_id").agg(F.min(F.struct("ord", "place", "node_type", "name")).alias("f"), F.countDistinct("evidence_id").alias("n_evidence"), last("module"), last("ecu"), last("block_role"))
    return merged.select("node_id", "f.node_type", "f.name", canonical(F.col("f.name")).alias("canonical_name"), "n_evidence", "module", "ecu", "block_role")


def edge_id(edge: Column) -> Column:
    """Id of an edge, given as its source, relation and target with NUL between them."""
    return F.concat(F.lit("Edge:"), F.substring(F.sha1(edge), 1, 20))


def graph_edges(e: DataFrame) -> DataFrame:
    """edge_id, source, relation, target and the number of evidence rows that state the edge.

    Most edges name a node of the row's own id: they are whole within the row and not shuffled. The rest are counted by
    aggregates that Spark combines before the shuffle.
    """
    one, many = _by_part(e)
    own, shared = _statements()
    n = F.when(F.col("evidence_id").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_evidence")
    single = _things(one).select(F.explode(own).alias("edge"), n)
    met = _things(many).select("evidence_id", F.explode(F.concat(own, shared)).alias("edge")).distinct().select("edge", n)
    counted = _things(one, shared=True).select(F.explode(shared).alias("edge"), n).unionByName(met).groupBy("edge").agg(F.sum("n_evidence").alias("n_evidence"))
    each = single.unionByName(counted).select("edge", "n_evidence", F.split("edge", "\0").alias("x"))
    return each.select(edge_id(F.col("edge")).alias("edge_id"), *[F.get("x", F.lit(i)).alias(k) for i, k in enumerate(("source", "relation", "target"))], "n_evidence")


def memberships(e: DataFrame) -> DataFrame:
    """graph_id, kind, evidence_id: which evidence rows mention a node or state an edge, as rows, so that no node holds an array of them."""
    one, many = _by_part(e)
    edges = F.transform(F.concat(*_statements()), lambda x: F.struct(edge_id(x).alias("graph_id"), F.lit("edge").alias("kind")))
    both = F.concat(F.transform(_node_ids(), lambda x: F.struct(x.alias("graph_id"), F.lit("node").alias("kind"))), edges)
    told = lambda rows: _things(rows).select(F.inline(both), "evidence_id").select("graph_id", "kind", "evidence_id")
    return told(one).unionByName(told(many).distinct())


def rendered(nodes: Column, relations: Column) -> Column:
    """A path as ``a --relation--> b --relation--> c``."""
    steps = F.transform(relations, lambda r, i: F.concat(F.lit("--"), r, F.lit("--> "), F.get(nodes, i + 1)))
    return F.array_join(F.concat(F.array(F.get(nodes, F.lit(0))), steps), " ")


def mentioned_paths(candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, evidence_id, path) of the node's graph paths that pass the candidate's role node."""
    ids = paths.select("node", "path", F.explode(F.array_distinct("nodes")).alias("role_id"))
    return candidates.select("node", "evidence_id", "role_id").join(ids, ["node", "role_id"]).select("node", "evidence_id", "path")
