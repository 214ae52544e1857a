"""Fragments of ids against a plain form, and how often they are evaluated."""

import re

from pyspark.sql import functions as F

from quarry.operators import knowledge as K


def _plain(v, limit=K.FRAGMENT):
    s = re.sub("_+", "_", re.sub("[^0-9A-Za-z_.=-]+", "_", (v or "").strip(" "))).strip("_")
    return s[:limit].strip("_") or "value"


VALUES = [None, "", "_", "  ", "a b", "__a__b_ c", "-x=.", "_ _", "ü", "naïve\nline", "😀x😀", "x" * 139 + " y", "x" * 140 + " y", "a " * 90, " " * 200 + "z", "a_" * 80]


def test_fragments(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    made = rows.select("i", K.fragment(F.col("v")).alias("f"), K.fragment(F.col("v"), 100).alias("g"), K.shorter(K.fragment(F.col("v")), 100).alias("h"))
    for r in made.collect():
        assert (r["f"], r["g"], r["h"]) == (_plain(VALUES[r["i"]]), _plain(VALUES[r["i"]], 100), _plain(VALUES[r["i"]], 100)), VALUES[r["i"]]


def test_joined_fragments_are_cut_as_one(spark):
    rows = spark.createDataFrame([(a, b) for a in VALUES for b in VALUES], "a string, b string")
    made = K.shorter(F.concat(K.fragment(F.col("a")), F.lit("="), K.shorter(K.fragment(F.col("b")), 100)), K.FRAGMENT)
    for r in rows.select("a", "b", made.alias("f")).collect():
        assert r["f"] == _plain(f"{_plain(r['a'])}={_plain(r['b'], 100)}")


def test_a_fragment_within_a_fragment_is_evaluated_once(spark):
    plan = spark.range(1).select(K.fragment(K.fragment(F.concat(F.lit("a "), F.col("id").cast("string")))).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("cast(id") == 1


def _evidence(spark, ids):
    schema = "ord long, evidence_id string, doc_id string, evidence_type string, block_role string, content string, section_title string, parent_evidence_id string, ecu string, module string, img_path string, service_ids array<string>, fields array<struct<header:string,cell:string>>"
    rows = [(i, e, "d", "table" if i % 2 else "text", "table_row" if i % 3 == 0 else None, "c", "Type 1" if i % 5 == 0 else None, "p", "BCM", None, "", ["22", "22", " "], [("DID", "f190"), ("did ", "0xF190"), ("Flowchart title", "T"), (None, "x")]) for i, e in enumerate(ids)]
    return spark.createDataFrame(rows, schema)


def test_rows_that_share_an_id_or_its_fragment_count_as_one_node(spark):
    e = _evidence(spark, ["a b", "a_b", "a b", None, None, "ü", "c", "d", "e"])
    told = K.memberships(e)
    assert told.count() == told.distinct().count()
    want = {r["graph_id"]: r["n"] for r in told.filter("kind = 'edge'").groupBy("graph_id").agg(F.countDistinct("evidence_id").alias("n")).collect()}
    edges = {(r["source"], r["relation"], r["target"]): (r["edge_id"], r["n_evidence"]) for r in K.graph_edges(e).collect()}
    assert len(edges) == len(want) and dict(edges.values()) == want
    assert edges["Document:d", "document_for_ecu", "ECU:BCM"][1] == 6 and edges["ParameterField:DID=f190", "normalizes_to", "DID:0xF190"][1] == 6
    assert edges["Table:value", "backed_by_evidence", "Evidence:value"][1] == 1 and edges["Section:value", "backed_by_evidence", "Evidence:value"][1] == 0 and edges["Table:a_b", "has_field", "ParameterField:did=0xF190"][1] == 1
    assert edges["TableRow:value", "mentions_service", "Service:22"][1] == 0  # its only row has no id


def test_what_a_row_alone_says_is_not_shuffled(spark):
    e = _evidence(spark, [f"e{i}" for i in range(9)])
    for made in (K.memberships(e), K.graph_edges(e)):
        union, *lines = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
        first = lines[: next(i for i, x in enumerate(lines) if x.startswith("+- "))]
        # Rows that share their id with others are the second branch.
        assert union.startswith("Union") and "Aggregate" not in "".join(first) and "Aggregate" in "".join(lines)
