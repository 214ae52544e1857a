"""Snapshots: layers against plain dictionaries, hashes by row order, and typed paths on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph_paths as P
from quarry.sources import snapshots as S


def test_layers_against_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    root, schema = str(tmp_path), "k int, part string, v string"
    state = {(i, "a"): f"v{i}" for i in range(50)} | {(1, "b"): None}
    S.write(spark.createDataFrame([(*k, v) for k, v in state.items()], schema), root, "t", ["k", "part"])
    states = [dict(state)]
    for step in range(3):
        change = {(rng.randrange(70), "a"): (f"s{step}", rng.random() < 0.3) for _ in range(20)}
        S.apply(spark.createDataFrame([(*k, v, gone) for k, (v, gone) in change.items()], schema + ", is_gone boolean"), root, "t")
        for k, (v, gone) in change.items():
            state.pop(k, None) if gone else state.update({k: v})
        states.append(dict(state))
    for version, want in enumerate(states, 1):
        got = S.read(spark, root, "t", version)
        assert {(r["k"], r["part"]): r["v"] for r in got.collect()} == want
        noted = S.manifest(spark, root).filter(F.col("version") == version).first()
        whole = S.content_hash(spark.createDataFrame([(v, *k) for k, v in sorted(want.items(), reverse=True)], "v string, k int, part string").repartition(3)).first()
        assert (noted["n_rows"], noted["total"], noted["parity"]) == tuple(whole)
    S.write(S.read(spark, root, "t"), root, "t", ["k", "part"], version=5)
    assert S.read(spark, root, "t").count() == len(state) and S.read(spark, root, "t", 1).count() == 51
    with pytest.raises(ValueError):
        S.read(spark, root, "other")


def _all_paths(edges, source, target, allowed, depth):
    out, todo = [], [([source], [])]
    while todo:
        nodes, rels = todo.pop()
        if nodes[-1] == target and rels:
            out.append((len(rels), nodes, rels))
            continue
        if len(rels) < depth:
            todo += [([*nodes, t], [*rels, r]) for s, r, t in edges if s == nodes[-1] and t not in nodes and (not allowed or r in allowed)]
    return sorted(out)


def test_typed_paths_against_a_walk(spark):
    rng = random.Random(6)
    edges = sorted({(f"n{rng.randrange(12)}", rng.choice("abc"), f"n{rng.randrange(12)}") for _ in range(45)})
    asks = [(i, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice([[], ["a"], ["a", "b"]]), rng.randint(1, 5)) for i in range(40)]
    got = P.typed_paths(spark.createDataFrame([*edges, *edges[:5]], "source string, relation string, target string"), spark.createDataFrame(asks, "ask int, source string, target string, allowed array<string>, max_depth int"), 4)
    found = {}
    for r in got.orderBy("ask", "nth").collect():
        found.setdefault(r["ask"], []).append((r["depth"], r["nodes"], r["relations"]))
    assert found == {i: w[:4] for i, s, t, a, n in asks if s != t and (w := _all_paths(edges, s, t, a, n))}
    assert P.typed_paths(spark.createDataFrame([], "source string, relation string, target string"), spark.createDataFrame([], "ask int, source string, target string, allowed array<string>, max_depth int"), 4).collect() == []


def test_targets_and_attached_paths(spark):
    bundles = spark.createDataFrame([("a", "T 1"), ("b", "")], "node string, template string")
    items = spark.createDataFrame([("a", 0, "TableRow:e1", [("Flowchart title", "DTC Read"), ("DID", "F190")]), ("a", 1, "TableRow:e1", [])], "node string, item int, role_id string, fields array<struct<header:string,cell:string>>")
    targets = P.path_targets(bundles, items)
    got = [(r["ord"], r["target"], r["max_depth"]) for r in targets.orderBy("ord").collect()]
    assert got == [(1, "TemplateClass:T_1", 1), (2, "XmlTemplate:T_1", 2), (3, "TableRow:e1", 1), (4, "FlowchartTitle:DTC_Read", 2), (5, "ParameterField:DID=F190", 2)]
    edges = spark.createDataFrame([("t:a", "uses_template", "TemplateClass:T_1"), ("TemplateClass:T_1", "backed_by_xml_template", "XmlTemplate:T_1"), ("t:a", "uses_template", "x"), ("x", "uses_template", "XmlTemplate:T_1"), ("t:a", "supported_by", "TableRow:e1"), ("TableRow:e1", "has_field", "ParameterField:DID=F190"), ("t:a", "next_step", "t:b"), ("t:a", "next_step", "t:c"), ("t:a", "next_step", "t:d")], "source string, relation string, target string")
    starts = spark.createDataFrame([("a", "t:a"), ("b", "t:b")], "node string, source string")
    own = spark.createDataFrame([("a", 1, "own"), ("a", 2, "own")], "node string, ord int, path string")
    paths = [r["path"] for r in P.attached(edges, starts, targets, own, 6, 2).filter("node = 'a'").orderBy("nth").collect()]
    assert paths == ["own", "t:a --next_step--> t:b", "t:a --next_step--> t:c", "t:a --uses_template--> TemplateClass:T_1", "t:a --uses_template--> TemplateClass:T_1 --backed_by_xml_template--> XmlTemplate:T_1", "t:a --uses_template--> x --uses_template--> XmlTemplate:T_1"]


def test_targets_that_many_share_are_walked_from_once(spark, monkeypatch):
    """Forty asks for one hub: the backward halves are those of the hub, not forty times as many."""
    edges = [(f"m{i}", "r", "hub") for i in range(5)] + [(f"p{i}", "r", f"m{i % 5}") for i in range(20)] + [(f"o{i}", "r", f"p{i}") for i in range(20)] + [(f"s{i}", "r", f"o{i % 20}") for i in range(40)]
    held, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, label: (lambda out: (held.append((label, out.count())), out)[1])(write(df, label)))
    asks = [(i, f"s{i}", "hub", [["r"], []][i % 2], 4) for i in range(40)]
    got = P.typed_paths(spark.createDataFrame(edges, "source string, relation string, target string"), spark.createDataFrame(asks, "ask int, source string, target string, allowed array<string>, max_depth int"), 3)
    assert sorted((r["ask"], r["depth"], r["nodes"][1]) for r in got.collect()) == [(i, 4, f"o{i % 20}") for i in range(40)]
    assert [n for label, n in held if label == "graph-halves"] == [40, 40, 2 * 5, 2 * 20]
