"""Semantic cases of the evidence, argument, graph and measure operators, with literal rows."""

from pyspark.sql import functions as F

from quarry.operators import arguments, audit, blocks, candidates, filters, graph, knowledge, lookups, measures
from quarry.sources import readers

BLOCK = "doc_id string, ord int, type string, page int, bbox array<int>, text string, caption array<string>, footnote array<string>, body string, img_path string"


def _block(ord_, type_, text="", page=0, bbox=(), caption=(), body=None, img=""):
    return ("d", ord_, type_, page, list(bbox), text, list(caption), [], body, img)


def test_chunks_keep_order_and_parents(spark):
    table = "<table><tr><td>Name</td><td>DID</td></tr><tr><td>Speed</td><td>F190</td></tr><tr><td></td><td></td></tr><tr><td>Heat</td></tr></table>"
    rows = [
        _block(1, "text", "one", bbox=(0, 0, 10, 10)), _block(2, "text", "two", bbox=(5, 12, 20, 20)), _block(3, "text", "far below", bbox=(0, 90, 10, 99)), _block(4, "text", " "), _block(5, "table", body=table),
        _block(6, "text", "1.2 Heading", page=1), _block(7, "equation", "a=b", page=1), _block(8, "image", img="flow.png", page=1),
    ]
    got = {r["chunk_id"]: r for r in blocks.semantic_chunks(spark.createDataFrame(rows, BLOCK)).collect()}
    assert {k: (r["chunk_type"], r["content"]) for k, r in got.items()} == {
        "d_sem_0001": ("paragraph", "one two"), "d_sem_0002": ("paragraph", "far below"), "d_sem_0003": ("table", "Name DID Speed F190 Heat"), "d_sem_0003_tbl_1_1": ("table_row", "NAME: Speed DID: F190"),
        "d_sem_0003_tbl_1_2": ("table_row", "NAME: Heat"), "d_sem_0006": ("paragraph", "1.2 Heading"), "d_sem_0007": ("equation", "a=b"), "d_sem_0008": ("flowchart", "flow.png"),
    }
    assert got["d_sem_0001"]["bbox"] == [0, 0, 20, 20] and got["d_sem_0001"]["source_block_ids"] == ["d_block_0001", "d_block_0002"]
    assert got["d_sem_0003_tbl_1_2"]["parent_chunk_id"] == "d_sem_0003" and got["d_sem_0006"]["section_title"] == "1.2 Heading"


def test_empty_blocks(spark):
    none = spark.createDataFrame([], BLOCK)
    assert blocks.semantic_chunks(none).count() == blocks.knowledge_units(none).count() == blocks.evidence_units(none).count() == 0


def test_parents_take_the_first_variant(spark):
    rows = spark.createDataFrame([("a", "md_p"), ("b", "q"), ("c", ""), ("d", "gone")], "evidence_id string, parent_evidence_id string")
    known = spark.createDataFrame([("p",), ("md_p",), ("md_q",)], "evidence_id string")
    assert {r["evidence_id"]: r["parent_id"] for r in lookups.parents(rows, known).collect()} == {"a": "md_p", "b": "md_q"}


def test_request_parameters(spark):
    cases = [("na", "x", "NA"), ("7f", "x", "0x7F"), ("0x01: normal; 0x0b: Active", "usage_mode_change", "0x0B"), ("0x01: normal; 0x0b: Active", "other", "0x01"), ("free text", "x", "free text")]
    df = spark.createDataFrame(cases, "v string, node string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", arguments.request_parameter(F.col("v"), F.col("node"), F.lit("")).alias("got")).collect())


def test_units(spark):
    df = spark.createDataFrame([("BCM_x", "y", "BCM"), ("x", "tcam2_y", "TCAM2"), ("GEEA30_BCM", "z", "")], "n string, t string, want string")
    assert all(r["u"] == r["want"] for r in df.select("want", arguments.unit_of(F.col("n"), F.col("t")).alias("u")).collect())
    fits = spark.createDataFrame([("BCM2", "BCM", True), ("rear-BCM", "BCM", True), ("ECM", "BCM", False)], "v string, o string, want boolean")
    assert all(r["f"] == r["want"] for r in fits.select("want", arguments.unit_fits(F.col("v"), F.col("o")).alias("f")).collect())


def test_filters_ignore_case_and_prefix(spark):
    units = spark.createDataFrame([("src1_1", "d1", "UDS", ["0xF190"]), ("src10_2", "d2", "uds", ["f190"]), ("src1_3", "d3", "CAN", ["F190"]), ("src1_4", "d4", "UDS", None)], "chunk_id string, doc_id string, protocol string, dids array<string>")
    found = units.filter(filters.RetrievalFilters(doc_ids=("src1",), protocol="uds", dids=("F190",)).condition())
    assert [r["doc_id"] for r in found.collect()] == ["d1"]


def test_paths_stop_where_a_start_has_enough(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "c"), ("b", "r", "d"), ("c", "x", "d"), ("d", "r", "a")], "source string, relation string, target string")
    starts = spark.createDataFrame([("a",)], "node string")
    rows = lambda **k: [r["path"] for r in graph.paths(edges, starts, 3, **k).orderBy("depth", "path").collect()]
    assert rows(max_paths=2) == ["a > b", "a > c"] and rows(max_paths=9) == ["a > b", "a > c", "a > b > d", "a > c > d"]
    assert rows(max_paths=9, relations=["r"]) == ["a > b", "a > c", "a > b > d"] and rows(max_paths=9, target="d") == ["a > b > d", "a > c > d"]


def test_graph_names(spark):
    df = spark.createDataFrame([(" a//b  c ", "IMMO Type21 0xF1"), ("", "x"), ("_" * 5 + "k" * 200, "")], "v string, n string")
    rows = df.select(knowledge.fragment(F.col("v")).alias("f"), knowledge.canonical(F.col("n")).alias("c")).collect()
    assert [r["f"] for r in rows] == ["a_b_c", "value", "k" * 140] and rows[0]["c"] == "immobilizer type21 type 21 f1 f 1"


def test_quantiles_from_counts(spark):
    values = [1.0] * 7 + [2.0, 5.0, 9.0]
    counts = measures.value_counts(spark.createDataFrame([(1, v) for v in values] + [(1, None)], "g int, v double"), ["g"], "v")
    linear = measures.linear_quantiles(counts, ["g"], {"p50": 0.5, "p75": 0.75, "p95": 0.95}).first()
    assert (linear["p50"], linear["p75"], linear["p95"]) == (1.0, 1.75, 7.2)
    ranked = measures.ranked_quantiles(counts, ["g"], {"p50": 0.5, "p90": 0.9, "p99": 0.99}).first()
    assert (ranked["p50"], ranked["p90"], ranked["p99"]) == (1.0, 5.0, 9.0)


def test_references_and_titles(spark):
    text = "Details can refer to the file EOL process. See also: refers to the moon; IO  Control Type 21 (x)"
    row = spark.createDataFrame([(text,)], "t string").select(candidates.references(F.col("t")).alias("r"), candidates.flowchart_title(F.col("t")).alias("f")).first()
    assert row["r"] == ["EOL process"] and row["f"] == "IO Control Type21 (x)"


def test_missing_nodes_and_metrics(spark):
    side = lambda *ns: spark.createDataFrame([(n,) for n in ns], "node string")
    got = {r["node"]: r["status"] for r in audit.missing_nodes(side("a", "b", "c", "d"), side("a", "b"), side("a", "c")).collect()}
    assert got == {"b": "node_missing_in_fused", "c": "node_missing_in_base", "d": "node_missing_in_fused"}
    lines = ["# x", "a 1", "a{k=\"" + "v" * 121 + "\"} 5", "a{k=\"v\",m=\"w\"} 2.5", "b_bucket 3", "b{le=\"1\"} 4", "c +Inf", "bad"]
    rows = {r["name"]: r["value"] for r in readers.parse_prometheus(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert rows == {"a": 3.5, "c": float("inf")}
