"""Literal cases of the workflow, evidence, prompt and streaming operators: nulls, empty inputs, ties."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import audit, evidence, planning, prompts
from quarry.streaming.breaker import breaker

T0 = dt.datetime(2024, 1, 1)


def _at(s):
    return T0 + dt.timedelta(seconds=s)


def test_breaker_opens_refuses_and_closes_over_batches(spark, tmp_path):
    batches = [[("a", 0, False), ("a", 10, False), ("b", 5, None), ("a", 3, True)], [("a", 20, False), ("a", 25, True), ("b", 90, False), (None, 1, True)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(e, _at(s), ok) for e, s, ok in rows], "endpoint string, at timestamp, ok boolean")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    schema = "endpoint string, at timestamp, ok boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    q = breaker(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {(r["endpoint"], r["at"]): (r["consecutive"], r["open_until"], r["refused"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        ("a", _at(0)): (1, None, False),
        ("a", _at(3)): (0, None, False),
        ("a", _at(10)): (1, None, False),
        ("a", _at(20)): (2, _at(50), False),
        ("a", _at(25)): (0, None, True),
        ("b", _at(5)): (1, None, False),
        ("b", _at(90)): (2, _at(120), False),
    }


def test_decisions_follow_the_order_of_rules(spark):
    rows = [
        (1, "BCM", "ECM", "ecu_parameter", "t", "x", 5.0),
        (2, "BCM", "ECM", "eol_process", "t", "x", 5.0),
        (3, "BCM", "BCM2", "ecu_parameter", "see TCAM", "x", 5.0),
        (4, "BCM", "BCM2", "ecu_parameter", None, "bcm2 only", -1.0),
        (5, None, None, None, None, None, 5.0),
        (6, "BCM", "BCM", "eol_process", "Revision History", "x", 5.0),
    ]
    df = spark.createDataFrame(rows, "id int, target string, unit string, module string, title string, content string, score double")
    got = {r["id"]: (r["decision"], r["reason"], r["score"]) for r in evidence.decide(df).collect()}
    assert got[1][:2] == ("drop", "explicit_ecu_conflict")
    assert got[2] == ("keep", "public_process_keep", 5.0)
    assert got[3] == ("demote", "local_ecu_context_conflict", 0.0)
    assert got[4] == ("keep", "generic_keep", 0.0)
    assert got[5][:2] == ("drop", "noise") and got[6][:2] == ("drop", "noise")
    assert evidence.decide(df.limit(0)).count() == 0


def test_coverage_of_no_nodes_is_zero(spark):
    empty = spark.createDataFrame([], "node int, parameter_id int, flowchart_id int")
    assert tuple(evidence.coverage(empty).first()) == (0, 0.0, 0.0)


def test_sections_are_deduplicated_cut_and_rendered(spark):
    rows = [(1, "a", 9.0, " one  two "), (1, "b", 8.0, "one two"), (1, "a", 7.0, "other"), (1, "c", 6.0, None), (1, "d", 5.0, "y" * 400), (1, "e", 4.0, "late")]
    row = prompts.budget_sections(spark.createDataFrame(rows, "g int, label string, score double, text string"), "g", 20).first()
    assert (row["kept"], row["used_tokens"], row["n_dropped"]) == ("a,d", 20, 4)
    room = 4 * (20 - 2)
    assert row["context"] == "[a]\none  two\n\n[d]\n" + "y" * (room - len(prompts.CUT)) + prompts.CUT


def test_a_lone_node_is_normal(spark):
    out = planning.positions(spark.createDataFrame([("p", 1), ("q", 1), ("q", 2), ("q", 3)], "plan string, ord int"), "plan", ["ord"])
    assert [r["script_type"] for r in out.orderBy("plan", "ord").collect()] == ["NORMAL", "START", "NORMAL", "END"]


def test_unknown_statuses_and_absent_contracts_go_to_review(spark):
    a = spark.createDataFrame([("n", "x", "node_missing_in_base"), ("n", "x2", "plan_arg_missing_in_fused")], "node string, arg string, status string")
    none = spark.createDataFrame([], "class string, arg string, required boolean")
    got = audit.resolve(a, spark.createDataFrame([("n", "C")], "node string, class string"), none)
    assert {(r["arg"], r["action"], r["confidence"]) for r in got.collect()} == {("x", "needs_review", 0.0), ("x2", "needs_review", 0.2)}


def test_rendered_xml_parses(spark):
    import xml.etree.ElementTree as ET

    nodes = spark.createDataFrame([("p", 1, 1, 'n"&', "C", "NORMAL")], "plan string, step int, row int, node string, class string, script_type string")
    args = spark.createDataFrame([("p", 'n"&', 1, "A", "<1>")], "plan string, node string, position int, arg string, value string")
    root = ET.fromstring(planning.render(nodes, args).select(F.col("xml")).first()["xml"])
    assert root.find(".//ScriptNode").get("Name") == 'n"&' and root.find(".//Arg").text == "<1>"


def test_copies_of_titles_are_dealt_out(spark):
    """Sets of words are compared by class, and the many rows of one class come from many tasks."""
    from quarry.operators import lookups

    titles = spark.createDataFrame([(i, ["Red bolt", "bolt red red"][i % 2]) for i in range(20)] + [(20, ""), (21, None), (22, "red nut brass")], "title_id int, title string")
    images = spark.createDataFrame([(i, "a red BOLT") for i in range(30)] + [(30, "nut red"), (31, None)], "image_id int, name string")
    found = lookups.title_images(titles, images, 0.6)
    assert found.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    got = sorted(map(tuple, found.collect()))
    assert got == sorted([(t, i, 1.0) for t in range(20) for i in range(30)] + [(22, 30, 0.666667)])
