"""Sources that several parts of an operator read are computed once: a counter in a column sees each row once."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import fusion, regression, retrieval, tables
from quarry.plans import vector_queries
from quarry.operators import xml_nodes as X


def _counted(spark, df, column):
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(look, df.schema[column].dataType).asNondeterministic()(column)), seen


def test_bm25_cuts_each_text_once(spark):
    docs, seen = _counted(spark, spark.createDataFrame([(1, "a b c"), (2, "c 0xAB d"), (3, None)], "doc_id int, text string"), "text")
    asked = spark.createDataFrame([(1, "0xab d"), (2, "zz")], "query_id int, query string")
    got = retrieval.bm25(docs, asked, 2, phrase_boost=5.0).collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, 2)] and got[0]["score"] > 5 and seen.value == 3


@pytest.mark.parametrize(("text", "services", "ids"), [("22 0x2E,2f é22 22_ 0x220", ["22", "2E", "2F"], []), ("DIDF190 didf191 Did1234 f190 0xF192 F1901", [], ["F190", "F191"]), (None, [], [])])
def test_identifiers_stand_alone(spark, text, services, ids):
    df = spark.createDataFrame([(text,)], "t string").select(T.service_ids(F.col("t")).alias("s"), T.data_ids(F.col("t")).alias("d"))
    (row,) = df.collect()
    assert row["s"] == services and row["d"] == ids
    # One scan of the text: no array of all its words.
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_vector_records_make_the_chunks_once(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "one line\nDID F190 0x22"), (2, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, chunks = [], vector_queries._chunks

    def counting(s, d):
        df, seen = _counted(s, chunks(s, d), "content")
        made.append(seen)
        return df

    monkeypatch.setattr(vector_queries, "_chunks", counting)
    n = len(vector_queries.vector_records(spark, str(tmp_path)).collect())
    assert n == 2 * made[0].value and len(made) == 1


def test_a_report_reads_the_metrics_once(spark):
    metrics, seen = _counted(spark, spark.createDataFrame([(1, "flow_steps", 2.0), (1, "serial_xml_valid", 1.0)], "workload int, metric string, value double"), "metric")
    expected = spark.createDataFrame([(1, "flow_steps", 2.0)], "workload int, name string, expected double")
    have = spark.createDataFrame([(1, n) for n in regression.REQUIRED], "workload int, name string")
    got = regression.report(metrics, expected, have).collect()
    assert len(got) == len(regression.REQUIRED) + 2 and all(r["passed"] for r in got) and seen.value == 2


def test_fusion_reads_the_nodes_once(spark):
    xml = '<SerialNode><Serials><ScriptNode Name="a" ClassName="C"><Args><Arg ArgName="x"> </Arg></Args></ScriptNode></Serials></SerialNode>'
    nodes, seen = _counted(spark, X.node_table(spark.createDataFrame([(1, xml)], "doc int, xml string")), "tag")
    plan = spark.createDataFrame([(1, 1, "s", 0, n, "C", "NORMAL", 0, 1, "false") for n in "ab"], "doc int, step int, step_key string, row int, node string, class string, script_type string, dead_ms int, retry_times int, interupt_start string")
    args = spark.createDataFrame([(1, "a", 1, "x", "v")], "doc int, node string, ord int, arg string, value string")
    fused, _, _ = fusion.fuse_workflow(nodes, plan, args, indent=False)
    (row,) = fused.collect()
    assert '<Arg ArgName="x">v</Arg>' in row["xml"] and 'Name="b"' in row["xml"] and seen.value == 5


def test_cells_of_tables_are_read_once(spark):
    rows = [("d", 0, 0, 0, ""), ("d", 0, 1, 0, "a  b"), ("d", 0, 1, 1, "c"), ("d", 0, 1, 2, ""), ("d", 0, 2, 0, "1"), ("d", 0, 2, 1, ""), ("d", 0, 2, 2, "x"), ("d", 0, 3, 1, "2"), (None, 0, 0, 0, "h"), (None, 0, 1, 0, "v")]
    cells, seen = _counted(spark, spark.createDataFrame(rows, 'doc string, table_index int, row int, column int, text string'), "text")
    got = {(r["doc"], r["row"]): [tuple(x) for x in r["fields"]] for r in tables.fields(cells).collect()}
    assert got == {("d", 2): [("A B", "1")], ("d", 3): [("C", "2")], (None, 1): [("H", "v")]} and seen.value == len(rows)
