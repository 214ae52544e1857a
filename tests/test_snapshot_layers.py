"""What a delta takes from the layers below is noted beside it, and sums go on from what a key had."""

from pyspark.sql import functions as F

from quarry.plans import knowledge_queries
from quarry.sources import snapshots as S


def test_added_columns_go_on_from_the_key_before(spark, tmp_path):
    root = str(tmp_path)
    S.write(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, n long"), root, "t", ["k"])
    S.apply(spark.createDataFrame([("b", 10), ("d", 4)], "k string, n int"), root, "t", added=("n",))
    S.apply(spark.createDataFrame([("a", 0, True), ("x", 0, True), ("d", 5, False)], "k string, n long, is_gone boolean"), root, "t")
    S.apply(spark.createDataFrame([("a", 7)], "k string, n long"), root, "t", added=("n",))
    want = [{"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 12, "c": 3, "d": 4}, {"b": 12, "c": 3, "d": 5}, {"a": 7, "b": 12, "c": 3, "d": 5}]
    for version, rows in enumerate(want, 1):
        got = S.read(spark, root, "t", version)
        noted = S.manifest(spark, root).filter(F.col("version") == version).first()
        assert {r["k"]: r["n"] for r in got.collect()} == rows and got.count() == len(rows)
        assert (noted["n_rows"], noted["total"], noted["parity"]) == tuple(S.content_hash(got).first())
    taken = [sorted(r["k"] for r in spark.read.parquet(f"{root}/t/taken{v}").collect()) for v in (2, 3, 4)]
    assert taken == [["b"], ["a", "d"], []]


def test_a_snapshot_is_read_without_a_shuffle(spark, tmp_path):
    """The delta is large, but few of its keys stood in the base."""
    spark.range(2000).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    made = knowledge_queries.graph_snapshot(spark, str(tmp_path))
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == knowledge_queries.knowledge_edges(spark, str(tmp_path)).count()


def test_every_order_is_in_a_layer(spark, tmp_path):
    rows = [(k, 1, "x") for k in (None, -4, -3, -2, -1, 0, 1, 2)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    edges = knowledge_queries.graph_snapshot(spark, str(tmp_path))
    whole = knowledge_queries.knowledge_edges(spark, str(tmp_path))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, whole.collect()))
    row = knowledge_queries.graph_snapshot_manifest(spark, str(tmp_path)).first()
    assert row["same_content"] and row["n_rows"] == whole.count()
