"""Block search against pair by pair scores."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import nearest, retrieval


def _pairs(vectors, queries, k, metric, source):
    met = vectors.join(queries, F.size("embedding") == F.size("q"))
    scored = met.withColumn("score", retrieval.similarity(F.col("embedding"), F.col("q"), metric))
    if source:
        w = Window.partitionBy("query_id", source).orderBy(F.desc("score"), "vec_id")
        scored = scored.withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    return retrieval.top_k(scored, k, id_col="vec_id").select("query_id", "rank", "vec_id", *([source] if source else []), "score")


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
@pytest.mark.parametrize("source", [None, "side"])
def test_blocks_equal_pairs(spark, monkeypatch, metric, source):
    """Ties, copies, zero, long, odd and missing vectors; blocks far smaller than the table."""
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).round(2).tolist(), f"s{i % 3}" if i % 7 else None) for i in range(600)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 1.0], f"s{i % 3}") for i in range(90)] + [(2000 + i, [1.0, 2.0, 0.0, 0.0, 1.0 + i * 1e-7], "near") for i in range(40)]
    rows += [(3000, [0.0] * 5, "zero"), (3001, [1.0], "short"), (3002, None, "none"), (3003, [], "empty"), (3004, [1e9, 0.0, 0.0, 0.0, 0.0], "far"), (3005, [float("nan"), 0.0, 0.0, 0.0, 0.0], "nan")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, side string")
    queries = vectors.filter("vec_id % 20 = 0 OR vec_id >= 3000 AND vec_id < 3005").selectExpr("vec_id AS query_id", "embedding AS q")
    got = retrieval.vector_search(vectors, queries, 4, metric, source=source)
    assert sorted(map(str, got.collect())) == sorted(map(str, _pairs(vectors, queries, 4, metric, source).collect()))


def test_halves_round_as_spark_does(spark):
    values = [0.1234565, 0.1234575, -0.1234565, 2.0000005, 1e-7, 0.0640625, float("inf")]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert nearest.rounded(np.array(values)).tolist() == want


def test_a_task_holds_no_table_of_pairs(spark):
    """No join of rows with queries is left, which had a row for every pair."""
    vectors = spark.range(300).selectExpr("id AS vec_id", "array(cast(id AS double), 1D) AS embedding")
    found = retrieval.vector_search(vectors, vectors.selectExpr("vec_id AS query_id", "embedding AS q"), 3)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
