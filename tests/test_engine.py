"""Engine queries against DuckDB, and semantic cases with literal rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import reporting, retrieval
from quarry.plans import argument_queries, candidate_queries, catalogue, evidence_build, family_queries, knowledge_queries, lookup_queries, measure_queries, workflows  # noqa: F401  these add their queries to the catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def _norm(v):
    return (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert cols == sorted(want.columns)
    rows = lambda it: sorted(str(tuple(map(_norm, r))) for r in it)
    assert rows(df.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_tokens_strip_hex_prefix(spark):
    row = spark.createDataFrame([("Change VMM 0xD134 2f",)], "s string").select(T.tokens(F.col("s")).alias("t")).first()
    assert row["t"] == ["change", "vmm", "d134", "2f"]


def test_repeated_query_term_counts_twice(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma gamma")], "doc_id int, text string")
    one = retrieval.bm25(docs, spark.createDataFrame([(1, "alpha")], "query_id int, query string"), 5).first()["score"]
    two = retrieval.bm25(docs, spark.createDataFrame([(1, "alpha alpha")], "query_id int, query string"), 5).first()["score"]
    assert abs(two - 2 * one) < 2e-6


def test_budget_skips_and_goes_on(spark):
    items = [("a", 5.0, 400), ("b", 4.0, 500), ("c", 3.0, 40), ("d", 2.0, 400), ("e", 1.0, 20)]
    df = spark.createDataFrame([(1, i, s, "x" * n) for i, s, n in items], "g int, id string, score double, text string")
    row = reporting.token_budget(df, "g", 120).first()
    assert (row["kept"], row["used_tokens"]) == ("a,c,e", 115)
