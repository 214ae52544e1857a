"""Approximate index and vector records: odd vectors, stored cells, hashed embeddings and document names on literal rows."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.operators import vector_index as V
from quarry.plans import catalogue, vector_queries


def test_recall_on_the_table(spark):
    """At least 0.9 of the exact neighbours, every row indexed."""
    for sf in ("sf0.01", "sf0.1"):
        (row,) = vector_queries.approximate_recall(spark, f"/root/testdata/{sf}").collect()
        assert row["recall"] >= 0.9, (sf, row)


def test_odd_vectors(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], i % 4) for i in range(50)] + [(50, None, 0), (51, [0.0, 0.0, 0.0], 1), (52, [1.0], 2), (53, [], 3), (54, [2.0], 2)]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")
    V.build(vectors, str(tmp_path / "index"))
    cells = spark.read.parquet(str(tmp_path / "index" / "cells"))
    assert cells.count() == len(rows) and {r["vec_id"] for r in cells.filter("cell = -1").collect()} == {50, 52, 53, 54}
    queries = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0, 0.0])], "query_id int, q array<double>")
    got = V.search(spark, str(tmp_path / "index"), queries, 3, 1.0).collect()
    want = retrieval.vector_search(vectors, queries, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["vec_id"] for r in got if r["query_id"] == 2} == {52, 54}
    V.build(vectors.limit(0), str(tmp_path / "empty"))
    assert V.search(spark, str(tmp_path / "empty"), queries, 3, 1.0).collect() == []


def test_overfetch_bounds_what_filters_see(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [1.0, i / 100], "even" if i % 2 == 0 else "odd") for i in range(40)], "vec_id int, embedding array<double>, side string")
    V.build(vectors, str(tmp_path))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>")
    far = V.search(spark, str(tmp_path), queries, 2, 1.0, overfetch=2, keep=F.col("vec_id") > 2).collect()
    assert [(r["rank"], r["vec_id"]) for r in far] == [(1, 3)]
    first = V.search(spark, str(tmp_path), queries, 2, 1.0, overfetch=5, source="side").collect()
    assert sorted((r["rank"], r["vec_id"], r["side"]) for r in first) == [(1, 0, "even"), (2, 1, "odd")]


@pytest.mark.parametrize("dimension", [4, 40])
def test_hashed_embeddings(spark, dimension):
    texts = ["Read the DTC the", "", None, "  ", "ünï código"]
    rows = V.embed(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", dimension).orderBy("i").collect()
    for text, r in zip(texts, rows):
        want = [0.0] * dimension
        for w in (text or "").lower().split():
            h = hashlib.sha256(w.encode()).hexdigest()
            want[int(h[:8], 16) % dimension] += -1 if int(h[9], 16) % 2 else 1
        if not any(want):
            h = hashlib.sha256((text or "").encode()).digest()
            want = [(h[k % 32] - 127.5) / 127.5 for k in range(dimension)]
        norm = math.sqrt(sum(x * x for x in want))
        assert r["embedding"] == pytest.approx([x / norm for x in want])


def test_document_names(spark):
    rows = [
        ("a_sem_1", "x/y/manual_content_list.json", "manual"), ("a_sem_1", "manual_middle.json", "manual"), ("a_sem_1", "/deep/v1.2.notes.md", "v1.2.notes"), ("a_sem_1", "folder/.hidden", ".hidden"), ("b_text_9_table_1", None, "b"),
        ("c_d_table_1_text_2", "", "c_d_table_1"), ("plain_id_7", None, "plain"), ("single", "", "single"), ("a_image_1", "dir/", "dir"),
    ]
    got = spark.createDataFrame(rows, "id string, path string, want string").select("want", V.document_of(F.col("id"), F.col("path")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_records_with_absent_fields(spark):
    units = spark.createDataFrame([("md_e1", "section", " text ", None, ["10", "22"]), ("d_sem_2", "table", None, None, None)], "chunk_id string, unit_type string, content string, source_path string, service_ids array<string>")
    evidence = spark.createDataFrame([("e1", 7, "text", None, "body", "UDS")], "evidence_id string, doc_id int, evidence_type string, source_evidence_id string, content string, protocol string")
    got = {r["primary_id"]: r for r in V.records(units, evidence).collect()}
    assert (got["ku:md_e1"]["source_evidence_id"], got["ku:md_e1"]["content"]) == ("e1", "text \n10 22")
    assert (got["ku:d_sem_2"]["content"], got["ku:d_sem_2"]["doc_id"]) == ("", "d") and (got["ev:e1"]["content"], got["ev:e1"]["doc_id"]) == ("body\nUDS", "7")


def test_hashed_embeddings_query_follows_its_sql(spark, tmp_path):
    """Words that cancel leave no row, white space and capitals are SQL's, and ties are rounded as SQL rounds doubles."""
    at = lambda w: (int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 16, int(hashlib.sha256(w.encode()).hexdigest()[9], 16) % 2)
    words = [f"w{i}" for i in range(2000)]
    other = next(w for w in words if at(w) == (at("w0")[0], 1 - at("w0")[1]))
    places = {at(w)[0]: w for w in words}
    counts = [41, 638, 29, 5, 3]
    assert sum(n * n for n in counts) == 640 * 640
    tie = " ".join(" ".join([places[k]] * n) for k, n in enumerate(counts))
    rows = [(1, f"w0 {other}"), (2, "a b c\x0bd\x1fe"), (3, "\x0b"), (4, "ΣΑΣ İstanbul"), (5, tie), (6, None), (7, " \n"), (None, "text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(f"SELECT doc_id, position, value FROM ({catalogue.oracle_sql()['hashed_embeddings']})").fetchall()
    got = vector_queries.hashed_embeddings(spark, str(tmp_path)).select("doc_id", "position", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r[0] for r in want} == {2, 3, 4, 5}
