"""Exact dedup against plain Python: groups, ties, nulls, texts that share a digest, hot texts and clashing names."""

import hashlib
import random

import pytest

from quarry.llm import exact_dedup


def _brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(best[t or ""]), len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def _rows():
    rng = random.Random(5)
    texts = [f"text number {k} " * rng.randint(1, 5) for k in range(150)]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(1000 + i, "the hot one") for i in range(300)]
    return [*rows, (2000, None), (2001, ""), (2002, " "), (2003, "Case"), (2004, "case"), (None, "case"), (None, "an orphan"), (2005, "case "), (2006, "é"), (2007, "é")]


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_against_plain_python(spark, digest_bytes):
    """With digests of one byte, or none, different texts meet in every stage and are told apart by their content."""
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_dedup.mark(docs, digest_bytes=digest_bytes).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == _brute(rows)


def test_survivors(spark):
    rows = _rows()
    kept = exact_dedup.survivors(spark.createDataFrame([*rows, (1299, "the hot one")], "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for _, t in rows})
    assert [r["doc_id"] for r in kept.filter("text = 'the hot one'").collect()] == [1299]


def test_odd_tables(spark):
    schema = "doc_id string, text string, text_key int, text_rows string, kept string, keep_id int"
    rows = [("b", "same", 1, "x", "old", 7), ("a", "same", 2, "y", "old", 7), ("a", "same", 2, "y", "old", 7), (None, None, None, None, None, None)]
    got = exact_dedup.mark(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "text_key", "text_rows", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((str(r["doc_id"]), r["text_key"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()) == [("None", None, None, 1, True), ("a", 2, "b", 3, False), ("a", 2, "b", 3, False), ("b", 1, "b", 3, True)]
    assert exact_dedup.mark(spark.createDataFrame(rows, schema).limit(0)).collect() == []


def test_a_very_long_text(spark):
    text = "a very long text, " * 200_000
    got = exact_dedup.mark(spark.createDataFrame([(1, text), (2, text), (3, text[:-1])], "doc_id long, text string")).select("doc_id", "keep_id", "kept").collect()
    assert sorted(map(tuple, got)) == [(1, 2, False), (2, 2, True), (3, 3, True)]
