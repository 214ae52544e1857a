"""Suffix-array dedup where one id has several texts, ids are strings or absent, and tables are empty or texts very long."""

import random

from quarry.llm import suffix_dedup


def _text(rng, n):
    return "".join(rng.choices("abcdefgh \n", k=n))


def _brute(rows, length=100):
    """Removed positions of each row; rows in order of (id, digest of the text)."""
    import hashlib

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], hashlib.sha256(rows[k][1].encode()).hexdigest()))
    seen, gone = {}, {}
    for k in order:
        raw = rows[k][1].encode()
        gone[k] = set()
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[k].update(range(i, i + length))
            else:
                seen[piece] = k
    return {k: (rows[k][0], len(rows[k][1].encode()), len(gone[k])) for k in gone}


def _got(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in df.collect())


def test_one_id_with_several_texts(spark):
    rng = random.Random(2)
    a, b, c = (_text(rng, 400) for _ in range(3))
    rows = [(1, a), (1, a[:200] + b), (2, b), (1, c + a[100:300]), (3, "short")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False)
    assert _got(got) == sorted(_brute(rows).values())
    assert all(n <= size for _, size, n in _got(got))


def test_string_ids(spark):
    rng = random.Random(3)
    a, b = _text(rng, 300), _text(rng, 300)
    rows = [("b", a + b), ("a", a), ("c", b)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"), with_text=False)
    assert _got(got) == sorted(_brute(rows).values())


def test_odd_rows(spark):
    rng = random.Random(4)
    a = _text(rng, 300)
    df = spark.createDataFrame([(None, a, 1), (1, a, 2), (2, None, 3), (3, "", 4), (4, a, 5)], "doc_id long, text string, n_bytes int")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], len(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(0, 300, 0, 300), (1, 300, 0, 300), (2, 0, 0, 0), (3, 0, 0, 0), (4, 300, 300, 0)]
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(5)
    long = _text(rng, 1_500_000)
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, long), (2, long[700_000:700_500] + "x")], "doc_id long, text string"), with_text=False)
    assert _got(got) == [(1, 1_500_000, 0), (2, 501, 500)]
