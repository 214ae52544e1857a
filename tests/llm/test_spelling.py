"""Spelling variants against brute force over all pairs, on tries cut into small shards and blocks."""

import random
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import queries, spelling


def _near(a, b):
    """Whether the Levenshtein distance is exactly one."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _brute(count, ratio=10):
    out = {}
    for w, n in count.items():
        near = sorted((-m, v) for v, m in count.items() if _near(w, v))
        form = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = [form, n, len(near), count[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def _vocabulary():
    rng = random.Random(11)
    count = {"aaaaaaa": 3, "aaaaaaaa": 30, "aaaaaaaaa": 300, "aaaaaaaaaa": 3000, "a" * 40: 2, "ÿÿÿÿÿÿÿ": 4, "ÿÿÿÿÿÿ": 40}
    for _ in range(60):
        base = "".join(rng.choices("abcé", k=rng.randint(2, 9)))
        count[base] = rng.choice([20, 200, 2000])
        for _ in range(6):
            p, w = rng.randrange(len(base)), base
            w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcé") + w[p:], w[:p] + rng.choice("abcé") + w[p + 1 :]])
            if w:
                count.setdefault(w, rng.choice([2, 3, 20]))
    return count


@pytest.mark.parametrize(("shard", "block"), [(1000, 1 << 20), (17, 3000), (1, 1)])
def test_against_all_pairs(spark, shard, block):
    count = _vocabulary()
    if shard == 1:
        count = dict(list(count.items())[:25])
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(words, shard=shard, block_bytes=block).collect()}
    assert got == _brute(count)
    assert any(root not in (w, form) for w, (form, root, *_) in got.items())


def _count(rows, slip=31):
    found = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            found[w[: h % len(w)] + w[h % len(w) + 1 :] if h % slip == 0 else w] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def test_the_query_on_its_table(spark):
    """All words of the smallest table; neighbours by the words that are left when one letter is deleted."""
    sf = "/root/testdata/sf0.001"
    count = _count((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    holes = {}
    for w in count:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(k, set()).add(w)
    got = {r["word"]: r for r in queries.op11_spelling_variants(spark, sf).collect()}
    assert {w: r["n"] for w, r in got.items()} == count
    for w, r in got.items():
        near = {v for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in holes[k] if _near(v, w)}
        best = min(((-count[v], v) for v in near), default=(0, ""))
        assert (r["n_near"], r["form"], r["form_n"]) == ((len(near), best[1], -best[0]) if -best[0] >= 10 * count[w] else (len(near), None, None))
        root = w
        while got[root]["form"]:
            root = got[root]["form"]
        assert r["root"] == root


def test_odd_rows(spark):
    rows = [(1, "Straße STRASSE straße"), (None, "ÀÉÎÕÜÿ× àéîõüÿ×"), (None, "ÀÉÎÕÜÿ×"), (3, None), (3, ""), (3, "x" * 300_000 + " " + "x" * 300_000 + " short"), (4, "abcdefg" * 3), (4, "abcdefg" * 3)]
    docs = spark.createDataFrame([(*r, "w", 9) for r in rows], "doc_id long, text string, word string, n int")
    got = spelling.group_variants(spelling.count_words(docs, slip=31))
    want = _count(rows)
    assert {r["word"]: r["n"] for r in got.collect()} == want and any(len(w) > 200_000 for w in want)
    assert spelling.group_variants(spelling.count_words(docs.limit(0))).collect() == []
    plain = {r["word"]: r["n"] for r in spelling.count_words(docs).collect()}
    assert plain == {"x" * 300_000: 2, "abcdefg" * 3: 2, "ÀÉÎÕÜÿ×": 2}
