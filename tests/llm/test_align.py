"""Alignment against a version that compares all byte ranges of a document, with the libraries' own encoders."""

import hashlib
from collections import Counter

import pytest

from quarry.llm import align, queries


@pytest.fixture(scope="module")
def tokenizers():
    return align.Tokenizers.load(queries.BYTE_MODEL, queries.PIECE_MODEL)


def _brute(rows):
    """doc_id to results; A by the tokenizers library, links by comparing ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(queries.BYTE_MODEL)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    letters = align.byte_letters()
    out, links, total = {}, {}, Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        a = [(x, bytes(letters[c] for c in a_tok.id_to_token(x))) for x in a_tok.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(x, bytes([int(p[3:5], 16)]) if b_tok.is_byte(x) else p.replace("▁", " ").encode()) for x in b_tok.encode(text or "") for p in [b_tok.id_to_piece(x)]]
        if not text or b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            out[i] = (0, 0, 0, 0, "")
            links[i] = []
            continue
        spans = []
        for side in (a, b):
            at, found = 0, []
            for x, t in side:
                found.append((at, at + len(t), x))
                at += len(t)
            spans.append(found)
        links[i] = [(y, x) for s, e, x in spans[0] for u, v, y in spans[1] if s < v and u < e]
        total.update(links[i])
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        texts, low = [], 0
        for cut in cuts:
            texts.append("|".join(",".join(str(x) for s, e, x in side if low < e <= cut) for side in spans))
            low = cut
        out[i] = (len(a), len(b), len(cuts), len(links[i]), hashlib.sha256(";".join(texts).encode()).hexdigest())
    best = {}
    for (y, _), n in total.items():
        best[y] = max(best.get(y, 0), n)
    return {i: (*out[i], sum(total[p] == best[p[0]] for p in links[i]), sum(total[p] for p in links[i])) for i, _ in rows}, total, best


NAMES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
ODD = [
    (-1, None), (-2, ""), (-3, " "), (-4, "<|endoftext|> and </s> <s> <unk>"), (-5, "lower▁mark"), (-6, "\n\t two\r\n lines \x00 zero"), (-7, "日本語と한국어 🙂🙃 ðéñ"), (-8, "  spaces   "),
    (-9, "the the the the"), (-10, "the the the the"), (-11, "<0x41> &amp; <0x0A>"), (-12, "é ‍ ﻿ ﬁ"),
]


def _results(df):
    return {r["doc_id"]: tuple(r[c] for c in NAMES) for r in df.collect()}


@pytest.mark.parametrize(("stripes", "chunk", "block"), [(256, 1 << 22, 2000), (3, 3000, 2)])
def test_against_all_ranges(spark, tokenizers, stripes, chunk, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 2500)[:60] + ODD
    got = align.alignments(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizers, stripes, chunk, block)
    assert _results(got) == _brute(rows)[0]


def test_pair_counts(spark, tokenizers):
    rows = [(i, t) for i, t in enumerate(["some words are cut otherwise", "words otherwise cut", "tokenizers aligned across vocabularies"] * 2)]
    _, total, best = _brute(rows)
    codes = align.Codes(50256, 32000, 7)
    chunks = align.encoded(spark.createDataFrame(rows, "doc_id long, text string"), tokenizers, codes)
    got = align.pair_counts(align.stripes(chunks, codes), codes).collect()
    assert {(r["b"], r["a"]): (r["n"], r["best"]) for r in got} == {p: (n, n == best[p[0]]) for p, n in total.items()}


def test_odd_tables(spark, tokenizers):
    docs = spark.createDataFrame([(None, "a text", 1), (1, "a text", 2), (1, "a text", 2)], "doc_id long, text string, n_a int")
    got = align.alignments(docs, tokenizers)
    assert sorted((r["doc_id"] or 0, r["n_a"], r["n_links"], r["n_best"], r["count_sum"]) for r in got.collect()) == [(i, 2, 2, 2, 6) for i in (0, 1, 1)]
    assert align.alignments(docs.limit(0), tokenizers).collect() == []


def test_a_very_long_text(spark, tokenizers):
    text = "a long text of words, " * 100_000 + "x" * 100_000
    (r,) = align.alignments(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizers).collect()
    assert r["n_a"] > 600_000 and r["n_groups"] <= min(r["n_a"], r["n_b"]) and r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]
