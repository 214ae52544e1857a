"""Training-data operators against plain Python on small fixtures with nulls, ties, repeats and extra columns."""

import collections
import hashlib
import itertools
import math
import re

import hypothesis
import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat, decontaminate, html_main, pieces, pii, quality, simhash_vp, suffix_dedup

from tests.llm.test_stages import _components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string"


@pytest.fixture(scope="module")
def odd(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", "a", passage, f"before {passage} after", passage, "x" * 300, "line one has five words\nline one has five words", "Mr. Smith met Mrs Jones; mail a.b@c.example.com or A.B@c.example.com, +1 (499) 555-6503", "ü" * 120]
    rows = [(i, t, "en", "s", 0, "clash", "clash") for i, t in enumerate(texts)] + [(None, passage, None, None, None, None, None)]
    return spark.createDataFrame(rows + rows[3:4], SCHEMA)


def _brute_removed(rows, length=100):
    seen, out = set(), {}
    for i, b in rows:
        mask = bytearray(len(b))
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            if k in seen:
                mask[s : s + length] = b"\x01" * length
            seen.add(k)
        out[i] = (len(b), sum(mask), hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [False, True])
def test_suffix_dedup(spark, odd, monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(suffix_dedup, "HEAVY_LOCAL", 0)
    docs = odd.select("doc_id", "text").distinct().filter("doc_id is not null").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text").limit(60))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == _brute_removed(sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()))
    assert suffix_dedup.remove_repeats(odd).count() == odd.count()


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\</s>[INST]"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, 0, "user", "hi"), (4, 0, "user", "hi"), (None, 0, None, "x\\")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in chat.digests(df).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x in turns:
        want[c].append((t, r or "", x or ""))
    assert got == {c: (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in sorted(ts)).encode()).hexdigest(), sum(len(x) for _, r, x in ts if r == "assistant")) for c, ts in want.items()}
    packed = chat.pack(chat.conversations(df)).filter("tokens like '%hi%'").count()
    assert packed <= 2 * 4
    for t in (*chat.CONTROL, "\\</s>", "\\\\[INST]\\", "<\\/s>", "<\\\\|im_end|>", "<<</s></s>>", "[[INST][/INST]]", "<<SYS>><</SYS>>"):
        for text in (t, f"a{t}b", t + t, t[:-1], t.replace("<", "<\\")):
            assert chat.unescape(chat.escape(text)) == text
            assert not any(c in chat.escape(text) for c in chat.CONTROL)


@hypothesis.given(st.lists(st.sampled_from([*"<>|/[]\\sINT", "</s>", "<|im_end|>", "[INST]"]), max_size=40).map("".join))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)


def test_pieces_match_the_model(spark, odd):
    v = pieces.Vocabulary.load(corpus_pipeline.PIECE_MODEL)
    m = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40))
    done = pieces.encode(docs.withColumnRenamed("doc_id", "k").selectExpr("k", "text", "text as source_text"), v)
    for r in done.collect():
        assert r["ids"] == m.encode(r["source_text"] or "") and r["round_trip"]
    assert pieces.decode(done, v).filter("not (text <=> coalesce(source_text, ''))").count() == 0


def test_unigram_lattice(spark):
    v = pieces.Vocabulary(("<unk>", "a", "b", "ab", "abc", "c", "bc"), (0.0, -2.5, -2.0, -3.0, -6.5, -1.0, -4.0), (), 0, False, frozenset({0}))
    s = pieces.Segmenter(v)
    units = ["abc", "aabbc", "xab", "c"]
    got = {r["unit"]: tuple(r["ids"]) for r in pieces.lattice_encode(spark.createDataFrame([(u,) for u in units], "unit string"), v).collect()}
    assert got == {u: s.unit(u) for u in units} and got["abc"] == (3, 5)


@pytest.mark.parametrize("part", [8_192, 16])
def test_simhash_components(spark, odd, monkeypatch, part):
    monkeypatch.setattr(simhash_vp, "PART", part)
    docs = odd.select("doc_id", "text").filter("doc_id is not null").distinct().unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text"))
    rows = sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash_vp.near_duplicates(docs).collect())
    fps = np.array([f for _, f, _ in rows], np.uint64)
    comp = list(range(len(rows)))
    for _ in rows:
        new = [min(comp[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)) for i in range(len(rows))]
        if new == comp:
            break
        comp = new
    assert [c for *_, c in rows] == [rows[c][0] for c in comp]


def test_html():
    page = '<nav>menu</nav><div class="ad">buy</div><article><h1>T &amp; t</h1><p>one<br>two <b>x</b><p>three<script>var a="</p>"</script></article><div id="comments"><p>nice</p></div><footer>f</footer>'
    assert html_main.main_text(page) == "T & t\n\none two x\n\nthree"
    assert html_main.main_text(None) == "" and html_main.main_text("<nav>never closed <p>x") == ""
    own = '<article><h2 class="search-results">Title</h2><div class="related-work"><p>body para</p></div><figure><img><figcaption>a caption</figcaption></figure><div class="ad-box">buy</div><div class="share">x</div><p>end</article>'
    assert html_main.main_text(own) == "Title\n\nbody para\n\na caption\n\nend"
    plain = "<body><div>" + "<p>" + "long text " * 30 + '</p><div class="ads">buy</div><p>short</p><div class="ads">buy</div><p>' + "more text " * 30 + "</p></div><footer>foot</footer></body>"
    assert html_main.main_text(plain).split("\n\n")[1] == "short" and "buy" not in html_main.main_text(plain) and "foot" not in html_main.main_text(plain)
    assert len(html_main.main_text("<p>" + "word " * 1_000_000)) == 4_999_999


def test_html_odd_rows(spark):
    rows = [(1, "u", "<article>a</article>", "old", 5), (1, "u", "<article>a</article>", "old", 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").withColumn("row", F.lit("x"))
    got = html_main.extract(df)
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["row"]) for r in got.collect()) == [(0, "", 0, "x"), (1, "a", 1, "x"), (1, "a", 1, "x")]
    assert html_main.extract(df.limit(0)).count() == 0


def test_decontamination(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
    changed = [w if i % 7 else "other" for i, w in enumerate(item)]
    docs = [(1, "so " + " ".join(item) + " end"), (2, " ".join(changed)), (3, " ".join(reversed(item))), (4, None), (5, "short one here"), (5, "short one here")]
    bench = [(10, " ".join(item)), (11, None), (12, "short one here")]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 10), (2, 10), (5, 12)}


def _leak_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _leaks(doc, item, window=13):
    """Whether some window of the item agrees with the document at 8 of 10 positions, over all diagonals."""
    n, w = len(item), min(window, len(item))
    if not w or len(doc) < w:
        return False
    ids = {x: i for i, x in enumerate(set(item))}
    d, it = np.array([ids.get(x, -1) for x in doc]), np.array([ids[x] for x in item])
    for diag in range(w - n, len(doc) - w + 1):
        lo, hi = max(0, -diag), min(n, len(doc) - diag)
        run = np.concatenate([[0], np.cumsum(d[diag + lo : diag + hi] == it[lo:hi])])
        if hi - lo >= w and 10 * (run[w:] - run[:-w]).max() >= 8 * w:
            return True
    return False


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 11, 12, 13, 20])
def test_every_allowed_substitution_is_found(spark, n):
    item = [f"w{i}" for i in range(n)]
    bad = [b for k in range(n // 5 + 1) for b in itertools.combinations(range(n), k)]
    docs = [(j, " ".join("zz" if i in b else x for i, x in enumerate(item))) for j, b in enumerate(bad)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(None, " ".join(item))], "item_id long, text string"))
    want = {j for j, t in docs if _leaks(t.split(), item)}
    rows = found.collect()
    assert {r["doc_id"] for r in rows} == want and all(r["item_id"] is None for r in rows)
    assert n > 13 or len(want) == len(docs)


def _base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed


def test_quality(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text"))
    rows = quality.judge(docs, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert all(tuple(r[n] for n in names) == _base(r["text"]) for r in rows)
    assert len(rows) == docs.count() and not any(r["kept"] and r["base_failed"] for r in rows)


def _kept_by_quality(docs, trusted, buckets=1 << 18):
    """Verdict per document: base rules, then the mean weight of words and word pairs against the score that 98 % of the trusted reach."""
    cut = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs.items()}
    one = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed=seed)
    grams = {i: [h % buckets for h in [*map(one, ws), *(one(b, one(a)) for a, b in zip(ws, ws[1:]))]] for i, ws in cut.items()}
    raw, good = collections.Counter(), collections.Counter()
    for i, gs in grams.items():
        raw.update(gs)
        good.update(gs if i in trusted else ())
    share = sum(good.values()) / sum(raw.values())

    def weight(g):
        expected = raw[g] * share
        ratio = math.log((good[g] + 1) / (expected + 1))
        return round(ratio, 6) if abs(good[g] - expected) >= 6 * math.sqrt(expected + 1) and abs(ratio) >= 0.7 else 0.0

    score = {i: sum(map(weight, gs)) / len(gs) for i, gs in grams.items() if not _base(docs[i])[-1]}
    least = np.quantile([s for i, s in score.items() if i in trusted], 1 - 98 / 100)
    return {i for i, s in score.items() if s >= least}


def test_quality_against_plain_python(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    rows = quality.judge(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), labels).collect()
    assert {r["doc_id"] for r in rows if r["kept"]} == _kept_by_quality(docs, trusted)


def test_quality_odd_rows(spark, odd):
    """Clashing columns, no trusted rows, an empty table, and a very long text."""
    labels = spark.createDataFrame([(3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    clash = odd.withColumn("verdict", F.lit(1)).withColumn("score", F.lit("x"))
    rows = quality.judge(clash, labels).collect()
    assert len(rows) == odd.count() and all(r["verdict"] == 1 and r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality.judge(odd.limit(0), labels).count() == 0
    long = spark.range(1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 1000000), x -> concat('w', x)), ' ') as text")
    assert quality.judge(long, labels).select("n_words", "n_repeat_words", "kept").first() == (1_000_000, 0, True)


def test_pipeline(spark):
    """run() against plain Python: which documents each stage keeps; ids are the model's, and differ from the input's just where data were replaced."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1 and r["toxic"] == 0}
    bench = [_leak_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = sorted(_kept_by_quality(docs, trusted))
    comp = _components([docs[i] for i in left])
    left = [i for k, i in enumerate(left) if comp[k] == k]
    left = [i for i in left if not any(_leaks(_leak_words(docs[i]), b) for b in bench)]
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(rows) == left and 0 < len(left) < len(docs)
    m = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    free = {r["doc_id"] for r in pii.replace(spark.createDataFrame([(i, docs[i]) for i in left], "doc_id long, text string"), "k").filter("size(entities) = 0").collect()}
    assert free and all(rows[i]["round_trip"] for i in left)
    assert all((rows[i]["ids"] == m.encode(docs[i])) == (i in free) for i in left)
