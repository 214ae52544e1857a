"""Line dedup against a plain-Python version on fixtures with passages in mid-line, repeats, nulls and clashing names."""

import random
import re

import pytest

from quarry.llm import line_dedup

WORDS = [f"w{i}" for i in range(500)]


def _sentence_borders(text):
    """Character positions after each sentence."""
    cuts = [m.end() for m in re.finditer(r"[.!?][ \t-\r]+|\n|[。！？…]", text)]
    return sorted({0, *cuts, len(text)})


def _size(text):
    unspaced = re.findall("[฀-࿿ក-៿　-\udfff\U00020000-\U0002ffff]", text)
    return max(len(text.split()), -(-len(unspaced) // 4))


def _brute(rows, min_words):
    """(doc_id, text) to removed character positions: covered by a unit whose words also begin earlier."""
    seen, out = {}, {}
    found = []
    for key in sorted(set(rows)):
        text = key[1] or ""
        cuts = _sentence_borders(text)
        for i, s in enumerate(cuts[:-1]):
            if not text[s : cuts[i + 1]].split():
                continue
            stop = next((e for e in cuts[i + 1 :] if sum(_size(text[a:b]) for a, b in zip(cuts, cuts[1:]) if s <= a < e) >= min_words), None)
            if stop:
                unit = " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), text[s:stop]).split())
                found.append((key, s, stop, unit))
                seen.setdefault(unit, (key, s))
    for key, s, stop, unit in found:
        if seen[unit] != (key, s):
            out.setdefault(key, set()).update(range(s, stop))
    return out


def _documents(n=60):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choices(WORDS, k=rng.randint(1, 14))).capitalize() + rng.choice([". ", "! ", ".\n", "\n", ".  "])
    passages = ["".join(sentence() for _ in range(10)) for _ in range(3)]
    rows = []
    for i in range(n):
        body = [sentence() for _ in range(rng.randint(0, 20))]
        if i % 2:
            # The passage begins and ends inside a sentence.
            body.insert(rng.randint(0, len(body)), "so as said " + passages[i % 3] + "and then ")
        if i % 5 == 0:
            body.append("Licensed to all. Ask us.")
        rows.append((i, "".join(body)))
    return [*rows, (100, rows[1][1]), (101, None), (102, ""), (103, "三つの長い文章が続く。" * 12), (104, "あ三つの長い文章が続く。" + "三つの長い文章が続く。" * 11)]


@pytest.mark.parametrize("min_words", [1, 6, 20])
def test_against_plain_python(spark, min_words):
    rows = _documents()
    want = _brute(rows, min_words)
    assert want
    got = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", line_dedup.F.col("text")), min_words).collect()
    assert len(got) == len(rows)
    for r in got:
        gone = want.get((r["doc_id"], r["old"]), set())
        assert {p for s in r["removed"] for p in range(s["start"], s["end"])} == gone, r["doc_id"]
        assert (r["text"] or "") == "".join(c for p, c in enumerate(r["old"] or "") if p not in gone) and r["n_removed_chars"] == len(gone)
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


def test_passages_in_mid_line_are_found_and_footers_stay(spark):
    rows = _documents()
    got = {r["doc_id"]: r for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_removed_chars"] > 0 for i in range(7, 60, 2)) and all(not got[i]["removed"] for i in range(0, 60, 2))


def test_first_occurrences_stay(spark):
    """Removing repeats leaves every word of the corpus somewhere."""
    rows = _documents()[:-2]
    left = " ".join(r["text"] or "" for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect())
    assert set(" ".join(t or "" for _, t in rows).lower().split()) == set(left.lower().split())


def test_odd_rows(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    schema = "doc_id long, text string, row string, digest string, at long, removed string, hit_id int"
    rows = [(None, passage), (1, passage), (1, passage), (2, passage), (2, "alone " + passage), (3, None), (4, passage.upper() + "\n")]
    df = spark.createDataFrame([(*r, "row", "digest", 5, "removed", 6) for r in rows], schema)
    got = line_dedup.remove_repeats(df)
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["row"], r["digest"], r["at"], r["hit_id"]) for r in got.collect()) == sorted(
        (i, t, "row", "digest", 5, 6) for i, t in [(0, passage), (1, ""), (1, ""), (2, ""), (2, "alone " + passage), (3, ""), (4, "")]
    )
    assert line_dedup.remove_repeats(df.limit(0)).collect() == []


def test_a_very_long_text(spark):
    text = "".join(f"sentence number {i} of this text. " for i in range(200_000))
    got = line_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], len(r["text"])) for r in got) == [(1, len(text)), (2, 0)]
