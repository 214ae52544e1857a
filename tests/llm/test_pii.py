"""PII surrogates: formats, coreference and distinctness against detection in plain Python."""

import collections
import re

import pytest
import regex
from pyspark.sql import functions as F

from quarry.llm import pii

ANY = regex.compile(pii.ANY)
NAMED = regex.compile(rf"(?:{pii._NAMED})")


def _replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.replace(df, "k").orderBy("doc_id").collect()]


def _luhn(digits):
    ds = [int(c) for c in digits][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(ds)) % 10 == 0


def _iban(value):
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _entities(value):
    """(type, normal form) of the entities that a mention names, or None where the type needs no check here."""
    if m := NAMED.fullmatch(value):
        given, last = m[2] or m[6], m[4] or m[8]
        return [(kind, part.lower()) for kind, part in (("given", given), ("surname", last)) if part]
    if "@" in value:
        return [("email", value.lower())]
    return [("other", value)]


def test_every_mention_of_the_documents(spark):
    """Texts change at the mentions only; one entity has one surrogate, two have two, and none is an original."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000, "Mr. Smith, Dr. Smith, Mr John Smith, Mrs Jane Smith-Doe; a.b@c.example.com A.B@c.example.com")], docs.schema)
    docs = docs.unionByName(extra)
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    stand_in, back, n = {}, {}, 0
    for r in pii.replace(docs, "k").collect():
        found = list(ANY.finditer(old[r["doc_id"]]))
        assert len(found) == len(r["entities"])
        at, out = 0, []
        for m, e in zip(found, r["entities"]):
            out += [old[r["doc_id"]][at : m.start()], e["surrogate"]]
            at, n = m.end(), n + 1
            for (kind, normal), (_, new) in zip(_entities(m[0]), _entities(e["surrogate"]), strict=True):
                assert stand_in.setdefault((kind, normal), new) == new and back.setdefault((kind, new), normal) == normal
        assert "".join([*out, old[r["doc_id"]][at:]]) == r["text"]
    assert n > 10 and not {k for k in stand_in} & {(k, v) for (k, _), v in stand_in.items() if k != "other"}


def test_formats(spark):
    texts = ["DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "4111 1111 1111 1111", "+1 (499) 555-6503, 499-555-6503, 499.555.6503", "password=" + "a1" * 150 + ".", "key sk-" + "b2" * 60 + " end", "10.0.0.1 and 192.168.100.7", "Frau Müller, господин Иванов, κυρία Παππά, Dr. Angela Merkel-Smith"]
    rows = _replaced(spark, texts)
    assert all(r["text"] != t and len(r["entities"]) for r, t in zip(rows, texts))
    ibans = [e["surrogate"] for e in rows[0]["entities"]]
    assert all(map(_iban, ibans)) and ibans[0][:2] == "DE" and ibans[1][:2] == "GB" and [len(x) for x in ibans] == [27, 22]
    card = rows[1]["text"]
    assert _luhn(card.replace(" ", "")) and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", card)
    phones = rows[2]["text"].split(", ")
    assert len({re.sub(r"\D", "", p)[-10:] for p in phones}) == 1 and re.fullmatch(r"\+1 \(4\d\d\) \d{3}-\d{4}", phones[0]) and phones[2].count(".") == 2
    assert "a1" * 5 not in rows[3]["text"] and len(rows[3]["text"]) == len(texts[3]) and "b2" * 5 not in rows[4]["text"] and len(rows[4]["text"]) == len(texts[4])
    assert [len(x) for x in re.findall(r"[\d.]+", rows[5]["text"])] == [len(x) for x in re.findall(r"[\d.]+", texts[5])]
    assert re.fullmatch(r"Frau \p{Lu}\p{Ll}+, господин \p{IsCyrillic}+, κυρία \p{IsGreek}+, Dr\. \p{Lu}\p{Ll}+-?.*".replace(r"\p{IsCyrillic}", "[А-я]").replace(r"\p{IsGreek}", "[Ͱ-Ͽ]").replace(r"\p{Lu}", "[A-Z]").replace(r"\p{Ll}", "[a-z]"), rows[6]["text"])


def test_more_names_than_short_ones_exist(spark):
    """Name surrogates grow by syllables of their script: never a digit, never shared, given names of the title's gender."""
    abc = [a + b + c for a in "bcdfghklmnprst" for b in "aeiou" for c in "bcdfghklmnprst"]
    names = [f"Mr {x.capitalize()}{y}" for x in abc for y in ("on", "er", "ix")]
    rows = _replaced(spark, names)
    new = [r["text"] for r in rows]
    assert len(set(new)) == len(names) and not set(new) & set(names) and all(re.fullmatch(r"Mr [A-Z][a-z]+", x) for x in new)
    ips = [f"{a}.{b}.1.1" for a in range(1, 10) for b in range(1, 10)]
    ips = [r["text"] for r in _replaced(spark, [*ips, *[f"{a}.{b}.{c}.2" for a in range(1, 10) for b in range(1, 10) for c in range(2, 10)]])]
    assert len(set(ips)) == len(ips) and all(re.fullmatch(r"\d+\.\d+\.\d+\.\d+", x) for x in ips)


def test_crowded_local_parts(spark):
    mails = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    new = [r["text"] for r in _replaced(spark, mails)]
    assert len(set(new)) == 26 and not set(new) & set(mails) and len({x.split("@")[1] for x in new}) == 1


def test_odd_rows(spark):
    rows = [(None, "mail me: a@b.org", "x", 1, "r"), (1, None, "x", 1, "r"), (1, "", "x", 1, "r"), (2, "to a@b.org", "x", 1, "r"), (2, "to a@b.org", "x", 1, "r"), (2, "nothing here", "x", 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, entities string, digest int, row string").withColumn("hit_id", F.lit(7))
    got = pii.replace(df, "k")
    counts = collections.Counter((r["doc_id"], r["text"] is None, len(r["entities"]), r["digest"], r["row"], r["hit_id"]) for r in got.collect())
    assert counts == {(None, False, 1, 1, "r", 7): 1, (1, True, 0, 1, "r", 7): 1, (1, False, 0, 1, "r", 7): 1, (2, False, 1, 1, "r", 7): 2, (2, False, 0, 1, "r", 7): 1}
    assert pii.replace(df.limit(0), "k").count() == 0


def test_a_very_long_text(spark):
    long = "words without data " * 200_000 + "mail a@b.org"
    (row,) = _replaced(spark, [long])
    assert len(row["entities"]) == 1 and row["text"].startswith("words without data ") and "a@b.org" not in row["text"]


@pytest.mark.parametrize("key", ["k", "other"])
def test_surrogates_depend_on_the_key_only(spark, key):
    df = spark.createDataFrame([(1, "Mr Smith a@b.org 8.8.8.8")], "doc_id long, text string")
    first, again = pii.replace(df, key).first()["text"], pii.replace(df.repartition(3), key).first()["text"]
    assert first == again and (pii.replace(df, "k").first()["text"] == first) == (key == "k")
