"""PII surrogates: detected entities are replaced by keyed, type-consistent stand-ins.

Detection is by patterns (e-mail, phone, payment card, national id, IBAN, IPv4, access keys and secrets, and names after a
title or a common given name). A mention is normalised within its type: letters lowered, separators dropped, a phone
number without its country code. A name is two entities, its given name (with the gender of title or given name) and its
surname, so "Mr. John Smith", "Dr Smith" and "John Smith" share the surname's surrogate. All mentions of an entity
anywhere in the corpus share one surrogate (coreference), poured back into each mention's own format: digits stay digits,
letters stay letters of the same case and script, hexadecimal stays hexadecimal, cards keep issuer digit and Luhn
validity, IBANs keep country and valid check digits, phone numbers keep country code and separators, names keep title,
script and gender.

Surrogates are a keyed hash of (type, normal form, attempt). Collision checks over the whole corpus: a surrogate equal
to any original of its type, or shared by two originals, is drawn again with the next attempt (of sharers the least
original stays), until none is left, so distinct entities stay distinct. Where a format has little room it grows with the
attempts in kind: names by syllables of their script, local parts of e-mails by letters, IPv4 octets to other widths.

All DataFrame expressions. Only texts that hold an entity are joined with their surrogates; entities are
distinct before the checks, so a very common entity is one row. Mentions of one row travel as one group, which the length
of the text bounds.

Defined results: null texts stay null with no entity; equal rows get equal results; rows are told apart by (doc_id, text),
so equal or null ids are no problem; extra columns of any name pass through, ``entities`` is replaced if present.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, materialized

# Titles and common given names by gender, and by script syllables of names and their gendered endings.
TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "господин", "κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "κυρία"], "n": ["Dr", "Prof", "Mx"]}
GIVEN = {"m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Peter", "Hans", "Klaus", "Wolfgang", "Pierre", "Jean", "Carlos", "Juan", "José"], "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Anna", "Angela", "Ursula", "Marie", "Sophie", "Carmen", "Lucía"]}
SYLLABLES = {
    "latin": [["Al", "Be", "Ca", "Do", "Fe", "Ga", "He", "Jo", "Ka", "Lo", "Ma", "No", "Or", "Pa", "Ro", "Sa"], ["ri", "na", "lo", "mi", "sa", "te", "ba", "de"]],
    "cyrillic": [["Ан", "Бо", "Ви", "Гле", "Да", "Е", "Ки", "Ма"], ["ри", "на", "ло", "ми", "са", "те"]],
    "greek": [["Αν", "Βα", "Γι", "Δη", "Ελ", "Κω", "Μα", "Νι"], ["ρι", "να", "λο", "μι", "σα", "τε"]],
}
GIVEN_ENDS = {
    ("latin", "m"): ["n", "r", "us", "rd"], ("latin", "f"): ["a", "ia", "lle", "tta"], ("latin", "n"): ["n", "y", "e", "is"],
    ("cyrillic", "m"): ["н", "р", "м", "й"], ("cyrillic", "f"): ["а", "ия", "на", "я"], ("cyrillic", "n"): ["а", "я", "о", "и"],
    ("greek", "m"): ["ος", "ης", "ας", "ων"], ("greek", "f"): ["α", "ια", "η", "ω"], ("greek", "n"): ["ις", "ων", "ι", "υς"],
}
SURNAME_ENDS = {"latin": ["berg", "dale", "feld", "ford", "holm", "lund", "mann", "stein", "ton", "vik", "wald", "wood"], "cyrillic": ["ский", "енко", "ук", "ич"], "greek": ["άκης", "ίδης", "όπουλος", "άτος"]}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "hex": "abcdef"}

_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GIVEN = "|".join(sorted((t for ts in GIVEN.values() for t in ts), key=len, reverse=True))
_INITIALS = "".join(sorted({t[0] for ts in (*TITLES.values(), *GIVEN.values()) for t in ts}))
_WORD = r"\p{Lu}\p{Ll}{1,30}"
#: Groups: what stands before the names, given name, what stands between, surname.
_NAMED = rf"((?:{_TITLE})\.?[ ])(?:({_WORD})([ -]))?({_WORD})|()({_GIVEN})([ -])({_WORD})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What stands before a secret's value; the look-ahead spares most positions the alternatives.
_SECRET = r"(?=[pPtTsSaA])(?i:password|passwd|pwd|token|secret|api_key|apikey|access_key)[ ]{0,2}[=:][ ]{0,2}[\"']?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9][A-Za-z0-9-]{0,62}){0,8}\.[A-Za-z]{2,24}",
    "secret": _SECRET + r"[A-Za-z0-9_/+.=-]{8,}+",
    "access_key": r"\b(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    "national_id": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "name": rf"(?=[{_INITIALS}])(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.?[ ](?:{_WORD}[ -])?|(?:{_GIVEN})[ -]){_WORD}(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every pattern needs one of these, so other texts need no matching.
MAYBE = rf"[0-9@=:]|AKIA|gh[pousr]_|sk-|(?=[{_INITIALS}])(?:(?:{_TITLE})\.?|{_GIVEN})[ -]\p{{Lu}}"


def _kind(value: Column) -> Column:
    """Type of a matched string. A secret is what no other pattern explains."""
    out = None
    for kind in ("email", "access_key", "ip", "national_id", "iban", "phone", "card", "name"):
        test = value.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out.otherwise(F.lit("secret"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _normal(kind: Column, value: Column) -> Column:
    """Form that all mentions of one entity share (for the parts of a name, the part itself)."""
    # A national number of ten digits is the same with the country code 1 and without; other numbers lose leading zeros.
    national = let(_digits(value), lambda d: F.when((F.length(d) == 11) & F.startswith(d, F.lit("1")), F.substring(d, 2, 10)).otherwise(F.regexp_replace(d, "^0+(?=[0-9])", "")))
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "phone", national)
        .when(kind.isin("card", "national_id"), _digits(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "secret", F.regexp_replace(value, f"^{_SECRET}", ""))
        .when(F.startswith(kind, F.lit("name:")), F.lower(value))
        .otherwise(value)
    )


def _parts(kind: Column, value: Column) -> Column:
    """The entities of a mention, as (part, kind of entity, text): a name has a given name and a surname, others are one."""
    group = lambda a, b: F.concat(F.regexp_extract(value, f"^(?:{_NAMED})$", a), F.regexp_extract(value, f"^(?:{_NAMED})$", b))
    given, surname, title = group(2, 6), group(4, 8), F.regexp_extract(value, rf"^({_TITLE})\.? ", 1)
    script = F.when(surname.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic")).when(surname.rlike(r"^\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))
    said = lambda who, words: who.isin(*words)
    gender = F.when(said(title, TITLES["m"]), F.lit("m")).when(said(title, TITLES["f"]), F.lit("f")).when(said(given, GIVEN["m"]), F.lit("m")).when(said(given, GIVEN["f"]), F.lit("f")).otherwise(F.lit("n"))
    one = lambda part, of, text: F.struct(F.lit(part).alias("part"), of.alias("of"), text.alias("text"))
    name = F.array_compact(F.array(F.when(given != "", one(0, F.concat(F.lit("name:given:"), script, F.lit(":"), gender), given)), one(1, F.concat(F.lit("name:surname:"), script), surname)))
    return F.when(kind == "name", name).otherwise(F.array(one(0, kind, value)))


def _draw(seed: Column, i: Column, n: int) -> Column:
    """Number below ``n`` from place ``i`` of a hexadecimal digest."""
    return F.pmod(F.conv(F.substring(seed, F.pmod(i * 3, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int") + i, F.lit(n))


def _like(c: Column, r, hexadecimal: Column) -> Column:
    """A character of the same class as ``c``; ``r(n)`` draws a number below n."""
    pick = lambda k: F.substring(F.lit(LETTERS[k]), r(len(LETTERS[k])) + 1, F.lit(1))
    letter = F.when(hexadecimal, pick("hex")).when(c.rlike(r"\p{IsCyrillic}"), pick("cyrillic")).when(c.rlike(r"\p{IsGreek}"), pick("greek")).otherwise(pick("latin"))
    return F.when(c.rlike("[0-9]"), r(10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)


def _each(text: Column, body) -> Column:
    return F.array_join(F.transform(F.split(text, ""), body), "")


def _surrogate(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """Stand-in for a normal form."""
    digest = lambda *parts: F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)
    seed = digest(kind, normal, attempt.cast("string"))
    hexadecimal = normal.rlike("^[0-9a-f]+$")
    plain = _each(normal, lambda c, i: _like(c, lambda n: _draw(seed, i, n), hexadecimal))
    local, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    place = digest(F.lit("domain"), domain)
    tld = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(tld))
    no = F.lit(False)
    wider = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(64)), 1, F.least(F.greatest(attempt - 3, F.lit(0)), F.lit(64))), lambda i: F.substring(F.lit(LETTERS["latin"]), _draw(seed, i + 70, 26) + 1, F.lit(1))), "")
    email = F.concat(_each(local, lambda c, i: _like(c, lambda n: _draw(seed, i, n), no)), wider, F.lit("@"), _each(host, lambda c, i: _like(c, lambda n: _draw(place, i, n), no)), tld)
    any_octet = lambda i: (_draw(seed, i, 254) + 1).cast("string")
    octet = lambda o, i: F.when(attempt >= 4, any_octet(i)).when(F.length(o) == 1, _draw(seed, i, 9) + 1).when(F.length(o) == 2, _draw(seed, i, 90) + 10).otherwise(_draw(seed, i, 155) + 100).cast("string")
    ip = F.array_join(F.transform(F.split(normal, r"\."), octet), ".")
    # Cards keep their first digit and phones too (long ones, which hold a country code, two); cards that pass the Luhn
    # test get a last digit that passes it.
    kept = F.when((kind == "phone") & (F.length(normal) > 10), 2).otherwise(1)
    lead = F.concat(F.substring(normal, F.lit(1), kept), F.substring(plain, kept + 1, F.length(plain)))
    doubled = lambda d, odd: F.when(odd, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    luhn = lambda s: F.aggregate(F.transform(F.split(F.reverse(s), ""), lambda c, i: doubled(c.cast("int"), i % 2 == 1)), F.lit(0), lambda a, d: a + d) % 10
    body = F.concat(F.substring(lead, F.lit(1), F.length(lead) - 1), F.lit("0"))
    card = F.when(luhn(normal) == 0, F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.pmod(10 - luhn(body), F.lit(10)).cast("string"))).otherwise(lead)
    named = F.startswith(kind, F.lit("name:"))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", lead).when(kind == "card", card).when(kind == "iban", _iban(normal, plain)).when(named, _name(kind, seed, attempt)).when(kind == "access_key", _key(normal, plain)).otherwise(plain)


def _iban(normal: Column, plain: Column) -> Column:
    """Country of the original, the drawn account, and the check digits that belong to them (mod 97 of both, letters as 10 to 35)."""
    country, account = F.substring(normal, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), lambda a, c: let(value(c), lambda v: F.when(v >= 10, a * 100 + v).otherwise(a * 10 + v)) % 97)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _key(normal: Column, plain: Column) -> Column:
    """Access keys keep the mark of their issuer."""
    size = F.when(normal.startswith("sk-"), 3).otherwise(4)
    return F.concat(F.substring(normal, F.lit(1), size), F.substring(plain, size + 1, F.length(plain)))


def _name(kind: Column, seed: Column, attempt: Column) -> Column:
    """A given name or surname of the kind's script (and gender), lower-cased; more attempts take more syllables."""
    pick = lambda parts, i: F.element_at(F.array(*map(F.lit, parts)), _draw(seed, i, len(parts)) + 1)
    script = lambda table, body: reduce(lambda c, s: c.when(F.contains(kind, F.lit(f":{s}")), body(table[s])), table, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(""))
    middle = lambda parts: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 2).cast("int")), lambda i: pick(parts[1], i * 2 + 5)), "")
    stem = script(SYLLABLES, lambda parts: F.concat(pick(parts[0], F.lit(0)), middle(parts)))
    given = reduce(lambda c, sg: c.when(F.endswith(kind, F.lit(f"{sg[0]}:{sg[1]}")), pick(GIVEN_ENDS[sg], F.lit(2))), GIVEN_ENDS, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(""))
    return F.lower(F.concat(stem, F.when(F.startswith(kind, F.lit("name:given")), given).otherwise(script(SURNAME_ENDS, lambda ends: pick(ends, F.lit(3))))))


def _poured(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one mention."""
    case = _each(value, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1))))
    slots = F.split(value, "")
    taken = F.aggregate(
        slots, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike("[A-Z0-9]"), F.struct(F.concat(a["out"], F.substring(surrogate, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(surrogate, a["at"], F.length(surrogate))),
    )
    # Digits of the surrogate fill the last places of a phone number, so that a country code stays.
    extra = F.greatest(F.length(_digits(value)) - F.length(surrogate), F.lit(0))
    phone = let(F.concat(F.substring(_digits(value), F.lit(1), extra), surrogate), lambda ds: F.array_join(F.transform(slots, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(ds, F.length(_digits(F.substring(value, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""))
    same = F.length(value) == F.length(surrogate)
    name = F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate)))
    return F.when((kind == "email") & same, case).when(kind == "phone", phone).when(kind.isin("card", "national_id", "iban"), taken).when(F.startswith(kind, F.lit("name:")), name).when(kind == "secret", F.concat(F.regexp_extract(value, f"^{_SECRET}", 0), surrogate)).otherwise(surrogate)


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), pos, value, kind, part, of (kind of entity), text and normal of every entity mentioned."""
    maybe = docs.filter(F.col("text").rlike(MAYBE)).select("doc_id", F.xxhash64("text").alias("digest"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("values"))
    each = maybe.select("doc_id", "digest", F.posexplode("values").alias("pos", "value")).withColumn("kind", _kind(F.col("value")))
    parts = each.select("*", F.inline(_parts(F.col("kind"), F.col("value"))))
    return parts.withColumn("normal", _normal(F.col("of"), F.col("text")))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, normal and surrogate, distinct within each kind and apart from all originals."""
    entities = entities.select("kind", "normal").distinct()
    originals = entities.select("kind", F.col("normal").alias("surrogate"))
    left, settled, attempt = entities, [], 0
    while True:
        drawn = left.withColumn("surrogate", _surrogate(F.col("kind"), F.col("normal"), F.lit(attempt), key))
        taken = reduce(DataFrame.unionByName, [originals, *(s.select("kind", "surrogate") for s in settled)])
        winner = drawn.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal"))
        fine = materialized(winner.join(taken.distinct(), ["kind", "surrogate"], "left_anti"), "pii-settled")
        settled.append(fine)
        left = materialized(left.join(fine, ["kind", "normal"], "left_anti"), "pii-left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, settled).select("kind", "normal", "surrogate")
        attempt += 1


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the text rewritten and ``entities`` (array<struct<kind, surrogate>>, in order) added."""
    docs = docs.drop("entities")
    # The caller's columns travel in one struct, so that no name of theirs can meet one of ours.
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    found = materialized(mentions(packed).distinct(), "pii-mentions")
    stand_in = surrogates(found.select(F.col("of").alias("kind"), "normal"), key).withColumnRenamed("kind", "of")
    poured = found.join(stand_in, ["of", "normal"]).withColumn("poured", _poured(F.col("of"), F.col("text"), F.col("surrogate")))
    of_part = lambda k: F.coalesce(F.max(F.when(F.col("part") == k, F.col("poured"))), F.lit(""))
    whole = poured.groupBy("doc_id", "digest", "pos", "kind", "value").agg(of_part(0).alias("first"), of_part(1).alias("second"))
    between = lambda a, b: F.concat(F.regexp_extract("value", f"^(?:{_NAMED})$", a), F.regexp_extract("value", f"^(?:{_NAMED})$", b))
    whole = whole.withColumn("surrogate", F.when(F.col("kind") == "name", F.concat(between(1, 5), "first", between(3, 7), "second")).otherwise(F.col("first")))
    per_row = whole.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "surrogate"))).alias("list"))
    per_row = per_row.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), F.transform("list", lambda x: F.struct(x["kind"].alias("kind"), x["surrogate"].alias("surrogate"))).alias("entities"))
    holds = F.coalesce(F.col("text").rlike(MAYBE) & F.col("text").rlike(ANY), F.lit(False))
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    touched = packed.filter(holds)
    joined = touched.join(per_row, touched["doc_id"].eqNullSafe(per_row["hit_id"]) & (F.xxhash64(touched["text"]) == per_row["hit_digest"])).select("row", "text", "entities")
    gaps = F.split("text", ANY, -1)
    rebuilt = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), F.col("entities").alias("e")), lambda z: F.array(F.coalesce(z["g"], F.lit("")), F.coalesce(z["e"]["surrogate"], F.lit(""))))), "")
    changed = joined.select("row", rebuilt.alias("new_text"), "entities")
    both = packed.filter(~holds).select("row", F.col("text").alias("new_text"), none.alias("entities")).unionByName(changed)
    return both.select(*[F.col("new_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], "entities")
