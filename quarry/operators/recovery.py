"""JSON objects and their fields from model text: fenced, surrounded by prose, doubled or cut off.

The first balanced object is found by a fold over strings, braces and what lies between (braces inside strings do not count)
and must parse. It is the whole text without its code fence, the span from the first brace to the last, or an object before
others. ``recovered`` also reads single fields from text that holds no object. (The parser alone would not do: it
takes a value and ignores what follows.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code fences, a JSON string, and how a reply's parts are found when it does not parse.
FENCE_START, FENCE_END = r"^```(?:json)?\s*", r"\s*```$"
PIECES = r'"(?:[^"\\]++|\\.)*+"?|[{}]|[^"{}]++'
STRING = r'"((?:[^"\\]++|\\.)*+)"'
ARGS = r'(?s)"args"\s*:\s*(\[.*?\])\s*,\s*"xml"'
EVIDENCE = r'(?s)"evidence_map"\s*:\s*(\{.*?\})\s*,\s*"confidence"'
SCRIPT = r"(?s)<ScriptNode\b.*?</ScriptNode>"
DELIMITERS = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'")]
CONFIDENCE = 0.75
WHITE = " \t\n\r\x0b\x0c"


def unfenced(text: Column) -> Column:
    """Text without white space and a code fence around it."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, FENCE_START, ""), FENCE_END, "")).otherwise(bare)


def is_object(text: Column) -> Column:
    """Whether a text begins with a JSON object that parses."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT")), F.lit(False))


def balanced(text: Column) -> Column:
    """The first object by its braces, null where it is never closed."""
    tail = F.when(F.contains(text, F.lit("{")), F.substr(text, F.instr(text, "{")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(a: Column, piece: Column) -> Column:
        depth = a["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["size"] + F.length(piece)).alias("size"), (depth == 0).alias("done")))

    end = F.aggregate(F.regexp_extract_all(tail, F.lit(f"(?s){PIECES}"), F.lit(0)), start, step, lambda a: F.when(a["done"], a["size"]))
    return F.substr(tail, F.lit(1), end)


def json_object(texts: DataFrame, text: str) -> DataFrame:
    """Adds ``object`` (JSON text, null for none) and ``found_by``: whole, span, balanced (the first of several) or null."""
    c = F.col
    named = texts.withColumn("_plain", unfenced(c(text)))
    made = named.withColumn("_b", balanced(c("_plain"))).withColumn("_ok", is_object(c("_b")))
    by = F.when(c("_b") == c("_plain"), "whole").when(c("_b") == F.regexp_extract("_plain", r"(?s)\{.*\}", 0), "span").otherwise("balanced")
    return made.withColumns({"object": F.when(c("_ok"), c("_b")), "found_by": F.when(c("_ok"), by)}).drop("_plain", "_b", "_ok")


def unescaped(value: Column) -> Column:
    """Content of a JSON string, null where it is malformed."""
    return F.get(F.from_json(F.concat(F.lit('["'), value, F.lit('"]')), "array<string>"), F.lit(0))


def string_field(text: Column, name: str) -> Column:
    """A string field by its name, trimmed, empty where it is absent or cut off."""
    pattern = rf'(?s)"{name}"\s*:\s*{STRING}'
    return F.when(text.rlike(pattern), F.btrim(F.coalesce(unescaped(F.regexp_extract(text, pattern, 1)), F.lit("")), F.lit(WHITE))).otherwise(F.lit(""))


def number_field(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf'"{name}"\s*:\s*(-?\d+(?:\.\d+)?)', 1).try_cast("double")


def flag_field(text: Column, name: str) -> Column:
    return F.lower(F.regexp_extract(text, rf'(?i)"{name}"\s*:\s*(true|false)', 1)) == "true"


def xml_field(text: Column) -> Column:
    """The XML of a reply: its string field, else the first script node in the text, delimiters unescaped."""
    fragment = F.regexp_extract(text, SCRIPT, 0)
    value = F.when(string_field(text, "xml") != "", string_field(text, "xml")).otherwise(fragment)
    for ref, char in DELIMITERS:
        value = F.replace(value, F.lit(ref), F.lit(char))
    return F.btrim(value, F.lit(WHITE))


def recovered(replies: DataFrame, text: str = "text") -> DataFrame:
    """Replies with node_name, class_name, xml, args (JSON), evidence_map (JSON), confidence, needs_review, reason, status and ``text`` dropped.

    ``status`` is parsed (the reply holds an object), recovered (fields of a malformed reply with XML, a warning) or failed.
    A parsed reply's fields come from its object. ``replies`` has default_name and default_class for replies that name none.
    """
    c = F.col
    found = json_object(replies, text).withColumn("_t", unfenced(c(text)))
    of = lambda name: F.get_json_object("object", f"$.{name}")
    parsed = c("object").isNotNull()
    evidence = F.nullif(F.regexp_extract("_t", EVIDENCE, 1), F.lit(""))
    args = F.nullif(F.regexp_extract("_t", ARGS, 1), F.lit(""))
    xml = of("xml")
    for ref, char in DELIMITERS:
        xml = F.replace(xml, F.lit(ref), F.lit(char))
    made = found.withColumn("xml", F.when(parsed, F.btrim(F.coalesce(xml, F.lit("")), F.lit(WHITE))).otherwise(xml_field(c("_t"))))
    status = F.when(parsed, "parsed").when(c("xml") != "", "recovered").otherwise("failed")
    text_of = lambda name: F.when(parsed, F.btrim(F.coalesce(of(name), F.lit("")))).otherwise(string_field(c("_t"), name))
    or_else = lambda value, default: F.coalesce(F.nullif(value, F.lit("")), c(default))
    keep = [x for x in replies.columns if x != text]
    return made.select(
        *keep, status.alias("status"), "found_by", or_else(text_of("node_name"), "default_name").alias("node_name"), or_else(text_of("class_name"), "default_class").alias("class_name"), "xml",
        F.when(parsed, of("args")).when(is_array(args), args).alias("args"), F.when(parsed, of("evidence_map")).when(is_object(evidence), evidence).alias("evidence_map"),
        F.coalesce(F.when(parsed, of("confidence").try_cast("double")).otherwise(number_field(c("_t"), "confidence")), F.when(~parsed, F.lit(CONFIDENCE))).alias("confidence"),
        F.coalesce(F.when(parsed, of("needs_review") == "true").otherwise(flag_field(c("_t"), "needs_review")), F.lit(False)).alias("needs_review"), text_of("missing_or_conflict_reason").alias("reason"),
    )


def is_array(text: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("ARRAY")), F.lit(False))
