"""Text expressions: tokens, cleaning, identifier extraction and small format helpers, all as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, the known diagnostic service identifiers and the session phrases.
TOKEN = r"0x[0-9a-fA-F]+|[A-Za-z]+[A-Za-z0-9]*|[0-9a-fA-F]{2,8}"
SERVICE_IDS = ["10", "11", "14", "19", "22", "27", "28", "2E", "2F", "31", "34", "36", "37", "3E", "85"]
SESSIONS = {"default session": "01", "programming session": "02", "extended session": "03"}
WORD_SPLIT = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Hex literals, words and short hex runs in order, lower-cased, ``0x`` dropped; null gives none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    # Comparing is much cheaper than a regular expression for every token.
    bare = lambda t: F.when(F.startswith(t, F.lit("0x")), F.substring(t, 3, 1 << 30)).otherwise(t)
    return F.filter(F.transform(F.transform(found, F.lower), bare), lambda t: t != "")


def normalised(text: Column) -> Column:
    """Tokens joined by one space."""
    return F.array_join(tokens(text), " ")


def _alone(text: Column, pattern: str) -> Column:
    """The group of each match that is a word by itself: one scan of the text, no array of its words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<![\p{{L}}\p{{N}}_]){pattern}(?![\p{{L}}\p{{N}}_])"), F.lit(1))


def service_ids(text: Column) -> Column:
    """Known two-digit service identifiers that stand alone, distinct, first seen first."""
    bare = F.transform(_alone(text, "(?:0x)?([0-9A-Fa-f]{2})"), F.upper)
    return F.array_distinct(F.filter(bare, lambda w: w.isin(SERVICE_IDS)))


def data_ids(text: Column) -> Column:
    """Stand-alone words of four hexadecimal digits (the prefix ``DID`` is allowed), upper-cased, distinct, first seen first."""
    return F.array_distinct(F.transform(_alone(text, "(?:DID|did)?([0-9A-Fa-f]{4})"), F.upper))


def sessions(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(p)), F.lit(c)) for p, c in SESSIONS.items()]))


def security_levels(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(?:security\s*access|level)\s*0?(\d{1,2})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda d: F.lpad(d.cast("int").cast("string"), 2, "0")))


def cleaned(text: Column) -> Column:
    """Common character references decoded, markup to spaces, white space collapsed, trimmed."""
    out = F.coalesce(text, F.lit(""))
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), r"\s+", " "))


def safe_id(value: Column, fallback: str = "document") -> Column:
    """Characters outside ``[A-Za-z0-9_.-]`` to one underscore, ends stripped."""
    slug = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9_.-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(slug, "^_+|_+$", ""), F.lit("")), F.lit(fallback))


def tokens_ceil(text: Column, per_token: int = 4) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / per_token)).cast("long")


def tokens_floor(text: Column, per_token: int = 4) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / per_token)).cast("long")


def hex_format(value: Column, width: int) -> Column:
    """``0x`` and upper-case digits padded to ``width``; longer values are not cut, others pass unchanged."""
    bare = F.upper(F.regexp_replace(F.trim(value), "^0[xX]", ""))
    padded = F.when(F.length(bare) < width, F.lpad(bare, width, "0")).otherwise(bare)
    return F.when(bare.rlike("^[0-9A-F]+$"), F.concat(F.lit("0x"), padded)).otherwise(value)


def comparable(value: Column) -> Column:
    """Form in which two values are equivalent: no white space, lower case, hexadecimal without leading zeros."""
    flat = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", ""))
    bare = F.regexp_replace(F.regexp_replace(flat, "^0x", ""), "^0+(?=.)", "")
    return F.when(flat.rlike("^(0x)?[0-9a-f]+$"), bare).otherwise(flat)


def containment(left: Column, right: Column) -> Column:
    """Share of the distinct left tokens that the right has; 0 for no left tokens."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def context_tier(n: Column) -> Column:
    return F.when(n <= 4096, "short").when(n <= 32768, "standard").when(n <= 65536, "extended").when(n <= 131072, "extreme").otherwise("overflow")
