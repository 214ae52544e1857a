"""Prompt sections: score order, deduplication and truncation to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens_ceil

# The mark of a cut section, and the characters by which two sections count as equal.
CUT = "\n...[truncated by prompt budget]"
KEY_CHARS = 512


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _cut(text: Column, left: Column, per_token: int) -> Column:
    room = F.greatest(F.lit(1), left * per_token)
    head = F.substr(text, F.lit(1), F.greatest(F.lit(1), room - len(CUT)).cast("int"))
    return F.when(F.length(text) <= room, text).otherwise(F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit(CUT)))


def budget_sections(sections: DataFrame, by: str, budget: int, max_items: int = 8, per_token: int = 4) -> DataFrame:
    """Per group: kept labels, used tokens, number dropped, and the rendered context of (label, score, text).

    Empty sections, known labels and known contents are dropped; a section beyond the budget is cut to what is left of it.
    A group is one prompt's candidates, so it is bounded by the retrieval depth.
    """
    content = _stripped(F.col("text"))
    item = F.struct((-F.col("score")).alias("neg"), F.col("label").cast("string").alias("label"), content.alias("content"))
    rows = sections.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.array().cast("array<struct<label:string,content:string,key:string>>")
    start = F.struct(empty.alias("kept"), F.lit(0).cast("long").alias("used"))

    def step(a: Column, x: Column) -> Column:
        key = F.substring(F.regexp_replace(x["content"], r"\s+", " "), 1, KEY_CHARS)
        left = F.lit(budget) - a["used"]
        known = F.exists(a["kept"], lambda k: (k["label"] == x["label"]) | (k["key"] == key))
        skip = (x["content"] == "") | known | (F.size(a["kept"]) >= max_items) | (left <= 0)
        text = F.when(tokens_ceil(x["content"], per_token) > left, _cut(x["content"], left, per_token)).otherwise(x["content"])
        one = F.struct(x["label"].alias("label"), text.alias("content"), key.alias("key"))
        return F.when(skip, a).otherwise(F.struct(F.concat(a["kept"], F.array(one)).alias("kept"), (a["used"] + tokens_ceil(text, per_token)).alias("used")))

    done = rows.select(by, F.size("items").alias("n"), F.aggregate("items", start, step).alias("a"))
    shown = F.array_join(F.transform("a.kept", lambda k: F.concat(F.lit("["), k["label"], F.lit("]\n"), k["content"])), "\n\n")
    return done.select(by, F.array_join(F.transform("a.kept", lambda k: k["label"]), ",").alias("kept"), F.col("a.used").alias("used_tokens"), (F.col("n") - F.size("a.kept")).cast("long").alias("n_dropped"), shown.alias("context"))
