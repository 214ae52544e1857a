"""Retrieval filters and exact-match boosts over knowledge units, and what is made of the chunks found."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import normalised, tokens

#: Weights of one identifier of the query that the unit carries.
BOOSTS = {"dids": 2.0, "service_ids": 1.5, "sessions": 1.0, "security_levels": 1.0}
PHRASE = 5.0


@dataclass(frozen=True)
class RetrievalFilters:
    """Conditions that must all hold; an empty one does not count."""

    doc_ids: tuple[str, ...] = ()
    unit_types: tuple[str, ...] = ()
    protocol: str = ""
    module: str = ""
    ecu: str = ""
    service_ids: tuple[str, ...] = ()
    dids: tuple[str, ...] = ()
    sessions: tuple[str, ...] = ()
    security_levels: tuple[str, ...] = ()

    def condition(self, by_prefix: bool = True) -> Column:
        """The filter as one Column; ``by_prefix`` takes documents by the start of the chunk id, else by doc_id."""
        tests: list[Column] = []
        if self.doc_ids:
            tests.append(reduce(lambda a, b: a | b, [F.startswith("chunk_id", F.lit(f"{d}_")) for d in self.doc_ids]) if by_prefix else F.col("doc_id").isin(*self.doc_ids))
        if self.unit_types:
            tests.append(F.col("unit_type").isin(*self.unit_types))
        tests += [F.lower(F.coalesce(c, F.lit(""))) == getattr(self, c).lower() for c in ("protocol", "module", "ecu") if getattr(self, c)]
        tests += [overlaps(F.col(c), F.array(*map(F.lit, getattr(self, c)))) for c in BOOSTS if getattr(self, c)]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def bare_hex(values: Column) -> Column:
    """Upper-case values without ``0X``."""
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.regexp_replace(F.upper(v), "^0X", ""))


def overlaps(left: Column, right: Column) -> Column:
    """Whether two identifier lists share a value, whatever its case and ``0x``."""
    return F.arrays_overlap(bare_hex(left), bare_hex(right))


def searchable(unit_text: str = "content") -> Column:
    """A unit's text with its protocol, module, unit name and identifiers."""
    lists = [F.array_join(c, " ") for c in ("service_ids", "dids", "sessions", "security_levels")]
    return F.concat_ws(" ", F.col(unit_text), *[F.coalesce(c, F.lit("")) for c in ("protocol", "module", "ecu")], *lists)


def exact_boost(query: Column, text: Column) -> Column:
    """Phrase boost if the query's tokens stand in the text's, and the weights of the identifiers that it names."""
    asked = normalised(query)
    phrase = F.when((asked != "") & F.contains(normalised(text), asked), F.lit(PHRASE)).otherwise(0.0)
    upper = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.upper)
    values = F.array_distinct(upper(tokens(query)))
    return reduce(lambda a, b: a + b, [F.size(F.array_intersect(values, upper(F.col(c)))) * w for c, w in BOOSTS.items()], phrase)


def as_chunks(scored: DataFrame, source: str) -> DataFrame:
    """Scored units as chunks found: source, and the evidence id behind a chunk marked ``md_``."""
    behind = F.when(F.startswith("chunk_id", F.lit("md_")), F.substring("chunk_id", 4, 1 << 20)).otherwise(F.lit(""))
    return scored.withColumns({"source": F.lit(source), "source_evidence_id": behind})


def pack_context(chunks: DataFrame, by: str = "query_id") -> DataFrame:
    """One numbered text of each query's chunks in rank order (query_id, rank, chunk_id, source, score, source_path, page, content)."""
    head = F.concat(F.lit("["), F.row_number().over(Window.partitionBy(by).orderBy("rank")).cast("string"), F.lit("] chunk_id="), F.col("chunk_id").cast("string"), F.lit(" source="), F.col("source"), F.lit(" score="), F.col("score").cast("string"))
    where = F.concat(F.lit("source="), F.coalesce("source_path", F.lit("")), F.lit(" page_idx="), F.col("page").cast("string"))
    block = chunks.withColumn("block", F.concat_ws("\n", head, where, F.col("content")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n")
    return block.groupBy(by).agg(F.count("*").alias("n_chunks"), joined.alias("context"))
