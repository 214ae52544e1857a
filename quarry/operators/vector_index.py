"""Vector records and an approximate index over them: hashed embeddings, cells around leaders, probing with overfetch.

The index is cluster pruning: ``n_leaders`` rows, chosen by a hash of their id, are leaders, and every row belongs to the
cell of its most similar leader (cosine to six decimals, ties to the smaller leader id). Leaders are a bounded sample
(``MAX_LEADERS``) and are sent to the tasks; all rows are indexed. The index is stored by cell, sorted, so that a scan for some
cells skips the rest by the files' statistics; one large cell spreads over as many files as its rows need.

Rows whose vector is null or of another length than the leaders' stand in cell -1, which every query probes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.nearest import nearest
from quarry.operators.retrieval import QUERY_BLOCK, TASKS, top_k

MAX_LEADERS = 4096
#: Rows whose scores against all leaders are held at once.
SCORED = 1024
OTHER = -1

# The middle of an id that says what the unit was cut from, endings of parser files, and id prefixes.
ID_MARKS = ["_sem_", "_text_", "_table_", "_image_", "_equation_"]
FILE_ENDS = ["_content_list", "_middle"]
KNOWLEDGE, EVIDENCE, MARKDOWN = "ku:", "ev:", "md_"
CONTENT_FIELDS = ["protocol", "module", "ecu", "service_ids", "dids", "sessions", "security_levels"]


def hashed_words(text: str) -> list[str]:
    """Words of a text as SQL has them: lower case character by character, cut at blanks, tabs, line ends and form feeds only."""
    return [w for w in re.split("[ \\t\\n\\f\\r]+", text.replace("Σ", "σ").replace("İ", "i").lower()) if w]


def hashed_vector(text: str, dimension: int, whole: bool = True) -> list[float] | None:
    """Signed counts of hashed words at length 1; a text whose counts are all zero is hashed as a whole, or has no vector."""
    out = np.zeros(dimension)
    for word in hashed_words(text):
        digest = hashlib.sha256(word.encode()).digest()
        out[int.from_bytes(digest[:4], "big") % dimension] += 1 - 2 * (digest[4] % 2)
    if not out.any():
        if not whole:
            return None
        digest = np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8)
        out = (digest[np.arange(dimension) % len(digest)] - 127.5) / 127.5
    return (out / np.sqrt((out * out).sum())).tolist()


def embed(texts: DataFrame, text_col: str, dimension: int = 16, whole: bool = True) -> DataFrame:
    """``texts`` with ``embedding``, the hashed vector of a column; null is an empty text.

    Without ``whole`` a text whose counts are all zero, as when its words cancel, has a null vector.
    """
    kept = [c for c in texts.columns if c != "embedding"]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [hashed_vector(t.as_py() or "", dimension, whole) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*kept, "embedding"])

    return texts.select(*kept).mapInArrow(run, T.StructType([*texts.select(*kept).schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def document_of(chunk_id: Column, source_path: Column) -> Column:
    """Document of a knowledge unit: the stem of its source file without the parser's ending, else what its id begins with."""
    name = F.regexp_replace(F.coalesce(source_path, F.lit("")), "/+$", "")
    name = F.substring_index(name, "/", -1)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
    ended = F.regexp_replace(stem, "(" + "|".join(FILE_ENDS) + ")$", "")
    of_id = F.when(F.lit(False), "")
    for mark in ID_MARKS:
        of_id = of_id.when(chunk_id.contains(mark), F.substring_index(chunk_id, mark, 1))
    return F.when(~name.isin("", ".", ".."), ended).otherwise(of_id.otherwise(F.substring_index(chunk_id, "_", 1)))


def record_content(content: Column, fields: list[Column]) -> Column:
    """Content, a line end, and the fields' values, trimmed."""
    return F.trim(F.concat(F.coalesce(content, F.lit("")), F.lit("\n"), F.trim(F.array_join(F.array(*fields), " "))), F.lit(" \t\n\r\x0b\x0c"))


def _fields(df: DataFrame) -> list[Column]:
    kinds = dict(df.dtypes)
    text = lambda c: F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c).cast("string")
    return [F.coalesce(text(c), F.lit("")) if c in kinds else F.lit("") for c in CONTENT_FIELDS]


def _of_unit(content: Column) -> list[Column]:
    own = F.when(F.col("chunk_id").startswith(MARKDOWN), F.substr("chunk_id", F.lit(len(MARKDOWN) + 1))).otherwise("")
    return [
        F.concat(F.lit(KNOWLEDGE), "chunk_id").alias("primary_id"), F.col("chunk_id").alias("source_id"), F.lit("knowledge_unit").alias("record_type"),
        document_of(F.col("chunk_id"), F.col("source_path")).alias("doc_id"), own.alias("source_evidence_id"), F.col("unit_type"), F.lit("").alias("evidence_type"), content.alias("content"),
    ]


def _of_evidence(evidence_id: str, content: Column) -> list[Column]:
    return [
        F.concat(F.lit(EVIDENCE), evidence_id).alias("primary_id"), F.col(evidence_id).alias("source_id"), F.lit("evidence_unit").alias("record_type"),
        F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("source_evidence_id", F.lit("")).alias("source_evidence_id"), F.lit("").alias("unit_type"), F.col("evidence_type"), content.alias("content"),
    ]


def records(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """primary_id, source_id, record_type, doc_id, source_evidence_id, unit_type, evidence_type, content of both kinds of units.

    ``units`` has chunk_id, unit_type, content, source_path and the ``CONTENT_FIELDS``; ``evidence`` evidence_id, doc_id,
    evidence_type, source_evidence_id, content and the same fields; lists are arrays. A field that is absent counts as empty.
    """
    content = lambda df: record_content(F.col("content"), _fields(df))
    return units.select(*_of_unit(content(units))).unionByName(evidence.select(*_of_evidence("evidence_id", content(evidence))))


def records_of_chunks(chunks: DataFrame) -> DataFrame:
    """The records of :func:`records` for chunks that are both, the unit and the evidence of one id: each chunk is read once."""
    made = chunks.withColumn("record", record_content(F.col("content"), _fields(chunks)))
    return made.select(F.inline(F.array(F.struct(*_of_unit(F.col("record"))), F.struct(*_of_evidence("chunk_id", F.col("record"))))))


def leaders(vectors: DataFrame, id_col: str = "vec_id", n_leaders: int | None = None) -> DataFrame:
    """leader, embedding: twice the square root of the number of rows as leaders (``MAX_LEADERS`` at most), chosen by a hash of the id.

    Leaders have one length: that of the vector of the first of them.
    """
    usable = vectors.filter(F.size("embedding") > 0).select(F.col(id_col).alias("leader"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    n = n_leaders or min(MAX_LEADERS, math.ceil(2 * math.sqrt(usable.count())))
    first = usable.withColumn("h", F.md5(F.col("leader").cast("string"))).orderBy("h", "leader").limit(max(1, n))
    return first.join(first.agg(F.min_by(F.size("embedding"), "h").alias("dims")), F.size("embedding") == F.col("dims")).select("leader", "embedding")


def _cells(rows: DataFrame, vector: str, lead: DataFrame, probes: int | None = None) -> DataFrame:
    """``rows`` with ``cell``, the number of the most similar leader in order of their ids, or with ``cells``: a bit for each of the ``probes`` most similar."""
    known = sorted(((r["leader"], r["embedding"]) for r in lead.collect()), key=lambda x: x[0])
    matrix = np.array([v for _, v in known], np.float64) if known else np.zeros((0, 0))
    length = np.sqrt((matrix * matrix).sum(axis=1))
    matrix = matrix / np.where(length > 0, length, 1)[:, None]
    shipped = rows.sparkSession.sparkContext.broadcast(matrix)
    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shipped.value
        for b in batches:
            listed = b.column(at)
            sizes = np.array([-1 if n is None else n for n in pa.compute.list_value_length(listed).to_pylist()], np.int64)
            fit = np.flatnonzero(sizes == base.shape[1]) if base.size else np.zeros(0, np.int64)
            cell, bits = np.full(b.num_rows, OTHER, np.int32), [bytes(-(-len(base) // 8))] * b.num_rows
            # One block of scores at a time, however many rows a batch has.
            for lo in range(0, len(fit), SCORED):
                part = fit[lo : lo + SCORED]
                x = listed.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                norm = np.sqrt((x * x).sum(axis=1))
                score = np.round(x @ base.T / np.where(norm > 0, norm, 1)[:, None], 6)
                if probes is None:
                    cell[part] = score.argmax(axis=1)
                    continue
                probed = np.zeros(score.shape, bool)
                np.put_along_axis(probed, np.argsort(-score, axis=1, kind="stable")[:, :probes], True, axis=1)
                for k, packed in zip(part.tolist(), np.packbits(probed, axis=1, bitorder="little")):
                    bits[k] = packed.tobytes()
            made = pa.array(cell) if probes is None else pa.array(bits, pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "cell" if probes is None else "cells"])

    more = T.StructField("cell", T.IntegerType()) if probes is None else T.StructField("cells", T.BinaryType())
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, more]))


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", n_leaders: int | None = None) -> None:
    """Write the index below ``path``: ``leaders`` and ``cells`` (the rows with their cell, by cell)."""
    lead = leaders(vectors, id_col, n_leaders)
    lead.write.mode("overwrite").parquet(f"{path}/leaders")
    lead = vectors.sparkSession.read.parquet(f"{path}/leaders")
    placed = _cells(vectors, "embedding", lead)
    placed.repartitionByRange("cell", id_col).sortWithinPartitions("cell", id_col).write.mode("overwrite").parquet(f"{path}/cells")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: float, metric: str = "COSINE", overfetch: int = 5, filters: Column | None = None, keep: Column | None = None, source: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of the rows in the probed cells the ``k * overfetch`` best, then ``keep`` and the first of each ``source``, then k.

    ``queries`` has query_id and q; ``filters`` is applied while scanning. Queries are broadcast in blocks of counted size with
    the cells that they probe, a bit a cell, so a row meets only the queries of its own cell and each task cuts before the shuffle.
    ``probes`` is the share of the cells that a query probes.
    """
    lead = spark.read.parquet(f"{path}/leaders")
    n_leaders = lead.count()
    rows = spark.read.parquet(f"{path}/cells")
    pool = rows.filter(filters) if filters is not None else rows
    # By range, so that a task has few cells of many rows each.
    pool = pool.repartitionByRange(TASKS * spark.sparkContext.defaultParallelism, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    # What ``keep`` may ask for is not known.
    carry = [c for c in rows.columns if c not in ("vec_id", "embedding", "cell")] if keep is not None else [source] if source else []
    size = queries.agg(F.coalesce(F.sum(F.size("q") * 8 + 64 + n_leaders // 8), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // QUERY_BLOCK))
    found = None
    for i in range(n_blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i) if n_blocks > 1 else queries
        asked = _cells(block.select("query_id", "q"), "q", lead, math.ceil(probes * n_leaders))
        scored = nearest(pool, asked, k * overfetch, metric, cell="cell", carry=carry)
        best = top_k(scored, k * overfetch, id_col="vec_id")
        if keep is not None:
            best = best.filter(keep)
        if source:
            first = Window.partitionBy("query_id", source).orderBy("rank")
            best = best.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
        best = top_k(best.drop("rank"), k, id_col="vec_id").select("query_id", "rank", "vec_id", *([source] if source else []), "score")
        found = best if found is None else found.unionByName(best)
    return found


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, recall: share of the exact rows (query_id, vec_id) that the approximate result holds, averaged over the queries."""
    hit = exact.select("query_id", "vec_id").join(approximate.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    each = hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("part"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("part"), 6).alias("recall"))
