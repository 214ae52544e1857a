"""Exact dedup by skew-safe combining: of equal texts one row stays.

Rows are combined in three stages, each of which groups by the digest *and* the full text, so that texts with one
digest are never taken for equal:

1. locally: the map side of the first aggregation leaves one row per text and task;
2. salted: digests that hold more than 1 / ``HOT`` of all repeated rows (fewer than ``HOT`` digests can, so the list
   is broadcast) are dealt by task over ``SALTS`` salts, all others have one salt; texts are shuffled once;
3. globally: the winners of the salts of one text are combined, at most ``SALTS`` rows a text.

Flags return to the rows by a join on the digest alone, without texts: by broadcast for the hot digests, so that a
third of all rows with one text meet in no task, by a shuffle of (id, digest) for the rest. Digests that more than one
text has are joined by digest and text.

Defined results: null text is an empty one; the largest id stays and nulls are the smallest; rows with one id and one
text are one document, so ``mark`` gives each of them the same result and ``survivors`` returns one of them; an empty table
stays empty; extra columns pass through and columns named as the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_name, materialized

HOT, SALTS = 1000, 64
OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")
#: Bytes of the digest that groups rows; fewer make digests of different texts meet (tests).
DIGEST_BYTES = 32


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` (rows of its text), ``kept`` and ``text_sha256``."""
    own = [c for c in docs.columns if c not in OUTPUTS]
    text, sha, key, salt, n, best = (free_name(docs, c) for c in ("text_whole", "text_digest", "text_key", "text_salt", "text_rows", "text_best"))
    rows = docs.select(*own, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text)).withColumn(sha, F.unhex(F.sha2(F.col(text), 256)))
    rows = rows.withColumn(key, F.col(sha) if digest_bytes >= DIGEST_BYTES else F.substring(F.col(sha), 1, digest_bytes))

    repeated = materialized(rows.groupBy(key).agg(F.count("*").alias(n)).filter(F.col(n) > 1), "exact-repeated")
    total = repeated.agg(F.sum(n)).first()[0] or 0
    hot = repeated.filter(F.col(n) * HOT > total).select(key)

    is_hot = free_name(docs, "text_hot")
    dealt = rows.join(F.broadcast(hot.withColumn(is_hot, F.lit(True))), key, "left").withColumn(salt, F.when(F.col(is_hot), F.spark_partition_id() % SALTS).otherwise(-1))
    winners = dealt.groupBy(salt, key, text).agg(F.max(id_col).alias(best), F.count("*").alias(n))
    winners = materialized(winners.withColumn(text, F.when(F.col(salt) >= 0, F.col(text))), "exact-winners")
    combined = winners.filter(F.col(salt) >= 0).groupBy(key, text).agg(F.max(best).alias(best), F.sum(n).alias(n))
    cold = winners.filter(F.col(salt) < 0).select(key, best, n)

    several = cold.unionByName(combined.select(key, best, n)).groupBy(key).agg(F.count("*").alias(n)).filter(F.col(n) > 1).select(key)
    several = materialized(several, "exact-several")
    shared = not several.isEmpty()
    plain = rows.join(several, key, "left_anti") if shared else rows
    # Every group of one row is its own result, so only larger ones are joined; a hot digest of one text has one row here.
    done = plain.join(F.broadcast(hot.withColumn(is_hot, F.lit(True))), key, "left")
    parts = [
        done.filter(F.col(is_hot)).drop(is_hot).join(F.broadcast(_alone(combined.select(key, best, n), several, key, shared)), key, "left"),
        done.filter(F.col(is_hot).isNull()).drop(is_hot).join(_alone(cold.filter(F.col(n) > 1), several, key, shared), key, "left"),
    ]
    if shared:
        met = rows.join(several, key, "left_semi")
        parts.append(met.join(met.groupBy(key, text).agg(F.max(id_col).alias(best), F.count("*").alias(n)), [key, text], "left"))
    results = [_results(p, own, id_col, sha, best, n) for p in parts]
    out = results[0]
    for p in results[1:]:
        out = out.unionByName(p)
    return out


def _alone(groups: DataFrame, several: DataFrame, key: str, shared: bool) -> DataFrame:
    """Groups whose digest has one text."""
    return groups.join(several, key, "left_anti") if shared else groups


def _results(rows: DataFrame, own: list[str], id_col: str, sha: str, best: str, n: str) -> DataFrame:
    keep = F.when(F.col(n).isNull(), F.col(id_col)).otherwise(F.col(best))
    return rows.select(*own, keep.alias("keep_id"), F.coalesce(F.col(n), F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col(id_col)).alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only: one for each different text."""
    done = mark(docs, id_col, text_col).filter("kept")
    return done.dropDuplicates([id_col, "text_sha256"]).select(*[c for c in docs.columns if c not in OUTPUTS])
