"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import align, chat, decontaminate, exact_dedup, html_main, licenses, line_dedup, pieces, pii, quality, simhash_vp, spelling, suffix_dedup
from quarry.llm.common import table

PIECE_MODEL = corpus_pipeline.PIECE_MODEL
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PII_KEY = corpus_pipeline.PII_KEY


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    return chat.digests(turns.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.replace(table(spark, sf_dir, "documents"), PII_KEY)
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["kind"]), ",").alias("kinds"), "text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = licenses.scan(table(spark, sf_dir, "documents"))
    return done.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "rules", "licences")])


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(PIECE_MODEL))
    return done.select("doc_id", "n_tokens", "round_trip", "ids")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_compared", F.round("similarity", 6).alias("similarity"), "first_word")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",")
    return done.select(
        "doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), "n_removed_chars", spans.alias("removed_spans"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents"), slip=31))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(table(spark, sf_dir, "documents"), align.Tokenizers.load(BYTE_MODEL, PIECE_MODEL))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *exact_dedup.OUTPUTS)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_suffix_array_dedup, op2_chat_formatting, op3_pii_surrogates, op4_license_scan, op5_sentencepiece, op6_simhash_near_dedup, op7_html_extraction, op8_benchmark_decontamination, op9_quality_rules, op10_line_dedup, op11_spelling_variants, op12_cross_tokenizer_alignment, op13_exact_dedup)}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from quarry.llm import oracles

    found = oracles.SQL
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
