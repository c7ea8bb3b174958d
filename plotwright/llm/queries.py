"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_format, decontaminate, html_extract, line_dedup, ngram_join, pii, quality, token_counts, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    forged = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{chat_format.FORGED}'), (-1L, 1L, 'assistant', '{chat_format.FORGED}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(forged)
    return chat_format.digests(chat_format.chat_windows(turns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.pii_spans(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.code_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", F.array_join(F.transform("deleted_lines", lambda x: x.cast("string")), ",").alias("deleted_lines"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_token_counts, op3_chat_format, op4_pii, op5_decontamination, op6_bpe_codec, op7_html_extraction, op8_toxicity, op9_ngram_join, op10_line_dedup)
}
ORACLES = {"op1_quality_rules": quality.ORACLE, "op3_chat_format": chat_format.ORACLE, "op9_ngram_join": ngram_join.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
