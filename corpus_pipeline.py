"""The corpus pipeline: documents to token ids, in stages that are each written and read again.

Toxic documents go; later copies of long line runs are cut out, and documents that this leaves
without a word go; of each group of near duplicates one row stays, that with the smallest id (null
comes last), whatever other rows have its id; documents that leak a benchmark item go; what is left
is encoded, and decoded again. A null text passes the filters and is encoded as empty.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.llm import bpe_codec, decontaminate, line_dedup, ngram_join, toxicity
from plotwright.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs)
    cut_out = F.size("deleted_lines") > 0
    cleaned = cleaned.where(~cut_out | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cleaned.withColumn("n_chars", F.when(cut_out, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe_codec", encode),
]

#: Compression, suffix ranks and tiling are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    first = STAGES[:-1]
    docs = reduce(lambda docs, stage: cut(stage[1](spark, docs, sf_dir)), first, table(spark, sf_dir, "documents"))
    return STAGES[-1][1](spark, docs, sf_dir)
