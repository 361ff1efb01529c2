"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import ann, bpe, langid, line_dedup, mixing, ngram_join, pii, stream_dedup, token_files, toxicity
from spanloom.llm.common import table


def tokenizer() -> str:
    """The vocabulary file: SPANLOOM_TOKENIZER, or the installed public one."""
    if own := os.environ.get("SPANLOOM_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.query(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), tokenizer())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_mixing, op3_ann, op4_pii, op5_exact_dedup, op6_toxicity, op7_langid, op8_token_files, op9_bpe, op10_line_dedup)}
ORACLE_SQL = {"op5_exact_dedup": stream_dedup.ORACLE_SQL, "op10_line_dedup": line_dedup.ORACLE_SQL}
