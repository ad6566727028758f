"""Queries of this subpackage: (spark, sf_dir) to a DataFrame, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import ann, bytebpe, cotrain, decontam, licences, linechunks, lmscore, ngramjoin, toxicity, warc
from tracewright.llm.common import table


def op1_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.op1_cotrain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.op2_line_dedup(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op3_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.op4_byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op5_licences(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.op6_lm_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op7_decontam(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.op8_ngram_join(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op9_warc(table(spark, sf_dir, "pages"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op10_ann(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_cotrain, op2_line_dedup, op3_toxicity, op4_byte_bpe, op5_licences, op6_lm_score, op7_decontam, op8_ngram_join, op9_warc, op10_ann)}
ORACLES: dict[str, str] = {"op7_decontam": decontam.ORACLE, "op8_ngram_join": ngramjoin.ORACLE, "op9_warc": warc.ORACLE}
