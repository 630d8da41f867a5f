"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import avi, bpe, debruijn, decontam, langid, pii, quotes, secrets, simhash, warc
from .common import table


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), bpe.default_codec())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op3_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_report(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.dedup_report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.langid_report(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_bpe": op2_bpe, "op5_decontaminate": op5_decontaminate, "op6_simhash": op6_simhash, "op3_avi": op3_avi, "op10_warc": op10_warc, "op7_substring_dedup": op7_substring_dedup, "op9_language_id": op9_language_id, "op4_pii": op4_pii, "op1_secrets": op1_secrets, "op8_quotes": op8_quotes}

ORACLE_SQL: dict[str, str] = {"op5_decontaminate": decontam.ORACLE, "op7_substring_dedup": debruijn.ORACLE, "op10_warc": warc.ORACLE, "op8_quotes": quotes.ORACLE}
