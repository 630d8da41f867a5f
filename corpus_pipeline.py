"""The corpus pipeline: from documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents, but
for the last, which returns doc_id, n_tokens, ids and decoded_sha256. Every stage's result is written to the shared
folder and read again, so that a lost executor costs tasks of one stage only; it's deleted once the next one is written.

Defined results: rows of null or empty text, or without a letter, go in the first stage. A row with null doc_id is judged like any
other, but stays where near-duplicates are dropped, since no document is less. Of rows that share a doc_id, those of different
groups are judged each for itself, and of those in one group one stays. An empty table gives an empty table, an empty
benchmark drops nothing. Columns beyond those of documents, whatever their names, go through all stages but the last.
Texts of any length are worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernweave.llm import bpe, decontam, langid, pii, simhash
from fernweave.llm.common import drop, durable_at, release, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with half of the probability, go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by fingerprints or by shared five-word shingles, the document of least doc_id stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten successive words of a benchmark item, or a whole shorter item, go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids, which are decoded again as a check."""
    return bpe.bpe_tokens(docs, bpe.default_codec())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: SQL can't express language models, near-duplicate components or sub-word merges; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = durable_at(stage(spark, docs, sf_dir))
        release(spark)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
