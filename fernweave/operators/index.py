"""The index as tables: upsert and delete by document, listing, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sentences import chunks_udf
from ..functions.text import word_count
from ..settings import DEFAULT, Settings


def chunk_documents(docs: DataFrame, settings: Settings = DEFAULT, first_pos: int = 0) -> DataFrame:
    """Chunk rows of documents; narrow. Insertion order is pos, then ordinal: pos is first_pos and the document's own `pos` if it has one, else a unique number in any order."""
    base = F.col("pos") if "pos" in docs.columns else F.monotonically_increasing_id()
    cut = docs.withColumn("base", base).withColumn("parts", chunks_udf(settings.chunk_size, settings.chunk_overlap, settings.min_chunk_words)("text"))
    each = cut.select("doc_id", "title", "source", "metadata", "base", F.posexplode("parts").alias("ordinal", "text"))
    return each.select(F.concat_ws("::", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "title", "text", "ordinal", "source", "metadata", (F.lit(first_pos) + F.col("base")).alias("pos"))


def latest(docs: DataFrame) -> DataFrame:
    """One row for each doc_id: the last by pos. (A batch with an id twice keeps its later document.)"""
    last = Window.partitionBy("doc_id").orderBy(F.desc("pos"))
    return docs.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")


def delete(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """chunks without those of doc_ids; what else they carry, vectors too, stays as it is."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select(chunks.columns)


def removed_count(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """One row: n_removed."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*").alias("n_removed"))


def upsert(chunks: DataFrame, doc_ids: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """chunks with those of doc_ids replaced by new_chunks; an id without new chunks is gone."""
    return delete(chunks, doc_ids).unionByName(new_chunks.select(chunks.columns))


def document_ids(chunks: DataFrame) -> DataFrame:
    """The distinct doc_ids."""
    return chunks.select("doc_id").distinct()


def list_documents(chunks: DataFrame) -> DataFrame:
    """doc_id, title, source, n_chunks, n_words, first_pos; in order of insertion by first_pos."""
    place = F.struct("pos", F.col("ordinal") if "ordinal" in chunks.columns else F.lit(0))
    return chunks.groupBy("doc_id").agg(F.min_by("title", place).alias("title"), F.min_by("source", place).alias("source"), F.count("*").alias("n_chunks"), F.sum(word_count(F.col("text"))).alias("n_words"), F.min("pos").alias("first_pos"))


def stats(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, n_documents."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_documents"))


def upload_status(batch: DataFrame, indexed: DataFrame, supported: tuple[str, ...] = ("txt", "md", "markdown", "pdf")) -> DataFrame:
    """doc_id, source, status (skipped, added, updated), reason, place: sorted by place, skipped rows come before the others.

    batch: doc_id, source (file name), text, pos, and `problem` if it's known why a file can't be indexed. Skipped: a file
    with a problem, of a suffix that isn't supported, or without text.
    """
    suffix = F.lower(F.regexp_extract("source", r"\.([^.]+)$", 1))
    problem = F.col("problem") if "problem" in batch.columns else F.lit(None).cast("string")
    reason = F.coalesce(problem, F.when(~suffix.isin(*supported), "unsupported file type").when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text found"))
    known = batch.join(document_ids(indexed).withColumn("known", F.lit(True)), "doc_id", "left")
    status = F.when(reason.isNotNull(), "skipped").when(F.col("known"), "updated").otherwise("added")
    told = known.select("doc_id", "source", status.alias("status"), reason.alias("reason"), "pos")
    return told.withColumn("place", F.struct((F.col("status") != "skipped").alias("late"), "pos"))
