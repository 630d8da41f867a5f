"""Files to documents: text, markdown and PDF, from any store that Spark reads."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sentences import reflow
from ..schema import QUESTION

SUFFIXES = ("txt", "md", "markdown", "pdf")
_SCHEME = r"^[a-z0-9]+:/*(?=/)"


def decoded(content: Column) -> Column:
    """UTF-8 text; bytes that aren't become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def _pdf_text(content: bytes) -> str:
    """Each page reflowed, pages apart by an empty line."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise RuntimeError("reading PDF files needs the optional package pypdf") from None
    return "\n\n".join(reflow(p.extract_text() or "") for p in PdfReader(io.BytesIO(content)).pages)


def _pdf_texts(strict: bool):
    """Texts of PDF contents, null for null; a file that can't be read fails the job if `strict`, else it's null as well."""

    def one(content: bytes | None) -> str | None:
        if content is None:
            return None
        try:
            return _pdf_text(content)
        except RuntimeError:  # the package is missing
            raise
        except Exception:
            if strict:
                raise
            return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield contents.map(one, na_action="ignore").astype(object)

    return F.pandas_udf(run, "string")


def _named(files: DataFrame, root: str | None) -> DataFrame:
    """files with key (the path below `root`, or the bare name), source (the base name) and suffix."""
    path = F.regexp_replace(F.col("path"), _SCHEME, "")
    prefix = None if root is None else re.sub(_SCHEME, "", root).rstrip("/") + "/"
    key = F.regexp_replace(path, r"^.*/", "") if prefix is None else F.when(path.contains(prefix), F.substring_index(path, prefix, -1)).otherwise(path)
    named = files.withColumn("key", key).withColumn("source", F.regexp_replace("key", r"^.*/", ""))
    return named.withColumn("suffix", F.lower(F.regexp_extract("source", r"\.([^.]+)$", 1)))


def _raw(strict: bool = True) -> Column:
    """Text of (content, suffix) in one pass over the files; only PDF contents go to Python."""
    pdf = F.col("suffix") == "pdf"
    return F.when(pdf, _pdf_texts(strict)(F.when(pdf, F.col("content")))).otherwise(decoded(F.col("content")))


def documents(files: DataFrame, root: str | None = None) -> DataFrame:
    """doc_id, title, text, source, metadata, pos of supported files with text. files: path, content (as binaryFile has them).

    A file's identity is its path below `root`, or its bare name without one; pos follows the paths' order, component by
    component. Only keys are sorted, by ranges over all partitions; pos has gaps between the ranges.
    """
    kept = _named(files, root).filter(F.col("suffix").isin(*SUFFIXES))
    texts = kept.select("key", "source", "suffix", T.normalize_whitespace(_raw()).alias("text")).filter("text <> ''")
    placed = kept.select("key").orderBy(F.split("key", "/")).select("key", F.monotonically_increasing_id().alias("pos"))
    return texts.join(placed, "key").select(T.doc_id_of(F.col("key")).alias("doc_id"), T.title(F.col("text"), F.col("source")).alias("title"), "text", "source", F.create_map(F.lit("suffix"), F.col("suffix")).alias("metadata"), "pos")


def uploads(files: DataFrame, max_mb: int) -> DataFrame:
    """Files as a batch of uploads: doc_id, title, text, source, metadata, pos, and `problem`, null if the file can be indexed.

    files: path, length, content. Names are made harmless, and a file's identity is its name. Contents over the limit are
    neither decoded nor kept.
    """
    own = _named(files, None).withColumn("source", T.safe_filename(F.col("source")))
    supported, fits = F.col("suffix").isin(*SUFFIXES), F.col("length") <= max_mb << 20
    kept = own.withColumn("content", F.when(supported & fits, F.col("content")))
    read = kept.select("source", "suffix", supported.alias("supported"), fits.alias("fits"), T.normalize_whitespace(_raw(False)).alias("text"))
    problem = F.when(~F.col("supported"), "unsupported file type").when(~F.col("fits"), f"larger than the {max_mb} MB limit").when(F.col("text").isNull(), "the file could not be read").when(F.col("text") == "", "no text found")
    return read.select(T.doc_id_of(F.col("source")).alias("doc_id"), T.title(F.coalesce("text", F.lit("")), F.col("source")).alias("title"), "text", "source", F.create_map(F.lit("suffix"), F.col("suffix")).alias("metadata"), F.monotonically_increasing_id().alias("pos"), problem.alias("problem"))


def load_directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Documents of a folder and its subfolders. (Spark leaves out names that begin with _ or a dot.)"""
    return documents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path), path)


def load_file(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark.read.format("binaryFile").load(path))


def load_uploads(spark: SparkSession, path: str, max_mb: int) -> DataFrame:
    return uploads(spark.read.format("binaryFile").load(path), max_mb)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records of a JSON-lines file; an error if it has none."""
    rows = spark.read.schema(QUESTION).json(path).filter(F.col("id").isNotNull())
    if rows.isEmpty():
        raise ValueError(f"no evaluation records in {path}")
    return rows


def from_table(docs: DataFrame) -> DataFrame:
    """Documents from a table (doc_id, text, source): title is the source, pos the id."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), "text", "source", F.create_map().cast("map<string,string>").alias("metadata"), F.col("doc_id").cast("bigint").alias("pos"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Documents from web pages (page_id, url, html)."""
    return pages.select(T.doc_id_of(F.col("url")).alias("doc_id"), T.page_title(F.col("html")).alias("title"), T.page_text(F.col("html")).alias("text"), F.col("url").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"), F.col("page_id").cast("bigint").alias("pos"))
