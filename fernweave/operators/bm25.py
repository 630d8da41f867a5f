"""BM25 over chunks: an inverted index by grouped counts, scores by a join for a whole set of questions.

Chunks have chunk_id, pos and, if a document has several, ordinal (insertion order, which breaks ties), title, text. Only
postings of terms that questions have are read for scores. A contribution is a whole number of 1e-13ths, so that sums
are exact, are combined before the shuffle, and equal chunks score equal under any partitioning; ranks go by nine decimals.

save() keeps the index as tables: postings by term, document frequencies, and sums. fit() makes it anew from chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..settings import DEFAULT, Settings
from .sizes import fits

#: Parts of 1 that contributions are counted in.
UNIT = 10_000_000_000_000
PLACE = ("chunk_id", "pos", "ordinal")


def _placed(chunks: DataFrame) -> DataFrame:
    return chunks if "ordinal" in chunks.columns else chunks.withColumn("ordinal", F.lit(0))


def tokens_of(chunks: DataFrame) -> DataFrame:
    """chunk_id, pos, ordinal, tokens, dl."""
    title = F.col("title") if "title" in chunks.columns else F.lit("")
    own = _placed(chunks).select(*PLACE, tokenize(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))).alias("tokens"))
    return own.withColumn("dl", F.size("tokens"))


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.select(*PLACE, "dl", F.explode("tokens").alias("term")).groupBy("term", *PLACE, "dl").agg(F.count("*").alias("tf"))


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, pos, ordinal, dl, tf."""
    return _counted(tokens_of(chunks))


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """term, df."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _raw_idf(n: Column) -> Column:
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _mean_idf(frequencies: DataFrame, size: DataFrame) -> DataFrame:
    """size's row with avg_idf: terms of one frequency are counted before their idf is taken."""
    by = frequencies.groupBy("df").agg(F.count("*").alias("terms")).crossJoin(F.broadcast(size))
    total = by.agg((F.sum(_raw_idf(F.col("n_chunks")) * F.col("terms")) / F.sum("terms")).alias("avg_idf"))
    return size.crossJoin(total)  # one row each


def _size(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, avgdl, avg_idf."""
    tokens = tokens_of(chunks)
    return _mean_idf(document_frequencies(tokens), _size(tokens))


def _weighted(frequencies: DataFrame, stats: DataFrame, settings: Settings) -> DataFrame:
    idf = _raw_idf(F.col("n_chunks"))
    return frequencies.crossJoin(F.broadcast(stats)).select("term", "df", F.when(idf < 0, settings.bm25_epsilon * F.col("avg_idf")).otherwise(idf).alias("idf"))  # stats has one row


def term_stats(chunks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """term, df, idf: negative values become epsilon times the mean over the vocabulary."""
    return _weighted(document_frequencies(tokens_of(chunks)), corpus_stats(chunks), settings)


@dataclass(frozen=True)
class Bm25Index:
    """What scoring needs: postings, term frequencies, and a one-row table of sums. `tokens`, if the index isn't saved, are what postings are counted from."""

    frequencies: DataFrame
    stats: DataFrame
    postings: DataFrame | None = None
    tokens: DataFrame | None = None

    @classmethod
    def fit(cls, chunks: DataFrame, settings: Settings = DEFAULT) -> Bm25Index:
        tokens = tokens_of(chunks)
        frequencies = document_frequencies(tokens)
        return cls(frequencies, _mean_idf(frequencies, _size(tokens)), tokens=tokens)

    def of_terms(self, wanted: DataFrame) -> DataFrame:
        """Postings of the wanted terms."""
        if self.postings is not None:
            return self.postings.join(wanted, "term", "left_semi")
        found = self.tokens.select(*PLACE, "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
        return found.groupBy("term", *PLACE, "dl").agg(F.count("*").alias("tf"))


def save(chunks: DataFrame, folder: str) -> None:
    """Write the lexical tables of chunks to a folder."""
    spark = chunks.sparkSession
    postings(chunks).repartitionByRange("term").sortWithinPartitions("term", "pos", "ordinal").write.parquet(f"{folder}/postings")
    kept = spark.read.parquet(f"{folder}/postings")
    kept.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{folder}/terms")
    frequencies = spark.read.parquet(f"{folder}/terms")
    # Every token of a chunk is in a posting, so lengths sum up to the postings' counts.
    size = chunks.agg(F.count("*").alias("n_chunks")).crossJoin(kept.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))).select("n_chunks", F.try_divide("n_tokens", "n_chunks").alias("avgdl"))
    _mean_idf(frequencies, size).coalesce(1).write.parquet(f"{folder}/stats")


def load(spark: SparkSession, folder: str) -> Bm25Index:
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Bm25Index(read("terms"), read("stats"), postings=read("postings"))


def question_terms(questions: DataFrame) -> DataFrame:
    """qid, qpos, term: every token, repetitions too."""
    return questions.select("qid", F.posexplode(tokenize(F.col("question"))).alias("qpos", "term"))


def topk(index: Bm25Index, questions: DataFrame, k: int = 20, settings: Settings = DEFAULT) -> DataFrame:
    """qid, chunk_id, pos, score, rank of each question's k best chunks, those with score over 0. questions: qid, question."""
    asked = question_terms(questions).groupBy("qid", "term").agg(F.count("*").alias("times"))
    hint = F.broadcast if fits(asked) else lambda df: df  # the terms and their weights are no more than what's asked
    wanted = hint(asked.select("term").distinct())
    weighted = asked.join(_weighted(index.frequencies.join(wanted, "term", "left_semi"), index.stats, settings), "term")
    k1, b = settings.bm25_k1, settings.bm25_b
    length = 1 - b + b * F.col("dl") / F.col("avgdl")
    part = F.col("times") * F.round(F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length) * UNIT).cast("bigint")
    parts = index.of_terms(wanted).join(hint(weighted), "term").crossJoin(F.broadcast(index.stats.select("avgdl"))).select("qid", *PLACE, part.alias("x"))
    scored = parts.groupBy("qid", *PLACE).agg((F.sum("x") / UNIT).alias("score")).filter("score > 0")
    return ranked(scored, F.round("score", 9), k, "pos", "ordinal").drop("ordinal")


def ranked(scored: DataFrame, by: Column, k: int, *then: str) -> DataFrame:
    """The k best rows of each qid with their rank, ties by `then`."""
    window = Window.partitionBy("qid").orderBy(by.desc(), *map(F.col, then or ("pos",)))
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
