"""Retrieval and answer metrics for a set of questions.

rankings: qid, id, rank (from 1). relevant: qid, id. Questions: qid and what strata they belong to. Every metric has one row for
each question; summaries average them. All questions, also those that found nothing, are in the result.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _positive(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def source_dedup(hits: DataFrame, k: int | None = None) -> DataFrame:
    """qid, id, rank: each source at its best place among the first k hits, places numbered anew. hits: qid, source, rank."""
    cut = hits.filter(F.col("rank") <= k) if k else hits
    best = cut.groupBy("qid", F.col("source").alias("id")).agg(F.min("rank").alias("best"))
    return best.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("best")).alias("rank"))


def metrics(questions: DataFrame, rankings: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """questions' columns with hit, recall, precision, ndcg (all at k) and rr (over the whole list)."""
    _positive(k)
    wanted = relevant.select("qid", "id").distinct()
    n_relevant = wanted.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    found = rankings.join(wanted, ["qid", "id"]).groupBy("qid").agg(
        F.count_if(F.col("rank") <= k).alias("n_found"),
        F.min("rank").alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.col("rank")))).alias("ranks"),
    )
    gain = lambda r: 1 / F.log2(r + 1)
    add = lambda xs: F.aggregate(F.transform(xs, gain), F.lit(0.0), lambda a, x: a + x)
    n, m = F.coalesce("n_found", F.lit(0)), F.coalesce("n_relevant", F.lit(0))
    ideal = add(F.sequence(F.lit(1), F.least(F.lit(k), m).cast("int")))
    none = F.array().cast("array<int>")
    rows = questions.join(n_relevant, "qid", "left").join(found, "qid", "left")
    return rows.select(
        *questions.columns,
        (n > 0).cast("int").alias("hit"),
        F.when(m > 0, n / m).otherwise(0.0).alias("recall"),
        (n / F.lit(k)).alias("precision"),
        F.when(m > 0, add(F.coalesce("ranks", none)) / F.when(m > 0, ideal)).otherwise(0.0).alias("ndcg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def summary(each: DataFrame, *by: str) -> DataFrame:
    """Means of the metrics, 0 where there is no question; by strata if any are named."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return each.groupBy(*by).agg(F.count("*").alias("n"), *(mean(c).alias(c) for c in ("hit", "recall", "precision", "ndcg", "rr")))


def failures(each: DataFrame) -> DataFrame:
    return each.filter("hit = 0")


def complementarity(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """outcome, n: how many questions both retrievers found, one alone, or none. Both: qid, hit."""
    return outcomes(dense, lexical).groupBy("outcome").agg(F.count("*").alias("n"))


def best_mode(summaries: DataFrame, order: tuple[str, ...] = ("dense", "lexical", "hybrid")) -> DataFrame:
    """The row of largest recall; the first mode in `order` wins ties. summaries: mode, recall, one row a mode."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("mode"))
    return summaries.orderBy(F.desc(F.round("recall", 9)), place).limit(1)


def retrieved(rankings: DataFrame, k: int) -> DataFrame:
    """qid, retrieved: the ids of each question's k best, in order."""
    kept = rankings.filter(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    return kept.select("qid", F.col("r.id").alias("retrieved"))


def sweep(questions: DataFrame, modes: dict[str, DataFrame], relevant: DataFrame, ks: Iterable[int]) -> DataFrame:
    """mode, k, recall, rr, ndcg of each mode's hits (qid, source, rank) at each depth. One retrieval serves all: hits are cut to k, then sources are counted once each."""
    rows = [summary(metrics(questions, source_dedup(hits, k), relevant, k)).select(F.lit(mode).alias("mode"), F.lit(k).alias("k"), "recall", "rr", "ndcg") for k in ks for mode, hits in modes.items()]
    return reduce(DataFrame.unionByName, rows)


def outcomes(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """qid, outcome: which of two retrievers found each question. Both: qid, hit."""
    both = dense.select("qid", F.col("hit").alias("d")).join(lexical.select("qid", F.col("hit").alias("x")), "qid", "full")
    d, x = F.coalesce("d", F.lit(0)), F.coalesce("x", F.lit(0))
    return both.select("qid", F.when((d > 0) & (x > 0), "both").when(d > 0, "dense_only").when(x > 0, "lexical_only").otherwise("both_miss").alias("outcome"))


def keyword_coverage(text: Column, keywords: Column) -> Column:
    """The share of keywords that a text has, in any case; 0 without keywords."""
    low = F.lower(text)
    found = F.size(F.filter(keywords, lambda w: F.contains(low, F.lower(w))))
    return F.when(F.size(keywords) > 0, found / F.size(keywords)).otherwise(0.0)


def answer_metrics(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: keyword_coverage and citation_rate over answerable questions, abstention_accuracy over all. gold: qid, answerable, answer_keywords."""
    rows = gold.join(answers, "qid", "left")
    able, quiet = F.col("answerable"), F.coalesce("abstained", F.lit(True))  # an answerable question that isn't answered cites nothing
    cited = (F.size(F.coalesce("cited_ordinals", F.array().cast("array<int>"))) > 0).cast("double")
    return rows.agg(
        F.coalesce(F.avg(F.when(able, keyword_coverage(F.coalesce("text", F.lit("")), F.col("answer_keywords")))), F.lit(0.0)).alias("keyword_coverage"),
        F.coalesce(F.avg(F.when(able, cited)), F.lit(0.0)).alias("citation_rate"),
        F.coalesce(F.avg((able != quiet).cast("double")), F.lit(0.0)).alias("abstention_accuracy"),
    )


#: Values of a key that are ranked in one window at most, and parts that a range is cut in to get there.
RANKED, PARTS = 50_000, 500


def upper_median(df: DataFrame, column: str, by: str) -> DataFrame:
    """by, p50: of n sorted values the one after n // 2 others. Exact, and no key's rows meet in one task.

    Equal values are counted, not kept. A key of more than RANKED distinct values is narrowed: its range is cut in PARTS by approximate
    quantiles, values are counted by part (combined before the shuffle), and the part that holds the wanted place is what remains.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(by).alias("key"), F.col(column).alias("v")).agg(F.count("*").alias("times"))
    places = values.groupBy("key").agg(F.floor(F.sum("times") / 2).alias("left"), F.min("v").alias("low"), F.max("v").alias("high"))
    while True:
        # State is one row a key, made of aggregates; `left` counts the values still before the wanted one.
        inside = values.join(places.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")))
        inside = inside.filter("v >= low and v <= high").select("key", "v", "times", "left")
        if (inside.groupBy("key").count().agg(F.max("count")).first()[0] or 0) <= RANKED:
            break
        cuts = inside.groupBy("key").agg(F.array_distinct(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS + 1)], 20 * PARTS)).alias("cuts"))
        told = inside.join(cuts.withColumnRenamed("key", "of"), F.col("key").eqNullSafe(F.col("of")))
        part = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        counted = told.groupBy("key", part.alias("part")).agg(F.sum("times").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("left").alias("left"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = counted.withColumn("before", before).filter("before <= left and left < before + n")  # PARTS + 1 rows a key at most
        places = kept.select("key", (F.col("left") - F.col("before")).alias("left"), "low", "high")
    upto = F.sum("times").over(Window.partitionBy("key").orderBy("v"))
    placed = inside.withColumn("upto", upto).filter("upto > left and upto - times <= left")
    return placed.select(F.col("key").alias(by), F.col("v").alias("p50"))
