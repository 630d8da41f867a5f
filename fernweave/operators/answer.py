"""Extractive answers with citations, as table operations over the passages of a set of questions.

Passages stay columns from retrieval to the answer (qid, marker, title, source, text); no prompt is built and parsed
again. Markers count from 1 in rank order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import INSUFFICIENT_CONTEXT, content_words, failure_reason, naive_sentences, parse_citations, strip_headings, strip_invalid_citations, word_count
from ..functions.text import build_prompt
from ..functions.vectors import with_retries
from ..settings import DEFAULT, Settings
from .sizes import small

#: Fixed values of the selection: sentences quoted, least shared words, how far below the best a similarity may lie.
MOST_SENTENCES, LEAST_OVERLAP, SLACK = 3, 2, 0.15
NO_ANSWER = "The indexed documents do not contain enough information to answer this question."
NOTHING_FOUND = "I could not find anything relevant in the indexed documents."


#: What a hosted model is told to do; it must abstain with the token, and cite by markers.
SYSTEM = f"Answer the question from the numbered passages alone. End every statement with the marker of its passage, such as [1] or [2][3]. Point out where passages disagree. Write two to four sentences unless more are needed. If the passages do not answer the question, reply with {INSUFFICIENT_CONTEXT} and nothing else."


class AnswerEngine(Protocol):
    """A hosted model: complete(system, prompt, temperature, max_output_tokens) returns the text. It runs in the Python workers and so must pickle. Its failures fall back to extraction."""

    name: str

    def complete(self, system: str, prompt: str, temperature: float, max_output_tokens: int) -> str: ...


def candidates(contexts: DataFrame) -> DataFrame:
    """qid, marker, spos, sentence: each distinct sentence of a question's passages at its first place, without headings."""
    split = contexts.select("qid", "marker", F.posexplode(naive_sentences(strip_headings(F.col("text"), F.col("title")))).alias("spos", "sentence"))
    first = Window.partitionBy("qid", F.lower("sentence")).orderBy("marker", "spos")
    return split.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def by_words(sentences: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, place, marker, sentence, overlap: up to three sentences that share two content words or more with the question."""
    words = questions.select("qid", content_words(F.col("question")).alias("asked"))
    shared = F.size(F.array_intersect("asked", content_words(F.col("sentence"))))
    scored = sentences.join(small(words), "qid").withColumn("overlap", shared).filter(F.col("overlap") >= LEAST_OVERLAP)
    order = Window.partitionBy("qid").orderBy(F.desc("overlap"), "marker", "spos")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MOST_SENTENCES).select("qid", "place", "marker", "sentence", "overlap")


def by_meaning(sentences: DataFrame, similarity: Column, least: float = 0.45) -> DataFrame:
    """qid, place, marker, sentence, similarity: of the three most similar, those at or over max(least, best - 0.15); none if the best is under least."""
    scored = sentences.withColumn("similarity", similarity)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", 9)), "marker", "spos")
    best = F.max("similarity").over(Window.partitionBy("qid"))
    placed = scored.withColumn("place", F.row_number().over(order)).withColumn("best", best)
    floor = F.greatest(F.lit(float(least)), F.col("best") - SLACK)
    return placed.filter((F.col("place") <= MOST_SENTENCES) & (F.col("best") >= least) & (F.col("similarity") >= floor)).select("qid", "place", "marker", "sentence", "similarity")


def extractive(selected: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, text: the chosen sentences with their markers, or the token for insufficient context."""
    joined = selected.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "sentence", "marker"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["sentence"], F.lit(" ["), x["marker"].cast("string"), F.lit("]"))), " ")
    return questions.select("qid").join(joined.select("qid", text.alias("text")), "qid", "left").select("qid", F.coalesce("text", F.lit(INSUFFICIENT_CONTEXT)).alias("text"))


def hosted(contexts: DataFrame, questions: DataFrame, engine: AnswerEngine, settings: Settings = DEFAULT) -> DataFrame:
    """qid, text, failure, latency_ms: the hosted model's answer to each question that has passages, or why there is none."""

    @F.pandas_udf("text string, failure string, latency_ms double")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        rows = []
        for prompt in prompts:
            began = time.perf_counter()
            try:
                told = with_retries(lambda: engine.complete(SYSTEM, prompt, settings.temperature, settings.max_output_tokens), settings.max_retries, settings.retry_base_delay, True), None
            except Exception as e:  # any failure of a hosted engine
                told = None, failure_reason(str(e))
            rows.append((*told, 1000 * (time.perf_counter() - began)))
        return pd.DataFrame(rows, columns=["text", "failure", "latency_ms"])

    passages = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("marker", "title", "source", "text"))).alias("passages"))  # top_k of each question at most
    asked = questions.select("qid", "question").join(passages, "qid")
    return asked.select("qid", ask.asNondeterministic()(build_prompt(F.col("question"), F.col("passages"))).alias("x")).select("qid", "x.*")


def notice_of(failure: Column) -> Column:
    """What an answer says that quotes the documents because the hosted model failed; null without a failure."""
    return F.concat(F.lit("The hosted model did not answer ("), failure, F.lit("); this answer quotes the documents."))


def finish(raw: DataFrame, contexts: DataFrame, questions: DataFrame, most: int, engine: str = "extractive", *also: str) -> DataFrame:
    """qid, question, text, cited_ordinals, abstained, usage, engine, and what else of raw is named: abstentions told, citations parsed, wrong ones removed."""
    passages = contexts.groupBy("qid").agg(F.count("*").alias("n"), F.sum(word_count(F.col("text"))).cast("int").alias("words"))
    rows = questions.join(raw, "qid", "left").join(passages, "qid", "left")
    n = F.coalesce("n", F.lit(0))
    valid = F.col("text")
    for i in range(most):
        valid = F.when(n == i, strip_invalid_citations(F.col("text"), i)).otherwise(valid)
    valid = F.when(n >= most, strip_invalid_citations(F.col("text"), most)).otherwise(valid)
    abstained = (n == 0) | F.coalesce("text", F.lit(INSUFFICIENT_CONTEXT)).contains(INSUFFICIENT_CONTEXT)
    none = F.array().cast("array<int>")
    usage = F.create_map(F.lit("prompt_tokens"), F.coalesce("words", F.lit(0)) + word_count(F.col("question")), F.lit("output_tokens"), word_count(F.coalesce("text", F.lit(""))))
    return rows.select(
        "qid",
        "question",
        F.when(n == 0, NOTHING_FOUND).when(abstained, NO_ANSWER).otherwise(valid).alias("text"),
        F.when(abstained, none).otherwise(parse_citations(F.col("text"), n)).alias("cited_ordinals"),
        abstained.alias("abstained"),
        usage.alias("usage"),
        F.lit(engine).alias("engine"),
        *also,
    )


def citations(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """qid, marker, title, source of each cited passage, in order of citation."""
    cited = answers.select("qid", F.posexplode("cited_ordinals").alias("nth", "marker"))
    return cited.join(contexts, ["qid", "marker"]).select("qid", "nth", "marker", "title", "source")


def with_fallback(hosted: Callable[[], object], local: Callable[[], object]) -> tuple[object, str | None]:
    """For one answer: the hosted one, or the local one with a notice that says why. For sets of questions: hosted()."""
    try:
        return hosted(), None
    except Exception as e:  # any failure of a hosted engine; the local engine's own are raised
        return local(), f"The hosted model did not answer ({failure_reason(str(e))}); this answer quotes the documents."
