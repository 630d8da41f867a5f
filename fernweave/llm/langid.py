"""Language identification by word-first backoff (operator 9).

A word that was seen in training scores by its log frequency in each language. An unseen word falls back to its
character 5-grams (with word boundaries), and where none of them was seen, to 4-grams, and so on down to single
characters. A text's score for a language is the sum over its words; the prediction is the largest, and `score` is
its share of the softmax over all languages.

Training takes a bounded sample of labelled documents, about SAMPLE_ROWS: of those whose crc32(doc_id as text) mod 4 is not 2,
the ones whose hash of doc_id and text lies under the share that SAMPLE_ROWS is of their number; of equal rows one. Counts over it
are grouped in Spark; every language of the sample, and every word and n-gram that it has LEAST_COUNT times, is in the model, which
is broadcast. It has no more numbers than the sample has distinct (language, n-gram), some MB.

Defined results: null text and text without a letter give `und` and score 0; with no labelled document everything is
`und`; text of unseen characters alone has equal scores, and the least language name; a null doc_id counts as held
out; ties go to the least language name; repeated rows give repeated rows; columns other than doc_id, text and lang
are not read. Very long texts are scored whole, by their distinct words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, durable_at, map_batches

SAMPLE_ROWS = 12_000
#: The longest n-grams, and how often the sample has what's in the model.
LONGEST, LEAST_COUNT = 5, 3
#: Bytes of words' scores that a worker remembers.
REMEMBERED_BYTES = 16 << 20
#: Part of a seen event that an unseen one counts as.
SMOOTHING = 0.1
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def grams_of(word: str, n: int) -> list[str]:
    """The word's n-grams; from two characters on with a mark at each end."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Level:
    """Log frequencies of words (n = 0) or n-grams by language: `unseen` by language, and what an entry's languages have beyond it, entry after entry."""

    entries: dict[str, int]
    unseen: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    beyond: np.ndarray

    def add_to(self, out: np.ndarray, rows: list[int], found: list[int], share: float) -> None:
        """Add the scores of entries `found` to the rows of out that they stand for."""
        row, entry = np.array(rows, np.int64), np.array(found, np.int64)
        size = self.starts[entry + 1] - self.starts[entry]
        at = np.repeat(self.starts[entry] - np.cumsum(size) + size, size) + np.arange(size.sum())
        flat = np.bincount(np.repeat(row, size) * out.shape[1] + self.languages[at], self.beyond[at], out.size).reshape(out.shape)
        out += share * (flat + np.bincount(row, minlength=len(out))[:, None] * self.unseen)


@dataclass
class Model:
    """Languages in order of their names, and the levels: words, then n-grams of 1 to LONGEST characters."""

    languages: list[str]
    levels: list[Level] = field(default_factory=list)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each language."""
        out = np.zeros((len(words), len(self.languages)))
        rows: list[list[int]] = [[] for _ in self.levels]
        found: list[list[int]] = [[] for _ in self.levels]
        known = self.levels[0].entries
        for i, word in enumerate(words):
            if (entry := known.get(word)) is not None:
                rows[0].append(i)
                found[0].append(entry)
                continue
            for n in range(LONGEST, 0, -1):
                get = self.levels[n].entries.get
                if own := [e for g in grams_of(word, n) if (e := get(g)) is not None]:
                    rows[n] += [i] * len(own)
                    found[n] += own
                    break
        for n, level in enumerate(self.levels):
            if rows[n]:
                level.add_to(out, rows[n], found[n], 1 / max(n, 1))
        return out


class Scorer:
    """A model with the scores of words that this worker has met lately."""

    def __init__(self, model: Model):
        self.model = model
        self.most = max(1000, REMEMBERED_BYTES // (8 * max(len(model.languages), 1)))
        self.table = np.zeros((self.most, len(model.languages)))
        self.rows: dict[str, int] = {}

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.model.languages:
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.model.languages))
        items = list(counts.items())
        for at in range(0, len(items), self.most // 2):  # so that what a part needs is remembered together
            part = items[at : at + self.most // 2]
            new = [w for w, _ in part if w not in self.rows]
            if new:
                if len(self.rows) + len(new) > self.most:
                    self.rows.clear()
                    new = [w for w, _ in part]
                first = len(self.rows)
                self.table[first : first + len(new)] = self.model.scores(new)
                self.rows.update(zip(new, range(first, first + len(new))))
            total += np.array([n for _, n in part], float) @ self.table[[self.rows[w] for w, _ in part]]
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, count) of a batch: n = 0 for words."""
    for batch in batches:
        by: dict[str, Counter] = {}
        for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
            by.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in by.items():
            grams = [words, *(Counter() for _ in range(LONGEST))]
            for w, k in words.items():
                for n in range(1, LONGEST + 1):
                    for g in grams_of(w, n):
                        grams[n][g] += k
            for n, counter in enumerate(grams):
                rows = len(counter)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), pa.array([n] * rows, pa.int32()), pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], names=["lang", "n", "gram", "count"])


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """text and lang of about `rows` labelled documents that aren't held out, or all if they're fewer."""
    open_ = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    share = min(1.0, rows / max(open_.count(), 1))
    mark = F.xxhash64("doc_id", "text") <= F.lit(min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1))
    return open_.filter(mark & F.col("text").isNotNull()).select("doc_id", "text", "lang").distinct().select("text", "lang")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from a sample of the labelled documents that aren't held out."""
    sample = sample_of(docs, sample_rows).repartition(16)
    counts = sample.mapInArrow(_counts, "lang string, n int, gram string, count bigint").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    pair = F.struct("lang", "count")
    by_gram, path = durable_at(counts.groupBy("n", "gram").agg(F.sum("count").alias("total"), F.array_sort(F.collect_list(pair)).alias("by")))  # languages of one entry, of a bounded sample
    sums = by_gram.select("n", F.explode("by").alias("x")).groupBy("n", "x.lang").agg(F.sum("x.count").alias("count")).collect()
    languages = sorted({r.lang for r in sums})
    levels = [_level(by_gram, n, languages, {r.lang: r["count"] for r in sums if r.n == n}) for n in range(LONGEST + 1)] if languages else []
    drop(docs.sparkSession, path)
    return Model(languages, levels)


def _level(by_gram: DataFrame, n: int, languages: list[str], seen: dict[str, int]) -> Level:
    kept = by_gram.filter((F.col("n") == n) & (F.col("total") >= LEAST_COUNT)).orderBy("gram").select("gram", "by.lang", "by.count").toArrow()
    flat = lambda c: kept.column(c).combine_chunks().flatten()
    starts = np.r_[0, np.cumsum(pc.list_value_length(kept.column("lang")).to_numpy().astype(np.int64))]
    places = pc.index_in(flat("lang"), value_set=pa.array(languages)).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.array([seen.get(lang, 0) for lang in languages], float) + SMOOTHING * max(kept.num_rows, 1)
    unseen = np.log(SMOOTHING / total)
    beyond = np.log((flat("count").to_numpy().astype(float) + SMOOTHING) / total[places]) - unseen[places]
    return Level({g: i for i, g in enumerate(kept.column("gram").to_pylist())}, unseen, starts, places, beyond)


def _scorer(broadcast) -> Scorer:
    """The worker's scorer of a broadcast model; it goes with the broadcast."""
    model = broadcast.value
    if "_scorer" not in model.__dict__:
        model._scorer = Scorer(model)
    return model._scorer


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row, without a shuffle; only text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = _scorer(shared)

        def run(ids, texts):
            told = [scorer.predict(t) for t in texts]
            return {"doc_id": ids, "lang_pred": [x for x, _ in told], "score": [x for _, x in told]}

        return run

    return map_batches(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", make)


def langid_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """docs without the rows whose language is undetermined or scores under least_score; columns and their order stay."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            told = [scorer.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least_score for lang, score in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

