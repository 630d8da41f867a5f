"""The engine: ingest, upload, query, list, remove and evaluate over one index folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import preview
from .functions.vectors import Embedder, embed, embedder_for, for_questions
from .operators import answer, bm25, dense, evaluate, index, retrieve
from .session import prepared
from .settings import DEFAULT, Settings
from .sources import files, store
from .streaming import ingest_stream

MODES = {"dense": ("dense",), "lexical": ("lexical",), "hybrid": retrieve.SOURCES}
#: Limits of a question's length and of the number of passages asked for.
LONGEST_QUESTION, MOST_PASSAGES = 2000, 20


class Engine:
    """A hybrid retrieval index in a folder of any store that Spark reads. Queries take a set of questions at a time."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, settings: Settings = DEFAULT, llm: answer.AnswerEngine | None = None):
        self.spark, self.path, self.settings, self.llm = prepared(spark), path, settings, llm
        self.embedder = embedder or embedder_for(settings)
        self.backend = settings.resolved_llm_backend(llm is not None)

    # --- index ---

    def _current(self) -> store.Version | None:
        try:
            return store.checked(self.spark, self.path, self.embedder.name)
        except FileNotFoundError:
            return None

    def _chunks_of(self, version: store.Version) -> DataFrame:
        return self.spark.read.parquet(f"{version.folder}/chunks")

    def chunks(self) -> DataFrame | None:
        """The current chunk table, or None before the first document; ValueError if another embedder made it."""
        now = self._current()
        return None if now is None else self._chunks_of(now)

    def _save(self, chunks: DataFrame, base: store.Version | None) -> store.Version:
        return store.save(chunks, self.path, self.embedder.name, self.embedder.dim, base or store.NONE)

    def upsert(self, docs: DataFrame) -> int:
        """Add documents or replace those of the same doc_id (within a batch, the last); returns the number of chunks that came.

        store.Conflict is raised, and nothing changes, if another writer saved the index meanwhile.
        """
        docs, base = index.latest(docs), self._current()
        old = None if base is None else self._chunks_of(base)
        start = 0 if old is None else (old.agg(F.max("pos")).first()[0] or 0) + 1
        new = index.chunk_documents(docs, self.settings, start).withColumn("vector", embed(F.col("text"), self.embedder))
        saved = self._save(new if old is None else index.upsert(old, docs, new), base)
        return self._chunks_of(saved).filter(F.col("pos") >= start).count()

    def ingest(self, path: str) -> tuple[int, int]:
        """Upsert a file or folder: (documents, chunks); ValueError if nothing in it is supported."""
        docs = files.load_directory(self.spark, path)
        n = docs.count()
        if not n:
            raise ValueError(f"nothing supported in {path}")
        return n, self.upsert(docs)

    def upload(self, path: str) -> DataFrame:
        """Upsert the files of a folder by their names: doc_id, source, status (skipped, added, updated), reason, n_chunks; skipped files come first.

        Files that can't be indexed are skipped with a reason: an unsupported type, more than max_upload_mb, unreadable, no text.
        """
        batch = files.load_uploads(self.spark, path, self.settings.max_upload_mb)
        now = self._current()
        known = self.spark.createDataFrame([], "doc_id string") if now is None else self._chunks_of(now)
        told = index.upload_status(batch, known, files.SUFFIXES)
        good = batch.filter("problem is null").drop("problem")
        if not good.isEmpty():
            self.upsert(good)
        saved = self.chunks()
        counts = self.spark.createDataFrame([], "doc_id string, n_chunks bigint") if saved is None else saved.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        n = F.when(F.col("status") == "skipped", 0).otherwise(F.coalesce("n_chunks", F.lit(0)))
        return told.join(counts, "doc_id", "left").orderBy("place").select("doc_id", "source", "status", "reason", n.alias("n_chunks"))

    def ingest_stream(self, docs: DataFrame, checkpoint: str, available_now: bool = True):
        return ingest_stream(docs, self.upsert, checkpoint, available_now)

    def remove(self, doc_ids: Iterable[str]) -> int:
        """Delete documents; returns the number of chunks that went."""
        base = self._required()
        chunks = self._chunks_of(base)
        ids = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        n = index.removed_count(chunks, ids).first()[0]
        if n:
            self._save(index.delete(chunks, ids), base)
        return n

    def clear(self) -> None:
        if (base := self._current()) is not None:
            self._save(self._chunks_of(base).limit(0), base)

    def document_ids(self) -> DataFrame:
        return index.document_ids(self._chunks_of(self._required()))

    def list_documents(self) -> DataFrame:
        return index.list_documents(self._chunks_of(self._required())).orderBy("first_pos")

    def stats(self) -> dict:
        row = index.stats(self._chunks_of(self._required())).first()
        return row.asDict() | {"embedder": self.embedder.name, "dim": self.embedder.dim, "engine": self.llm.name if self.backend == "hosted" else "extractive"}

    def _required(self) -> store.Version:
        now = self._current()
        if now is None:
            raise LookupError("the index has no documents")
        return now

    # --- questions ---

    def rankings(self, questions: DataFrame, version: store.Version | None = None) -> dict[str, DataFrame]:
        """The dense and the lexical ranking of questions (qid, question), by the saved vectors and postings."""
        now, s = version or self._required(), self.settings
        asked = questions.select("qid", embed(F.col("question"), for_questions(self.embedder)).alias("vector"))
        return {"dense": dense.topk(self._chunks_of(now), asked, s.dense_top_k), "lexical": bm25.topk(bm25.load(self.spark, now.folder), questions, s.lexical_top_k, s)}

    def retrieve(self, questions: DataFrame, top_k: int | None = None, sources: Iterable[str] = retrieve.SOURCES, rerank: Callable | None = None) -> retrieve.Retrieved:
        """The passages to answer from; with rerank(questions, texts), the best of the first 4 * top_k."""
        return self._retrieve(self._required(), questions, top_k, sources, rerank)

    def _retrieve(self, now: store.Version, questions: DataFrame, top_k: int | None, sources: Iterable[str] = MODES["hybrid"], rerank: Callable | None = None) -> retrieve.Retrieved:
        n = top_k or self.settings.final_top_k
        if not 1 <= n <= MOST_PASSAGES:
            raise ValueError(f"top_k must be in 1..{MOST_PASSAGES}")
        rankings = self.rankings(questions, now)
        fused = retrieve.hybrid(rankings, sources, 4 * n if rerank else n, self.settings)
        hits = retrieve.rerank(fused, questions, self._chunks_of(now), rerank, n) if rerank else fused
        return retrieve.Retrieved(hits, retrieve.debug(rankings, fused))

    def contexts(self, hits: DataFrame) -> DataFrame:
        """qid, marker, chunk_id, doc_id, title, source, text, score and component_scores (to six decimals), preview of hits."""
        return self._contexts(self._required(), hits)

    def _contexts(self, now: store.Version, hits: DataFrame) -> DataFrame:
        six = F.transform_values("components", lambda _, v: F.round(v, 6))
        own = hits.select("qid", "chunk_id", F.col("rank").alias("marker"), F.round("score", 6).alias("score"), six.alias("component_scores"))
        joined = own.join(self._chunks_of(now), "chunk_id").withColumn("preview", preview(F.col("text")))
        return joined.select("qid", "marker", "chunk_id", "doc_id", "title", "source", "text", "score", "component_scores", "preview")

    def query(self, questions: DataFrame, top_k: int | None = None, similarity: Column | None = None) -> DataFrame:
        """Answers with citations, one row a question: qid, question, text, cited_ordinals, abstained, usage, engine, notice, latency_ms.

        By the hosted model, if there is one; where it fails, and without one, by quoting the passages: sentences that share words
        with the question, or by a similarity column over (question, sentence) where the embedder is semantic. notice says why a
        question's hosted answer is missing. latency_ms is the hosted model's alone: quoting is done for all questions at once.
        Questions over LONGEST_QUESTION characters fail the job.
        """
        now, n = self._required(), top_k or self.settings.final_top_k
        asked = questions.withColumn("question", F.when(F.length("question") <= LONGEST_QUESTION, F.col("question")).otherwise(F.raise_error(F.lit(f"a question has over {LONGEST_QUESTION} characters"))))
        contexts = self._contexts(now, self._retrieve(now, asked, top_k).hits)
        sentences = answer.candidates(contexts)
        if similarity is not None and self.embedder.semantic:
            chosen = answer.by_meaning(sentences.join(asked, "qid"), similarity, self.settings.extractive_min_similarity)
        else:
            chosen = answer.by_words(sentences, asked)
        quoted = answer.extractive(chosen, asked)
        if self.backend == "extractive":
            return answer.finish(quoted, contexts, asked, n).withColumns({"notice": F.lit(None).cast("string"), "latency_ms": F.lit(None).cast("double")})
        told = answer.hosted(contexts, asked, self.llm, self.settings).withColumnRenamed("text", "written")
        failed = F.col("failure").isNotNull()
        raw = quoted.join(told, "qid", "left").select("qid", F.when(failed | F.col("written").isNull(), F.col("text")).otherwise(F.col("written")).alias("text"), F.struct(failed.alias("failed"), answer.notice_of(F.col("failure")).alias("notice"), "latency_ms").alias("how"))
        done = answer.finish(raw, contexts, asked, n, self.llm.name, "how")
        engine = F.when(F.col("how.failed"), F.lit("extractive")).otherwise(F.col("engine"))
        return done.select("qid", "question", "text", "cited_ordinals", "abstained", "usage", engine.alias("engine"), F.col("how.notice").alias("notice"), F.col("how.latency_ms").alias("latency_ms"))

    def evaluate(self, gold: DataFrame, k: int = 5, ks: Iterable[int] = (), answers: bool = False) -> dict[str, DataFrame]:
        """Summary tables of an evaluation set (sources.files.load_questions): each retriever, the best one's recall by type and failures, and who finds what.

        ks: depths to score all retrievers at as well. answers: score answers too, over all questions.
        """
        now = self._required()
        able = gold.filter("answerable").select(F.col("id").alias("qid"), "type", "question", "relevant_sources")
        asked = able.select("qid", "type")
        relevant = able.select("qid", F.explode("relevant_sources").alias("id"))
        rankings, source = self.rankings(able.select("qid", "question"), now), self._chunks_of(now).select("chunk_id", "source")
        deepest = max([k, *ks])
        hits = {mode: retrieve.hybrid(rankings, sources, deepest, self.settings).join(source, "chunk_id") for mode, sources in MODES.items()}
        ranked = {mode: evaluate.source_dedup(own, k) for mode, own in hits.items()}
        each = {mode: evaluate.metrics(asked, own, relevant, k) for mode, own in ranked.items()}
        told = [evaluate.summary(df).select(F.lit(mode).alias("mode"), "*") for mode, df in each.items()]
        retrieval = told[0].unionByName(told[1]).unionByName(told[2])
        best = evaluate.best_mode(retrieval, tuple(MODES)).first().mode  # one row
        missed = evaluate.failures(each[best]).select("qid").join(able, "qid").join(evaluate.retrieved(ranked[best], k), "qid", "left")
        out = {
            "Retrieval": retrieval,
            "Best retriever": self.spark.createDataFrame([(best,)], "mode string"),
            "Recall by type": evaluate.summary(each[best], "type").select("type", "n", "recall").orderBy("type"),
            "Complementarity": evaluate.complementarity(each["dense"], each["lexical"]),
            "Found by one or none": evaluate.outcomes(each["dense"], each["lexical"]).filter("outcome <> 'both'").join(able.select("qid", "question"), "qid").orderBy("outcome", "qid"),
            "Failures": missed.select("qid", "question", F.col("relevant_sources").alias("expected"), "retrieved").orderBy("qid"),
        }
        if ks := tuple(ks):
            out["Depth sweep"] = evaluate.sweep(asked, hits, relevant, ks).orderBy("k", "mode")
        if answers:
            own = self.query(gold.select(F.col("id").alias("qid"), "question"), k)
            scored = evaluate.answer_metrics(own, gold.select(F.col("id").alias("qid"), "answerable", "answer_keywords"))
            timed = evaluate.upper_median(own.select(F.lit(1).alias("one"), "latency_ms"), "latency_ms", "one").select(F.col("p50").alias("p50_latency_ms"))
            out["Answers"] = scored.join(timed, how="left")  # one row each
        return out


def register(spark: SparkSession, settings: Settings = DEFAULT) -> None:
    """SQL functions for the operators on texts: tokenize, hash_embed, chunk_text, split_sentences, reflow; and the table function chunks(doc_id, text)."""
    from .functions.sentences import chunk_text, chunks_udf, reflow_udf, sentences_udf
    from .functions.text import STOP_WORDS
    from .functions.vectors import HashEmbedder, embed_udf

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(x STRING) RETURNS ARRAY<STRING> RETURN filter(regexp_extract_all(lower(x), '([a-z0-9]+)', 1), t -> NOT t IN ({stop}))")
    spark.udf.register("hash_embed", embed_udf(HashEmbedder(settings.embedding_dim)))
    spark.udf.register("chunk_text", chunks_udf(settings.chunk_size, settings.chunk_overlap, settings.min_chunk_words))
    spark.udf.register("split_sentences", sentences_udf)
    spark.udf.register("reflow", reflow_udf)

    @F.udtf(returnType="chunk_id string, doc_id string, ordinal int, text string")
    class Chunks:
        def eval(self, doc_id: str, text: str):
            for i, chunk in enumerate(chunk_text(text or "", settings.chunk_size, settings.chunk_overlap, settings.min_chunk_words)):
                yield f"{doc_id}::{i}", doc_id, i, chunk

    spark.udtf.register("chunks", Chunks)

