"""One query for each operator over the given tables. Documents play passages, the benchmark's texts questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sentences as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import answer, bm25, dense, evaluate, fusion, index, retrieve
from ..operators.sizes import small
from ..session import prepared
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K, DEPTH = 5, 20


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("pos"), F.col("source").alias("title"), "source", "lang", "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"))


def _lexical(spark: SparkSession, sf_dir: str, k: int = DEPTH) -> DataFrame:
    return bm25.topk(bm25.Bm25Index.fit(_passages(spark, sf_dir)), _questions(spark, sf_dir), k)


_MD5 = V.HashEmbedder(512, "md5")


def _dense(spark: SparkSession, sf_dir: str, k: int = DEPTH) -> DataFrame:
    vectors = _passages(spark, sf_dir).select("chunk_id", "pos", V.embed(F.col("text"), _MD5).alias("vector"))
    return dense.topk(vectors, _questions(spark, sf_dir).select("qid", V.embed(F.col("question"), _MD5).alias("vector")), k)


def _rankings(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"dense": _dense(spark, sf_dir), "lexical": _lexical(spark, sf_dir)}


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, id: passages that contain the whole question.

    Such a passage has the question's tokens but the first and last, which may be cut, in a row: both meet on the second to fourth,
    and the whole is looked for then. Questions of fewer tokens are held against all passages.
    """
    asked = _questions(spark, sf_dir).withColumn("t", T.raw_tokens(F.col("question")))
    passages = _passages(spark, sf_dir).select("chunk_id", "text")
    runs = F.expr("array_distinct(transform(sequence(1, greatest(size(t) - 2, 1)), i -> xxhash64(slice(t, i, 3))))")
    placed = passages.withColumn("t", T.raw_tokens(F.col("text"))).select("chunk_id", "text", F.explode(runs).alias("h"))
    met = placed.join(small(asked.filter("size(t) >= 5").select("qid", "question", F.xxhash64(F.slice("t", 2, 3)).alias("h"))), "h")
    rest = passages.join(small(asked.filter("size(t) < 5").select("qid", "question")), F.contains("text", "question"))
    found = met.filter(F.contains("text", "question")).select("qid", "chunk_id").unionByName(rest.select("qid", "chunk_id"))
    return found.select("qid", F.col("chunk_id").alias("id"))


def _each(spark: SparkSession, sf_dir: str, hits: DataFrame, k: int = K) -> DataFrame:
    return evaluate.metrics(_questions(spark, sf_dir).select("qid"), hits.select("qid", F.col("chunk_id").alias("id"), "rank"), _relevant(spark, sf_dir), k)


def _six(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


# --- text functions ---


@query
def word_count(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("n_words"))


@query
def tokenize_terms(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("terms"))


@query
def bigrams(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(T.grams(F.col("text")), " ").alias("grams"))


@query
def content_words(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.content_words(F.col("text"))), " ").alias("words"))


@query
def naive_sentences(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.naive_sentences(F.col("text"))).alias("spos", "sentence"))


@query
def normalize_ws(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query
def preview_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query
def safe_filename(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query
def slugify(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.slugify(T.page_title(F.col("html"))).alias("slug"))


@query
def page_title(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


@query
def document_title(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.title(F.concat(F.lit("# "), "text"), F.concat("source", F.lit(".md"))).alias("heading"), T.title(F.lit("plain"), F.concat(F.lit("a/"), "source", F.lit("_x-y.md"))).alias("stem"))


@query
def document_key(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.doc_id_of(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("key"))


_WIKI = ("Lead.\n\n\n\n== History ==\n", "\n=== Early ===\nText\n===== Deep =====\n", "\n== See also ==\n* x")


@query
def wiki_clean(spark, sf_dir):
    """Every document's text in two sections of a page, before a section that goes."""
    head, middle, tail = map(F.lit, _WIKI)
    return _documents(spark, sf_dir).select("doc_id", T.wiki_clean(F.concat("source", head, "text", middle, "text", tail)).alias("text"))


@query
def paragraphs(spark, sf_dir):
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n"))
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(doubled)).alias("place", "paragraph"))


@query
def strip_headings(spark, sf_dir):
    headed = F.concat(F.lit("# "), "source", F.lit("\n## Part one\n"), "text", F.lit(" ### tail"))
    return _documents(spark, sf_dir).select("doc_id", T.strip_headings(headed, F.col("source")).alias("text"))


def _cited(spark, sf_dir):
    """Every document as an answer: a good marker in each sentence, and at each comma one that's good for some documents only."""
    marked = F.replace(F.replace(F.col("text"), F.lit("."), F.lit(" [1].")), F.lit(","), F.concat(F.lit(" ["), (F.col("doc_id") % 12).cast("string"), F.lit("],")))
    return _documents(spark, sf_dir).select("doc_id", marked.alias("cited"))


@query
def parse_citations(spark, sf_dir):
    return _cited(spark, sf_dir).select("doc_id", F.array_join(F.transform(T.parse_citations(F.col("cited"), 8), lambda n: n.cast("string")), ",").alias("cited"))


@query
def strip_invalid_citations(spark, sf_dir):
    return _cited(spark, sf_dir).select("doc_id", T.strip_invalid_citations(F.col("cited"), 3).alias("text"))


def _prompts(spark, sf_dir):
    contexts = F.array(F.struct(F.lit("T").alias("title"), F.lit("s.md").alias("source"), F.col("text").alias("text")), F.struct(F.lit("U").alias("title"), F.lit("u.md").alias("source"), F.lit("Other.").alias("text")))
    return _table(spark, sf_dir, "benchmark").select("item_id", T.build_prompt(F.col("text"), contexts).alias("prompt"))


@query
def prompt_build(spark, sf_dir):
    return _prompts(spark, sf_dir)


@query
def prompt_parse(spark, sf_dir):
    told = _prompts(spark, sf_dir).select("item_id", T.parse_prompt(F.col("prompt")).alias("p"))
    return told.select("item_id", "p.question", F.explode("p.passages").alias("x")).select("item_id", "question", "x.marker", "x.title", "x.text")


# --- lexical and dense search, fusion ---


@query
def postings(spark, sf_dir):
    return bm25.postings(_passages(spark, sf_dir)).select("term", "chunk_id", "dl", "tf")


@query
def term_stats(spark, sf_dir):
    return bm25.term_stats(_passages(spark, sf_dir)).select("term", "df", *_six("idf"))


@query
def corpus_stats(spark, sf_dir):
    return bm25.corpus_stats(_passages(spark, sf_dir)).select("n_chunks", *_six("avgdl", "avg_idf"))


@query
def bm25_topk(spark, sf_dir):
    return _lexical(spark, sf_dir).select("qid", "chunk_id", *_six("score"), "rank")


@query
def l2_normalize(spark, sf_dir):
    v = V.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("i", "x")).select("vec_id", "i", (F.round("x", 5) + 0.0).alias("x"))


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), "label")


def _vector_hits(spark, sf_dir, k: int = DEPTH):
    v = _vectors(spark, sf_dir)
    return dense.topk(v, v.filter("pos % 20 = 0").select(F.col("chunk_id").alias("qid"), "vector"), k)


@query
def dense_topk(spark, sf_dir):
    return _vector_hits(spark, sf_dir).select("qid", "chunk_id", *_six("score"), "rank")


@query
def hash_md5_vectors(spark, sf_dir):
    own = _passages(spark, sf_dir).select("chunk_id", F.posexplode(V.embed(F.col("text"), V.HashEmbedder(32, "md5"))).alias("i", "x"))
    return own.filter("x <> 0").select("chunk_id", "i", *_six("x"))


@query
def rrf_fuse(spark, sf_dir):
    return fusion.fuse(_rankings(spark, sf_dir)).select("qid", "chunk_id", *_six("score"), "rank")


@query
def rrf_weighted(spark, sf_dir):
    return fusion.fuse(_rankings(spark, sf_dir), 10, {"dense": 0.25, "lexical": 2.0}).select("qid", "chunk_id", *_six("score"), "rank")


@query
def rrf_components(spark, sf_dir):
    fused = fusion.fuse(_rankings(spark, sf_dir))
    return fused.select("qid", "chunk_id", F.explode("components").alias("component", "value")).select("qid", "chunk_id", "component", *_six("value"))


@query
def hybrid_topk(spark, sf_dir):
    return retrieve.hybrid(_rankings(spark, sf_dir)).select("qid", "chunk_id", *_six("score"), "rank")


@query
def source_ablation(spark, sf_dir):
    rankings = _rankings(spark, sf_dir)
    one = lambda s: retrieve.hybrid(rankings, [s]).select(F.lit(s).alias("source"), "qid", "chunk_id", *_six("score"), "rank")
    return one("dense").unionByName(one("lexical"))


@query
def retrieval_debug(spark, sf_dir):
    rankings = _rankings(spark, sf_dir)
    return retrieve.debug(rankings, retrieve.hybrid(rankings, top_k=4 * K))


@query
def rerank(spark, sf_dir):
    rankings = {"lexical": _lexical(spark, sf_dir)}
    shared = lambda questions, texts: [float(len(set(q.split()) & set(t.split()))) for q, t in zip(questions, texts)]
    hits = retrieve.rerank(retrieve.hybrid(rankings, ["lexical"], 4 * K), _questions(spark, sf_dir), _passages(spark, sf_dir), shared, K)
    return hits.select("qid", "chunk_id", "score", "rank")


# --- index ---


def _indexed(spark, sf_dir):
    return _passages(spark, sf_dir).select("chunk_id", F.col("source").alias("doc_id"), "title", "source", "text", "pos")


@query
def list_documents(spark, sf_dir):
    return index.list_documents(_indexed(spark, sf_dir))


@query
def index_stats(spark, sf_dir):
    return index.stats(_indexed(spark, sf_dir))


@query
def delete_document(spark, sf_dir):
    gone = spark.createDataFrame([("src3",), ("src7",), ("absent",)], "doc_id string")
    return index.delete(_indexed(spark, sf_dir), gone).select("chunk_id", "doc_id")


@query
def removed_count(spark, sf_dir):
    return index.removed_count(_indexed(spark, sf_dir), spark.createDataFrame([("src3",), ("src7",)], "doc_id string"))


def _keyed(spark, sf_dir):
    return _passages(spark, sf_dir).select("chunk_id", F.col("chunk_id").alias("doc_id"), "text", "pos")


def _pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("chunk_id"), F.col("page_id").cast("string").alias("doc_id"), F.col("html").alias("text"), F.col("page_id").alias("pos"))


@query
def upsert_documents(spark, sf_dir):
    """All pages come into an index of all documents; those of a document's id replace it."""
    batch = _pages(spark, sf_dir)
    return index.upsert(_keyed(spark, sf_dir), batch, batch).select("chunk_id", F.md5("text").alias("digest"))


@query
def upload_status(spark, sf_dir):
    """All documents as files of four kinds, some of them blank, come into an index of all pages."""
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".TXT", ".exe", ""))), (F.col("pos") % 4 + 1).cast("int"))
    batch = _keyed(spark, sf_dir).select("doc_id", F.concat(F.lit("f"), "doc_id", suffix).alias("source"), F.when(F.col("pos") % 10 == 0, " ").otherwise(F.col("text")).alias("text"), "pos")
    return index.upload_status(batch, _pages(spark, sf_dir)).select("doc_id", "source", "status", "reason", F.col("place.late").alias("late"))


@query
def chunk_documents(spark, sf_dir):
    chunks = index.chunk_documents(files.from_table(_documents(spark, sf_dir)))
    return chunks.select("chunk_id", "doc_id", "ordinal", T.word_count(F.col("text")).alias("n_words"), F.md5("text").alias("digest"))


@query
def split_sentences(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(S.sentences_udf("text")).alias("spos", "sentence"))


@query
def pdf_reflow(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(S.reflow_udf("text")).alias("digest"))


@query
def hash_blake2b_embed(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(V.embed(F.col("text"), V.HashEmbedder())).alias("i", "x")).filter("x <> 0").select("item_id", "i", *_six("x"))


# --- evaluation ---


def _metric(name: str):
    def run(spark, sf_dir):
        return _each(spark, sf_dir, _lexical(spark, sf_dir)).select("qid", *_six(name))

    return run


QUERIES |= {"hit_rate_at_k": lambda s, d: _each(s, d, _lexical(s, d)).select("qid", "hit"), "recall_at_k": _metric("recall"), "precision_at_k": _metric("precision"), "ndcg_at_k": _metric("ndcg"), "mrr": _metric("rr")}


@query
def dense_label_metrics(spark, sf_dir):
    """Of the vectors whose id is divisible by 20; relevant are those of the same label."""
    v = _vectors(spark, sf_dir)
    asked = v.filter("pos % 20 = 0").select(F.col("chunk_id").alias("qid"), "label")
    hits = _vector_hits(spark, sf_dir).select("qid", F.col("chunk_id").alias("id"), "rank")
    relevant = asked.join(v.select("label", F.col("chunk_id").alias("id")), "label").select("qid", "id")
    return evaluate.summary(evaluate.metrics(asked, hits, relevant, 10), "label").select("label", "n", *_six("hit", "recall", "precision", "ndcg", "rr"))


def _with_source(spark, sf_dir, hits):
    return hits.join(_passages(spark, sf_dir).select("chunk_id", "source", "lang"), "chunk_id")


@query
def source_dedup(spark, sf_dir):
    return evaluate.source_dedup(_with_source(spark, sf_dir, _lexical(spark, sf_dir)), 10)


@query
def recall_by_type(spark, sf_dir):
    """By the language of the question's best hit."""
    hits = _lexical(spark, sf_dir)
    kind = _with_source(spark, sf_dir, hits.filter("rank = 1")).select("qid", "lang")
    each = _each(spark, sf_dir, hits).join(kind, "qid", "left").withColumn("lang", F.coalesce("lang", F.lit("none")))
    return evaluate.summary(each, "lang").select("lang", "n", *_six("recall"))


@query
def retrieval_failures(spark, sf_dir):
    return evaluate.failures(_each(spark, sf_dir, _dense(spark, sf_dir))).select("qid")


def _modes(spark, sf_dir):
    rankings = _rankings(spark, sf_dir)
    return {"dense": retrieve.hybrid(rankings, ["dense"], DEPTH), "lexical": retrieve.hybrid(rankings, ["lexical"], DEPTH), "hybrid": retrieve.hybrid(rankings, top_k=DEPTH)}


@query
def k_sweep(spark, sf_dir):
    """Each retriever's recall, MRR and nDCG at several depths; hits are cut before the metrics."""
    out = None
    for mode, hits in _modes(spark, sf_dir).items():
        for k in (1, 3, 5, 10):
            row = evaluate.summary(_each(spark, sf_dir, hits.filter(F.col("rank") <= k), k)).select(F.lit(mode).alias("mode"), F.lit(k).alias("k"), *_six("recall", "rr", "ndcg"))
            out = row if out is None else out.unionByName(row)
    return out


@query
def complementarity(spark, sf_dir):
    modes = _modes(spark, sf_dir)
    return evaluate.complementarity(_each(spark, sf_dir, modes["dense"]), _each(spark, sf_dir, modes["lexical"]))


@query
def best_retriever(spark, sf_dir):
    rows = None
    for mode, hits in _modes(spark, sf_dir).items():
        row = evaluate.summary(_each(spark, sf_dir, hits)).select(F.lit(mode).alias("mode"), "recall")
        rows = row if rows is None else rows.unionByName(row)
    return evaluate.best_mode(rows).select("mode", *_six("recall"))


@query
def p50_upper_median(spark, sf_dir):
    return evaluate.upper_median(_table(spark, sf_dir, "events"), "value", "event_type")


# --- answers ---


def _contexts(spark, sf_dir, k: int = 3):
    hits = _lexical(spark, sf_dir, k).select("qid", "chunk_id", F.col("rank").alias("marker"))
    return hits.join(_passages(spark, sf_dir), "chunk_id").select("qid", "marker", "title", "source", "text")


@query
def candidate_sentences(spark, sf_dir):
    return answer.candidates(_contexts(spark, sf_dir))


def _chosen(spark, sf_dir):
    return answer.by_words(answer.candidates(_contexts(spark, sf_dir)), _questions(spark, sf_dir))


@query
def answer_by_words(spark, sf_dir):
    return _chosen(spark, sf_dir)


@query
def extractive_answer(spark, sf_dir):
    return answer.extractive(_chosen(spark, sf_dir), _questions(spark, sf_dir))


def _answers(spark, sf_dir):
    contexts, questions = _contexts(spark, sf_dir), _questions(spark, sf_dir)
    return answer.finish(answer.extractive(answer.by_words(answer.candidates(contexts), questions), questions), contexts, questions, 3)


@query
def answers(spark, sf_dir):
    # Only citations that the answer itself may have are told: quoted texts have no bracketed numbers here.
    return _answers(spark, sf_dir).select("qid", "text", F.array_join(F.transform("cited_ordinals", lambda n: n.cast("string")), ",").alias("cited"), "abstained", F.col("usage")["output_tokens"].alias("output_tokens"))


@query
def resolved_citations(spark, sf_dir):
    return answer.citations(_answers(spark, sf_dir), _contexts(spark, sf_dir))


@query
def answer_by_meaning_gate(spark, sf_dir):
    """Vectors play sentences: of a question's three nearest, those close enough to the best."""
    hits = _vector_hits(spark, sf_dir, 10).select("qid", F.lit(1).alias("marker"), F.col("rank").alias("spos"), F.col("chunk_id").alias("sentence"), "score")
    return answer.by_meaning(hits.filter("qid <> sentence"), F.col("score")).select("qid", "place", "sentence", *_six("similarity"))


def _gold(spark, sf_dir):
    relevant = _relevant(spark, sf_dir).select("qid").distinct().withColumn("able", F.lit(True))
    words = F.slice(T.content_words(F.col("question")), 1, 3)
    return _questions(spark, sf_dir).join(relevant, "qid", "left").select("qid", F.coalesce("able", F.lit(False)).alias("answerable"), words.alias("answer_keywords"))


@query
def keyword_coverage(spark, sf_dir):
    rows = _gold(spark, sf_dir).join(_answers(spark, sf_dir), "qid")
    return rows.select("qid", F.round(evaluate.keyword_coverage(F.col("text"), F.col("answer_keywords")), 6).alias("coverage"))


@query
def answer_metrics(spark, sf_dir):
    return evaluate.answer_metrics(_answers(spark, sf_dir), _gold(spark, sf_dir)).select(*_six("keyword_coverage", "citation_rate", "abstention_accuracy"))
