"""The engine end to end over files, and a stream of documents."""

import pytest

from fernweave.engine import Engine, register
from fernweave.functions.vectors import HashEmbedder
from fernweave.settings import Settings
from fernweave.sources import files, reports, store


@pytest.fixture()
def folder(tmp_path):
    docs = tmp_path / "docs" / "sub"
    docs.mkdir(parents=True)
    (docs.parent / "port_ops.md").write_text("# Port Operations\n\nThe berth schedule lists every vessel.\n\nCranes lift containers from the vessel at night.")
    (docs / "customs.md").write_text("# Customs\n\nA declaration is filed before arrival.\n\nDuty is paid on imported goods.")
    (docs.parent / "baking.txt").write_bytes("Bread needs flour \xff and water.".encode("latin-1"))
    (docs.parent / "skip.exe").write_text("no")
    (docs.parent / "blank.md").write_text(" \n")
    return str(docs.parent)


def test_end_to_end(spark, folder, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", settings=Settings(final_top_k=3, embedding_dim=64))
    with pytest.raises(LookupError):
        engine.list_documents()
    n, chunks = engine.ingest(f"file://{folder}")
    assert n == 3 and chunks == 3
    assert [r.source for r in engine.list_documents().collect()] == ["baking.txt", "port_ops.md", "customs.md"]
    questions = spark.createDataFrame([("1", "Which cranes lift containers?"), ("2", "zzz qqq")], "qid string, question string")
    told = {r.qid: r for r in engine.query(questions).collect()}
    assert "Cranes lift containers" in told["1"].text and told["1"].cited_ordinals and told["2"].abstained
    # The same file again replaces itself.
    assert engine.ingest(f"file://{folder}")[0] == 3 and engine.stats()["n_chunks"] == 3
    gone = engine.list_documents().first().doc_id
    assert engine.remove([gone, "absent"]) == 1 and engine.stats()["n_documents"] == 2
    with pytest.raises(ValueError):
        Engine(spark, f"file://{tmp_path}/index", HashEmbedder(64, "md5")).chunks()
    gold = spark.createDataFrame([("g1", "fact", "berth schedule vessel", ["port_ops.md"], ["berth"], True), ("g2", "none", "x", [], [], False)], "id string, type string, question string, relevant_sources array<string>, answer_keywords array<string>, answerable boolean")
    report = engine.evaluate(gold, 3)
    assert {r["mode"]: r.recall for r in report["Retrieval"].collect()} == {"dense": 1.0, "lexical": 0.0, "hybrid": 1.0}  # each term is in half of the two chunks, and so weighs nothing
    assert "| hybrid | 1 | 1.000" in reports.markdown(report) and '"Retrieval"' in reports.as_json(report)
    engine.clear()
    assert engine.stats()["n_chunks"] == 0


def test_identity_does_not_depend_on_the_folder(spark, folder):
    ids = {r.source: r.doc_id for r in files.load_directory(spark, f"file://{folder}").collect()}
    assert ids["port_ops.md"] == __import__("hashlib").sha1(b"port_ops.md").hexdigest()[:12]
    assert ids["customs.md"] == __import__("hashlib").sha1(b"sub/customs.md").hexdigest()[:12]
    assert "�" in files.load_file(spark, f"file://{folder}/baking.txt").first().text


def test_store_faults(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.load(spark, f"file://{tmp_path}/none")
    rows = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "chunk_id string, vector array<double>")
    store.save(rows, f"file://{tmp_path}/bad", "hash", 2)
    with pytest.raises(ValueError):
        store.load(spark, f"file://{tmp_path}/bad")


def test_questions_file(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "x", "answerable": true}\n\n')
    assert files.load_questions(spark, f"file://{tmp_path}/q.jsonl").count() == 1
    (tmp_path / "e.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        files.load_questions(spark, f"file://{tmp_path}/e.jsonl")


def test_stream(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", HashEmbedder(16))
    schema = "doc_id string, title string, text string, source string, metadata map<string,string>, pos bigint"
    for i, text in enumerate(("First text here.", "Second text here.")):
        spark.createDataFrame([("a", "t", text, "s", {}, i)], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
        engine.ingest_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/cp").awaitTermination()
    assert [r.text for r in engine.chunks().collect()] == ["Second text here."]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT chunk_text('One two. Three.') AS c, split_sentences('Aa bb. Cc.') AS s").first().s == ["Aa bb.", "Cc."]


SCHEMA = "doc_id string, title string, text string, source string, metadata map<string,string>, pos bigint"


def docs(spark, *rows):
    return spark.createDataFrame([(i, "t", text, f"{i}.md", {}, n) for n, (i, text) in enumerate(rows)], SCHEMA)


def test_a_crash_at_any_moment_loses_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    engine = Engine(spark, path, HashEmbedder(16))
    engine.upsert(docs(spark, ("a", "First text here.")))
    # A writer that stopped after writing its version, and one that stopped before its pointer's rename.
    (tmp_path / "index" / "v-halfway" / "chunks").mkdir(parents=True)
    (tmp_path / "index" / "pointers" / "new-halfway").write_text("{")
    assert [r.doc_id for r in engine.chunks().collect()] == ["a"]
    engine.upsert(docs(spark, ("b", "Second text here.")))
    assert {r.doc_id for r in engine.chunks().collect()} == {"a", "b"}
    for n in range(store.KEPT + 1):
        engine.upsert(docs(spark, ("c", f"Text number {n}.")))
    assert len([p for p in (tmp_path / "index" / "pointers").iterdir() if p.name.isdecimal()]) == store.KEPT
    assert len([p for p in (tmp_path / "index").glob("v-*") if p.name != "v-halfway"]) == store.KEPT


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    engine = Engine(spark, path, HashEmbedder(16))
    engine.upsert(docs(spark, ("a", "First text here.")))
    base, chunks = store.current(spark, path), engine.chunks()
    engine.upsert(docs(spark, ("b", "Second text here.")))
    with pytest.raises(store.Conflict):
        store.save(chunks.limit(0), path, engine.embedder.name, 16, base)
    assert {r.doc_id for r in engine.chunks().collect()} == {"a", "b"}


def test_missing_files_are_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    engine = Engine(spark, path, HashEmbedder(16))
    engine.upsert(docs(spark, ("a", "First text here."), ("b", "Second text here.")))
    next((tmp_path / "index").glob("v-*/chunks/part-*.parquet")).unlink()
    with pytest.raises(ValueError, match="corrupt"):
        engine.chunks()


def test_another_dimension_is_refused(spark, tmp_path):
    Engine(spark, f"file://{tmp_path}/index", HashEmbedder(16)).upsert(docs(spark, ("a", "First text here.")))
    with pytest.raises(ValueError, match="hash-16"):
        Engine(spark, f"file://{tmp_path}/index", HashEmbedder(32)).chunks()


def test_saved_postings_score_like_fitted_ones(spark, small, tmp_path):
    from pyspark.sql import functions as F

    from fernweave.operators import bm25

    rows = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("pos"), F.lit("").alias("title"), "text")
    questions = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"))
    bm25.save(rows, f"file://{tmp_path}/lexical")
    by_saved = sorted(map(tuple, bm25.topk(bm25.load(spark, f"file://{tmp_path}/lexical"), questions).collect()))
    by_fitted = sorted(map(tuple, bm25.topk(bm25.Bm25Index.fit(rows), questions).collect()))
    assert [(q, c, p, r) for q, c, p, _, r in by_saved] == [(q, c, p, r) for q, c, p, _, r in by_fitted]
    assert max(abs(a[3] - b[3]) for a, b in zip(by_saved, by_fitted)) < 1e-9


class Hosted:
    """Answers with a good and a wrong marker; fails for some questions."""

    name = "hosted-1"

    def complete(self, system, prompt, temperature, max_output_tokens):
        assert "INSUFFICIENT_CONTEXT" in system and temperature == 0.0 and max_output_tokens == 1024
        if "declaration" in prompt.splitlines()[0]:
            raise RuntimeError("401 bad api key")
        return "Cranes do [1]. Others too [9]."


def test_hosted_answers_and_fallback(spark, folder, tmp_path):
    settings = Settings(final_top_k=2, embedding_dim=64)
    engine = Engine(spark, f"file://{tmp_path}/index", settings=settings, llm=Hosted())
    engine.ingest(f"file://{folder}")
    assert engine.stats()["engine"] == "hosted-1"
    questions = spark.createDataFrame([("1", "Which cranes lift containers?"), ("2", "When is a declaration filed?")], "qid string, question string")
    told = {r.qid: r for r in engine.query(questions).collect()}
    assert told["1"].text == "Cranes do [1]. Others too ." and told["1"].cited_ordinals == [1] and told["1"].engine == "hosted-1" and told["1"].notice is None and told["1"].latency_ms >= 0
    assert told["2"].engine == "extractive" and "API key" in told["2"].notice and "declaration is filed" in told["2"].text
    quoting = Engine(spark, f"file://{tmp_path}/index", settings=Settings(final_top_k=2, embedding_dim=64, llm_backend="extractive"), llm=Hosted())
    assert {r.engine for r in quoting.query(questions).collect()} == {"extractive"}
    with pytest.raises(RuntimeError):
        Engine(spark, f"file://{tmp_path}/index", settings=Settings(llm_backend="hosted"))
    with pytest.raises(ValueError):
        Engine(spark, f"file://{tmp_path}/index", settings=Settings(embedding_backend="other"))
    context = engine.contexts(engine.retrieve(questions).hits).filter("qid = '1' and marker = 1").first()
    assert context.score == round(context.score, 6) and set(context.component_scores) >= {"dense_rank"} and "#" not in context.preview


def test_uploads(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    for name, content in (("a b?c.md", "# Head\n\nSome words here."), ("c.exe", "x"), ("blank.txt", " \n"), ("big.txt", "word " * 300_000)):
        (folder / name).write_text(content)
    (folder / "broken.pdf").write_bytes(b"%PDF-nothing")
    engine = Engine(spark, f"file://{tmp_path}/index", settings=Settings(embedding_dim=16, max_upload_mb=1))
    try:
        import pypdf  # noqa: F401
    except ImportError:
        (folder / "broken.pdf").unlink()
    first = [tuple(r) for r in engine.upload(f"file://{folder}").collect()]
    assert [r[2] for r in first] == ["skipped"] * (len(first) - 1) + ["added"] and first[-1][1] == "a b_c.md" and first[-1][4] == 1
    assert {r[1]: r[3] for r in first if r[2] == "skipped"}.items() >= {"c.exe": "unsupported file type", "blank.txt": "no text found", "big.txt": "larger than the 1 MB limit"}.items()
    assert [r.status for r in engine.upload(f"file://{folder}").collect()][-1] == "updated" and engine.stats()["n_chunks"] == 1


def test_pdf_pages(monkeypatch):
    """Each page reflowed, apart by an empty line; by a stand-in for the optional package."""
    import sys
    import types

    class Page:
        def __init__(self, text):
            self.extract_text = lambda: text

    class Reader:
        def __init__(self, stream):
            assert stream.read() == b"%PDF"
            self.pages = [Page("Leave Policy\nEmployees are eligible after\nsome time."), Page(None), Page("More follows\nhere.")]

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    assert files._pdf_text(b"%PDF") == "# Leave Policy\nEmployees are eligible after some time.\n\n\n\nMore follows here."


def test_whole_evaluation(spark, folder, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", settings=Settings(embedding_dim=64))
    engine.ingest(f"file://{folder}")
    rows = [("g1", "fact", "Which cranes lift containers?", ["port_ops.md"], ["cranes", "absent"], True), ("g2", "fact", "zzz qqq", ["customs.md"], ["duty"], True), ("g3", "none", "xyzzy", [], [], False)]
    gold = spark.createDataFrame(rows, "id string, type string, question string, relevant_sources array<string>, answer_keywords array<string>, answerable boolean")
    report = engine.evaluate(gold, 1, ks=[1, 3], answers=True)
    assert report["Best retriever"].first().mode == "dense" and report["Depth sweep"].count() == 6
    scored = report["Answers"].first()
    assert (scored.keyword_coverage, scored.citation_rate, scored.p50_latency_ms) == (0.25, 0.5, None)
    told = reports.markdown(report, {"Documents": 3, "Depth": 1})
    assert "- Documents: **3**" in told and "## Depth sweep" in told and "## Answers" in told
    assert '"complete"' in reports.as_json(report) and reports.NO_FAILURES in reports.markdown({"Failures": gold.limit(0)})


def test_sql_functions_of_texts(spark):
    register(spark)
    assert spark.sql("SELECT tokenize('The berth is at No. 4') AS t").first().t == ["berth", "no", "4"]
    assert len(spark.sql("SELECT hash_embed('a b') AS v").first().v) == 512
    assert [tuple(r) for r in spark.sql("SELECT * FROM chunks('d', 'One two. Three.')").collect()] == [("d::0", "d", 0, "One two. Three.")]
