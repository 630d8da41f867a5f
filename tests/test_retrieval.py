"""BM25, dense search, fusion, metrics and answers, on hand-computed cases and under other partitionings."""

import math

import pytest
from pyspark.sql import functions as F

from fernweave.functions.vectors import HashEmbedder, RemoteEmbedder
from fernweave.operators import answer, bm25, dense, evaluate, fusion, index, retrieve


def chunks(spark, texts):
    return spark.createDataFrame([(f"d::{i}", i, "", t) for i, t in enumerate(texts)], "chunk_id string, pos bigint, title string, text string")


def asked(spark, *questions):
    return spark.createDataFrame([(str(i), q) for i, q in enumerate(questions)], "qid string, question string")


def search(spark, texts, question, k=20):
    return [(r.chunk_id, r.score) for r in bm25.topk(bm25.Bm25Index.fit(chunks(spark, texts)), asked(spark, question), k).orderBy("rank").collect()]


def test_bm25(spark):
    texts = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota"]
    (best, score), = search(spark, texts, "epsilon")
    assert best == "d::1" and score == pytest.approx(math.log(2.5 / 1.5))
    assert search(spark, texts, "the of and") == []
    assert search(spark, ["alpha beta"], "alpha") == []  # with one chunk every weight is negative
    twice = search(spark, texts, "epsilon epsilon")
    assert twice[0][1] == pytest.approx(2 * score)


def test_bm25_common_terms_weigh_epsilon_of_the_mean(spark):
    texts = ["common a1", "common b1", "common c1", "other"]
    rare, common = math.log(3.5 / 1.5), math.log(1.5 / 3.5)
    mean = (4 * rare + common) / 5
    terms = {r.term: r.idf for r in bm25.term_stats(chunks(spark, texts)).collect()}
    assert terms["common"] == pytest.approx(0.25 * mean) and terms["other"] == pytest.approx(rare)


def test_ties_go_to_the_first_under_any_partitioning(spark):
    rows = chunks(spark, ["x y", "same words here", "same words here", "z", "same words here", "q", "w"])
    want = None
    for n in (1, 7):
        got = [r.chunk_id for r in bm25.topk(bm25.Bm25Index.fit(rows.repartition(n)), asked(spark, "same here"), 2).orderBy("rank").collect()]
        want = want or got
        assert got == want == ["d::1", "d::2"]


def ranking(spark, *ids, qid="q"):
    return spark.createDataFrame([(qid, c, 1.0 / (i + 1), i + 1) for i, c in enumerate(ids)], "qid string, chunk_id string, score double, rank int")


def test_fusion(spark):
    out = fusion.fuse({"dense": ranking(spark, "a", "b"), "lexical": ranking(spark, "a", "b")}).orderBy("rank").collect()
    assert out[0].chunk_id == "a" and out[0].score == pytest.approx(2 / 61)
    assert out[0].components == {"dense": 1.0, "dense_rank": 1.0, "lexical": 1.0, "lexical_rank": 1.0}
    agreed = fusion.fuse({"dense": ranking(spark, "x", "b"), "lexical": ranking(spark, "y", "b")}).orderBy("rank").collect()
    assert [r.chunk_id for r in agreed] == ["b", "x", "y"]
    as_text = fusion.fuse({"dense": ranking(spark, "d::2"), "lexical": ranking(spark, "d::10")}).orderBy("rank").first()
    assert as_text.chunk_id == "d::10"
    with pytest.raises(ValueError):
        fusion.fuse({"dense": ranking(spark, "a")}, 0)
    with pytest.raises(ValueError):
        retrieve.hybrid({}, [])


def test_dense(spark, monkeypatch):
    vectors = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("c", 2, [-1.0, 0.0]), ("d", 3, [1.0, 0.0])], "chunk_id string, pos bigint, vector array<float>").repartition(3)
    questions = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0]), ("3", [-1.0, 0.0])], "qid string, vector array<double>")
    whole = sorted(map(tuple, dense.topk(vectors, questions, 9).collect()))
    assert len(whole) == 12 and [r[1] for r in sorted(whole, key=lambda r: r[4]) if r[0] == "1"] == ["a", "d", "b", "c"]
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, dense.topk(vectors, questions, 9).collect())) == whole
    assert dense.topk(vectors.limit(0), questions, 2).count() == 0 == dense.topk(vectors, questions.limit(0), 2).count()


def test_metrics(spark):
    questions = spark.createDataFrame([("q",), ("none",)], "qid string")
    ranked = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate("abcde")], "qid string, id string, rank int")
    relevant = spark.createDataFrame([("q", "c")], "qid string, id string")
    each = {r.qid: r for r in evaluate.metrics(questions, ranked, relevant, 5).collect()}
    assert (each["q"].hit, each["q"].recall, each["q"].precision, each["q"].rr) == (1, 1.0, 0.2, pytest.approx(1 / 3))
    assert each["q"].ndcg == pytest.approx(0.5)
    assert (each["none"].hit, each["none"].recall, each["none"].ndcg, each["none"].rr) == (0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        evaluate.metrics(questions, ranked, relevant, 0)
    hits = spark.createDataFrame([("q", s, i + 1) for i, s in enumerate("xxyxz")], "qid string, source string, rank int")
    assert [(r.id, r.rank) for r in evaluate.source_dedup(hits, 4).orderBy("rank").collect()] == [("x", 1), ("y", 2)]


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 7.0), ("b", None)], "k string, v double")
    assert {r.k: r.p50 for r in evaluate.upper_median(rows, "v", "k").collect()} == {"a": 3.0, "b": 7.0}


@pytest.mark.parametrize("similarities, want", [([0.44], 0), ([0.46], 1), ([0.8, 0.5], 1), ([0.8, 0.7, 0.66, 0.9], 2)])
def test_by_meaning(spark, similarities, want):
    rows = spark.createDataFrame([("q", 1, i, f"s{i}", s) for i, s in enumerate(similarities)], "qid string, marker int, spos int, sentence string, s double")
    assert answer.by_meaning(rows, F.col("s")).count() == want


def test_answers(spark):
    questions = asked(spark, "Which cargo ship entered harbour?", "Unknown matter entirely", "No passages")
    contexts = spark.createDataFrame([("0", 1, "T", "a.md", "# T\nThe cargo ship entered. Nothing else."), ("0", 2, "T", "b.md", "THE CARGO SHIP ENTERED. A cargo ship entered the harbour."), ("1", 1, "T", "a.md", "Plain text.")], "qid string, marker int, title string, source string, text string")
    chosen = answer.by_words(answer.candidates(contexts), questions)
    got = {r.qid: r for r in answer.finish(answer.extractive(chosen, questions), contexts, questions, 5).collect()}
    assert got["0"].text == "A cargo ship entered the harbour. [2] The cargo ship entered. [1]"
    assert got["0"].cited_ordinals == [2, 1] and not got["0"].abstained
    assert got["1"].abstained and got["1"].text == answer.NO_ANSWER and got["2"].text == answer.NOTHING_FOUND


def test_fallback():
    def broken():
        raise RuntimeError("503 overloaded")

    text, notice = answer.with_fallback(broken, lambda: "local")
    assert text == "local" and "overloaded" in notice
    assert answer.with_fallback(lambda: "hosted", lambda: "local") == ("hosted", None)


def test_embedders():
    v = HashEmbedder(64).embed(["a b", "", "a b"])
    assert (v[0] == v[2]).all() and not v[1].any() and (v[0] ** 2).sum() == pytest.approx(1)
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise RuntimeError("429")
        return [[3.0, 4.0]] * len(texts)

    assert RemoteEmbedder("m", 2, flaky, batch=2, delay=0).embed(["x", "y", "z"]).tolist() == [[0.6, 0.8]] * 3
    assert calls == [2, 2, 1]


def test_latest_of_a_batch(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 3, "x")], "doc_id string, pos bigint, text string")
    assert {r.doc_id: r.text for r in index.latest(rows).collect()} == {"a": "new", "b": "x"}


def test_upper_median_of_many_values(spark, monkeypatch):
    """Narrowed in several rounds, with ties, infinities and a null key, it's the sorted list's."""
    import random

    monkeypatch.setattr(evaluate, "RANKED", 40)
    monkeypatch.setattr(evaluate, "PARTS", 5)
    rng = random.Random(1)
    rows = [(k, v) for k in ("a", "b", None) for v in ([float(rng.randint(0, 3000)) for _ in range(3000)] if k == "a" else [rng.random() for _ in range(1501)] + [1.0, float("inf"), -5.0])]
    want = {k: sorted(v for q, v in rows if q == k)[len([1 for q, _ in rows if q == k]) // 2] for k in ("a", "b", None)}
    assert {r.k: r.p50 for r in evaluate.upper_median(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()} == want
    assert evaluate.upper_median(spark.createDataFrame([], "k string, v double"), "v", "k").count() == 0


def test_broadcasts_are_checked(spark):
    from fernweave.operators.sizes import small

    rows = spark.range(10).toDF("id")
    plan = lambda most: rows.join(small(rows, most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10) and "strategy=broadcast" not in plan(9)


def test_hash_embedder_against_its_definition():
    import hashlib

    for text in ("The cat sat. The cat!", "a", "", "x1 y2 x1 y2"):
        tokens = [t for t in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()]
        want = [0.0] * 512
        for g in tokens + [f"{a}_{b}" for a, b in zip(tokens, tokens[1:])]:
            d = hashlib.blake2b(g.encode(), digest_size=8).digest()
            want[int.from_bytes(d[:4], "big") % 512] += 1 if d[4] % 2 else -1
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert HashEmbedder().embed([text])[0].tolist() == pytest.approx([x / norm for x in want])


def test_embedders_by_settings():
    from fernweave.functions.vectors import LocalEmbedder, embedder_for, for_questions
    from fernweave.settings import Settings

    assert embedder_for(Settings(embedding_dim=64)).name == "hash-64"
    local = embedder_for(Settings(embedding_backend="local", embedding_model="m", embedding_dim=2), load=lambda model: lambda texts: [[3, 4]] * len(texts))
    assert isinstance(local, LocalEmbedder) and local.name == "auto:m" and local.embed(["x"]).tolist() == [[0.6, 0.8]]
    asked = []
    hosted = RemoteEmbedder("m", 1, lambda texts, task: asked.append(task) or [(i, [float(i + 1)]) for i in reversed(range(len(texts)))], task=RemoteEmbedder.DOCUMENT)
    assert hosted.embed(["a", "b"]).tolist() == [[1.0], [1.0]] and for_questions(hosted).embed(["q"]).tolist() == [[1.0]] and asked == ["document", "question"]
    calls = []

    def down(texts):
        calls.append(1)
        raise RuntimeError("503")

    with pytest.raises(RuntimeError):
        RemoteEmbedder("m", 1, down, retries=3, delay=0).embed(["x"])
    assert len(calls) == 3
