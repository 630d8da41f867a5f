"""The pipeline's stages on a small corpus with planted cases."""

import hashlib
import itertools
import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from fernweave.llm import bpe, common, simhash
from tests.llm.test_operators import documents


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the", "and", "of", "was", f"word{rng.choice('abcdefghijklm')}{rng.choice('nopqrstuvwxyz')}"]) for _ in range(150))
    clean = [text() for _ in range(20)]
    passage = " ".join(f"bench{i}" for i in range(12))
    near = clean[1].split()
    near[70] = "changed"
    texts = [*clean, clean[0], " ".join(near), f"{text()} {passage} {text()}", f"{text()} mail me@example.com", "12345 678", None]
    docs = documents(spark, texts).drop("spans", "n_words")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"file://{tmp_path}")
        assert kept.columns == docs.columns, name
    assert {r.doc_id for r in kept.collect()} == {*range(20), 23}
    codec = bpe.default_codec()
    rows = {r.doc_id: codec.decode(r.ids).decode() for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert rows.keys() == {*range(20), 23}
    assert rows[23].endswith("mail [EMAIL]") and rows[5] == clean[5]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    documents(spark, []).drop("spans", "n_words").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def brute(rows, items):
    """(doc_id, text) that are left of rows (doc_id, text): all pairs, all windows, and e-mail addresses masked."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    words = [t.lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    fps = [simhash.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if ((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 3 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            group[find(a)] = find(b)
    kept = []
    for root in {find(k) for k in range(len(rows))}:
        own = [rows[k] for k in range(len(rows)) if find(k) == root]
        kept += [r for r in own if r[0] is None]
        ids = [i for i, _ in own if i is not None]
        kept += [r for r in own if ids and r[0] == min(ids)][:1]
    grams = [tuple(w[k : k + 10]) for w in (x.split() for x in items) for k in range(max(1, len(w) - 9))]
    bad = lambda t: any(tuple(w[k : k + len(g)]) == g for w in [t.lower().split()] for g in grams for k in range(len(w) - len(g) + 1))
    return sorted(((i, t.replace("me@example.com", "[EMAIL]")) for i, t in kept if not bad(t)), key=str)


def test_run_equals_brute_force(spark, tmp_path):
    """Near copies in chains, rows of one id, null ids and texts, repeated rows, a very long text, and columns with names that operators use."""
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))
    rows, ids = [], iter(rng.sample(range(1000), 400))
    for _ in range(12):
        words = text(rng.choice([8, 60, 200])).split()
        for _ in range(rng.randint(1, 6)):
            rows.append((next(ids), " ".join(words)))
            words[rng.randrange(len(words))] = text(1)
    passage = " ".join(f"bench{c}" for c in "abcdefghijkl")
    rows += [(next(ids), f"{text(50)} {passage} {text(5)}"), (next(ids), f"{text(50)} {' '.join(passage.split()[:9])} {text(5)}"), (next(ids), f"{text(30)} me@example.com {text(30)}")]
    rows += [(2000, text(40)), (2000, text(40)), (None, text(30)), (None, rows[0][1]), (2001, None), (2002, ""), (2003, "12 34"), rows[3], rows[3], (2004, text(60_000))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7, "h") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, row long, found string")
    docs.repartition(5).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "zz yy xx")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.default_codec().ranks, special_tokens={})
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    want = [(i, own.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in brute(rows, [passage, "zz yy xx"])]
    assert sorted(((r.doc_id, r.ids, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str) and all(r.n_tokens == len(r.ids) for r in got)
    assert 15 < len(want) < 40


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
