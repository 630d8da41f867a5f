"""The training-data operators against brute force, on small tables with nulls, ties, repeated and long rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from fernweave.llm import avi, bpe, components, debruijn, decontam, langid, pii, quotes, secrets, simhash, warc
from tests.test_queries import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words long"


def documents(spark, texts, ids=None):
    """Columns beyond those of documents clash with names that the operators use."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


ODD = [None, "", " ", "\n", "word", "é ü 日本 \U0001f600", "a " * 3000, "x" * 20000, "word", None, "1.2.3.4 a@b.co"]


@pytest.mark.parametrize(
    "report",
    [avi.media_report, lambda d: bpe.bpe_digest(d, bpe.default_codec()), debruijn.dedup_report, langid.langid_report, pii.pii_report, secrets.secret_report, simhash.simhash_report, lambda d: decontam.decontaminate_report(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(0))],
)
def test_every_row_has_one_result(spark, report):
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 4, None, 10]
    got = report(documents(spark, ODD, ids)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(ids, key=str)
    assert report(documents(spark, [])).count() == 0


def test_bpe_equals_the_library(spark):
    codec = bpe.default_codec()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng, parts = random.Random(1), ["a", "b", " ", "  ", "\n", " \n", "\t", "é", "'s", "12", "!!", "\x1c", "\xa0", "日本", "\U0001f600", "\x85", "the", "q" * 50]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + ["z" * 50_000, "ab" * 3000, None]
    for t in texts:
        ids = codec.encode(t)
        assert ids.tolist() == own.encode_ordinary(t or "") and codec.decode(ids) == (t or "").encode()
    df = documents(spark, texts[:50])
    back = bpe.bpe_decode(bpe.bpe_encode(df, codec), codec).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {i: t.encode() for i, t in enumerate(texts[:50])}
    # What is remembered has no effect when it's dropped.
    small = bpe.BpeCodec(codec.ranks, codec.pattern)
    before, bpe.KEPT_BYTES = bpe.KEPT_BYTES, 600
    try:
        assert all((small.encode(t) == codec.encode(t)).all() for t in texts[:200])
    finally:
        bpe.KEPT_BYTES = before


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_minimal_perfect_hash(n):
    values = {f"key{i}".encode(): i for i in range(n)}
    table = bpe.MinimalPerfectHash(values)
    assert sorted(filter(None, table.keys)) == sorted(values) and len(table.keys) == n
    assert all(table.get(k) == v for k, v in values.items()) and table.get(b"absent") is None


def test_avi_round_trip_and_faults():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 70_000):
        data = rng.randbytes(n)
        payload = data.ljust(max(1, -(-n // 64)) * 64, b"\0")
        media = avi.write_avi(payload)
        back, frames, _ = avi.read_payload(media)
        assert back == payload and len(frames) == -(-len(payload) // 1024)
        images = avi.read_avi(media).images
        assert (avi._decode_each(avi._parse_image(images[0])) == frames[0]).all()
        # Without an index the movi list is read in order.
        assert avi.read_avi(media.replace(b"idx1", b"JUNK")).images == images
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFF0000WAVE")
    with pytest.raises(ValueError):
        avi.read_payload(media[:5000])


def test_avi_shots(spark):
    dark, light = np.zeros((16, 64), np.uint8), np.full((16, 64), 200, np.uint8)
    assert avi.shots([dark] * 8 + [light] * 8 + [dark] * 4) == [(0, 8), (8, 16), (16, 20)]
    assert avi.shots([]) == [] and avi.shots([dark]) == [(0, 1)]
    media = avi.write_avi(b"".join(f.tobytes() for f in [dark] * 25 + [light] * 25))
    rows = avi.clips(spark.createDataFrame([(1, bytearray(media)), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.start_s, r.end_s) for r in rows] == [(1, 0.0, 1.0), (1, 1.0, 2.0)]


def test_media_report(spark):
    r = avi.media_report(documents(spark, ["hé"])).first()
    payload = "hé".encode().ljust(64, b"\0")
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (3, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_pii_base_equals_the_patterns():
    rng = random.Random(3)
    parts = [*"a.@-+ 0123456789()_%é\n", "@a.b", "1.2.3.4", "4111 1111 1111 1111", "+1 555 1234567", "٣"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 24)))
        want = []
        for kind, p in PII.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                    want.append((kind, *m.span()))
        assert pii.base_spans(t) == sorted(want, key=pii._order), repr(t)


def test_pii_field_on_held_out_sentences():
    field, data = pii.model(), pii.labelled(400, 99)
    bases = [pii.base_spans(t) for t, _ in data]
    found = wrong = missed = 0
    for (_, truth), base, added in zip(data, bases, field.label([t for t, _ in data], bases)):
        hit = lambda spans, s: any(k == s[0] and a < s[2] and s[1] < b for k, a, b in spans)
        found += sum(hit(base + added, s) for s in truth)
        missed += sum(not hit(base + added, s) for s in truth)
        wrong += sum(not hit(truth, s) for s in added)
    assert found / (found + missed) > 0.93 and wrong / found < 0.02


def test_pii_repetitions_agree(spark):
    """A name told by a cue is found again far away, where nothing tells it."""
    text = "dear Zolan Quex, " + "plain words go here " * 40 + "and Zolan said so. Nobody else did."
    assert [text[a:b] for k, a, b in pii.model().label([text], [[]])[0] if k == "name"] == ["Zolan Quex", "Zolan"]
    masked = pii.mask(documents(spark, ["mail a@b.co now", None, "clean"])).orderBy("doc_id").collect()
    assert [r.text for r in masked] == ["mail [EMAIL] now", None, "clean"] and masked[0].n_chars == 16 and masked[0].source == "s"


def test_pii_similar_tokens_agree():
    """What a cue tells of one token holds for similar ones, far away; without any, a number of ten digits is none."""
    field, far = pii.model(), " plain words go here" * 40
    for text, kind, want in (
        (f"Dear Zolander Quex,{far} and Zolander's boat", "name", ["Zolander Quex", "Zolander's"]),
        (f"phone 030 1234567 now{far} 0301234567 again", "phone", None),
        (f"ring 555-123-4567 or wait{far}", "phone", ["555-123-4567"]),
        (f"write or call 555-123-4567.{far} It is (555) 123-4567 still", "phone", ["555-123-4567"]),
    ):
        found = [text[a:b] for k, a, b in field.label([text], [pii.base_spans(text)])[0] if k == kind]
        assert found if want is None else set(want) <= set(found), text
    assert pii.graph("0301234567 x 49301234567 Ab@c.de AB@x.yz Zolander Zolanders", [(0, 10), (13, 24), (25, 32), (33, 40), (41, 49), (50, 59)])[1] == [(0, 1), (2, 3), (4, 5)]
    assert field.label([f"the 4030123456 boxes{far}"], [[]])[0] == []


@pytest.mark.parametrize(
    "text",
    [
        '{"note":"' + "v" * 300 + '","ssn":"123-45-6789","n":[' + "1," * 200 + '2],"tax":"987-65-4321"}',
        "a=b&" * 80 + "ssn=123-45-6789&x=%20" + "y" * 50 + "&identity=%20987-65-4321&z=1",
        "用户" * 150 + "身份123-45-6789和" + "电话" * 150 + "987-65-4321。",
        "row," * 70 + "123-45-6789," + "x;" * 100 + "987-65-4321",
        "log_" * 70 + "ssn_123-45-6789_" + "x-" * 100 + "ssn_987-65-4321_end",
    ],
)
def test_pii_in_long_runs_without_blanks(text):
    found = pii.model().label([text], [pii.base_spans(text)])[0]
    assert [text[a:b] for k, a, b in found if k == "id"] == ["123-45-6789", "987-65-4321"]


def test_pii_messages_reach_any_distance():
    """On a chain of repetitions the messages are exact, as by products along it; and they settle on loops of opposites."""
    n, L = 60, len(pii.LABELS)
    field, unary = pii.SkipChain(None, np.eye(L) * 6, np.eye(L) * 12), np.zeros((n, L))
    unary[0, 3] = 9
    got = field.marginals(unary, np.empty((0, 2), np.int64), np.array([(i - 1, i) for i in range(1, n)]))
    want = np.exp(unary[0])
    for _ in range(1, n):
        want = want @ np.exp(field.skip)
        want /= want.sum()
    assert np.abs(got[-1] - want).max() < 1e-3
    odd = pii.SkipChain(None, np.eye(L) * -6, np.eye(L) * 6)
    ring = np.array([(0, 1), (1, 2), (2, 3), (3, 4)])
    assert np.isfinite(odd.marginals(unary[:5], ring, np.array([(0, 2), (0, 4), (1, 3)]))).all()


def test_secret_base_equals_the_patterns():
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rng = random.Random(4)
    parts = ["token", "ToKen", "api_key", "APIKEY", "ſecret", "toKen", "password", " ", "=", ":", "'", '"', "abcdef", "0123456789ab", "AKIA", "ABCDEFGHIJ", "Z9", "é", "\n", ".", "-", "x"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        want = [("assign", *m.span()) for m in re.finditer(assign, t) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secrets.base_spans(t) == sorted(want, key=secrets._order), repr(t)


def test_secret_network_on_held_out_findings(spark):
    net, rows = secrets.model(), secrets.labelled(1500, 77)
    found, truth = net.probability(secrets.windows([r[:3] for r in rows])) >= net.threshold, np.array([r[3] for r in rows]) == 1
    assert found[truth].mean() > 0.95 and truth[found].mean() > 0.97
    table = secrets.scores(documents(spark, ["key Zx8Kq2LmP9vT4nRw7YbC3dFg here", "thequickbrownfoxjumpsover1 ok", "token = abcdef123"])).collect()
    assert {r.doc_id: r.found for r in table} == {0: True, 1: False, 2: True}


def test_secrets_at_the_end_of_long_candidates():
    """The whole of a candidate is seen, not its first characters only."""
    net, key = secrets.model(), "Zx8Kq2LmP9vT4nRw7YbC3dFgH5jS1uXe6oA0"
    for filler in ("files/of/the/harbour/office/", "some-words-in-a-row-"):
        for n in (2, 5, 40):
            for text in (f"see {filler * n}{key} now", f"see {filler * n}{key}/{filler * n}end now"):
                (span, p), = secrets._judged(net, [text])[0]
                assert p >= net.threshold and text[span[1] : span[2]] == text.split()[1]
            (_, p), = secrets._judged(net, [f"see {filler * n}4 now"])[0]
            assert p < net.threshold
    assert secrets.pieces(3, 3 + 48) == [(3, 51)] and secrets.pieces(0, 100) == [(0, 100), (24, 72), (48, 96), (52, 100)]


def normal_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(decontam.UPPER, decontam.LOWER)))


def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = ["ab", "Cd", "é1", "x9"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(80)] + [None, ""]
    items = [(1, " ".join(rng.choices(vocabulary, k=14))), (2, texts[0][:30]), (3, "cd, cd; X9"), (4, None), (5, "..."), (3, "cd, cd; X9"), (6, texts[3])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for i, t in items:
        w = normal_words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for limit in (decontam.SET_LIMIT, 0):
        got = {r.doc_id: r for r in decontam.decontaminate_report(documents(spark, texts), bench, set_limit=limit).collect()}
        for i, t in enumerate(texts):
            w, covered, told = normal_words(t), set(), set()
            for g, ids in grams.items():
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        covered |= set(range(k, k + len(g)))
                        told |= ids
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(covered), len(told), bool(covered))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(told)).encode()).hexdigest()
        clean = {i for i in got if not got[i].contaminated}
        kept = decontam.drop_contaminated(documents(spark, texts), bench, set_limit=limit)
        assert kept.columns == documents(spark, []).columns and {r.doc_id for r in kept.collect()} == clean
        assert decontam.decontaminate_report(documents(spark, texts), bench.limit(0), set_limit=limit).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("limit", [decontam.SET_LIMIT, 0])
def test_decontamination_judges_each_row_by_its_own_text(spark, limit):
    passage = " ".join(f"bench{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    texts = [f"a {passage}", "clean one", f"b {passage} b", "clean two", "clean two", None]
    kept = decontam.drop_contaminated(documents(spark, texts, [None, None, 7, 7, 7, 8]), bench, set_limit=limit).collect()
    assert sorted((str(r.doc_id), str(r.text), r.lang, r.n_words) for r in kept) == [("7", "clean two", "en", 1), ("7", "clean two", "en", 1), ("8", "None", "en", 1), ("None", "clean one", "en", 1)]


def brute_components(fps, ids):
    least = dict.fromkeys(fps)
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(set(fps), 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    for f, i in zip(fps, ids):
        least[find(f)] = i if least.get(find(f)) is None else min(least[find(f)], i)
    return [least[find(f)] for f in fps]


def test_simhash(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(60)] for _ in range(12)]
    texts = [" ".join(w if rng.random() > p else "zz" for w in rng.choice(base)) for p in (0, 0, 0.005, 0.01, 0.02) for _ in range(25)] + ["", None, "a", "A", "a b", "\t"]
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: r for r in simhash.simhash_report(documents(spark, texts, ids)).collect()}

    def plain(t):
        w = (t or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [plain(t) for t in texts]
    assert [got[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in ids] == brute_components(fps, ids)


@pytest.mark.parametrize("group", [simhash.GROUP, 40])
def test_links_lose_none(spark, group):
    """Fingerprints around one centre: anchors of many rows, whole and cut in chunks."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(400):
        f = 0x0123456789ABCDEF
        for _ in range(rng.randint(0, 6)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = [(r.a, r.b) for r in simhash.links(rows, group).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unsigned = lambda x: x % (1 << 64)
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in found:
        parent[find(unsigned(a))] = find(unsigned(b))
    want = brute_components(list(fps), list(fps))
    assert len({(find(f), w) for f, w in zip(fps, want)}) == len(set(want)) == len({find(f) for f in fps})


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100), (None, 3)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_groups_keep_one(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    near = [*words]
    near[150] = "changed"
    other = [f"v{rng.randint(0, 400)}" for _ in range(300)]
    df = documents(spark, [" ".join(words), " ".join(near), " ".join(words), " ".join(other), None, "", "x"], [5, 6, 7, 8, 9, 10, None])
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {5, 8, 9, None}
    a, b, none = (simhash.shingle_set([w.encode() for w in t]) for t in (words, near, []))
    assert simhash.similarity(a, a) == 1 and 0.9 < simhash.similarity(a, b) < 1 and simhash.similarity(none, none) == 1


@pytest.mark.parametrize("cells, hot", [(simhash.CELLS, simhash.HOT_SHINGLE), (1 << 14, 8)])
def test_near_groups_miss_no_pair(spark, cells, hot, monkeypatch):
    """Chains in which only neighbours are 0.8 alike, and crowds of texts around a common one, against all pairs; with exact and with rough counts, and with salted shingles."""
    monkeypatch.setattr(simhash, "CELLS", cells)
    monkeypatch.setattr(simhash, "HOT_SHINGLE", hot)
    monkeypatch.setattr(simhash, "SALTS", 3)
    monkeypatch.setattr(simhash, "SEEN", 5)
    monkeypatch.setattr(simhash, "PAIRS_A_ROW", 20 if hot > 1000 else 1)
    monkeypatch.setattr(simhash, "CROWD", 30)
    rng = random.Random(19)
    texts = []
    for _ in range(4):
        line = [f"w{rng.randint(0, 5000)}" for _ in range(140)]
        texts += [" ".join(line[k * 4 : k * 4 + 60]) for k in range(20)]
    for _ in range(2):
        centre = [f"v{rng.randint(0, 300)}" for _ in range(120)]
        texts += [" ".join(w if rng.random() > 0.02 else f"x{rng.random()}" for w in centre) for _ in range(60)]
    texts += [texts[3], texts[90], "", None, "one", "One"]
    ids = rng.sample(range(1000), len(texts))
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    fps = [simhash.fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] | sets[j])
        if ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 3 or 5 * len(sets[i] & sets[j]) >= 4 * both:
            parent[find(i)] = find(j)
    want = {d: min(e for k, e in enumerate(ids) if find(k) == find(i)) for i, d in enumerate(ids)}
    assert {r.doc_id: r.component_id for r in simhash.near_groups(documents(spark, texts, ids).repartition(3)).collect()} == want


def test_similarity_of_long_texts_is_exact():
    """Texts of far more shingles than a sketch of the least hashes would hold."""
    rng = random.Random(18)
    for share in (0.0005, 0.004, 0.03, 0.045):
        words = [f"w{rng.random()}".encode() for _ in range(3000)]
        near = [w if rng.random() > share else b"changed" for w in words]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (words, near))
        a, b = simhash.shingle_set(words), simhash.shingle_set(near)
        assert simhash.similarity(a, b) == len(x & y) / len(x | y)


def test_parities_rule_out_no_alike_pair():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for n in (1, 3, 40, 63, 64, 65, 500, 5000):
        for share in (0, 0.02, 0.05, 0.1, 0.11, 0.12, 0.2, 0.5):
            for more in (1, 1.2, 1.26):
                x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                y = np.unique(np.r_[x[rng.random(len(x)) >= share], rng.integers(0, 1 << 63, int(n * (share + more - 1))).astype(np.uint64)])
                can = simhash.may_be_alike(len(x), len(y), simhash.parity(x), simhash.parity(y))
                assert can or simhash.similarity(x, y) < 0.8
                ruled_out += not can
    assert ruled_out > 60 and simhash.may_be_alike(0, 0, simhash.parity(x[:0]), simhash.parity(x[:0]))


def test_keep_one_among_rows_of_one_id(spark):
    """Rows that share a doc_id are judged in their own groups; of equal ones the least by all columns stays."""
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "alpha beta gamma delta epsilon zeta", "one two three four five six seven", None]
    df = documents(spark, texts, [1, 1, 2, 1, None]).withColumn("source", F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string")))
    want = {(1, texts[0]), (1, texts[1]), (None, None)}
    for n in (1, 3):
        got = simhash.keep_one(df.repartition(n))
        assert got.columns == df.columns and {(r.doc_id, r.text) for r in got.collect()} == want and got.count() == 3


@pytest.mark.parametrize("hot, run, weak", [(debruijn.HOT_RUNS, debruijn.RUN, False), (1, debruijn.RUN, False), (5, 3, False), (5, 7, True)])
def test_substring_dedup(spark, hot, run, weak, monkeypatch):
    """Whole and salted minimizers, runs cut at other places, and a first seed under which many nodes have one hash."""
    monkeypatch.setattr(debruijn, "RUN", run)
    if weak:
        walk = debruijn.walk
        monkeypatch.setattr(debruijn, "walk", lambda text, seed=0: ((a, m, np.where(h > 0, h % np.uint64(97) + np.uint64(1), h) if seed == 0 else h) for a, m, h in walk(text, seed)))
    rng = random.Random(9)
    pool = [" ".join(f"t{rng.randint(0, 3000)}" for _ in range(80)) for _ in range(6)] + ["x " * 120]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.5 else " ".join(f"u{rng.random()}" for _ in range(30)) for _ in range(3)) for _ in range(60)] + [None, "", pool[0], " ".join(pool[0].split()[:50]), " ".join(pool[0].split()[:49])]
    ids = rng.sample(range(500), len(texts) - 1) + [None]
    got = {r.doc_id: r for r in debruijn.dedup_report(documents(spark, texts, ids), hot).collect()}
    first = {}
    for i, t in sorted((i, t) for i, t in zip(ids, texts) if i is not None and t):
        w = t.split()
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    for i, t in zip(ids, texts):
        w = (t or "").split()
        gone = {q for p in range(len(w) - 49) if i is not None and first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    digests = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in debruijn.dedup_text(documents(spark, texts, ids), hot).collect()}
    assert digests == {i: r.kept_sha256 for i, r in got.items()}


@pytest.mark.parametrize("slab", [7, 50, 64])
def test_walks_in_slabs(slab, monkeypatch):
    text = " ".join(f"w{i % 90}" for i in range(400))
    (_, minimizers, nodes), = debruijn.walk(text)
    monkeypatch.setattr(debruijn, "SLAB", slab)
    parts = list(debruijn.walk(text))
    assert (np.concatenate([m for _, m, _ in parts]) == minimizers).all()
    assert all((h == nodes[at : at + len(h)]).all() for at, _, h in parts) and nodes[0] == nodes[-1] == 0


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in langid.langid_report(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_scores_against_plain_counts(spark):
    """Every prediction and score, by an independent reading of the rule: 230 languages, words of many kinds, ties."""
    import math

    rng = random.Random(12)
    languages = [f"l{i:03}" for i in range(230)]
    alphabets = {lang: rng.sample("abcdefghijklmnopqrstuvwxyzäöüéß日本語中文字", 9) for lang in languages}
    word = lambda lang: "".join(rng.choices(alphabets[lang], k=rng.randint(1, 7)))
    vocabulary = {lang: [word(lang) for _ in range(12)] for lang in languages}
    rows = []
    for i in range(1400):
        lang = rng.choice(languages)
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) if rng.random() < 0.7 else word(lang) for _ in range(rng.randint(0, 30))) + " 12!", lang if rng.random() < 0.9 else None))
    rows += [(2000, "Ωμέγα", None), (2001, "", "l000"), (2002, None, "l001"), (2003, rows[0][1], rows[0][2]), (None, rows[1][1], "zz")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.langid_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    training = {(i, t, lang) for i, t, lang in rows if i is not None and lang is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    seen = {n: {} for n in range(6)}  # n: gram: language: count
    pieces = lambda w, n: [w] if n == 0 else [w[i] for i in range(len(w))] if n == 1 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    for _, t, lang in training:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for n in range(6):
                for g in pieces(w, n):
                    by = seen[n].setdefault(g, {})
                    by[lang] = by.get(lang, 0) + 1
    names = sorted({lang for by in seen[0].values() for lang in by})
    total = {n: {x: sum(by.get(x, 0) for by in seen[n].values()) for x in names} for n in seen}
    kept = {n: {g for g, by in seen[n].items() if sum(by.values()) >= langid.LEAST_COUNT} for n in seen}
    log = lambda n, g, x: math.log((seen[n][g].get(x, 0) + 0.1) / (total[n][x] + 0.1 * max(len(kept[n]), 1)))
    truth = {}
    for i, t, _ in rows[:120] + rows[-5:]:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        sums = dict.fromkeys(names, 0.0)
        for w in words:
            n = next((n for n in (0, 5, 4, 3, 2, 1) if any(g in kept[n] for g in pieces(w, n))), None)
            for x in names if n is not None else ():
                sums[x] += sum(log(n, g, x) for g in pieces(w, n) if g in kept[n]) / max(n, 1)
        best = max(sums.values())
        truth[i] = ("und", 0.0) if not words else (min(x for x in names if sums[x] > best - 1e-9), 1 / sum(math.exp(s - best) for s in sums.values()))
    assert len(names) > 200 and len(got) == len(rows)
    for i, lang, score in got:
        if i in truth:
            assert (lang, score) == (truth[i][0], pytest.approx(truth[i][1], abs=1e-9))


def test_language_sample_is_bounded(spark):
    """Rows that repeat count once, and rows of one doc_id are drawn one by one."""
    docs = spark.range(6000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 3000).cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert 300 < langid.sample_of(docs, 1000).count() < 700  # half of them are repeated
    assert langid.sample_of(docs, 10_000).count() == 3000 and langid.sample_of(docs.limit(0), 10).count() == 0


def test_language_odd_texts(spark):
    docs = documents(spark, ["der die das und", "123 ²", None, "日本"] * 8)
    told = {(r.lang_pred, r.score) for r in langid.langid_report(docs).filter("doc_id % 4 in (1, 2)").collect()}
    assert told == {("und", 0.0)}
    assert langid.keep_identified(docs).filter("text is null").count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.langid_report(unlabelled).collect()} == {"und"}


def test_warc(spark, tmp_path):
    same, small = "<p>" + "y" * 1000, "<p>tiny"
    rows = [(1, "http://a/\r\nx", same), (2, None, same), (3, "u", None), (4, "u", small), (5, "u", small), (6, "é", same), (None, "n", same), (6, "é", same)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet/x")
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(f"{tmp_path}/pages.parquet/x"), f"{tmp_path}/flat.parquet")
    folder = tmp_path / "t"
    folder.mkdir()
    (tmp_path / "flat.parquet").rename(folder / "pages.parquet")
    compare(spark, str(folder), lambda s, d: warc.warc_report(s.read.parquet(f"{d}/pages.parquet")), warc.ORACLE)
    archives = warc.write_archives(warc.with_revisits(spark.read.parquet(f"{folder}/pages.parquet")), 1500).collect()
    (tmp_path / "a").mkdir()
    for i, a in enumerate(archives):
        (tmp_path / "a" / f"{i}.warc.zst").write_bytes(bytes(a.archive))
    back = warc.read_files(spark, f"file://{tmp_path}/a").collect()
    assert sorted(bytes(r.payload).decode() for r in back if r.payload is not None) == sorted([same, same, "", small, small]) and len(back) == 8


def test_warc_faults():
    record = warc.record(1, "u", b"x" * 2000, hashlib.sha1(b"x" * 2000).hexdigest(), None)
    data = warc.archive([record, record])
    assert list(warc.frames(data)) == [record, record]
    with pytest.raises(ValueError):
        list(warc.frames(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.frames(data[:-2] + bytes([data[-2] ^ 255]) + data[-1:]))
    for bad in (record.replace(b"xx", b"xy", 1), record[:-1], record.replace(b"Content-Length: 2", b"Content-Length: 3"), b"no"):
        with pytest.raises(ValueError):
            warc.content(*warc.parse(bad))


def test_decontamination_edges(spark):
    """Null ids and texts, clashing columns, repeated rows and one very long text, with whole and with partitioned sets."""
    passage = " ".join(f"bench{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage), (None, passage), (2, "short one"), (3, None)], "item_id long, text string")
    texts = [f"{'long ' * 200_000}{passage} end", passage, passage, None, "a short one here", ""]
    for limit in (decontam.SET_LIMIT, 0):
        got = decontam.decontaminate_report(documents(spark, texts, [1, 2, 2, 3, None, 4]), bench, set_limit=limit).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in got) == [("1", 200_013, 12, 1), ("2", 12, 12, 1), ("2", 12, 12, 1), ("3", 0, 0, 0), ("4", 0, 0, 0), ("None", 4, 2, 1)]
        assert decontam.decontaminate_report(documents(spark, []), bench, set_limit=limit).count() == 0


def brute_quotes(rows):
    """(conv, turn): content lines, thread and depth, by a plain reading of the rule."""
    prefix = re.compile(r"^(?:[ \t]*>)+[ \t]?")
    normal = lambda x: re.sub(r"[ \t\r\n\f\x0B]+", " ", x.lower()).strip(" ")
    units = lambda xs: ([" ".join(xs)] if xs else []) + xs
    own, passages, first, reply = {}, {}, {}, {}
    for conv, turn, _, text in rows:
        plain, found, before = [], [], 0
        for i, line in enumerate((text or "").split("\n")):
            m = prefix.match(line)
            level, body = (m[0].count(">"), line[m.end() :]) if m else (0, line)
            if not level:
                plain.append(body)
            elif level == before:
                found[-1][2].append(body)
            else:
                found.append((level, i, [body]))
            before = level
        own[conv, turn] = [x for x in map(normal, plain) if x]
        passages[conv, turn] = [(lv, i, [x for x in map(normal, b) if x]) for lv, i, b in found]
    for (conv, turn), xs in own.items():
        for u in units(xs):
            first[conv, u] = min(turn, first.get((conv, u), turn))
    for (conv, turn), ps in passages.items():
        found = [((lv, i, k), first[conv, u]) for lv, i, b in ps for k, u in enumerate(units(b)) if first.get((conv, u), turn) < turn]
        if found:
            reply[conv, turn] = min(found)[1]
    out = {}
    for key in own:
        at, depth = key, 0
        while at in reply:
            at, depth = (at[0], reply[at]), depth + 1
        out[key] = (reply.get(key), at[1], depth)
    return out


def test_quotes_of_generated_conversations(spark, tmp_path):
    """Nested quotes, lines that nearly all messages share, chains of 60 replies, negative turns; against brute force and SQL."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, rows = random.Random(14), []
    for conv in range(25):
        said = []
        for turn in range(-3, 57 if conv == 0 else rng.randint(0, 14)):
            lines = ["Thanks a lot!"] if rng.random() < 0.8 else []
            lines += [f"{rng.choice(['Point', 'point', ' POINT  '])} {rng.randint(0, 400)} of {conv}" for _ in range(rng.randint(0, 3))]
            quoted = []
            for _ in range(1 if conv == 0 and said else rng.randint(0, 2) if said else 0):
                source = said[-1] if conv == 0 else rng.choice(said)
                quoted += [f"{rng.choice(['>', '> ', ' >'])}{x.swapcase() if rng.random() < 0.5 else x}" for x in source]
            text = quoted + lines if rng.random() < 0.7 else lines[:1] + quoted + lines[1:]
            if conv == 0:
                text = [*quoted, f"only {turn}"]
                lines = [f"only {turn}"]
            said.append(text if rng.random() < 0.3 and conv else lines or ["nothing"])
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(text)))
    rows += [(30, 0, "user", "x" * 100_000), (30, 1, "user", ">" + "X" * 100_000 + "\nshort"), (31, 5, None, None)]
    columns = list(zip(*rows))
    pq.write_table(pa.table({"conv_id": pa.array(columns[0], pa.int64()), "turn": pa.array(columns[1], pa.int64()), "role": columns[2], "text": columns[3], "level": columns[3], "passages": columns[0]}), tmp_path / "conversations.parquet")
    run = lambda s, d: quotes.conversations(s.read.parquet(f"{d}/conversations.parquet"))
    compare(spark, str(tmp_path), run, quotes.ORACLE)
    got = run(spark, str(tmp_path)).collect()
    want = brute_quotes(rows)
    assert {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth) for r in got} == want
    assert max(d for _, _, d in want.values()) >= 50 and sum(r is not None for r, _, _ in want.values()) > 150
    for conv in range(25):
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.reply_order)
        assert own == sorted(own, key=lambda r: (r.thread, r.depth, r.turn))
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, line string")).count() == 0


def test_warc_edges(spark, tmp_path):
    """An empty table, one very long page with its copy, and clashing columns."""
    page = "<p>" + "é" * 12_000_000
    docs = spark.createDataFrame([(1, "u", page, "x", 1), (2, "u", page, "x", 1), (3, None, "", "x", 1)], "page_id long, url string, html string, digest string, n long")
    got = {r.page_id: r for r in warc.warc_report(docs).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[1].payload_bytes) == ("revisit", 2, "response", 24_000_003)
    assert got[3].payload_digest == hashlib.sha1(b"").hexdigest() and warc.warc_report(docs.limit(0)).count() == 0


def test_quotes(spark, tmp_path):
    rows = [(1, 0, "user", "Hello there\nHow are  you?"), (1, 1, "assistant", "> Hello there\n> how are you?\nFine.\n> nothing known\nok"), (1, 2, "user", "> > Hello there\n> Fine.\n\nGreat"), (1, 3, None, ">Great\n>> fine.\n>>> hello there\nbye"), (1, 4, "user", None), (1, 5, "user", "> Great\r\nX\r\n")]
    rows += [(2, 0, "user", "> Great\nY"), (2, 1, "user", ""), (2, 1, "user", "> y\nZ"), (None, 0, "user", "> y"), (2, None, "user", "> y\nq"), (2, 3, "user", ">\n> \n>> z\nfin"), (2, 1, "user", "> y\nZ"), (4, 0, "a", "x")]
    rows += [(4, i, "a", f"> {'x' if i == 1 else f'r{i - 1}'}\nr{i}") for i in range(1, 12)]
    import pyarrow as pa
    import pyarrow.parquet as pq

    columns = list(zip(*rows))
    pq.write_table(pa.table({"conv_id": pa.array(columns[0], pa.int64()), "turn": pa.array(columns[1], pa.int64()), "role": columns[2], "text": columns[3]}), tmp_path / "conversations.parquet")
    run = lambda s, d: quotes.conversations(s.read.parquet(f"{d}/conversations.parquet"))
    compare(spark, str(tmp_path), run, quotes.ORACLE)
    deepest = run(spark, str(tmp_path)).filter("conv_id = 4").orderBy(F.desc("depth")).first()
    assert (deepest.turn, deepest.thread, deepest.depth, deepest.content) == (11, 0, 11, "r11")
