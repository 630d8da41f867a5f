"""Substring dedup by de Bruijn compaction (operator 7).

Edges of the graph are token k-mers of 50 words, nodes their 49-word ends; a document is a walk. A node is told by a 64-bit
hash, an edge by its two nodes. Nodes are dealt out by their minimizer (the least hash among their 10-word parts), so that
all occurrences of a node meet, each with the nodes before and after it; successive nodes of a walk that share a
minimizer travel as one row, a run. That makes one shuffle of about 9 bytes an edge.

Where they meet, a node's degrees are counted: it's inner if every occurrence has the same node before it, and the same
one after it. Branching nodes, and ends of documents, cut the paths. An edge that several documents have is repeated, and its
source is the least of its occurrences (document, text, first word). Successive repeated edges that only inner nodes part
have their occurrences in common; they make a piece, told once, at its source.

Compaction. Pieces end where another minimizer's nodes begin. A piece that begins at an inner node is joined to the one that
ends there, by node and source coordinates; joined pieces make a path. All occurrences of a path's first edge in
documents beyond the source's are spans to remove, as long as the path.

Verification. The words of every span, and of every path at its source, are read from the texts, and their SHA-256 must
agree. If they don't, or if a piece finds no other to join, two k-mers have one hash, and all is done anew with another seed.

Hot minimizers. One pass before counts all runs of every minimizer; those with over HOT_RUNS (the HOT_KEYS largest of them, so
that what's sent to all tasks is bounded, and the rest have no more than a HOT_KEYS-th of all runs) aren't grouped in a task: their
nodes' degrees and their edges' sources are grouped sums and minima, combined before the shuffle, and their occurrences are found by
joins that adaptive execution can split. What's hot decides the plan, not the result.

Defined results: null or empty text has no words; documents of under 50 words keep all; a null doc_id is no
source and loses nothing; rows that share a doc_id are no sources of each other; repeated rows give repeated rows; an
empty table gives an empty table; columns other than doc_id and text are not read. Very long texts are hashed in slabs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, durable_at, map_batches, release, sha256_hex, utf8

WINDOW, PART = 50, 10
NODE = WINDOW - 1
SLAB = 1 << 20
#: A run has so many nodes at most.
RUN = 256
#: A minimizer with more runs is hot; so many hot ones are told to all tasks at most.
HOT_RUNS, HOT_KEYS = 1000, 1 << 20
#: Seeds that are tried.
SEEDS = 5

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, m, np.uint64)])) for m in (_STEP, _BACK))


_UP, _DOWN = _powers(1 << 12)


def _rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` successive word hashes."""
    global _UP, _DOWN
    if len(_UP) <= len(words):
        _UP, _DOWN = _powers(2 * len(words))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _UP[: len(words)])])
    n = len(words) - size + 1
    return _mix((total[size:] - total[:-size]) * _DOWN[:n])


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every `size` successive values."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if width < size else x


def walk(text: str | None, seed: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A text's nodes, a slab at a time: the first one's word, their minimizers, and their hashes with those of the node before and the node after; 0 stands beyond the text."""
    words = utf8(text).split()
    if len(words) < WINDOW:
        return
    digest = xxhash.xxh64_digest
    hashed = np.frombuffer(b"".join([digest(w, seed) for w in words]), ">u8").astype(np.uint64)
    n = len(words) - NODE + 1
    for at in range(0, n, SLAB):
        to = min(at + SLAB, n)
        low, high = max(at - 1, 0), min(to + 1, n)
        own = np.maximum(_rolling(hashed[low : high + NODE - 1], NODE), np.uint64(1))
        beyond = np.zeros(1, np.uint64)
        whole = np.concatenate([*([beyond] if low == at else []), own, *([beyond] if high == to else [])])
        yield at, _least(_rolling(hashed[at : to + NODE - 1], PART), NODE - PART + 1), whole


def _runs(minimizers: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal minimizers, no longer than `longest`."""
    new = np.r_[True, minimizers[1:] != minimizers[:-1]]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(minimizers)])
    if sizes.max() > longest:
        new[np.concatenate([np.arange(s, s + n, longest) for s, n in zip(starts, sizes)])] = True
        starts = np.flatnonzero(new)
    return starts, np.r_[starts[1:], len(minimizers)]


def _hot(docs: DataFrame, seed: int, hot_runs: int) -> np.ndarray:
    """The minimizers with more than hot_runs runs, sorted."""

    def make():
        def run(ids, texts):
            found = [m[_runs(m, RUN)[0]] for d, t in zip(ids, texts) if d is not None for _, m, _ in walk(t, seed)]
            keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            return {"key": keys.view(np.int64), "n": n}

        return run

    sums = map_batches(docs, ["doc_id", "text"], "key bigint, n bigint", make).groupBy("key").agg(F.sum("n").alias("n"))
    top = sums.filter(F.col("n") > hot_runs).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").toArrow()
    return np.sort(top.column("key").to_numpy().astype(np.int64).view(np.uint64))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted `known`."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


_RUN_SCHEMA = "key bigint, doc_id bigint, th bigint, first bigint, nodes binary"


def _to_runs(hot, seed: int):
    """Of (doc_id, th, text): the runs of minimizers that aren't hot."""

    def make():
        known = hot.value

        def run(ids, hashes, texts):
            key, doc, th, first, nodes = ([] for _ in range(5))
            for d, t, text in zip(ids, hashes, texts):
                for at, m, h in walk(text, seed) if d is not None else ():
                    starts, ends = _runs(m, RUN)
                    cool = ~_among(m[starts], known)
                    starts, ends = starts[cool], ends[cool]
                    raw = h.tobytes()
                    key.extend(m[starts].view(np.int64).tolist())
                    first.extend((starts + at).tolist())
                    nodes.extend([raw[8 * a : 8 * b + 16] for a, b in zip(starts.tolist(), ends.tolist())])
                    doc.extend([d] * len(starts))
                    th.extend([t] * len(starts))
            return {"key": key, "doc_id": doc, "th": th, "first": first, "nodes": nodes}

        return run

    return make


_NODE_SCHEMA = "before bigint, head bigint, second bigint, doc_id bigint, th bigint, first bigint"


def _to_nodes(hot, seed: int):
    """Of (doc_id, th, text): each node of a hot minimizer, with the nodes before and after it."""

    def make():
        known = hot.value

        def run(ids, hashes, texts):
            parts = []
            for d, t, text in zip(ids, hashes, texts):
                for at, m, h in walk(text, seed) if d is not None else ():
                    own = np.flatnonzero(_among(m, known))
                    h = h.view(np.int64)
                    parts.append(np.stack([h[own], h[own + 1], h[own + 2], np.full(len(own), d, np.int64), np.full(len(own), t, np.int64), own + at]))
            whole = np.concatenate([np.empty((6, 0), np.int64), *parts], axis=1)
            return dict(zip(("before", "head", "second", "doc_id", "th", "first"), whole))

        return run

    return make


#: occurs: whether it's an occurrence of a path's first edge (head, second) or a piece, which has a tail, n edges, whether it begins at an inner node, and its source.
_FOUND = ["occurs", "head", "second", "tail", "n", "inner", "doc_id", "th", "first"]
_FOUND_SCHEMA = "occurs boolean, head bigint, second bigint, tail bigint, n bigint, inner boolean, doc_id bigint, th bigint, first bigint"


def _paths(key: np.ndarray, doc: np.ndarray, th: np.ndarray, first: np.ndarray, payload: list[bytes]) -> pa.RecordBatch:
    """Pieces, and occurrences of first edges, of all runs of some minimizers."""
    h = np.frombuffer(b"".join(payload), np.uint64)
    size = np.fromiter(map(len, payload), np.int64, len(payload)) // 8 - 2
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    at = place + 1 + np.repeat(np.cumsum(size + 2) - size - 2, size)
    before, node, after = h[at - 1], h[at], h[at + 1]
    doc, th, first = doc[row], th[row], first[row] + place
    mixed = node ^ _mix(key.view(np.uint64))[row]
    order = np.lexsort((first, th, doc, after, mixed))
    new_node = np.r_[True, (mixed[order][1:] != mixed[order][:-1]) | (key[row][order][1:] != key[row][order][:-1])]
    new_edge = new_node | np.r_[True, after[order][1:] != after[order][:-1]]
    starts = np.flatnonzero(new_node)
    alone = lambda x: np.minimum.reduceat(x[order], starts) == np.maximum.reduceat(x[order], starts)
    some = lambda x: np.minimum.reduceat(x[order], starts) > 0
    inner = np.empty(len(order), bool)
    inner[order] = (alone(before) & alone(after) & some(before) & some(after))[np.cumsum(new_node) - 1]
    edge, edges = np.cumsum(new_edge) - 1, np.flatnonzero(new_edge)
    least, last = order[edges], order[np.r_[edges[1:], len(order)] - 1]
    source, repeated = np.empty(len(order), np.int64), np.empty(len(order), bool)
    source[order], repeated[order] = least[edge], (doc[least] < doc[last])[edge]
    repeated &= after > 0
    begins = np.flatnonzero(repeated & ((place == 0) | ~inner | ~np.r_[False, repeated[:-1]]))
    # A piece ends before the next one's beginning, before an edge that isn't repeated, or with its run.
    stops = np.flatnonzero(np.r_[(~repeated | (place == 0))[1:], True])
    ends = np.minimum(stops[np.searchsorted(stops, begins)] + 1, np.r_[begins[1:], len(order)]) if len(begins) else begins
    told = source[begins] == begins
    piece, end = begins[told], ends[told]
    occurs = begins[~inner[begins] & (doc[begins] > doc[source[begins]])]
    both = np.r_[piece, occurs]
    none = np.zeros(len(occurs), np.int64)
    columns = [np.r_[np.zeros(len(piece), bool), np.ones(len(occurs), bool)], node[both].view(np.int64), after[both].view(np.int64), np.r_[after[end - 1].view(np.int64), none], np.r_[end - piece, none], inner[both], doc[both], th[both], first[both]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_FOUND)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by key to what _paths() tells of them; the last key of a batch may go on in the next."""
    held: list[list] = []  # parts of what isn't done yet: keys, documents, text hashes, first words, nodes

    def done(parts: list[list]) -> pa.RecordBatch:
        return _paths(*(np.concatenate([p[i] for p in parts]) for i in range(4)), [x for p in parts for x in p[4]])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), batch.column(4).to_pylist()]
        last = int(np.searchsorted(now[0], now[0][-1]))
        if held and (last or held[-1][0][-1] != now[0][0]):
            ready, held = [*held, [x[:last] for x in now]], []
            yield done(ready)
        elif last:
            yield done([[x[:last] for x in now]])
        held.append([x[last:] for x in now])
    if held:
        yield done(held)


def _hot_paths(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """What _paths() tells, of nodes of hot minimizers (durable): each edge is a piece of its own. And the folders it rests on."""
    one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0) & (F.max(c) != 0)
    nodes = rows.groupBy("head").agg((one("before") & one("second")).alias("inner"))
    edges = rows.filter("second <> 0").groupBy("head", "second").agg(F.min(F.struct("doc_id", "th", "first")).alias("s"), F.max("doc_id").alias("last")).filter("s.doc_id < last")
    pieces, path = durable_at(edges.join(nodes, "head").select("head", "second", "inner", "s"))
    told = pieces.select(F.lit(False).alias("occurs"), "head", "second", F.col("second").alias("tail"), F.lit(1).cast("bigint").alias("n"), "inner", "s.doc_id", "s.th", "s.first")
    later = rows.join(pieces.filter("not inner").select("head", "second", F.col("s.doc_id").alias("source")), ["head", "second"]).filter("doc_id > source")
    zero = F.lit(0).cast("bigint")
    return told.unionByName(later.select(F.lit(True).alias("occurs"), "head", "second", zero.alias("tail"), zero.alias("n"), F.lit(False).alias("inner"), "doc_id", "th", "first")), [path]


def _compacted(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (head, second, n, doc_id, th, first) of pieces, and whether each piece that begins at an inner node (follows: null if not) has been joined to another."""
    ended = pieces.select(F.col("tail").alias("head"), "doc_id", "th", (F.col("first") + F.col("n")).alias("first"), F.lit(True).alias("joined"))
    linked = pieces.join(ended, ["head", "doc_id", "th", "first"], "left").withColumn("follows", F.when(F.col("inner"), F.col("joined").isNotNull()))
    text = Window.partitionBy("doc_id", "th").orderBy("first")  # the paths of one source text
    numbered = linked.withColumn("path", F.sum(F.when(F.coalesce("follows", F.lit(False)), 0).otherwise(1)).over(text))
    paths = numbered.groupBy("doc_id", "th", "path").agg(F.min_by("head", "first").alias("head"), F.min_by("second", "first").alias("second"), F.sum("n").alias("n"), F.min("first").alias("first"), F.bool_and(F.coalesce("follows", F.lit(True))).alias("sound"))
    return paths.select("head", "second", "n", "doc_id", "th", "first", "sound")


def _graph(docs: DataFrame, seed: int, hot_runs: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Paths, occurrences of their first edges (head, second, doc_id, th, first), and the folders they rest on."""
    spark = docs.sparkSession
    known = _hot(docs, seed, hot_runs)
    release(spark)
    hot = spark.sparkContext.broadcast(known)
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = map_batches(own, ["doc_id", "th", "text"], _RUN_SCHEMA, _to_runs(hot, seed))
    found, path = durable_at(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, _FOUND_SCHEMA))
    paths = [path]
    del rows
    release(spark)
    if len(known):
        nodes, path = durable_at(map_batches(own, ["doc_id", "th", "text"], _NODE_SCHEMA, _to_nodes(hot, seed)))
        more, rest = _hot_paths(nodes)
        more, last = durable_at(more)
        drop(spark, path, *rest)
        found, paths = found.unionByName(more), [*paths, last]
    compacted, path = durable_at(_compacted(found.filter("not occurs")))
    release(spark)
    return compacted, found.filter("occurs").select("head", "second", "doc_id", "th", "first"), [*paths, path]


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """The words that no span (first, end) covers."""
    if not spans:
        return words
    keep, at = [], 0
    for first, end in sorted(spans):
        keep += words[at:first] if at < first else []
        at = max(at, end)
    return keep + words[at:]


_READ_SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept {kept}, told array<struct<head:bigint,second:bigint,digest:string>>"


def _removed(docs: DataFrame, kept: str, make_kept, hot_runs: int) -> DataFrame:
    """doc_id, n_words, n_removed and `kept` (make_kept() of the kept words, of SQL type `kept`) of every row, verified."""
    spark = docs.sparkSession

    def make():
        def run(ids, texts, asked):
            out = {"doc_id": ids, "n_words": [], "n_removed": [], "kept": [], "told": []}
            for text, wanted in zip(texts, asked):
                words = utf8(text).split()
                left = _kept(words, [(a["first"], a["end"]) for a in wanted or () if a["own"]])
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(left))
                out["kept"].append(make_kept(b" ".join(left)))
                out["told"].append([{"head": a["head"], "second": a["second"], "digest": sha256_hex(b" ".join(words[a["first"] : a["end"]]))} for a in wanted or ()])
            return out

        return run

    for seed in range(SEEDS):
        compacted, occurrences, folders = _graph(docs, seed, hot_runs)
        end = (F.col("first") + F.col("n") + (WINDOW - 1)).alias("end")
        spans = occurrences.join(compacted.select("head", "second", "n"), ["head", "second"]).select("doc_id", "th", F.lit(True).alias("own"), "first", end, "head", "second")
        sources = compacted.select("doc_id", "th", F.lit(False).alias("own"), "first", end, "head", "second")
        asked = spans.unionByName(sources).distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("own", "first", "end", "head", "second")).alias("asked"))  # of one text
        texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(asked, ["doc_id", "th"], "left")
        read, path = durable_at(map_batches(texts, ["doc_id", "text", "asked"], _READ_SCHEMA.format(kept=kept), make))
        digests = read.select(F.explode("told").alias("x")).groupBy("x.head", "x.second").agg((F.min("x.digest") == F.max("x.digest")).alias("same"))
        sound = compacted.filter("not sound").isEmpty() and digests.filter("not same").isEmpty()
        del spans, sources, asked, texts, digests, occurrences, compacted
        drop(spark, *folders)
        release(spark)
        if sound:
            return read.drop("told")
        drop(spark, path)
    raise RuntimeError(f"different passages had equal hashes under {SEEDS} seeds")


def dedup_text(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id and the kept text: words joined by one space."""
    return _removed(docs, "string", lambda kept: kept.decode("utf-8"), hot_runs).select("doc_id", F.col("kept").alias("text"))


def dedup_report(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return _removed(docs, "string", sha256_hex, hot_runs).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


#: The same rows as dedup_report()'s, window by window.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT id, doc_id, k, md5(array_to_string(w[k:k + {WINDOW - 1}], ' ')) AS h FROM (SELECT id, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM d)),
least AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT id, unnest(range(k, k + {WINDOW})) AS pos FROM win JOIN least USING (h) WHERE least < doc_id),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY pos) AS kept FROM (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d) ANTI JOIN gone USING (id, pos) GROUP BY id),
n AS (SELECT id, count(*) AS n_removed FROM gone GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (id) LEFT JOIN n USING (id)
"""
