"""SimHash near-duplicates by anchor-point covering (operator 6).

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of the text's word
shingles. Two fingerprints link if at most three bits differ, and groups are what links reach.

Anchors. Of two fingerprints that differ in three bits at most, one of the two 32-bit halves differs in at most one. So
each half has its own anchors: the 2^26 words of the perfect Hamming code of length 31 (a half's last bit is
left out of the anchor), which has covering radius 1. A fingerprint is copied to every anchor within the radius
plus the threshold, 1 + 1 = 2, of each half: that is one anchor where the half is a code word and 16 elsewhere, 32
copies of 16 bytes at most. Where one of a linked pair has its nearest anchor, the other is present as well, since it
is at most 1 further away. At an anchor, all 64 bits are compared.

Only distinct fingerprints take part, so exact copies cost nothing. An anchor emits at most the links of a
spanning forest if it holds many fingerprints, and an anchor of more than GROUP fingerprints is not held in one task:
it's cut in chunks, and each pair of chunks is compared as a group of its own.

Defined results: null or empty text, and text without words, has fingerprint zero, which links like any other. A row
with null doc_id gets a fingerprint and its group's id. A group whose doc_ids are all null has a null id. Repeated
rows give repeated rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import drop, durable, durable_at, map_batches, release, small, small_batches, utf8
from .components import components

#: Bits that linked fingerprints may differ in; the anchors are made for this number.
THRESHOLD = 3
SEED = 42
#: Fingerprints of one anchor that a task compares at once; beyond it they are cut in chunks of so many.
GROUP = 32_768
#: Up to so many fingerprints at an anchor are compared pairwise in vector form.
SMALL = 8
#: For near_groups(): words of a shingle, and the least similarity of linked texts (as a fraction).
NEAR_SHINGLE, SIMILARITY = 5, (4, 5)
#: Cells that all shingles are counted in, and of them in one row of the counts. Counts decide what the search costs, not what it finds.
CELLS, CELL_BLOCK = 1 << 20, 1 << 14
#: A shingle whose cell counts more is dealt out by SALTS parts of its sets.
HOT_SHINGLE, SALTS = 2000, 64
#: Pairs for each row at a shingle, on average, from which crowds are thinned first; sets of a shingle that are put in an order at once.
PAIRS_A_ROW, CROWD = 20, 10_000
#: Thinning goes on while at least this part of the pairs is alike.
FEW = 0.05
#: Sets that a task remembers at most, so as not to send copies again.
SEEN = 100_000


def _hashes(words: list[bytes], shingle_words: int) -> bytes:
    """The big-endian XXH64 hashes of the shingles, repeats included; fewer words are one shingle."""
    runs = words if shingle_words == 1 else [b" ".join(words)] if len(words) < shingle_words else map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, SEED) for s in runs])


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The signed 64-bit fingerprint. Upper-case A-Z count as lower-case; words end at ASCII white space."""
    words = utf8(text).lower().split()
    return _fingerprint(_hashes(words, shingle_words)) if words else 0


def _fingerprint(joined: bytes) -> int:
    n = len(joined) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, len(joined), 8 << 16):
        ones += np.unpackbits(np.frombuffer(joined[at : at + (8 << 16)], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """(key, fp bigint) for every row, without a shuffle."""

    def make():
        return lambda keys, texts: {key: keys, "fp": [fingerprint(t, shingle_words) for t in texts]}

    return map_batches(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, fp bigint", make)


def _flips() -> np.ndarray:
    """For each syndrome of the length-31 Hamming code, what to flip to reach each code word within distance 2."""
    out = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        pairs = [(1 << i - 1) | (1 << (i ^ s) - 1) for i in range(1, 32) if i < i ^ s and i ^ s]
        out[s] = [1 << s - 1, *pairs]
    return out


_FLIPS = _flips()
_CHECKS = [np.uint64(sum(1 << i - 1 for i in range(1, 32) if i >> bit & 1)) for bit in range(5)]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of uint64 fingerprints: the index of a fingerprint and an anchor of it, for all anchors within distance 2."""
    index, anchor = [], []
    for half in range(2):
        part = (fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        syndrome = np.zeros(len(fp), np.int64)
        for bit, check in enumerate(_CHECKS):
            syndrome |= (np.bitwise_count(part & check).astype(np.int64) & 1) << bit
        near = part[:, None] ^ _FLIPS[syndrome] | np.uint64(half << 32)
        real = np.ones_like(near, bool)
        real[syndrome == 0, 1:] = False
        rows, columns = np.nonzero(real)
        index.append(rows)
        anchor.append(near[rows, columns])
    return np.concatenate(index), np.concatenate(anchor)


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 20_000):
            own = fp[at : at + 20_000]
            index, anchor = anchors(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own[index])], names=["anchor", "fp"])


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of linked fingerprints among fp, a star around its first and the tree by which it was searched.

    Breadth first, each step against what's left: two edges for each fingerprint at most.
    """
    left, ends, roots = np.arange(len(fp)), [], []
    while len(left):
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= THRESHOLD
            if near.any():
                for start in {int(root), int(at)}:
                    ends.append(left[near])
                    roots.append(np.full(int(near.sum()), start))
                todo += left[near].tolist()
                left = left[~near]
    none = np.empty(0, np.int64)
    return (fp[np.concatenate([none, *roots])], fp[np.concatenate([none, *ends])])


def _links(key: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(key)])
    run = np.repeat(np.arange(len(starts)), sizes)
    out = []
    small = sizes[run] <= SMALL
    for k in range(1, SMALL):
        at = np.flatnonzero(small[:-k] & (run[:-k] == run[k:])) if len(run) > k else np.empty(0, np.int64)
        at = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= THRESHOLD]
        out.append((fp[at], fp[at + k]))
    for i in np.flatnonzero(sizes > SMALL):
        out.append(forest(fp[starts[i] : starts[i] + sizes[i]]))
    return out


def _compare(key_columns: int, limit: int):
    """Of rows (key..., fp) sorted by key: rows (a, b, part), with links if part is null, else what a run has beyond limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, part):
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(part, pa.int32())], names=["a", "b", "part"])

        held_key, held_fp = np.empty((0, key_columns), np.int64), np.empty(0, np.uint64)
        over, parts = None, 0  # the key whose rows go on to a second pass, and the chunks of it so far
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held_key = np.concatenate([held_key, np.stack(columns[:-1], axis=1)])
            held_fp = np.concatenate([held_fp, columns[-1].view(np.uint64)])
            if over is not None:
                same = int((held_key == over).all(axis=1).sum())
                if same:
                    yield out(held_key[:same, 0], held_fp[:same], np.full(same, parts, np.int32))
                    parts += 1
                    held_key, held_fp = held_key[same:], held_fp[same:]
                if len(held_key):
                    over = None
            if not len(held_key):
                continue
            last = int((held_key == held_key[-1]).all(axis=1).argmax())  # the last run may go on
            for a, b in _links(held_key[:last], held_fp[:last]) if last else ():
                if len(a):
                    yield out(a, b, np.full(len(a), None, object))
            held_key, held_fp = held_key[last:], held_fp[last:]
            if len(held_key) > limit:
                over, parts = held_key[0].copy(), 1
                yield out(held_key[:, 0], held_fp, np.zeros(len(held_fp), np.int32))
                held_key, held_fp = held_key[:0], held_fp[:0]
        for a, b in _links(held_key, held_fp) if len(held_key) else ():
            if len(a):
                yield out(a, b, np.full(len(a), None, object))

    return run


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp bigint) that join all fingerprints of a group, no more than needed at large anchors."""
    at = fps.mapInArrow(_to_anchors, "anchor bigint, fp bigint").repartition("anchor").sortWithinPartitions("anchor")
    found = durable(at.mapInArrow(_compare(1, group), "a bigint, b bigint, part int"))
    large = found.filter("part is not null").select(F.col("a").alias("anchor"), F.col("b").alias("fp"), "part")
    parts = large.groupBy("anchor").agg((F.max("part") + 1).alias("parts"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pairs = large.join(parts, "anchor").select("anchor", "part", "fp", other).select("anchor", F.least("part", "other").cast("bigint").alias("p"), F.greatest("part", "other").cast("bigint").alias("q"), "fp")
    again = pairs.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q").mapInArrow(_compare(3, 1 << 62), "a bigint, b bigint, part int")
    return found.filter("part is null").select("a", "b").unionByName(again.select("a", "b"))


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """For every row of df: the key, fp bigint, component_id (the least key reachable, itself included)."""
    each = durable(fingerprints(df, key, text, shingle_words))
    fps = durable(each.groupBy("fp").agg(F.min(key).alias("least")))
    return _named(each, fps, components(links(fps.select("fp")))).drop("root")


def simhash_report(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    return simhash_groups(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The 64-bit hashes of all distinct five-word shingles, sorted."""
    return np.unique(np.frombuffer(_hashes(words, NEAR_SHINGLE), ">u8").astype(np.uint64)) if words else np.empty(0, np.uint64)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two texts' distinct shingles. Two empty ones are equal."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / (len(x) + len(y) - shared) if len(x) or len(y) else 1.0


def _least_shared(n, m):
    """How many elements sets of n and m share at least if they're SIMILARITY alike."""
    up, down = SIMILARITY
    return -(-up * (n + m) // (up + down))


def parity(shingles: np.ndarray) -> bytes:
    """Parities of how many elements fall in each of a power of two of cells, two to four for each element, as bits."""
    cells = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def may_be_alike(n: int, m: int, x: bytes, y: bytes) -> bool:
    """False only for sets of n and m elements that can't be SIMILARITY alike: an element of one alone changes one parity, so as many differ as there are such elements at most."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    for _ in range(2):
        while len(a) > len(b):  # folded, parities are those of half the cells
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        a, b = b, a
    return n + m - int(np.bitwise_count(a ^ b).sum()) >= 2 * _least_shared(n, m)


def prefix(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order, those in cells of low count first: so many that sets SIMILARITY alike share one of them."""
    n, (up, down) = len(shingles), SIMILARITY
    length = n - -(-up * n // down) + 1
    return shingles[np.argsort(counts[(shingles % np.uint64(len(counts))).astype(np.int64)], kind="stable")[:length]]


def _may_reach(n, at, m, to):
    """Whether sets of n and m shingles that share those at places `at` and `to` of the common order can be SIMILARITY alike."""
    least, rest = (np.minimum, np.minimum(n - at, m - to)) if isinstance(n, np.ndarray) else (F.least, F.least(n - at, m - to))
    up, down = SIMILARITY
    return (down * least(n, m) >= up * (n + m - least(n, m))) & ((up + down) * (least(at, to) + rest) >= up * (n + m))


_MET = "h bigint, salt int, sid bigint, n bigint, at bigint, first bigint, able boolean"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, salt, sid, n, at) sorted by h, salt and sid: each with `first`, the least sid of its h and salt, and whether the two
    can be alike. Firsts themselves are left out where salt is -1. Two rows of a run are held, so that it may have any number."""
    least = last = None  # the first row of the run that may go on, and the last row
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        fresh = np.r_[last is None or (rows[0, :3] != last[:3]).any(), (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        first = rows[np.repeat(starts, np.diff(np.r_[starts, len(rows)]))]
        if least is not None:
            first[(rows[:, :2] == least[:2]).all(axis=1)] = least
        least, last = first[-1].copy(), rows[-1].copy()
        other = rows[:, 2] != first[:, 2]
        kept = fresh & (other | (rows[:, 1] >= 0))
        rows, first, other = rows[kept], first[kept], other[kept]
        able = _may_reach(rows[:, 3], rows[:, 4], first[:, 3], first[:, 4]) & other
        columns = [pa.array(rows[:, 0]), pa.array(rows[:, 1], pa.int32()), *(pa.array(rows[:, i]) for i in range(2, 5)), pa.array(first[:, 2]), pa.array(able)]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "salt", "sid", "n", "at", "first", "able"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, cells) sorted by block to one for each block, the cells' sums."""
    now, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "cells"])
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block != now:
                if now is not None:
                    yield row()
                now, total = block, np.zeros(len(cells) // 4, np.int64)
            total += np.frombuffer(cells, np.uint32)
    if now is not None:
        yield row()


def _read(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each of df: key, th, fp, sid (the id of its set of shingles), n (the set's size), marks (its parities); and
    a task's shingles counted by cells, a row (n null, th the block, cells) for each block of them. No shuffle."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(struct)
        counts, row = np.zeros(CELLS, np.uint32), lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        for batch in batches:
            fps, sids, sizes, marks = [], [], [], []
            for i in range(batch.num_rows):  # one text's words at a time
                words = utf8(batch.column(2)[i].as_py()).lower().split()
                own = shingle_set(words)
                fps.append(_fingerprint(_hashes(words, 3)) if words else 0)
                sids.append(_sid(own))
                sizes.append(len(own))
                marks.append(np.frombuffer(parity(own), np.int64))
                np.add.at(counts, (own % np.uint64(CELLS)).astype(np.int64), 1)
            yield row(batch.column(0), batch.column(1), fps, sids, sizes, marks, [None] * len(fps))
        if counts.any():
            blocks = range(0, CELLS, CELL_BLOCK)
            none = [None] * len(blocks)
            yield row(none, list(blocks), none, none, none, none, [counts[b : b + CELL_BLOCK].tobytes() for b in blocks])

    struct = StructType([StructField(key, kind), *StructType.fromDDL("th bigint, fp bigint, sid bigint, n bigint, marks array<bigint>, cells binary")])
    return df.select(key, F.xxhash64(text).alias("th"), text).mapInArrow(run, struct)


def _alike(df: DataFrame, text: str, each: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of ids of sets that are SIMILARITY alike. each: sid, th, n, marks of one text of every set.

    Parities rule out nearly all others first; only the texts of what's left are read and their shingles compared.
    """
    spark = df.sparkSession
    sided = lambda end: each.select(F.col("sid").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("n", "marks", "th")))

    def sift():
        def run(*columns):
            kept = [(a, b, i, j) for a, b, i, j, n, m, x, y in zip(*columns) if may_be_alike(n, m, np.array(x, np.int64).tobytes(), np.array(y, np.int64).tobytes())]
            return {c: [r[k] for r in kept] for k, c in enumerate(("a", "b", "a_th", "b_th"))}

        return run

    names = ["a", "b", "a_th", "b_th", "a_n", "b_n", "a_marks", "b_marks"]
    left, path = durable_at(map_batches(pairs.join(sided("a"), "a").join(sided("b"), "b"), names, "a bigint, b bigint, a_th bigint, b_th bigint", sift))
    wanted = small(left.select(F.col("a").alias("sid"), F.col("a_th").alias("th")).unionByName(left.select(F.col("b").alias("sid"), F.col("b_th").alias("th"))).distinct())
    texts = df.select(F.xxhash64(text).alias("th"), F.col(text).alias("text")).join(wanted.select("th").distinct(), "th", "left_semi").dropDuplicates(["th", "text"])
    shingled = map_batches(texts, ["text"], "sid bigint, shingles binary", lambda: lambda texts: dict(zip(("sid", "shingles"), zip(*[(_sid(own), own.tobytes()) for own in (shingle_set(utf8(t).lower().split()) for t in texts)]))) or {"sid": [], "shingles": []})
    sets, sets_path = durable_at(shingled.dropDuplicates(["sid"]))
    release(spark)
    of = lambda end: sets.select(F.col("sid").alias(end), F.col("shingles").alias(f"{end}_set"))

    def judge():
        told = lambda x: np.frombuffer(x, np.uint64)

        def run(a, b, x, y):
            kept = [similarity(told(u), told(v)) * SIMILARITY[1] >= SIMILARITY[0] for u, v in zip(x, y)]
            return {"a": [i for i, k in zip(a, kept) if k], "b": [i for i, k in zip(b, kept) if k]}

        return run

    found = durable(map_batches(left.select("a", "b").join(of("a"), "a").join(of("b"), "b"), ["a", "b", "a_set", "b_set"], "a bigint, b bigint", judge))
    drop(spark, path, sets_path)
    release(spark)
    return found


#: may_be_alike() of rows x and y whose parities have the same number of cells; others are told later.
_PARITY = "size(x.marks) <> size(y.marks) or x.n + y.n - aggregate(zip_with(x.marks, y.marks, (a, b) -> bit_count(a ^ b)), 0, (s, v) -> s + v) >= 2 * (({up} * (x.n + y.n) + {both} - 1) div {both})".format(up=SIMILARITY[0], both=sum(SIMILARITY))


def _mixed(met: DataFrame, roots: DataFrame) -> tuple[DataFrame, str]:
    """Rows of met at shingles that sets of several components have, with root and c, the number of such rows at the shingle; durable."""
    placed = met.join(roots.select(F.col("a").alias("sid"), F.col("b").alias("root")), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c")).filter("low <> high").select("h", "c")
    return durable_at(placed.join(mixed, "h").select("h", "sid", "n", "at", "root", "c"))


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row of df the key, th (xxhash64 of the text), root (its group) and component_id (the group's least key), by links of two kinds.

    Links of simhash_groups(); and those of texts whose distinct five-word shingles are SIMILARITY alike, all of them. Nodes
    are the distinct sets of shingles. Two sets that are so alike share a shingle of their prefixes, whatever the common order
    is; here it's that of all shingles' counts. At such a shingle each set is first compared with the least one there, and, once the
    components of these true links are known, with all others that belong to another component.
    """
    spark = small_batches(df.sparkSession)
    read, read_path = durable_at(_read(df, key, text))
    each = read.filter("n is not null").select(key, "th", "fp", "sid", "n", "marks")
    cells = read.filter("n is null").select(F.col("th").alias("block"), "cells").repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block bigint, cells binary")
    counts = np.zeros(CELLS, np.int64)
    for row in cells.collect():  # CELLS numbers in all
        own = np.frombuffer(row.cells, np.int64)
        counts[row.block : row.block + len(own)] = own
    shared = spark.sparkContext.broadcast(counts)

    def make_prefixes():
        seen: set[int] = set()

        def run(texts):
            sids, hashes, sizes, lengths = [], [], [], []
            for t in texts:
                own = shingle_set(utf8(t).lower().split())
                sid = _sid(own)
                if sid not in seen and len(own):
                    if len(seen) < SEEN:  # more copies in one task cost rows, nothing else
                        seen.add(sid)
                    h = prefix(own, shared.value)
                    sids.append(sid)
                    hashes.append(h.view(np.int64))
                    sizes.append(len(own))
                    lengths.append(len(h))
            at = np.concatenate([np.empty(0, np.int64), *map(np.arange, lengths)])
            h, sid = np.concatenate([np.empty(0, np.int64), *hashes]), np.repeat(np.array(sids, np.int64), lengths)
            salt = np.where(shared.value[(h.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)] > HOT_SHINGLE, sid.view(np.uint64) % np.uint64(SALTS), -1).astype(np.int32) if len(h) else np.empty(0, np.int32)
            return {"h": h, "salt": salt, "sid": sid, "n": np.repeat(np.array(sizes, np.int32), lengths), "at": at.astype(np.int32)}

        return run

    copies = map_batches(df, [text], "h bigint, salt int, sid bigint, n int, at int", make_prefixes)
    met, met_path = durable_at(copies.repartition("h", "salt").sortWithinPartitions("h", "salt", "sid").mapInArrow(_shared, _MET))
    release(spark)
    sets, sets_path = durable_at(each.groupBy("sid").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("marks").alias("marks")))
    # The firsts of a salted shingle are compared with the least of them.
    firsts = met.filter("salt >= 0 and sid = first").select("h", "sid")
    tops = firsts.join(firsts.groupBy("h").agg(F.min("sid").alias("top")), "h").filter("sid <> top").select(F.col("top").alias("a"), F.col("sid").alias("b"))
    alike = _alike(df, text, sets, met.filter("able").select(F.col("first").alias("a"), F.col("sid").alias("b")).unionByName(tops).distinct())
    # Sets with one fingerprint link anyhow: each with the least of them, which stands for the fingerprint.
    nodes = durable(each.groupBy("fp", "sid").agg(F.min(key).alias("least")))
    stands = durable(nodes.groupBy("fp").agg(F.min("sid").alias("one")))
    by_fp = nodes.join(stands, "fp").select(F.col("one").alias("a"), F.col("sid").alias("b"))
    end = lambda c: stands.select(F.col("fp").alias(c), F.col("one").alias(f"{c}_one"))
    linked = links(stands.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("a_one").alias("a"), F.col("b_one").alias("b"))
    roots = components(by_fp.unionByName(linked).unionByName(alike))
    release(spark)
    # What's left: at each shingle, the pairs of different components, but for those with the least set, which were compared.
    left, left_path = _mixed(met, roots)
    # Where that's many, a crowd around one text say, each set first meets one other at every shingle, in an order that each
    # shingle has of its own. Most crowds are one component after that; what isn't is compared pair by pair.
    for turn in itertools.count():
        each_root = left.groupBy("h", "root").agg(F.count("*").cast("double").alias("k"))
        by_h = each_root.groupBy("h").agg(F.sum("k").alias("rows"), F.expr("(sum(k) * sum(k) - sum(k * k)) / 2").alias("pairs"))
        size = by_h.agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).first()  # one row
        if (size.pairs or 0) <= PAIRS_A_ROW * (size.rows or 0):
            break
        mark = F.xxhash64("sid", "h", F.lit(turn))
        near = Window.partitionBy("h", F.pmod(mark, F.ceil(F.col("c") / CROWD))).orderBy(mark)
        met_next = left.withColumns({f"next_{c}": F.lead(c).over(near) for c in ("sid", "n", "at", "root")}).filter("root <> next_root")
        asked = met_next.filter(_may_reach(*map(F.col, ("n", "at", "next_n", "next_at")))).select(F.least("sid", "next_sid").alias("a"), F.greatest("sid", "next_sid").alias("b")).distinct()
        asked, asked_path = durable_at(asked)
        found = _alike(df, text, sets, asked)
        few = found.count() < FEW * asked.count()
        drop(spark, asked_path)
        roots = components(roots.unionByName(found))
        drop(spark, left_path)
        left, left_path = _mixed(met, roots)
        if few:
            break
    # Parities rule pairs out inside the join, so that a crowd's pairs are looked at but not written.
    marked = left.select("h", "sid", "n", "at", "root").join(sets.select("sid", "marks"), "sid")
    x, y = marked.alias("x"), marked.alias("y")
    apart = (F.col("x.h") == F.col("y.h")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.root") != F.col("y.root"))
    others = x.join(y, apart & F.expr(_PARITY) & _may_reach(*map(F.col, ("x.n", "x.at", "y.n", "y.at")))).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    every = components(roots.unionByName(_alike(df, text, sets, others)))
    ids = nodes.select(F.col("sid").alias("fp"), "least").groupBy("fp").agg(F.min("least").alias("least"))
    told = durable(_named(each.select(key, "th", F.col("sid").alias("fp")), ids, every).select(key, "th", "root", "component_id"))
    drop(spark, read_path, met_path, sets_path, left_path)
    release(spark)
    return told


def _sid(shingles: np.ndarray) -> int:
    """The id of a set of shingles."""
    return int.from_bytes(xxhash.xxh64_digest(shingles.tobytes(), SEED), "big", signed=True)


def _named(each: DataFrame, fps: DataFrame, linked: DataFrame) -> DataFrame:
    """each with root (the least node of its component) and component_id; fps: fp, least; linked: a node and the least node of its component."""
    roots = fps.join(linked.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return each.join(named, "fp").select(*each.columns, "root", "component_id")


def keep_one(df: DataFrame) -> DataFrame:
    """df with one row of each group of near_groups(): the row of least doc_id.

    Of rows of that doc_id, if the group has several, the one of least text hash stays, and of equal ones the least by all
    columns. Rows that share a doc_id but belong to different groups are judged each in its own. Rows with null doc_id stay.
    """
    kept = near_groups(df).filter("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("th").alias("th")).select("doc_id", "th").distinct()
    own = df.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.struct(*df.columns).alias("row")).filter("doc_id is not null")
    one = own.join(kept, ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.min("row").alias("row"))
    return one.select("row.*").unionByName(df.filter("doc_id is null"))
