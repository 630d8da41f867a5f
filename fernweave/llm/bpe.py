"""Byte-level BPE encoding and decoding (operator 2).

Two tiers. A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash: one hash, one
displacement, one comparison with the only key that can be in that slot. Any other pre-token starts as single
bytes in a linked list, and a heap of adjacent pairs gives the merge of lowest rank, leftmost first, until none
is left. Results equal those of the public `tiktoken` library for the same ranks and pattern.

Texts are cut before each space that a non-space follows; no pre-token of the pattern crosses such a cut, so what a
piece encodes to depends on the piece alone and is kept in a bounded table of recent pieces.

Defined results: null text counts as empty; an empty text has no ids; repeated rows give repeated rows; an empty
table gives an empty table; columns other than the key and the text are not read. Texts of any length are encoded
whole: a pre-token of n bytes takes O(n log n) steps.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, sha256_hex

#: Bytes of pieces kept in each of two generations by a Python worker, what a piece takes beside its characters and ids, and the longest piece kept.
KEPT_BYTES, PIECE_BYTES, KEPT_LENGTH = 72 << 20, 190, 48


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and decimal ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: Odd multipliers that spread a hash over the slots, and the mask of a 64-bit word.
_SALT, _MIX, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


class MinimalPerfectHash:
    """n keys to n slots without collision, by hash and displace; `get` returns a key's value or None."""

    def __init__(self, values: dict[bytes, int], keys_per_bucket: int = 3):
        keys = list(values)
        n = self.n = len(keys)
        self.buckets = n // keys_per_bucket + 1
        self.shift = [0] * self.buckets
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate((hashes % np.uint64(self.buckets)).tolist()):
            members[b].append(i)
        taken = np.zeros(n, bool)
        place = np.zeros(n, np.int64)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        singles = [b for b in order if len(members[b]) == 1]
        for b in order:
            own = np.array(members[b], np.int64)
            if len(own) < 2:
                break
            for d in range(0, 1 << 24, 128):
                salt = np.arange(d, d + 128, dtype=np.uint64)[:, None] * np.uint64(_SALT)
                slots = ((((hashes[own] ^ salt) * np.uint64(_MIX)) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                ordered = np.sort(slots, axis=1)
                fits = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fits.any():
                    at = int(fits.argmax())
                    taken[slots[at]] = True
                    place[own] = slots[at]
                    self.shift[b] = d + at
                    break
            else:
                raise ValueError("two keys have one hash")
        for b, slot in zip(singles, np.flatnonzero(~taken).tolist(), strict=True):
            place[members[b][0]] = slot
            self.shift[b] = -slot - 1
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for key, slot in zip(keys, place.tolist(), strict=True):
            self.keys[slot] = key
            self.values[slot] = values[key]

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else (((h ^ (d * _SALT & _WORD)) * _MIX & _WORD) >> 32) % self.n
        return self.values[slot] if self.keys[slot] == key else None


class BpeCodec:
    """Encodes and decodes by a rank table and a pre-token pattern, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        self.ranks, self.pattern, self.whole = ranks, pattern, MinimalPerfectHash(ranks)
        self.tokens = {rank: token for token, rank in ranks.items()}

    def __getstate__(self):
        return self.ranks, self.pattern, self.whole, self.tokens

    def __setstate__(self, state):
        self.ranks, self.pattern, self.whole, self.tokens = state

    @property
    def pre_tokens(self):
        """The compiled pattern's findall; white space is Unicode's property, as in the library's regex dialect."""
        if "_find" not in self.__dict__:
            self._find = regex.compile(self.pattern).findall
        return self._find

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that isn't in the vocabulary: a heap of adjacent pairs over a linked list of parts."""
        if "_pairs" not in self.__dict__:
            self._pairs, self._bytes = _pair_table(self.ranks), [self.ranks[bytes([b])] for b in range(256)]
        rank_of, n = self._pairs.get, len(token)
        part: list[int | None] = [self._bytes[b] for b in token]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [r << bits | i for i in range(n - 1) if (r := rank_of(part[i] << _ID_BITS | part[i + 1])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i, rank = entry & low, entry >> bits
            left, mid = part[i], after[i]
            if left is None or mid >= n or rank_of(left << _ID_BITS | part[mid]) != rank:
                continue  # one of the two parts has changed since
            stop = after[mid]
            part[i], part[mid], after[i] = rank, None, stop
            if stop < n:
                before[stop] = i
                if (r := rank_of(rank << _ID_BITS | part[stop])) is not None:
                    push(heap, r << bits | i)
            if i and (r := rank_of(part[before[i]] << _ID_BITS | rank)) is not None:
                push(heap, r << bits | before[i])
        return [p for p in part if p is not None]

    def encode_piece(self, piece: str) -> list[int]:
        ids: list[int] = []
        for pre in self.pre_tokens(piece):
            token = pre.encode("utf-8")
            whole = self.whole.get(token)
            if whole is None:
                ids += self.merge(token)
            else:
                ids.append(whole)
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, int32."""
        if not text:
            return np.empty(0, np.int32)
        if "_recent" not in self.__dict__:
            self._recent = _Recent(self)
        first, *rest = _cut(text)
        return np.frombuffer(b"".join([_packed(self.encode_piece(first)), *map(self._recent.__getitem__, rest)]), np.int32)

    def csv(self, ids: np.ndarray) -> str:
        """Decimal ids joined by commas."""
        return ",".join(self._table("_decimal", lambda rank, token: str(rank))[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self._table("_token", lambda rank, token: token)[ids])

    def _table(self, name: str, value) -> np.ndarray:
        if name not in self.__dict__:
            table = np.full(max(self.tokens) + 1, None, object)
            for rank, token in self.tokens.items():
                table[rank] = value(rank, token)
            setattr(self, name, table)
        return getattr(self, name)


#: Bits of an id in the key of a pair of ids.
_ID_BITS = 24


def _pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """For each two tokens that together are a token: both ids to its rank."""
    get = ranks.get
    return {a << _ID_BITS | b: rank for token, rank in ranks.items() for cut in range(1, len(token)) if (a := get(token[:cut])) is not None and (b := get(token[cut:])) is not None}


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


#: A space that a non-space follows starts a piece. (Python's \S is the narrower class, which only makes pieces longer.)
_CUT = re.compile(r" (?=\S)")
_NO_CUT = re.compile(r" (?!\S)")


def _cut(text: str) -> list[str]:
    return _CUT.split(text) if _NO_CUT.search(text) else text.split(" ")


class _Recent(dict):
    """Pieces (without their leading space) to their packed ids: two generations, the older dropped when this is full."""

    def __init__(self, codec: BpeCodec):
        self.codec, self.older, self.held = codec, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = _packed(self.codec.encode_piece(" " + piece))
        if len(piece) <= KEPT_LENGTH:
            if self.held >= KEPT_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
            self.held += PIECE_BYTES + len(piece) + len(ids)
        return ids


def codec_for(vocabulary: str, pattern: str | None = None) -> BpeCodec:
    """A codec from a rank file; by default with the pattern of the public tokenizers package."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return BpeCodec(load_ranks(vocabulary), pattern)


def bpe_encode(df: DataFrame, codec: BpeCodec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: the key and `ids array<int>`. No shuffle; the codec (about 1 MB) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def make():
        own = shared.value  # with the pieces that this worker has met; it goes with the broadcast
        return lambda keys, texts: {key: keys, "ids": [own.encode(t).tolist() for t in texts]}

    return map_batches(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>", make)


def bpe_decode(df: DataFrame, codec: BpeCodec, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The inverse: the key and `decoded binary`. Null ids count as none; an id outside the vocabulary is an error."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def make():
        own = shared.value  # with the pieces that this worker has met; it goes with the broadcast
        return lambda keys, rows: {key: keys, "decoded": [own.decode(np.array(r or [], np.int64)) for r in rows]}

    return map_batches(df, [key, ids], f"`{key}` {df.schema[key].dataType.simpleString()}, decoded binary", make)


def bpe_digest(df: DataFrame, codec: BpeCodec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text, and return for each row the key, n_tokens, ids_sha256 and decoded_sha256."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def make():
        own = shared.value  # with the pieces that this worker has met; it goes with the broadcast

        def run(keys, texts):
            out: dict[str, list] = {key: keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in texts:
                ids = own.encode(t)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha256_hex(own.csv(ids).encode("ascii")))
                out["decoded_sha256"].append(sha256_hex(own.decode(ids)))
            return out

        return run

    return map_batches(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)


def bpe_tokens(df: DataFrame, codec: BpeCodec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row the key, n_tokens, ids array<int>, and decoded_sha256 of what the ids decode to."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def make():
        own = shared.value  # with the pieces that this worker has met; it goes with the broadcast

        def run(keys, texts):
            ids = [own.encode(t) for t in texts]
            return {key: keys, "n_tokens": [len(i) for i in ids], "ids": ids, "decoded_sha256": [sha256_hex(own.decode(i)) for i in ids]}

        return run

    return map_batches(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids array<int>, decoded_sha256 string", make)


def default_codec(spark: SparkSession | None = None) -> BpeCodec:
    """By the public vocabulary for many languages."""
    import public_tokenizers

    return codec_for(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
