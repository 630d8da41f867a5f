"""AVI motion-JPEG columns (operator 3): RIFF indexes, intra frames, shots by adaptive histogram differences, timed clips.

Bytes are stored as 8-bit grey samples of 64 x 16 intra frames, each a lossless JPEG (process 14, predictor: left), in an
AVI file with an idx1 index. The last frame is filled up with zero rows; the payload's length stands in the INFO list.

The frames' Huffman table gives difference category c a code of 9 - c bits, so that code and extra bits are
9 bits for every sample. That is an ordinary table to any decoder (Kraft sum 511/512, the all-ones code unused),
and it lets numpy encode and decode all samples of a file at once. Frames with other tables or predictors are
decoded sample by sample.

Shots. Consecutive frames' 16-bin grey histograms are compared by half their L1 distance; a cut is where the distance
exceeds both a floor and a multiple of the mean distance of the 5 steps on either side, and no neighbour exceeds it.

Defined results: null text counts as empty, whose payload is 64 zero bytes; equal texts give equal files;
repeated rows give repeated rows; an empty table gives an empty table; columns other than the key and the text are
not read. Texts of any length are stored and read back in slabs of 1 MB of samples.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches, sha256_hex, utf8

WIDTH, HEIGHT, FPS = 64, 16, 25
FRAME = WIDTH * HEIGHT
SLAB = 1024
#: Shots: a cut's distance is at least CUT_FLOOR and CUT_FACTOR times the mean distance of SPAN steps on either side.
CUT_FLOOR, CUT_FACTOR, SPAN, BINS = 0.2, 1.5, 5, 16


def _sample_codes() -> tuple[np.ndarray, np.ndarray]:
    """9 bits for each difference from -255 to 255, and the difference for each 9-bit code."""
    bits, back, code, codes = np.zeros((511, 9), np.uint8), np.zeros(512, np.int16), 0, {}
    for length in range(1, 10):  # canonical: one code of each length, for categories 8 to 0
        codes[9 - length] = code
        code = code + 1 << 1
    for d in range(-255, 256):
        category = abs(d).bit_length()
        value = codes[category] << category | (d if d >= 0 else d + (1 << category) - 1)
        bits[d + 255] = [value >> 8 - i & 1 for i in range(9)]
        back[value] = d
    return bits, back


_BITS, _BACK = _sample_codes()
_COUNTS = bytes([1] * 9 + [0] * 7)
_SYMBOLS = bytes(range(8, -1, -1))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_JPEG_HEAD = b"\xff\xd8" + _segment(0xC4, b"\x00" + _COUNTS + _SYMBOLS) + _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG images of uint8 samples (frames, HEIGHT, WIDTH)."""
    out: list[bytes] = []
    for at in range(0, len(samples), SLAB):
        x = samples[at : at + SLAB].astype(np.int16)
        d = x.copy()
        d[:, :, 1:] -= x[:, :, :-1]
        d[:, 1:, 0] -= x[:, :-1, 0]
        d[:, 0, 0] -= 128
        packed = np.packbits(_BITS[d.reshape(len(x), -1) + 255].reshape(len(x), -1), axis=1)
        out += [_JPEG_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed]
    return out


@dataclass
class _Image:
    """The parts of a one-component lossless JPEG."""

    width: int
    height: int
    predictor: int
    counts: bytes
    symbols: bytes
    data: bytes


def _parse_image(image: bytes) -> _Image:
    if image[:2] != b"\xff\xd8" or image[-2:] != b"\xff\xd9":
        raise ValueError("not a whole JPEG image")
    at, size, table = 2, None, (b"", b"")
    while True:
        if image[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        marker, length = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body = image[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC4:
            table = (body[1:17], body[17 : 17 + sum(body[1:17])])
        elif marker == 0xC3:
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only 8-bit images of one component are decoded")
            size = struct.unpack(">HH", body[1:5])
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError(f"JPEG process {marker - 0xC0} isn't lossless sequential Huffman")
        elif marker == 0xDA:
            if size is None:
                raise ValueError("a JPEG scan comes before its frame header")
            return _Image(size[1], size[0], body[3], *table, image[at:-2].replace(b"\xff\x00", b"\xff"))


def _decode_each(image: _Image) -> np.ndarray:
    """Any table, any of the seven predictors; sample by sample."""
    lookup, code, i = {}, 0, 0
    for length, n in enumerate(image.counts, 1):
        for _ in range(n):
            lookup[length, code] = image.symbols[i]
            code, i = code + 1, i + 1
        code <<= 1
    value, left = int.from_bytes(image.data, "big"), 8 * len(image.data)

    def take(n: int) -> int:
        nonlocal left
        left -= n
        if left < 0:
            raise ValueError("JPEG data ends early")
        return value >> left & (1 << n) - 1

    w, h = image.width, image.height
    x = np.zeros((h, w), np.int64)
    for r in range(h):
        for c in range(w):
            code = length = 0
            while (length, code) not in lookup:
                code, length = code << 1 | take(1), length + 1
                if length > 16:
                    raise ValueError("no such JPEG code")
            category = lookup[length, code]
            d = take(category) if category else 0
            if category and d < 1 << category - 1:
                d -= (1 << category) - 1
            if r and c:
                a, b, e = int(x[r, c - 1]), int(x[r - 1, c]), int(x[r - 1, c - 1])
                guess = (0, a, b, e, a + b - e, a + (b - e >> 1), b + (a - e >> 1), a + b >> 1)[image.predictor]
            else:
                guess = int(x[r, c - 1]) if c else int(x[r - 1, c]) if r else 128
            x[r, c] = guess + d & 0xFFFF
    return x.astype(np.uint8)


def decode_frames(images: list[bytes]) -> list[np.ndarray]:
    """uint8 samples (height, width) of lossless JPEG images; runs of our own kind of image are decoded together."""
    out: list[np.ndarray] = []
    for at in range(0, len(images), SLAB):
        slab = images[at : at + SLAB]
        if all(image.startswith(_JPEG_HEAD) for image in slab):
            data = b"".join([image[len(_JPEG_HEAD) : -2].replace(b"\xff\x00", b"\xff") for image in slab])
            if len(data) != len(slab) * FRAME * 9 // 8:
                raise ValueError("JPEG data ends early")
            b = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, 9)
            d = _BACK[np.packbits(b[:, 1:], axis=1)[:, 0] + b[:, 0].astype(np.int16) * 256].reshape(-1, HEIGHT, WIDTH).astype(np.int32)
            d[:, 0, 0] += 128
            d[:, :, 0] = d[:, :, 0].cumsum(axis=1)
            out += list(d.cumsum(axis=2).astype(np.uint8))
        else:
            out += [_decode_each(_parse_image(image)) for image in slab]
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file that holds the payload's bytes as grey samples."""
    n = max(1, -(-len(payload) // FRAME))
    images = encode_frames(np.frombuffer(payload.ljust(n * FRAME, b"\0"), np.uint8).reshape(n, HEIGHT, WIDTH))
    most = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    at, index = 4, []
    for image in images:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += 8 + len(image) + (len(image) & 1)
    movi = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", image) for image in images]))
    return _chunk(b"RIFF", b"AVI " + head + info + movi + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk is longer than what holds it")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


@dataclass
class Avi:
    """What read_avi finds: the images of the first video stream, frames a second, and the payload's length if it's stated."""

    images: list[bytes]
    fps: float
    payload: int | None


def read_avi(data: bytes) -> Avi:
    """Parse a RIFF AVI file: images by its idx1 index, else by its OpenDML indexes, else in the order of the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, payload, movi, idx1, supers, stream = float(FPS), None, None, None, [], -1
    todo = [(12, 8 + int.from_bytes(data[4:8], "little"))]
    while todo:
        at, end = todo.pop()
        for name, start, size in _chunks(data, at, min(end, len(data))):
            if name == b"LIST":
                kind = data[start : start + 4]
                if kind == b"movi":
                    movi = (start, start + size)
                elif kind in (b"hdrl", b"strl", b"INFO"):
                    todo.append((start + 4, start + size))
            elif name == b"strh" and data[start : start + 4] == b"vids" and stream < 0:
                scale, rate = struct.unpack("<II", data[start + 20 : start + 28])
                fps, stream = (rate / scale if scale else float(FPS)), 0
            elif name == b"indx":
                supers += [struct.unpack("<QII", data[p : p + 16]) for p in range(start + 24, start + 24 + 16 * struct.unpack("<I", data[start + 4 : start + 8])[0], 16)]
            elif name == b"ICMT" and data[start : start + 8] == b"payload=":
                payload = int(data[start + 8 : start + size].rstrip(b"\0"))
            elif name == b"idx1":
                idx1 = (start, size)
    if movi is None:
        raise ValueError("the AVI file has no movi list")
    video = lambda name: name[2:] in (b"dc", b"db")
    if idx1:
        entries = [struct.unpack("<4sIII", data[p : p + 16]) for p in range(idx1[0], idx1[0] + idx1[1] - 15, 16)]
        entries = [(at, size) for name, _, at, size in entries if video(name)]
        base = 0 if entries and entries[0][0] >= movi[0] else movi[0]  # some writers count from the file's start
        return Avi([_indexed(data, base + at, size) for at, size in entries], fps, payload)
    if supers:
        images = []
        for at, _, _ in supers:
            n, base = struct.unpack("<I", data[at + 12 : at + 16])[0], struct.unpack("<Q", data[at + 20 : at + 28])[0]
            images += [data[base + o : base + o + (s & 0x7FFFFFFF)] for o, s in struct.iter_unpack("<II", data[at + 32 : at + 32 + 8 * n])]
        return Avi(images, fps, payload)
    return Avi([data[start : start + size] for name, start, size in _chunks(data, movi[0] + 4, movi[1]) if video(name)], fps, payload)


def _indexed(data: bytes, at: int, size: int) -> bytes:
    if int.from_bytes(data[at + 4 : at + 8], "little") != size or at + 8 + size > len(data):
        raise ValueError("the index and a chunk don't agree")
    return data[at + 8 : at + 8 + size]


def read_payload(data: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """The bytes that write_avi() stored, with the frames and frames a second."""
    avi = read_avi(data)
    frames = decode_frames(avi.images)
    return b"".join([f.tobytes() for f in frames])[: avi.payload], frames, avi.fps


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, end) frames of each shot."""
    n = len(frames)
    if n < 2:
        return [(0, n)] if n else []
    hist = np.stack([np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames])
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    total = np.r_[0, np.cumsum(d)]
    i = np.arange(n - 1)
    low, high = np.maximum(i - SPAN, 0), np.minimum(i + SPAN + 1, n - 1)
    around = (total[high] - total[low] - d) / np.maximum(high - low - 1, 1)
    peak = (d >= np.r_[0, d[:-1]]) & (d > np.r_[d[1:], 0])
    cuts = np.flatnonzero((d >= CUT_FLOOR) & (d >= CUT_FACTOR * around) & peak) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:]))


def padded(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 length of a text, and its bytes with zeros up to a positive multiple of 64."""
    data = utf8(text)
    return len(data), data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")


def store_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media binary): each text's AVI file."""
    return map_batches(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, media binary", lambda: lambda keys, texts: {key: keys, "media": [write_avi(padded(t)[1]) for t in texts]})


def clips(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each shot of each AVI file: key, clip, first_frame, end_frame, start_s, end_s. Null media has no clips."""

    def make():
        def run(keys, files):
            out: dict[str, list] = {c: [] for c in (key, "clip", "first_frame", "end_frame", "start_s", "end_s")}
            for k, data in zip(keys, files):
                if data is not None:
                    avi = read_avi(data)
                    for i, (first, end) in enumerate(shots(decode_frames(avi.images))):
                        for c, v in zip(out, (k, i, first, end, first / avi.fps, end / avi.fps)):
                            out[c].append(v)
            return out

        return run

    return map_batches(df, [key, media], f"`{key}` {df.schema[key].dataType.simpleString()}, clip int, first_frame int, end_frame int, start_s double, end_s double", make)


def media_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as an AVI file, read it back and describe both; one row for each row."""

    def make():
        def run(keys, texts):
            out: dict[str, list] = {c: [] for c in (key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for k, t in zip(keys, texts):
                n, payload = padded(t)
                media = write_avi(payload)
                back, frames, fps = read_payload(media)
                feature = f"frames={len(frames)};clips=" + "|".join(f"{a / fps:.2f}-{b / fps:.2f}" for a, b in shots(frames))
                for c, v in zip(out, (k, n, len(back), sha256_hex(back), zlib.crc32(back[-64:]), len(media), sha256_hex(media), feature)):
                    out[c].append(v)
            return out

        return run

    return map_batches(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", make)
