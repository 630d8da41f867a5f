"""Zstandard WARC archives (operator 10): written and read as tables of whole archives, or read from files.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary, itself compressed or not;
after it comes one frame for each record, compressed with that dictionary. The reader finds each frame's end from its
block headers, decodes it alone, and validates the checksum, the record's header lines, its lengths and its digests.

Of records with equal payloads of at least REVISIT_BYTES, the one of largest page_id is the response, others revisit it:
their record has the HTTP header (with the payload's length) and the payload's digest, but no payload.

Defined results: null html is an empty payload; null url gives a record without target; rows of the same page_id and the
same payload are all responses if that page_id is the largest; a null page_id is smaller than any other; repeated rows
give repeated records; an empty table gives no archives; extra columns are not read. Payloads of any length are one
record; an archive is closed at ARCHIVE_BYTES of payload, so a task holds one archive and one payload beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_batches, small

DICT_MAGIC, ZSTD_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained on the archive's own first records: so many bytes of them, to so many bytes.
DICT_SAMPLE, DICT_BYTES, LEVEL = 1 << 20, 16 << 10, 3
DATE = "1970-01-01T00:00:00Z"
ID = "urn:fernweave:page:"


def _uri(url: str) -> str:
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. With refers_to, a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A dictionary frame, then one frame for each record."""
    samples, size = [], 0
    for r in records:
        if size >= DICT_SAMPLE:
            break
        samples.append(r[: DICT_SAMPLE >> 3])
        size += len(samples[-1])
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # too few or too small samples: the first record itself, as raw content
        trained = zstandard.ZstdCompressionDict(samples[0][:DICT_BYTES].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    stored = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    return b"".join([DICT_MAGIC, len(stored).to_bytes(4, "little"), stored, *map(pack.compress, records)])


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends."""
    try:
        head = zstandard.get_frame_parameters(data[at : at + 18])
        end = at + zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as e:
        raise ValueError(f"not a Zstandard frame: {e}") from None
    last = False
    while not last:
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("a Zstandard block of reserved type")
        end += 3 + (1 if kind == 1 else size)
        if end > len(data):
            raise ValueError("a Zstandard frame ends early")
    end += 4 * bool(head.has_checksum)
    if end > len(data):
        raise ValueError("a Zstandard frame ends early")
    return end


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, decoded; a dictionary in the leading skippable frame is loaded first."""
    at, unpack = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = data[at : at + 4]
        if magic[1:] == DICT_MAGIC[1:] and 0x50 <= magic[0] <= 0x5F:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            body = data[at + 8 : at + 8 + size]
            if len(body) != size:
                raise ValueError("a skippable frame ends early")
            if at == 0 and magic == DICT_MAGIC:
                raw = zstandard.ZstdDecompressor().decompress(body) if body[:4] == ZSTD_MAGIC else body
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        end = frame_end(data, at)
        try:
            yield unpack.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"a Zstandard frame can't be decoded: {e}") from None
        at = end


def _same(digest: str | None, data: bytes) -> bool:
    if digest is None:
        return True
    kind, _, value = digest.partition(":")
    if kind.lower() != "sha1":
        return True  # other digests aren't checked
    own = hashlib.sha1(data)
    return value.lower() == own.hexdigest() or value.upper() == base64.b32encode(own.digest()).decode()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record; ValueError for any fault in lines, lengths or digests."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header line: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"header lines are missing: {sorted(missing)}")
    size = int(fields["content-length"]) if fields["content-length"].isdigit() else -1
    if rest[size:] != b"\r\n\r\n" or size < 0:
        raise ValueError(f"a record's block has {len(rest) - 4} bytes, not {fields['content-length']}")
    if not _same(fields.get("warc-block-digest"), rest[:size]):
        raise ValueError("a record's block digest is wrong")
    return fields, rest[:size]


def content(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int, str]:
    """Payload (None for a revisit), the full payload's bytes, its bare digest."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    if not gap or not length:
        raise ValueError("a record's block has no HTTP header with a length")
    stated, digest = int(length[1]), fields.get("warc-payload-digest")
    if fields["warc-type"] == "revisit":
        return None, stated, (digest or "").removeprefix("sha1:")
    if stated != len(payload):
        raise ValueError(f"a payload has {len(payload)} bytes, not {stated}")
    if not _same(digest, payload):
        raise ValueError("a payload digest is wrong")
    return payload, stated, hashlib.sha1(payload).hexdigest()


def page_of(uri: str | None) -> int | None:
    digits = (uri or "").strip("<>").removeprefix(ID)
    return int(digits) if digits else None


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses): one grouped maximum over ids and digests, and one join on the
    digest with the payloads that several pages have; pages aren't shuffled for it unless those are too many to broadcast."""
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    own = own.withColumns({"digest": F.sha1("html"), "n": F.octet_length("html").cast("bigint")})
    best = own.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n").agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "n", "best")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("best")), F.col("best"))
    return own.join(small(durable(best)), ["digest", "n"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive binary, records int) from rows of with_revisits()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary()), pa.array([len(held)], pa.int32())], names=["archive", "records"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page_id, url, html.encode("utf-8"), digest, refers_to))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held.clear()
                    size = 0
        if held:
            yield close()

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive binary, records int")


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """A row for each record: page_id, url, record_type, payload binary (null for revisits), payload_bytes, payload_digest, refers_to."""
    return _records(archives, column, True)


def _records(archives: DataFrame, column: str, whole: bool) -> DataFrame:
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for cell in batch.column(0):  # an archive at a time
                rows = []
                for data in frames(cell.as_py() or b""):
                    fields, block = parse(data)
                    payload, n, digest = content(fields, block)
                    rows.append((page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], payload if whole else None, n, digest, page_of(fields.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return archives.select(column).mapInArrow(run, "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """read_archives() over .warc.zst files in any store that Spark reads; a file is one task's."""
    return read_archives(spark.read.format("binaryFile").load(path), "content")


def warc_report(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder, read them back, and describe each record."""
    archives = durable(write_archives(with_revisits(pages)))
    return _records(archives, "archive", False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows from the pages alone.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS digest FROM p),
     r AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY digest, n) END AS best FROM q)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN best IS NOT NULL AND (page_id IS NULL OR page_id < best) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best IS NOT NULL AND (page_id IS NULL OR page_id < best) THEN best END AS refers_to
FROM r
"""
