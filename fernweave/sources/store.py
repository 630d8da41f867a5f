"""The index on disk: versioned Parquet folders, and numbered pointers to them of which the highest counts.

A version is written whole, then a pointer file with the next number is put in place by one rename. Pointers are never
changed, so a reader or a crash at any moment finds the version before or the new one. A writer names the number that
it started from; if another has saved meanwhile, it's told so and nothing is lost. KEPT versions stay for readers that still hold one.

A version has the chunks with their vectors, and the lexical tables: postings sorted by term (so that a scan for a few terms
skips the other row groups), document frequencies, and sums. What was written is checked once, when it's saved;
loading compares the files' number and bytes with what the pointer says, without reading them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25

#: Versions that stay, the current one among them.
KEPT = 3


class Conflict(RuntimeError):
    """Another writer saved the index since it was read."""


@dataclass(frozen=True)
class Version:
    """A pointer: its number, the version's folder, and what was written there."""

    number: int
    folder: str
    info: dict


#: What stands before the first version.
NONE = Version(0, "", {})


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(path: str) -> str:
    return f"{path.rstrip('/')}/pointers"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the pointers that are in place, ascending."""
    where, fs = _path(spark, _pointers(path))
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n) for n in names if n.isdecimal())


def _read(spark: SparkSession, path: str, number: int) -> Version:
    where, fs = _path(spark, f"{_pointers(path)}/{number}")
    stream = fs.open(where)
    try:
        told = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()
    return Version(number, f"{path.rstrip('/')}/{told.pop('version')}", told)


def _written(spark: SparkSession, folder: str) -> list[int]:
    """Files and bytes of a folder."""
    where, fs = _path(spark, folder)
    if not fs.exists(where):
        return [0, 0]
    own = fs.getContentSummary(where)
    return [own.getFileCount(), own.getLength()]


def current(spark: SparkSession, path: str) -> Version | None:
    """The current version, or None before the first."""
    numbers = _numbers(spark, path)
    return _read(spark, path, numbers[-1]) if numbers else None


def save(chunks: DataFrame, path: str, embedder: str, dim: int, base: Version | None = None) -> Version:
    """Write a new version of chunks (with `vector`) and make it the current one.

    base: the version that chunks were made from. If it isn't the current one any more, Conflict is raised and the current
    version stays. Without it, whatever is there is replaced.
    """
    spark = chunks.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{name}"
    chunks.write.parquet(f"{folder}/chunks")
    saved = spark.read.parquet(f"{folder}/chunks")
    if {"chunk_id", "pos", "text"} <= set(saved.columns):
        bm25.save(saved, folder)
    whole = saved.agg(F.count("*").alias("n"), F.count_if(F.size("vector") == dim).alias("m")).first()
    told = {"version": name, "dim": dim, "embedder": embedder, "count": whole.n, "vectors": whole.m, "written": _written(spark, folder)}
    numbers = _numbers(spark, path)
    number = (numbers[-1] if numbers else 0) + 1 if base is None else base.number + 1
    _point(spark, path, number, told)
    _forget(spark, path)
    return _read(spark, path, number)


def _point(spark: SparkSession, path: str, number: int, told: dict) -> None:
    """Put a pointer in place, by a rename that fails if one of its number is there."""
    where, fs = _path(spark, f"{_pointers(path)}/{number}")
    fresh, _ = _path(spark, f"{_pointers(path)}/new-{uuid.uuid4().hex}")
    fs.mkdirs(where.getParent())
    stream = fs.create(fresh, False)
    stream.write(bytearray(json.dumps(told).encode("utf-8")))
    stream.close()
    if fs.exists(where) or (_numbers(spark, path) or [0])[-1] >= number or not fs.rename(fresh, where):
        fs.delete(fresh, False)
        raise Conflict(f"the index in {path} has been saved by another writer")


def _forget(spark: SparkSession, path: str) -> None:
    """Delete versions older than the last KEPT: the pointer first, then what it pointed to."""
    for number in _numbers(spark, path)[:-KEPT]:
        old = _read(spark, path, number)
        where, fs = _path(spark, f"{_pointers(path)}/{number}")
        fs.delete(where, False)
        folder, fs = _path(spark, old.folder)
        fs.delete(folder, True)


def info(spark: SparkSession, path: str) -> dict:
    """dim, embedder, count and version of the current index; FileNotFoundError if there is none."""
    now = current(spark, path)
    if now is None:
        raise FileNotFoundError(f"no index in {path}")
    return now.info | {"version": now.folder}


def checked(spark: SparkSession, path: str, embedder: str | None = None) -> Version:
    """The current version; ValueError if rows, vectors or files are missing, or if another embedder made it."""
    now = current(spark, path)
    if now is None:
        raise FileNotFoundError(f"no index in {path}")
    told = now.info
    if embedder is not None and told["embedder"] != embedder:
        raise ValueError(f"the index was made with {told['embedder']}, not {embedder}")
    if told["vectors"] != told["count"]:
        raise ValueError(f"the index in {path} is corrupt: of {told['count']} chunks {told['vectors']} have vectors")
    if (there := _written(spark, now.folder)) != told["written"]:
        raise ValueError(f"the index in {path} is corrupt: {told['written']} files and bytes were saved, {there} are there")
    return now


def load(spark: SparkSession, path: str, embedder: str | None = None) -> DataFrame:
    """The current chunks; errors as in checked()."""
    return spark.read.parquet(f"{checked(spark, path, embedder).folder}/chunks")


def load_lexical(spark: SparkSession, path: str) -> bm25.Bm25Index:
    """The current lexical index, as it was saved; errors as in checked()."""
    return bm25.load(spark, checked(spark, path).folder)
