"""What the training-data operators share: reading tables, mapping Arrow batches, and cutting lineage durably."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.sizes import small
from ..session import prepared

__all__ = ["drop", "durable", "durable_at", "map_batches", "release", "sha256_hex", "shared_dir", "small", "small_batches", "table", "utf8"]

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
#: Rows and bytes of an Arrow batch that goes to Python at most, where the session has Spark's defaults. (A row over that is a batch of its own.)
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with batches small enough that a worker's memory doesn't depend on how long texts are; what the user has set stays."""
    for key, default, own in ((_ROWS, 10_000, BATCH_ROWS), (_BYTES, 64 << 20, BATCH_BYTES)):
        if spark.conf.get(key).rstrip("b") == str(default):
            spark.conf.set(key, str(own))
    return prepared(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder, by Spark's own reader."""
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def map_batches(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., dict[str, list]]]) -> DataFrame:
    """Map `columns` of df through Python, an Arrow batch at a time and without a shuffle.

    `make()` runs once in each task and returns a function that takes one list for each column and returns
    one list for each output column of the DDL `schema`. Columns that aren't named never leave the JVM, so that
    extra columns, whatever their names, have no effect.
    """
    struct = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        func = make()
        for batch in batches:
            out = func(*(column.to_pylist() for column in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, struct)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that's unset, a local folder if all run in one process, and an error if not."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        where = f"file://{tempfile.gettempdir()}/checkpoints/fernweave"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive any executor. They go when the session ends."""
    return durable_at(df)[0]


def durable_at(df: DataFrame) -> tuple[DataFrame, str]:
    """durable(), and the folder that drop() takes."""
    spark = small_batches(df.sparkSession)
    path = f"{shared_dir(spark)}/fernweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _folder(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders that durable_at() wrote, once nothing will read them again."""
    for path in paths:
        where, fs = _folder(spark, path)
        fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are durable: it does so once nothing refers to them and the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()
