"""Shared plumbing: the shared folder, written intermediates and Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import plain_unions, remove, shared_dir, without_shuffles

#: Python output is sent back to the JVM once a batch holds about this much.
FLUSH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch than Spark's default: rows here are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "2000")


class Scratch:
    """Intermediate tables and files under the shared folder.

    ``keep`` cuts the lineage by a written table: lost executors then reread
    files instead of repeating the work before, and what was shuffled for it
    goes at once.  Results are lazy and may read what is kept, so the folder
    goes at interpreter exit or on ``close``.
    """

    def __init__(self, spark: SparkSession, name: str):
        plain_unions(spark)
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with without_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        remove(self.spark, f"{self.root}/{name}" if name else self.root)

    def close(self) -> None:
        self.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, b``: the id, a hash that tells repeated ids apart, and the text's bytes (null: empty).

    Rows without an id are left out: no result could be told apart for them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("b")
    )


def whole_rows(docs: DataFrame) -> DataFrame:
    """``id, h, row``: the text's hash as in ``texts``, and all columns as one, whose names then can't clash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"), row.alias("row"))


_WORKER: dict[str, object] = {}


def kept_in_worker(name: str, make):
    """What a Python worker keeps between tasks: one thing at a time, so that the next operator finds the memory free."""
    if name not in _WORKER:
        fresh_worker()
        _WORKER[name] = make()
    return _WORKER[name]


def fresh_worker() -> None:
    """Python workers live on after a task; this gives back what the tasks before have left."""
    _WORKER.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than under glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Rows:
    """Gathers output rows into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.size = 0

    def add(self, *values, size: int = 64) -> bool:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.size += size
        return self.size >= FLUSH_BYTES

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.clear()
        return out


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[dict[str, list]]:
    """Python values of a few rows at a time, so that one batch never exists twice as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()
