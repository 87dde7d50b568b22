"""Sessions with settings that the plans rely on."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.unionOutputPartitioning": "false",
}


#: With this on, Spark 4.1 takes a union for partitioned like its sides; when adaptive execution then
#: merges partitions of a reused exchange, rows come twice.
PLAIN_UNIONS = "spark.sql.unionOutputPartitioning"


def plain_unions(spark: SparkSession) -> None:
    if spark.conf.get(PLAIN_UNIONS, "true") != "false":
        spark.conf.set(PLAIN_UNIONS, "false")


#: Shuffle files else stay until the driver happens to collect its garbage, whatever the disk that they take.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """A table written in here takes its shuffle files along when it is complete."""
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("matchloom").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets a folder of
    its own for the life of the session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("matchloom.shared.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local") and "cluster" not in master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='matchloom-')}"
    spark.conf.set("matchloom.shared.dir", where)
    return where


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, made once however often they are read; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
