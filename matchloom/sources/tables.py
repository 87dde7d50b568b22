"""Sources and sinks: TSV tables, truth lists, the normalized store, artifacts, submissions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import exact_sample

COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("matched_entity_ids", T.StringType())])
#: Part of the store's key: raise it when normalization changes.
NORMALIZER_VERSION = 1


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quotes as in common TSV files; what is missing is an empty text."""
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', inferSchema=False, nullValue="\0", emptyValue="")
    return rows.fillna("")


def load_source(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None, sample: int | None = None, seed: int = 42) -> DataFrame:
    """A source table with all of ``COLUMNS`` (absent ones empty), or only some of them.

    ``sample``: that many rows from the whole file, seeded; ``limit``: the first by id.
    """
    rows = read_tsv(spark, path)
    for c in COLUMNS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    rows = rows.select(*(columns or COLUMNS))
    if sample is not None:
        return exact_sample(rows, "entity_id", sample, seed)
    return rows.orderBy("entity_id").limit(limit) if limit is not None else rows


def load_truth(spark: SparkSession, path: str, entities: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``source1_entity_id, matched_entity_ids`` (an array: trimmed, without blanks and repeats); blank lines are skipped."""
    rows = read_tsv(spark, path).select(F.trim("source1_entity_id").alias("source1_entity_id"), "matched_entity_ids").where("source1_entity_id <> ''")
    ids = F.array_distinct(F.filter(F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x)), lambda x: x != ""))
    rows = rows.withColumn("matched_entity_ids", ids)
    if entities is not None:
        rows = rows.join(entities.select(F.col("entity_id").alias("source1_entity_id")).distinct(), "source1_entity_id", "left_semi")
    return rows.orderBy("source1_entity_id").limit(limit) if limit is not None else rows


def truth_links(truth: DataFrame) -> DataFrame:
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode("matched_entity_ids").alias("pool_id"))


def cache_key(*parts) -> str:
    """Ten digits that name a stage's output by what it was made from."""
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:10]


def file_state(spark: SparkSession, path: str) -> list:
    """Path, length and time of change of a source, part of the key of what is made from it; a missing one has its path alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return [path]
    status = fs.getFileStatus(where)
    return [path, fs.getContentSummary(where).getLength(), status.getModificationTime()]


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def cached(spark: SparkSession, folder: str, name: str, key: str, make, partition_by: list[str] | None = None) -> DataFrame:
    """``make()`` written once under its key; read from there when complete."""
    path = f"{folder}/{name}/key={key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        writer = make().write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small artifact as a one-line text file."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def countries(records: DataFrame) -> list[str]:
    return [r[0] for r in records.select("country").distinct().orderBy("country").collect()]


def submission(entities: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """``source1_entity_id`` and a comma list for every entity, empty if it has none; ids in order."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("pool_id")), ",").alias(name))
    out = entities.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left")
    return out.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def allowed(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches among the entity's candidates."""
    return matches.join(candidates.select("s1_id", "pool_id"), ["s1_id", "pool_id"], "left_semi")


def write_submission(entities: DataFrame, candidates: DataFrame, matches: DataFrame, folder: str) -> None:
    """Two TSV folders, in the order of ids."""
    for name, pairs in (("candidate_entity_ids", candidates), ("matched_entity_ids", allowed(matches, candidates))):
        out = submission(entities, pairs, name).orderBy("source1_entity_id")
        out.write.mode("overwrite").csv(f"{folder}/{name}", sep="\t", header=True, emptyValue="")
