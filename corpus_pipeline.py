"""From documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, written as Parquet and read again,
and returns the columns of documents; the last returns the packed pieces.

1. Language ID: documents without a letter go, and those whose letters are no
   more like any learned language than chance allows (``language_id.keep_known``).
2. SimHash near-dedup over five-word shingles: of each group of near copies
   (sets of shingles that share 0.8 of their union) the document with the
   smallest id stays.
3. Substring dedup: words in runs of 50 that stand in a document with a smaller
   id are cut out; a document that loses all its words goes.
4. Benchmark decontamination: documents that share ten consecutive words with a
   benchmark item, or hold a shorter item whole, go.
5. Packing into sequences of at most 2048 tokens.

Defined cases: a null, empty or wordless text has no letter and goes in the
first stage; rows without a doc_id go in the second, of rows that repeat an id
and text one stays there; ties go to the smaller id; extra columns stay up to
the last stage, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import decontaminate, language_id, packing, shingle_sets, simhash, substring_dedup
from matchloom.llm.common import Scratch, table

_held: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A stage begins when its predecessor's result is written; that one's intermediates can go."""
    while _held:
        _held.pop().close()
    _held.append(Scratch(spark, f"pipeline-{name}"))
    return _held[-1]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _scratch(spark, "language")
    return language_id.keep_known(docs, language_id.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, _scratch(spark, "simhash"), near=shingle_sets.near_copies)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.strip_repeats(docs, _scratch(spark, "substrings"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _scratch(spark, "benchmark")
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, _scratch(spark, "packing"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage's rule can be written in SQL; the run is tested against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    between = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = between.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
