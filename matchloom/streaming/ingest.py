"""Pool records that arrive as a stream, against entities that stand.

What a pool record finds depends on itself and the entities alone, so retrieval
runs per micro-batch.  Ranks within an entity, exclusive assignment and the gate
need all candidates and stay batch operators over what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import RETRIEVED, Retrieval, forward_cap, keep, reverse_ranks, score_pairs, union_views
from ..operators.topk import topk_join


def find(s1: DataFrame, pool: DataFrame, settings: Retrieval, digits: int | None = None) -> DataFrame:
    """A batch's kept pairs, without the rank within an entity."""
    views = []
    for vector, own in (("name_vec", F.lit(True)), ("addr_vec", F.col("has_addr"))):
        left, right = (x.where(own).select("id", "part", F.col(vector).alias("v")) for x in (s1, pool))
        views.append(topk_join(left, right, settings.per_view, settings.blank, digits=digits))
    ranked = reverse_ranks(score_pairs(union_views(*views), s1, pool, settings.name_weight, digits))
    return keep(ranked, settings.rev_k, settings.margin).select(*(c for c in RETRIEVED if c != "ret_fwd_rank"))


def ingest(stream: DataFrame, s1: DataFrame, path: str, checkpoint: str, settings: Retrieval = Retrieval()) -> StreamingQuery:
    """Writes each micro-batch's pairs under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        find(s1, batch, settings).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark, path: str, settings: Retrieval = Retrieval()) -> DataFrame:
    """All candidates that the stream has found so far, with ranks and the cap."""
    return forward_cap(spark.read.parquet(path).drop("batch"), settings.cap).select(*RETRIEVED)
