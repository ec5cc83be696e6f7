"""Streaming form of shared-key blocking: new target records meet the S1 postings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.operators.postings import postings, prepare


def stream_candidates(targets: DataFrame, s1_postings: DataFrame, family: str, country_aware: bool = False) -> DataFrame:
    """Candidate edges of a stream of target records against a static posting table.

    A record's repeated edges (several shared keys) are dropped within its micro-batch by the sink;
    frequency caps need the whole target and are applied to the static side.
    """
    own = postings(prepare(targets), family).withColumnRenamed("id", "target_id")
    on = ["country", "key"] if country_aware else ["key"]
    left = s1_postings.withColumnRenamed("id", "s1_id").select("s1_id", *on)
    return own.select("target_id", *on).join(left, on).select("s1_id", "target_id", F.col("key"))


def start(candidates: DataFrame, path: str, checkpoint: str):
    """Append candidates to a Parquet table, each micro-batch without repeats."""

    def write(batch: DataFrame, _: int) -> None:
        batch.select("s1_id", "target_id").distinct().write.mode("append").parquet(path)

    return candidates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
