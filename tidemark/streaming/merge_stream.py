"""Continuous upsert: each micro-batch is deduplicated and merged with the restatement guard, so replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.pipeline import merge_batch


def merge_stream(canonical: DataFrame, silver_path: str, checkpoint: str, guarded: bool = True) -> StreamingQuery:
    """Start the stream over what is available; the guard makes a repeated micro-batch a no-op."""

    def each(batch: DataFrame, _: int) -> None:
        merge_batch(batch.sparkSession, batch, {silver_path: guarded})

    return canonical.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
