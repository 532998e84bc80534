"""Append-only bronze storage: raw columns plus the metadata of the interval that produced them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.scalars import row_hash
from tidemark.intervals import Interval
from tidemark.metrics import emit_metric
from tidemark.session import path_exists
from tidemark.sources.feeds import Feed


def add_metadata(df: DataFrame, run_id: str, iv: Interval, wall_clock: bool = True) -> DataFrame:
    """``_ingest_date`` comes from the interval, so a replay lands in the same partition. ``_ingested_at`` is the only
    clock read; it is never compared, ordered by or hashed."""
    start = F.lit(iv.start_iso).cast("timestamp")
    cols = {
        "_ingest_run_id": F.lit(run_id), "_interval_start": start, "_interval_end": F.lit(iv.end_iso).cast("timestamp"), "_ingest_date": F.to_date(start),
    }
    return df.withColumns(cols | ({"_ingested_at": F.current_timestamp()} if wall_clock else {}))


def fingerprint_state(df: DataFrame) -> list:
    """Aggregates of a mergeable, order-free fingerprint of a row multiset: row count and 52-bit limb sums of SHA-256.
    They combine map-side, so no row hash reaches the driver or one task."""
    h = row_hash(*[F.col(f"`{c}`") for c in df.columns])
    limb = lambda i: F.sum(F.conv(F.substring(h, 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
    return [F.count(F.lit(1)).alias("n"), *[limb(i) for i in range(4)]]


def multiset_fingerprint(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and a 16-digit ``fingerprint``; equal for equal multisets in any order."""
    s = df.agg(*fingerprint_state(df))
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "s0", "s1", "s2", "s3")])
    return s.select(F.col("n").alias("rows"), F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def append_bronze(spark: SparkSession, raw: DataFrame, feed: Feed, run_id: str, iv: Interval, root: str, declared: StructType | None = None) -> int:
    """Append one slice; count and fingerprint are observed while it is written, in the same pass. A slice without rows
    adds no row. ``declared`` makes drift an error."""
    if declared is not None and [(f.name, f.dataType) for f in declared] != [(f.name, f.dataType) for f in raw.schema]:
        raise ValueError(f"{feed.name}: schema drift: {raw.schema.simpleString()} is not {declared.simpleString()}")
    seen = Observation()
    out = add_metadata(raw.observe(seen, *fingerprint_state(raw)), run_id, iv)
    out.write.mode("append").partitionBy("_ingest_date").parquet(f"{root}/{feed.name}")
    got = seen.get
    emit_metric(job="bronze", feed=feed.name, rows_read=got["n"], rows_appended=got["n"], run_id=run_id)
    return got["n"]


def read_bronze(spark: SparkSession, feed: Feed, iv: Interval, root: str, declared: StructType) -> DataFrame:
    """Every ingest of exactly this interval, replays included. The partition predicate prunes folders; a feed that was
    never written reads as empty."""
    path = f"{root}/{feed.name}"
    if not path_exists(spark, path):
        return add_metadata(spark.createDataFrame([], declared), "", iv)
    start, end = (F.lit(t).cast("timestamp") for t in (iv.start_iso, iv.end_iso))
    df = spark.read.parquet(path)
    return df.where((F.col("_ingest_date") == F.to_date(start)) & (F.col("_interval_start") == start) & (F.col("_interval_end") == end))
