"""Latest version per key inside a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The version order, newest first. The last names only break ties, so that reruns agree.
VERSION_ORDER = ("updated_at_utc", "version_seq", "version_tag", "gross_amount", "_interval_start", "_ingest_run_id")


def dedupe_latest(df: DataFrame, key: str | list[str] = "order_key", order: tuple[str, ...] = VERSION_ORDER) -> DataFrame:
    """One row per key; Catalyst limits each group before the exchange, so a hot key sends one row per task."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order if c in df.columns])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
