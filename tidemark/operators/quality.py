"""Quality report of a canonical batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import CANONICAL_STATUS, listed_status
from tidemark.operators.snapshot import MONEY
from tidemark.sources.feeds import Feed

REQUIRED = ["order_key", "event_time_utc", "order_date", "updated_at_utc", "gross_amount", "gross_amount_usd", "net_amount_usd"]


def market_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("marketplace").agg(
        F.count(F.lit(1)).alias("versions"), F.count_distinct("order_key").alias("orders"),
        F.sum("gross_amount_usd").cast(MONEY).alias("gross_usd"), F.sum("net_amount_usd").cast(MONEY).alias("net_usd"),
    )


def status_histogram(df: DataFrame) -> DataFrame:
    known = F.col("order_status").isin(*CANONICAL_STATUS)
    return df.groupBy("order_status").agg(F.count(F.lit(1)).alias("row_count"), F.sum("net_amount_usd").cast(MONEY).alias("net_usd")).withColumn("known", known)


def null_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns or REQUIRED])


def unknown_raw_status(raw: DataFrame, feed: Feed) -> DataFrame:
    """(marketplace, raw_status, versions) of raw values, nulls included, that the feed's map does not list; taken before
    the map's default hides them."""
    value = F.col(feed.status_column)
    unknown = raw.where(~listed_status(value, feed.marketplace))
    return unknown.groupBy(F.lit(feed.marketplace).alias("marketplace"), value.alias("raw_status")).agg(F.count(F.lit(1)).alias("versions"))


def quality_report(df: DataFrame, unknown: DataFrame | None = None) -> dict:
    """Null counts, missing rates and, from ``unknown`` (see ``unknown_raw_status``), how many values and versions no map
    lists. Numbers only: the values themselves stay in ``unknown``."""
    nulls = null_audit(df).first().asDict()
    values, versions = unknown.agg(F.count(F.lit(1)), F.coalesce(F.sum("versions"), F.lit(0))).first() if unknown is not None else (0, 0)
    missing = df.where("fx_missing").count() if "fx_missing" in df.columns else 0
    return {"nulls": nulls, "unknown_statuses": values, "unknown_versions": versions, "fx_missing": missing, "ok": not any(nulls.values()) and not values}
