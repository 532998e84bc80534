"""Fingerprints, invariants and differences of a silver table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.bronze import multiset_fingerprint

BUSINESS = ["order_key", "order_date", "order_status", "currency", "gross_amount", "gross_amount_usd", "net_amount_usd"]
MONEY = "decimal(38,2)"
SNAPSHOT = {"row_count": "bigint", "key_count": "bigint", "net_usd": MONEY, "duplicate_keys": "bigint", "hash": "string"}


def revenue_by_market_day(silver: DataFrame) -> DataFrame:
    return silver.groupBy("marketplace", "order_date").agg(F.sum("net_amount_usd").cast(MONEY).alias("net_usd"), F.count(F.lit(1)).alias("orders"))


def totals(silver: DataFrame) -> DataFrame:
    """Rows, distinct keys, their difference and revenue in one pass."""
    return silver.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("order_key").alias("key_count"), F.sum("net_amount_usd").cast(MONEY).alias("net_usd")
    ).withColumn("duplicate_keys", F.col("row_count") - F.col("key_count"))


def revenue_on(silver: DataFrame, start: str, end: str) -> DataFrame:
    """Revenue of a half-open range of business days; 0 where there is none. Stays decimal."""
    day = silver.where((F.col("order_date") >= F.lit(start).cast("date")) & (F.col("order_date") < F.lit(end).cast("date")))
    return day.agg(F.coalesce(F.sum("net_amount_usd"), F.lit(0)).cast(MONEY).alias("net_usd"))


def invariants(silver: DataFrame) -> DataFrame:
    """Duplicate keys, rows filed under a wrong day, and rows written more than two days after their business day."""
    return silver.agg(
        (F.count(F.lit(1)) - F.count_distinct("order_key")).alias("duplicate_keys"),
        F.count_if(F.col("order_date") != F.to_date("event_time_utc")).alias("wrong_day"),
        F.count_if(F.to_date("_interval_start") > F.date_add("order_date", 2)).alias("back_dated"),
    )


def snapshot(silver: DataFrame) -> dict:
    """Counts, revenue and multiset fingerprint, computed on executors; one row reaches the driver."""
    t = totals(silver).first().asDict()
    return t | {"hash": multiset_fingerprint(silver.select(*BUSINESS)).first()["fingerprint"]}


def save_snapshot(spark: SparkSession, state: dict, path: str) -> None:
    """Keep a snapshot as one row of typed columns, so that a later process can compare with it."""
    spark.createDataFrame([tuple(state[n] for n in SNAPSHOT)], ", ".join(f"{n} {t}" for n, t in SNAPSHOT.items())).write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> dict:
    return spark.read.parquet(path).first().asDict()


def reverted(guarded: DataFrame, naive: DataFrame) -> DataFrame:
    """Orders that the naive table holds in an older version than the guarded one."""
    clock = F.struct("updated_at_utc", "version_seq", "version_tag")
    g, n = (x.select("order_key", clock.alias(v)) for x, v in ((guarded, "g"), (naive, "n")))
    return g.join(n, "order_key").where(F.col("n") < F.col("g"))
