"""Feed registry and bounded slices of append-only version logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.scalars import text_clock
from tidemark.intervals import Interval


@dataclass(frozen=True)
class Feed:
    """A source relation with its declared columns and its own expression of the version clock (Spark and SQL form)."""

    name: str
    marketplace: str
    source_table: str
    clock_sql: str
    clock: Callable[[], Column]
    status_column: str
    ddl: str

    @property
    def schema(self) -> StructType:
        """Declared columns; drift from them is an error where bronze is appended."""
        return StructType.fromDDL(self.ddl)

    def bound_query(self, iv: Interval) -> str:
        """Half-open slice as text for a database that evaluates the clock itself."""
        lo, hi = (f"{{ts '{t.strftime('%Y-%m-%d %H:%M:%S')}'}}" for t in (iv.start, iv.end))  # JDBC escape, portable
        return f"SELECT * FROM {self.source_table} WHERE {self.clock_sql} >= {lo} AND {self.clock_sql} < {hi}"

    def slice(self, log: DataFrame, iv: Interval) -> DataFrame:
        return log.where(in_interval(self.clock(), iv))


def in_interval(clock: Column, iv: Interval) -> Column:
    lo, hi = (F.lit(t).cast("timestamp") for t in (iv.start_iso, iv.end_iso))
    return (clock >= lo) & (clock < hi)


MONEY = "decimal(12,2)"
ORDER = "version_seq int, version_tag string"
SHOPIFY = f"""id bigint, order_number string, created_at timestamp, processed_at timestamp, updated_at timestamp, total_price {MONEY}, subtotal_price {MONEY},
  total_shipping {MONEY}, total_discounts {MONEY}, currency string, financial_status string, customer_id bigint, {ORDER}"""
AMAZON = f"""AmazonOrderId string, PurchaseDate timestamp, LastUpdateDate timestamp, OrderTotal_Amount {MONEY}, OrderTotal_CurrencyCode string,
  ShippingPrice_Amount {MONEY}, OrderStatus string, MarketplaceId string, BuyerInfoHash string, {ORDER}"""
LAZADA = f"""order_id bigint, created_at string, updated_at string, price string, shipping_fee string, currency string, statuses string,
  customer_first_name string, {ORDER}"""
FEEDS: tuple[Feed, ...] = (
    Feed("shopify_orders", "shopify", "raw_shopify_orders", '"updated_at"', lambda: F.col("updated_at"), "financial_status", SHOPIFY),
    Feed("amazon_orders", "amazon", "raw_amazon_orders", '"LastUpdateDate"', lambda: F.col("LastUpdateDate"), "OrderStatus", AMAZON),
    Feed("lazada_orders", "lazada", "raw_lazada_orders", '"updated_at"', lambda: text_clock(F.col("updated_at")), "statuses", LAZADA),
)
FEEDS_BY_NAME = {f.name: f for f in FEEDS}


def pick_feeds(names: str = "all") -> tuple[Feed, ...]:
    """``all`` or a comma list; an unknown name fails before any work starts."""
    if names == "all":
        return FEEDS
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    unknown = [n for n in wanted if n not in FEEDS_BY_NAME]
    if unknown or not wanted:
        raise ValueError(f"unknown feeds {unknown}; known: {sorted(FEEDS_BY_NAME)}")
    return tuple(FEEDS_BY_NAME[n] for n in wanted)


def read_jdbc_slice(
    spark: SparkSession, feed: Feed, iv: Interval, url: str, driver: str, *, partitions: int = 1, partition_column: str | None = None, **options: str
) -> DataFrame:
    """Slice through JDBC. A typed clock is filtered with ``where`` and so is pushed by Catalyst, column pruning
    included; with ``partition_column`` its [start, end) range is also read in parallel. A text clock is parsed by
    Spark after the scan, since no portable SQL parses it."""
    reader = spark.read.format("jdbc").options(url=url, driver=driver, dbtable=feed.source_table, **options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, numPartitions=str(partitions), lowerBound=str(iv.start.replace(tzinfo=None)), upperBound=str(iv.end.replace(tzinfo=None)))
    return feed.slice(reader.load(), iv)


def read_jdbc_query(spark: SparkSession, feed: Feed, iv: Interval, url: str, driver: str, **options: str) -> DataFrame:
    """Slice with the whole query given to the database."""
    return spark.read.format("jdbc").options(url=url, driver=driver, query=feed.bound_query(iv), **options).load()


def seed_jdbc(log: DataFrame, feed: Feed, url: str, driver: str) -> None:
    """Load generated rows into the source database. Repeating it gives the same rows: an existing table is emptied and
    keeps its definition and grants."""
    log.write.format("jdbc").options(url=url, driver=driver, dbtable=feed.source_table, truncate="true").mode("overwrite").save()
