"""Native feed shapes -> one canonical shape, currency conversion, union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import AMOUNT, PASCAL_STATUS, RATE, SNAKE_STATUS, list_status, mapped_status, revenue, text_clock

META = ["_ingest_run_id", "_interval_start", "_interval_end"]
VERSION = ["version_seq", "version_tag"]
# The canonical column names.
BASE_COLUMNS = [
    "order_key", "marketplace", "marketplace_order_id", "event_time_utc", "order_date", "updated_at_utc", "order_status", "currency", "gross_amount",
    "shipping_amount",
]
CANONICAL_COLUMNS = [*BASE_COLUMNS, "gross_amount_usd", "net_amount_usd", *META]
#: Rows up to which the FX dimension is broadcast: two pairs a day for 68 years, about 3 MB.
FX_BROADCAST_ROWS = 50_000


def _finish(df: DataFrame, market: str, order_id: Column, event: Column, updated: Column, status: Column, currency: str, gross: Column, shipping: Column) -> DataFrame:
    """Shared tail: key, business date and column list. Metadata and version columns pass through where present."""
    keep = [c for c in [*VERSION, *META] if c in df.columns]
    text_id = order_id.cast("string")
    return df.select(
        F.concat_ws(":", F.lit(market), text_id).alias("order_key"), F.lit(market).alias("marketplace"), text_id.alias("marketplace_order_id"),
        event.cast("timestamp").alias("event_time_utc"), F.to_date(event.cast("timestamp")).alias("order_date"), updated.cast("timestamp").alias("updated_at_utc"),
        status.alias("order_status"), F.col(currency).alias("currency"), gross.cast(AMOUNT).alias("gross_amount"), shipping.cast(AMOUNT).alias("shipping_amount"), *keep,
    )


def normalize_shopify(df: DataFrame) -> DataFrame:
    c = F.col
    return _finish(df, "shopify", c("id"), c("created_at"), c("updated_at"), mapped_status(c("financial_status"), SNAKE_STATUS), "currency", c("total_price"), c("total_shipping"))


def normalize_amazon(df: DataFrame) -> DataFrame:
    c = F.col
    return _finish(df, "amazon", c("AmazonOrderId"), c("PurchaseDate"), c("LastUpdateDate"), mapped_status(c("OrderStatus"), PASCAL_STATUS), "OrderTotal_CurrencyCode", c("OrderTotal_Amount"), c("ShippingPrice_Amount"))


def normalize_lazada(df: DataFrame, strict: bool = True) -> DataFrame:
    """Text time and text money. Strict raises on malformed values; lenient turns them to null (see ``rejects``)."""
    c = F.col
    money = (lambda x: x) if strict else (lambda x: x.try_cast(AMOUNT))
    return _finish(df, "lazada", c("order_id"), text_clock(c("created_at"), strict), text_clock(c("updated_at"), strict), list_status(c("statuses")), "currency", money(c("price")), money(c("shipping_fee")))


NORMALIZERS = {"shopify": normalize_shopify, "amazon": normalize_amazon, "lazada": normalize_lazada}


def rejects(raw: DataFrame) -> DataFrame:
    """Rows of the text feed that lenient parsing cannot read."""
    bad = lambda c, f: F.col(c).isNotNull() & f(F.col(c)).isNull()
    clock, money = (lambda x: text_clock(x, False)), (lambda x: x.try_cast(AMOUNT))
    return raw.where(bad("created_at", clock) | bad("updated_at", clock) | bad("price", money) | bad("shipping_fee", money))


def union_canonical(parts: list[DataFrame]) -> DataFrame:
    """Bag union: every version stays."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def convert_to_usd(orders: DataFrame, fx: DataFrame, broadcast_rows: int = FX_BROADCAST_ROWS) -> DataFrame:
    """Left join on pair and the order's own business date; no rate converts at 1 and is flagged in ``fx_missing``.
    The rates are counted (pass a written dimension, whose Parquet footers hold the count): they are broadcast up to
    ``broadcast_rows`` rows, beyond it the join shuffles."""
    rates = fx.select(F.col("currency_pair").alias("_pair"), F.col("rate_date").alias("_day"), F.col("rate").cast(RATE).alias("_rate"))
    rates = F.broadcast(rates) if fx.count() <= broadcast_rows else rates.hint("merge")
    joined = orders.join(rates, (F.concat("currency", F.lit("/USD")) == F.col("_pair")) & (F.col("order_date") == F.col("_day")), "left")
    usd = (F.col("gross_amount") * F.coalesce("_rate", F.lit(1).cast(RATE))).cast(AMOUNT)
    return (
        joined.withColumns({"gross_amount_usd": usd, "fx_missing": F.col("_rate").isNull() & (F.coalesce("currency", F.lit("")) != "USD")})
        .withColumn("net_amount_usd", revenue(F.col("order_status"), F.col("gross_amount_usd")))
        .drop("_pair", "_day", "_rate")
    )
