"""Three native feed shapes and FX rates, derived from ``orders`` and ``lineitem`` by column expressions.

Every order has a first version at its order time and one more for each distinct line shipped after it. ``version_seq``
and ``version_tag`` make the version order total where clocks tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import AMOUNT, RATE
from tidemark.sources.feeds import Feed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = lambda c: F.col(c).cast("timestamp")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", ts("o_orderdate").alias("event_time"), F.col("o_totalprice").cast(AMOUNT).alias("gross"),
        (F.col("o_orderkey") % 3).cast("int").alias("market"), "o_custkey",
    )
    first = orders.withColumns({"version_time": F.col("event_time"), "version_seq": F.lit(0), "version_tag": F.lit("")})
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), ts("l_shipdate").alias("version_time"), F.col("l_linenumber").alias("version_seq"),
        F.concat("l_returnflag", "l_linestatus").alias("version_tag"),
    )
    later = orders.join(lines, "o_orderkey").where(F.col("version_time") > F.col("event_time")).distinct()
    return first.unionByName(later)


def _raw_status(placed: str, r: Column, a: str, n: Column) -> Column:
    flag = F.substring("version_tag", 1, 1)
    return F.when(F.col("version_tag") == "", placed).when(flag == "R", r).when(flag == "A", F.lit(a)).otherwise(n)


def feed_log(spark: SparkSession, sf_dir: str, feed: Feed, log: DataFrame | None = None) -> DataFrame:
    """The append-only log of one feed in its native shape; ``log`` is a written version log to read instead of deriving it."""
    v, key, line = version_log(spark, sf_dir) if log is None else log, F.col("o_orderkey"), F.substring("version_tag", 2, 1)
    shipping = (F.col("o_orderkey") % 2500 / 100).cast(AMOUNT)
    order = [F.col("version_seq"), F.col("version_tag")]
    if feed.marketplace == "shopify":
        status = _raw_status("pending", F.when(line == "O", "partially_refunded").otherwise("refunded"), "voided", F.lit("paid"))
        return v.where("market = 0").select(
            (key + 5_000_000).alias("id"), F.concat(F.lit("#"), key + 1000).alias("order_number"), F.col("event_time").alias("created_at"),
            (F.col("event_time") + F.expr("interval 7 minutes")).alias("processed_at"), F.col("version_time").alias("updated_at"),
            F.col("gross").alias("total_price"), (F.col("gross") - shipping).cast(AMOUNT).alias("subtotal_price"), shipping.alias("total_shipping"),
            F.lit(0).cast(AMOUNT).alias("total_discounts"), F.lit("USD").alias("currency"), status.alias("financial_status"),
            F.col("o_custkey").alias("customer_id"), *order,
        )
    if feed.marketplace == "amazon":
        status = _raw_status("Pending", F.lit("Refunded"), "Canceled", F.when(line == "F", "Shipped").otherwise("Unshipped"))
        return v.where("market = 1").select(
            F.concat(F.lit("111-"), key + 7_000_000, F.lit("-"), F.lpad((key % 9999).cast("string"), 4, "0")).alias("AmazonOrderId"),
            F.col("event_time").alias("PurchaseDate"), F.col("version_time").alias("LastUpdateDate"), F.col("gross").alias("OrderTotal_Amount"),
            F.lit("USD").alias("OrderTotal_CurrencyCode"), shipping.alias("ShippingPrice_Amount"), status.alias("OrderStatus"),
            F.lit("market-1").alias("MarketplaceId"), F.concat(F.lit("buyer-"), "o_custkey").alias("BuyerInfoHash"), *order,
        )
    status = _raw_status("unpaid", F.lit("delivered,returned"), "canceled", F.when(line == "F", "delivered").otherwise("shipped"))
    local = lambda c: F.concat(F.date_format(F.col(c) + F.expr("interval 8 hours"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0800"))
    return v.where("market = 2").select(
        (key + 8_000_000).alias("order_id"), local("event_time").alias("created_at"), local("version_time").alias("updated_at"),
        F.col("gross").cast("string").alias("price"), shipping.cast("string").alias("shipping_fee"), F.lit("SGD").alias("currency"),
        status.alias("statuses"), F.concat(F.lit("cust"), "o_custkey").alias("customer_first_name"), *order,
    )


def version_years(spark: SparkSession, sf_dir: str) -> range:
    """The years from the first to the last version that can occur; the scans read one date column each."""
    o = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi")).first()
    ship = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").cast("date")).first()[0]
    return range(o["lo"].year, max(x for x in (o["hi"], ship) if x).year + 1) if o["lo"] else range(0)


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair and order date: the whole dimension, since an order needs the rate of its own day. At most two
    rows per calendar day, so its size is bounded by the calendar and not by the orders."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("rate_date")).distinct()
    rate = (F.lit(0.74).cast(RATE) + ((F.dayofyear("rate_date") % 21) - 10).cast(RATE) / F.lit(1000)).cast(RATE)
    pairs = F.explode(F.array(F.struct(F.lit("SGD/USD").alias("currency_pair"), rate.alias("rate")), F.struct(F.lit("USD/USD").alias("currency_pair"), F.lit(1).cast(RATE).alias("rate"))))
    return days.select("rate_date", pairs.alias("p")).select("p.currency_pair", "rate_date", "p.rate")
