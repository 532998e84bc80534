"""Registered queries and their SQL, one for each group of operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tidemark.functions.scalars import PASCAL_STATUS, SNAKE_STATUS, list_status, mapped_status, pct_change
from tidemark.intervals import Interval
from tidemark.operators import quality, snapshot as snap
from tidemark.operators.dedupe import dedupe_latest
from tidemark.operators.normalize import BASE_COLUMNS, VERSION
from tidemark.plans.pipeline import canonical, fx_dimension, gate, revenue_change, silver, silver_tables
from tidemark.session import shared_folder, use_utc
from tidemark.sources.bronze import add_metadata, append_bronze, multiset_fingerprint, read_bronze
from tidemark.sources.derive import feed_log
from tidemark.sources.feeds import FEEDS, FEEDS_BY_NAME

IV = Interval.year(1996)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The whole log in canonical shape, as DuckDB sees it.
WITH = """
WITH ver AS (
  SELECT o_orderkey k, o_orderdate ev, o_orderdate upd, 0 AS seq, '' AS tag, o_totalprice price FROM orders
  UNION ALL
  SELECT DISTINCT o_orderkey, o_orderdate, l_shipdate, l_linenumber, l_returnflag || l_linestatus, o_totalprice
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate
), c AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 'shopify' WHEN 1 THEN 'amazon' ELSE 'lazada' END AS marketplace,
    CASE k % 3 WHEN 0 THEN CAST(k + 5000000 AS VARCHAR) WHEN 1 THEN '111-' || (k + 7000000) || '-' || lpad(CAST(k % 9999 AS VARCHAR), 4, '0') ELSE CAST(k + 8000000 AS VARCHAR) END AS marketplace_order_id,
    CASE WHEN tag = '' THEN 'placed' WHEN tag[1] = 'R' THEN 'refunded' WHEN tag[1] = 'A' THEN 'cancelled' ELSE 'paid' END AS order_status,
    CASE k % 3 WHEN 2 THEN 'SGD' ELSE 'USD' END AS currency,
    CAST(price AS DECIMAL(12,2)) AS gross_amount, CAST((k % 2500) / 100.0 AS DECIMAL(12,2)) AS shipping_amount, CAST(ev AS DATE) AS order_date,
    CASE k % 3 WHEN 2 THEN CAST(0.74 + ((dayofyear(ev) % 21) - 10) / 1000.0 AS DECIMAL(18,8)) ELSE CAST(1 AS DECIMAL(18,8)) END AS rate
  FROM ver
), u AS (
  SELECT *, marketplace || ':' || marketplace_order_id AS order_key, CAST(CAST(gross_amount AS DECIMAL(20,2)) * rate AS DECIMAL(12,2)) AS gross_amount_usd,
    CASE WHEN order_status IN ('refunded', 'cancelled') THEN CAST(0 AS DECIMAL(12,2)) ELSE CAST(CAST(gross_amount AS DECIMAL(20,2)) * rate AS DECIMAL(12,2)) END AS net_amount_usd
  FROM c
), ranked AS (
  SELECT *, year(upd) AS iv, row_number() OVER (PARTITION BY order_key, year(upd) ORDER BY upd DESC, seq DESC, tag DESC) AS r FROM u
), d AS (SELECT * FROM ranked WHERE r = 1),
guarded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY upd DESC, seq DESC, tag DESC) AS q FROM d) WHERE q = 1),
naive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY (iv = 1996) DESC, iv DESC) AS q FROM d) WHERE q = 1)
"""
CANON = (
    "order_key, marketplace, marketplace_order_id, ev AS event_time_utc, order_date, upd AS updated_at_utc, order_status, currency, gross_amount, shipping_amount"
)
SLICE = "upd >= TIMESTAMP '1996-01-01' AND upd < TIMESTAMP '1997-01-01'"


def query(name: str, sql: str | None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return plain(f(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return register


def plain(df: DataFrame) -> DataFrame:
    """Types that both engines print alike: times without zone, counts as bigint, sums as decimal(38,2)."""
    cols = {}
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "timestamp":
            cols[f.name] = F.col(f.name).cast("timestamp_ntz")
        elif kind == "int":
            cols[f.name] = F.col(f.name).cast("bigint")
        elif isinstance(f.dataType, DecimalType) and f.dataType.precision > 12 and f.dataType.scale == 2:
            cols[f.name] = F.col(f.name).cast("decimal(38,2)")
    return df.withColumns(cols) if cols else df


@query("slice_half_open", f"{WITH} SELECT marketplace_order_id, upd AS version_time, CAST(seq AS BIGINT) AS version_seq, tag AS version_tag FROM u WHERE marketplace <> 'lazada' AND {SLICE}")
def slice_half_open(spark, d):
    a, b = FEEDS_BY_NAME["shopify_orders"], FEEDS_BY_NAME["amazon_orders"]
    x = a.slice(feed_log(spark, d, a), IV).select(F.col("id").cast("string").alias("marketplace_order_id"), F.col("updated_at").alias("version_time"), *VERSION)
    y = b.slice(feed_log(spark, d, b), IV).select(F.col("AmazonOrderId").alias("marketplace_order_id"), F.col("LastUpdateDate").alias("version_time"), *VERSION)
    return x.unionByName(y)


@query("slice_text_clock", f"""{WITH} SELECT k + 8000000 AS order_id, strftime(upd + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || ' +0800' AS updated_at,
  CAST(gross_amount AS VARCHAR) AS price, CAST(seq AS BIGINT) AS version_seq, tag AS version_tag FROM u WHERE marketplace = 'lazada' AND {SLICE}""")
def slice_text_clock(spark, d):
    f = FEEDS_BY_NAME["lazada_orders"]
    return f.slice(feed_log(spark, d, f), IV).select("order_id", "updated_at", "price", *VERSION)


@query("normalize_each_shape", f"{WITH} SELECT {CANON} FROM u")
def normalize_each_shape(spark, d):
    return canonical(spark, d).select(*BASE_COLUMNS)


@query("bronze_metadata", f"""{WITH} SELECT k + 5000000 AS id, upd AS updated_at, CAST(seq AS BIGINT) AS version_seq, tag AS version_tag, 'run-1' AS _ingest_run_id,
  TIMESTAMP '1996-01-01' AS _interval_start, TIMESTAMP '1997-01-01' AS _interval_end, DATE '1996-01-01' AS _ingest_date FROM u WHERE marketplace = 'shopify' AND {SLICE}""")
def bronze_metadata(spark, d):
    f = FEEDS_BY_NAME["shopify_orders"]
    out = add_metadata(f.slice(feed_log(spark, d, f), IV), "run-1", IV)
    return out.select("id", "updated_at", *VERSION, "_ingest_run_id", "_interval_start", "_interval_end", "_ingest_date")


@query("bronze_interval_scan", f"""{WITH} SELECT marketplace, run AS _ingest_run_id, count(*) AS versions, count(DISTINCT order_key) AS orders
  FROM u, (VALUES ('run-1'), ('run-2')) r(run) WHERE {SLICE} GROUP BY 1, 2""")
def bronze_interval_scan(spark, d):
    """One interval ingested twice by the real append; the scan returns both."""
    root, parts = shared_folder(spark, "bronze"), []
    for f in FEEDS:
        log = feed_log(spark, d, f)
        for run in ("run-1", "run-2"):
            append_bronze(spark, f.slice(log, IV), f, run, IV, root, declared=f.schema)
        key = {"shopify": "id", "amazon": "AmazonOrderId", "lazada": "order_id"}[f.marketplace]
        parts.append(read_bronze(spark, f, IV, root, f.schema).select(F.lit(f.marketplace).alias("marketplace"), "_ingest_run_id", F.col(key).cast("string").alias("key")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("marketplace", "_ingest_run_id").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("key").alias("orders"))


@query("dedupe_latest", f"{WITH} SELECT order_key, upd AS updated_at_utc, CAST(seq AS BIGINT) AS version_seq, tag AS version_tag, order_status, gross_amount FROM d WHERE iv = 1996")
def dedupe(spark, d):
    return dedupe_latest(canonical(spark, d, IV)).select("order_key", "updated_at_utc", *VERSION, "order_status", "gross_amount")


@query("status_vocabulary", f"""{WITH} SELECT marketplace, CASE marketplace
    WHEN 'shopify' THEN CASE WHEN tag = '' THEN 'pending' WHEN tag = 'RO' THEN 'partially_refunded' WHEN tag[1] = 'R' THEN 'refunded' WHEN tag[1] = 'A' THEN 'voided' ELSE 'paid' END
    WHEN 'amazon' THEN CASE WHEN tag = '' THEN 'Pending' WHEN tag[1] = 'R' THEN 'Refunded' WHEN tag[1] = 'A' THEN 'Canceled' WHEN tag = 'NF' THEN 'Shipped' ELSE 'Unshipped' END
    ELSE CASE WHEN tag = '' THEN 'unpaid' WHEN tag[1] = 'R' THEN 'delivered,returned' WHEN tag[1] = 'A' THEN 'canceled' WHEN tag = 'NF' THEN 'delivered' ELSE 'shipped' END END AS raw_status,
  order_status, count(*) AS versions FROM u GROUP BY 1, 2, 3""")
def status_vocabulary(spark, d):
    parts = []
    for f in FEEDS:
        raw = F.col(f.status_column)
        mapped = {"shopify": mapped_status(raw, SNAKE_STATUS), "amazon": mapped_status(raw, PASCAL_STATUS), "lazada": list_status(raw)}[f.marketplace]
        parts.append(feed_log(spark, d, f).select(F.lit(f.marketplace).alias("marketplace"), raw.alias("raw_status"), mapped.alias("order_status")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("marketplace", "raw_status", "order_status").agg(F.count(F.lit(1)).alias("versions"))


@query("unknown_raw_status", f"""{WITH} SELECT marketplace, CASE seq WHEN 7 THEN 'on_hold' END AS raw_status, count(*) AS versions FROM u WHERE seq IN (6, 7) GROUP BY 1, 2""")
def unknown_raw_status(spark, d):
    """Values that no map lists, planted in two line numbers: one unknown word, one null."""
    seq, parts = F.col("version_seq"), []
    for f in FEEDS:
        raw = F.when(seq == 7, F.lit("on_hold")).when(seq != 6, F.col(f.status_column))
        parts.append(quality.unknown_raw_status(feed_log(spark, d, f).withColumn(f.status_column, raw), f))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("union_canonical", f"""{WITH} SELECT {CANON}, gross_amount_usd, net_amount_usd, 'manual__19960101T000000Z' AS _ingest_run_id, TIMESTAMP '1996-01-01' AS _interval_start,
  TIMESTAMP '1997-01-01' AS _interval_end FROM u WHERE {SLICE}""")
def union_all(spark, d):
    from tidemark.operators.normalize import CANONICAL_COLUMNS

    return canonical(spark, d, IV).select(*CANONICAL_COLUMNS)


@query("fx_convert", f"""{WITH} SELECT order_key, CAST(seq AS BIGINT) AS version_seq, tag AS version_tag, upd AS updated_at_utc,
  CASE WHEN order_date = DATE '1996-03-05' THEN gross_amount ELSE gross_amount_usd END AS gross_amount_usd, order_date = DATE '1996-03-05' AND currency <> 'USD' AS fx_missing FROM u WHERE {SLICE}""")
def fx_convert(spark, d):
    fx = fx_dimension(spark, d).where("rate_date <> date'1996-03-05'")
    return canonical(spark, d, IV, fx=fx).select("order_key", *VERSION, "updated_at_utc", "gross_amount_usd", "fx_missing")


@query("status_histogram", f"{WITH} SELECT order_status, count(*) AS row_count, CAST(sum(net_amount_usd) AS DECIMAL(38,2)) AS net_usd, true AS known FROM u GROUP BY 1 ORDER BY 1")
def status_histogram(spark, d):
    return quality.status_histogram(canonical(spark, d)).orderBy("order_status")


@query("marketplace_summary", f"""{WITH} SELECT marketplace, count(*) AS versions, count(DISTINCT order_key) AS orders, CAST(sum(gross_amount_usd) AS DECIMAL(38,2)) AS gross_usd,
  CAST(sum(net_amount_usd) AS DECIMAL(38,2)) AS net_usd FROM u GROUP BY 1 ORDER BY 1""")
def marketplace_summary(spark, d):
    return quality.market_summary(canonical(spark, d)).orderBy("marketplace")


@query("null_audit", f"""{WITH} SELECT count(*) FILTER (order_key IS NULL) AS null_order_key, count(*) FILTER (order_status IS NULL) AS null_order_status,
  count(*) FILTER (gross_amount_usd IS NULL) AS null_gross_amount_usd, count(*) FILTER (nullif(tag, '') IS NULL) AS null_tag FROM u""")
def null_audit(spark, d):
    return quality.null_audit(canonical(spark, d).withColumn("tag", F.nullif("version_tag", F.lit(""))), ["order_key", "order_status", "gross_amount_usd", "tag"])


SILVER = "order_key, order_date, upd AS updated_at_utc, CAST(seq AS BIGINT) AS version_seq, tag AS version_tag, order_status, gross_amount_usd, net_amount_usd"
SILVER_COLS = ["order_key", "order_date", "updated_at_utc", *VERSION, "order_status", "gross_amount_usd", "net_amount_usd"]


@query("silver_guarded_after_replay", f"{WITH} SELECT {SILVER} FROM guarded")
def silver_guarded(spark, d):
    return silver(spark, d).select(*SILVER_COLS)


@query("silver_naive_after_replay", f"{WITH} SELECT {SILVER} FROM naive")
def silver_naive(spark, d):
    return silver(spark, d, "naive").select(*SILVER_COLS)


@query("merge_actions", f"""{WITH}, s AS (SELECT * FROM d WHERE iv = 1996), touched AS (SELECT DISTINCT date_trunc('month', order_date) AS y FROM s),
  t AS (SELECT count(*) AS n FROM guarded WHERE date_trunc('month', order_date) IN (SELECT y FROM touched)), n AS (SELECT count(*) AS n FROM s)
  SELECT 'guarded' AS name, CAST(0 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS updated, t.n AS unchanged FROM t
  UNION ALL SELECT 'naive', CAST(0 AS BIGINT), n.n, t.n - n.n FROM t, n""")
def merge_actions(spark, d):
    """Action counts of the replayed merge: guarded updates nothing, naive every match."""
    rows = [(n, r["rows_inserted"], r["rows_updated"], r["rows_unchanged"]) for n, r in silver_tables(spark, d)["replay"].items()]
    return spark.createDataFrame(rows, "name string, inserted bigint, updated bigint, unchanged bigint")


@query("revenue_by_marketplace_day", f"{WITH} SELECT marketplace, order_date, CAST(sum(net_amount_usd) AS DECIMAL(38,2)) AS net_usd, count(*) AS orders FROM guarded GROUP BY 1, 2")
def revenue_by_marketplace_day(spark, d):
    """Latest version of every order by recompute, then revenue; no table is written."""
    return snap.revenue_by_market_day(dedupe_latest(canonical(spark, d)))


@query("revenue_on_period", f"{WITH} SELECT CAST(coalesce(sum(net_amount_usd), 0) AS DECIMAL(38,2)) AS net_usd FROM guarded WHERE order_date >= DATE '1996-01-01' AND order_date < DATE '1997-01-01'")
def revenue_on_period(spark, d):
    return snap.revenue_on(silver(spark, d).where("order_month >= date'1996-01-01' and order_month < date'1997-01-01'"), "1996-01-01", "1997-01-01")


@query("snapshot_totals", f"""{WITH} SELECT count(*) AS row_count, count(DISTINCT order_key) AS key_count, CAST(sum(net_amount_usd) AS DECIMAL(38,2)) AS net_usd,
  count(*) - count(DISTINCT order_key) AS duplicate_keys FROM guarded""")
def snapshot_totals(spark, d):
    return snap.totals(silver(spark, d))


@query("invariants", f"""{WITH} SELECT count(*) - count(DISTINCT order_key) AS duplicate_keys, count(*) FILTER (order_date <> CAST(ev AS DATE)) AS wrong_day,
  count(*) FILTER (make_date(iv, 1, 1) > order_date + 2) AS back_dated FROM guarded""")
def invariants(spark, d):
    return snap.invariants(silver(spark, d))


@query("orders_reverted", f"""{WITH} SELECT g.order_key, g.upd AS guarded_at, n.upd AS naive_at FROM guarded g JOIN naive n USING (order_key)
  WHERE (n.upd, n.seq, n.tag) < (g.upd, g.seq, g.tag)""")
def orders_reverted(spark, d):
    return snap.reverted(silver(spark, d), silver(spark, d, "naive")).select("order_key", F.col("g.updated_at_utc").alias("guarded_at"), F.col("n.updated_at_utc").alias("naive_at"))


@query("guard_would_update", f"""{WITH} SELECT s.order_key, s.upd AS source_at, t.upd AS target_at FROM d s JOIN d t USING (order_key) WHERE s.iv = 1997 AND t.iv = 1996 AND s.upd > t.upd""")
def guard_would_update(spark, d):
    at = lambda y, n: dedupe_latest(canonical(spark, d, Interval.year(y))).select("order_key", F.col("updated_at_utc").alias(n))
    return at(1997, "source_at").join(at(1996, "target_at"), "order_key").where("source_at > target_at")


def _hash_sql(cols: list[str], source: str) -> str:
    row = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    limbs = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 13 * i}, 13) AS BIGINT)) AS s{i}" for i in range(4))
    return f"""{WITH}, hs AS (SELECT sha256({row}) AS h FROM {source}), t AS (SELECT count(*) AS n, {limbs} FROM hs)
  SELECT n AS "rows", substr(sha256(concat_ws(',', n, s0, s1, s2, s3)), 1, 16) AS fingerprint FROM t"""


@query("content_hash", _hash_sql(snap.BUSINESS, "guarded"))
def content_hash(spark, d):
    return multiset_fingerprint(silver(spark, d).select(*snap.BUSINESS))


@query("slice_fingerprint", _hash_sql(["marketplace_order_id", "seq", "tag", "gross_amount", "currency"], f"(SELECT * FROM u WHERE marketplace = 'amazon' AND {SLICE})"))
def slice_fingerprint(spark, d):
    f = FEEDS_BY_NAME["amazon_orders"]
    return multiset_fingerprint(f.slice(feed_log(spark, d, f), IV).select("AmazonOrderId", *VERSION, "OrderTotal_Amount", "OrderTotal_CurrencyCode"))


@query("top_orders_preview", f"{WITH} SELECT {SILVER} FROM guarded ORDER BY order_key LIMIT 8")
def top_orders_preview(spark, d):
    return silver(spark, d).select(*SILVER_COLS).orderBy("order_key").limit(8)


@query("snapshot_diff", f"""{WITH}, b AS (SELECT marketplace, order_date, sum(net_amount_usd) AS v FROM guarded GROUP BY 1, 2), a AS (SELECT marketplace, order_date, sum(net_amount_usd) AS v FROM naive GROUP BY 1, 2)
  SELECT 'naive' AS name, marketplace, order_date, CAST(b.v AS DECIMAL(38,2)) AS before_usd, CAST(a.v AS DECIMAL(38,2)) AS after_usd FROM b FULL JOIN a USING (marketplace, order_date) WHERE a.v IS DISTINCT FROM b.v""")
def snapshot_diff(spark, d):
    parts = [revenue_change(spark, d, n).withColumn("name", F.lit(n)) for n in ("guarded", "naive")]
    return parts[0].unionByName(parts[1]).select("name", "marketplace", "order_date", "before_usd", "after_usd")


@query("gate_report", f"""{WITH}, t AS (SELECT (SELECT sum(net_amount_usd) FROM guarded) AS b, (SELECT sum(net_amount_usd) FROM naive) AS a,
    (SELECT count(*) FROM guarded g JOIN naive n USING (order_key) WHERE (n.upd, n.seq, n.tag) < (g.upd, g.seq, g.tag)) AS reverted, (SELECT count(*) FROM guarded WHERE make_date(iv, 1, 1) > order_date + 2) AS back_dated)
  SELECT reverted > 0 AND back_dated > 0 AND a <> b AS ok, true AS guarded_unchanged, a <> b AS naive_changed, back_dated, reverted, CAST(b AS DECIMAL(38,2)) AS before_usd, CAST(a AS DECIMAL(38,2)) AS after_usd FROM t""")
def gate_report(spark, d):
    g = gate(spark, d)
    names = ["ok", "guarded_unchanged", "naive_changed", "back_dated", "reverted", "before_usd", "after_usd"]
    return spark.createDataFrame([tuple(g[n] for n in names)], "ok boolean, guarded_unchanged boolean, naive_changed boolean, back_dated bigint, reverted bigint, before_usd decimal(38,2), after_usd decimal(38,2)")


@query("revenue_drift", f"""{WITH}, b AS (SELECT marketplace, sum(net_amount_usd) AS v FROM guarded GROUP BY 1), a AS (SELECT marketplace, sum(net_amount_usd) AS v FROM naive GROUP BY 1)
  SELECT marketplace, CAST(round((a.v - b.v) * 100 / CAST(b.v AS DOUBLE), 2) AS DECIMAL(18,2)) AS drift_pct FROM a JOIN b USING (marketplace)""")
def revenue_drift(spark, d):
    side = lambda n, c: silver(spark, d, n).groupBy("marketplace").agg(F.sum("net_amount_usd").alias(c))
    return side("guarded", "b").join(side("naive", "a"), "marketplace").select("marketplace", F.round(pct_change(F.col("b"), F.col("a")), 2).cast("decimal(18,2)").alias("drift_pct"))


@query("full_recompute_gap", f"""{WITH}, inc AS (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY upd DESC, seq DESC, tag DESC) AS q FROM u WHERE upd < TIMESTAMP '2001-01-01'),
    f AS (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY upd DESC, seq DESC, tag DESC) AS q FROM u),
    i AS (SELECT CAST(year(order_date) AS BIGINT) AS order_year, sum(net_amount_usd) AS v FROM inc WHERE q = 1 GROUP BY 1), g AS (SELECT CAST(year(order_date) AS BIGINT) AS order_year, sum(net_amount_usd) AS v FROM f WHERE q = 1 GROUP BY 1)
  SELECT order_year, CAST(coalesce(i.v, 0) AS DECIMAL(38,2)) AS incremental_usd, CAST(coalesce(g.v, 0) AS DECIMAL(38,2)) AS full_usd FROM i FULL JOIN g USING (order_year)""")
def full_recompute_gap(spark, d):
    """Recent periods are provisional: revenue through 2000 against that of all versions."""
    log = canonical(spark, d)
    upto = log.where(F.col("updated_at_utc") < F.lit("2001-01-01").cast("timestamp"))
    by_year = lambda x, n: dedupe_latest(x).groupBy(F.year("order_date").alias("order_year")).agg(F.sum("net_amount_usd").cast(snap.MONEY).alias(n))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(snap.MONEY).alias(c)
    return by_year(upto, "incremental_usd").join(by_year(log, "full_usd"), "order_year", "full").select("order_year", zero("incremental_usd"), zero("full_usd"))
