import json
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import PASCAL_STATUS, SNAKE_STATUS, list_status, mapped_status, row_hash
from tidemark.intervals import Interval, default_run_id, parse_interval
from tidemark.metrics import metrics_from
from tidemark.operators.dedupe import dedupe_latest
from tidemark.operators.merge import merge_into_silver, merge_rows
from tidemark.operators.normalize import convert_to_usd, normalize_lazada, rejects
from tidemark.operators.quality import unknown_raw_status
from tidemark.session import shared_folder
from tidemark.sources.bronze import append_bronze, multiset_fingerprint, read_bronze
from tidemark.sources.feeds import FEEDS_BY_NAME, pick_feeds, read_jdbc_query, read_jdbc_slice, seed_jdbc

IV = Interval(datetime(2026, 8, 2, tzinfo=timezone.utc), datetime(2026, 8, 3, tzinfo=timezone.utc))
LAZADA = "order_id long, created_at string, updated_at string, price string, shipping_fee string, currency string, statuses string"


def test_intervals():
    assert parse_interval("2026-08-02", "2026-08-03") == IV
    with pytest.raises(ValueError):
        parse_interval("2026-08-03", "2026-08-03")
    assert default_run_id(IV.start) == "manual__20260802T000000Z"


def test_metrics_ignore_malformed_lines():
    assert metrics_from('x\nMETRIC {"job": "silver"}\nMETRIC {oops') == [{"job": "silver"}]


def test_feeds_fail_fast():
    assert len(pick_feeds()) == 3
    with pytest.raises(ValueError):
        pick_feeds("shopify_orders,nope")


def test_status_maps(spark):
    raw = [*SNAKE_STATUS, *PASCAL_STATUS, "on_hold", "", None]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, s string")
    got = {r["i"]: tuple(r)[1:] for r in df.select("i", mapped_status(F.col("s"), SNAKE_STATUS), mapped_status(F.col("s"), PASCAL_STATUS)).collect()}
    assert got == {i: (SNAKE_STATUS.get(x, "placed"), PASCAL_STATUS.get(x, "placed")) for i, x in enumerate(raw)}
    lists = {"packed": "placed", "packed,shipped": "paid", "shipped,canceled": "cancelled", "canceled,returned": "refunded", "": "placed", None: "placed"}
    df = spark.createDataFrame([(x,) for x in lists], "s string")
    assert {r[0]: r[1] for r in df.select("s", list_status(F.col("s"))).collect()} == lists


def test_unknown_raw_status(spark):
    for feed, known in (("shopify_orders", "voided"), ("amazon_orders", "Shipped"), ("lazada_orders", "packed,shipped")):
        f = FEEDS_BY_NAME[feed]
        df = spark.createDataFrame([(known,), ("on_hold",), ("on_hold",), (None,)], f"{f.status_column} string")
        assert {(r["raw_status"], r["versions"]) for r in unknown_raw_status(df, f).collect()} == {("on_hold", 2), (None, 1)}
        assert unknown_raw_status(df.limit(0), f).count() == 0


def test_text_clock_and_rejects(spark):
    rows = [(31, "1999-12-31 23:30:00 -0130", "2000-02-29 00:00:07 +0545", "7.05", "0", "SGD", "shipped"), (32, "1999-13-01 00:00:00 +0000", "2000-02-29 00:00:07 +0545", "7,05", "0", "SGD", "shipped")]
    df = spark.createDataFrame(rows, LAZADA)
    r = normalize_lazada(df.where("order_id = 31")).first()
    assert r["event_time_utc"] == datetime(2000, 1, 1, 1) and r["order_date"].year == 2000
    assert r["updated_at_utc"] == datetime(2000, 2, 28, 18, 15, 7) and r["gross_amount"] == Decimal("7.05")
    with pytest.raises(Exception):
        normalize_lazada(df).collect()
    assert normalize_lazada(df, strict=False).count() == 2 and [r["order_id"] for r in rejects(df).collect()] == [32]


def test_fx_by_business_day(spark):
    rows = [(i, cur, f"1999-05-{day:02}", 37 + i, st) for i, (cur, day, st) in enumerate([("SGD", 4, "paid"), ("SGD", 5, "paid"), ("SGD", 6, "placed"), ("USD", 4, "cancelled"), (None, 4, "paid")])]
    o = spark.createDataFrame(rows, "k int, currency string, d string, g int, order_status string")
    o = o.select("k", "currency", F.to_date("d").alias("order_date"), F.col("g").cast("decimal(12,2)").alias("gross_amount"), "order_status")
    fx = spark.createDataFrame([("SGD/USD", "1999-05-04", "0.5"), ("SGD/USD", "1999-05-05", "0.125")], "currency_pair string, d string, r string").select("currency_pair", F.to_date("d").alias("rate_date"), F.col("r").cast("decimal(18,8)").alias("rate"))
    want = {0: ("18.50", "18.50", False), 1: ("4.75", "4.75", False), 2: ("39.00", "39.00", True), 3: ("40.00", "0.00", False), 4: ("41.00", "41.00", True)}
    for bound in (10, 1):  # broadcast, and beyond the checked size
        out = convert_to_usd(o, fx, broadcast_rows=bound)
        assert {r["k"]: (str(r["gross_amount_usd"]), str(r["net_amount_usd"]), r["fx_missing"]) for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("broadcast" in plan) == (bound == 10) and ("merge" in plan) == (bound == 1)


def silver_rows(spark, rows):
    return spark.createDataFrame(rows, "order_key string, updated_at_utc timestamp, version_seq int, version_tag string, net int, order_month int")


def at(h):
    return datetime(2026, 8, 2, h)


def test_dedupe_latest_and_ties(spark):
    rows = [(f"k{i % 7}", at(i * 5 % 6), i % 4, "xy"[i % 2], i, 1) for i in range(60)] + [("k0", None, 9, "z", 99, 1)]
    want = {}
    for r in rows:
        if r[1] is not None and (r[0] not in want or r[1:4] > want[r[0]][1:4]):
            want[r[0]] = r
    got = {r["order_key"]: (r["updated_at_utc"], r["version_seq"], r["version_tag"]) for r in dedupe_latest(silver_rows(spark, rows)).collect()}
    assert got == {k: r[1:4] for k, r in want.items()}


def test_merge_null_versions(spark):
    """A comparison with a null keeps the target, whichever side and column it is in."""
    target = silver_rows(spark, [("a", None, 0, "", 1, 1), ("b", at(1), 0, "", 1, 1), ("c", at(1), None, "", 1, 1), ("d", at(1), None, "", 1, 1), ("e", None, 0, "", 1, 1)])
    batch = silver_rows(spark, [("a", at(2), 0, "", 2, 1), ("b", None, 0, "", 2, 1), ("c", at(1), 5, "", 2, 1), ("d", at(2), 0, "", 2, 1), ("e", None, 0, "", 2, 1)])
    assert {r["order_key"]: r["net"] for r in merge_rows(target, batch).collect()} == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 1}
    assert {r["net"] for r in merge_rows(target, batch, guarded=False).collect()} == {2}


def test_merge_guard_naive_ties_and_empty_batch(spark):
    for guarded, want in ((True, {"a": 1, "b": 20, "c": 3, "d": 4}), (False, {"a": 10, "b": 20, "c": 30, "d": 4})):
        path = shared_folder(spark, "merge-test")
        first = merge_into_silver(spark, silver_rows(spark, [("a", at(14), 0, "", 1, 1), ("b", at(9), 0, "", 2, 1), ("c", at(9), 0, "", 3, 2), ("d", at(9), 0, "", 4, 3)]), path, guarded=guarded)
        assert first["created"] and first["rows_inserted"] == 4
        batch = silver_rows(spark, [("a", at(9), 0, "", 10, 1), ("b", at(20), 0, "", 20, 1), ("c", at(9), 0, "", 30, 2)])
        got = merge_into_silver(spark, batch, path, guarded=guarded)
        assert {r["order_key"]: r["net"] for r in spark.read.parquet(path).collect()} == want
        assert got["rows_updated"] == (1 if guarded else 3) and got["rows_inserted"] == 0 and got["partitions_touched"] == 2
        assert merge_into_silver(spark, batch.limit(0), path)["partitions_touched"] == 0


def test_row_hash_keeps_null_shift_apart_and_fingerprint_is_order_free(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert len({r[0] for r in df.select(row_hash(F.col("x"), F.col("y"))).collect()}) == 2
    big = spark.range(500).select(F.col("id").cast("string").alias("x"))
    assert multiset_fingerprint(big).first() == multiset_fingerprint(big.orderBy(F.desc("x")).repartition(7)).first()
    assert multiset_fingerprint(big).first() != multiset_fingerprint(big.where("x <> '7'")).first()


def test_bronze_replay_empty_feed_and_drift(spark):
    feed, root = FEEDS_BY_NAME["shopify_orders"], shared_folder(spark, "bronze-test")
    df = spark.createDataFrame([(1, at(1))], "id long, updated_at timestamp")
    assert read_bronze(spark, feed, IV, root, df.schema).count() == 0
    for run in ("r1", "r2"):
        assert append_bronze(spark, feed.slice(df, IV), feed, run, IV, root, declared=df.schema) == 1
    assert read_bronze(spark, feed, IV, root, df.schema).count() == 2
    with pytest.raises(ValueError):
        append_bronze(spark, df.withColumn("new", F.lit(1)), feed, "r3", IV, root, declared=df.schema)


def test_jdbc_slices(spark):
    url, driver, feed = "jdbc:derby:memory:t;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver", FEEDS_BY_NAME["shopify_orders"]
    rows = [(1, datetime(2026, 8, 1, 23, 59, 59)), (2, datetime(2026, 8, 2)), (3, datetime(2026, 8, 2, 12)), (4, datetime(2026, 8, 3))]
    spark.createDataFrame(rows, "id long, updated_at timestamp").write.format("jdbc").options(url=url, driver=driver, dbtable=feed.source_table).mode("overwrite").save()
    whole = read_jdbc_query(spark, feed, IV, url, driver)
    pushed = read_jdbc_slice(spark, feed, IV, url, driver)
    parallel = read_jdbc_slice(spark, feed, IV, url, driver, partitions=3, partition_column="updated_at")
    assert [sorted(r["id"] for r in x.collect()) for x in (whole, pushed, parallel)] == [[2, 3]] * 3
    assert "PushedFilters: [" in pushed._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_merge_stream(spark, sf_dir):
    from tidemark.plans.pipeline import canonical
    from tidemark.streaming.merge_stream import merge_stream

    src, path = shared_folder(spark, "stream-in"), shared_folder(spark, "stream-silver")
    canonical(spark, sf_dir, Interval.year(1996)).limit(200).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    merge_stream(stream, path, shared_folder(spark, "ck")).awaitTermination()
    assert spark.read.parquet(path).count() == spark.read.parquet(src).select("order_key").distinct().count()


def test_declared_schemas(spark, sf_dir):
    from tidemark.sources.derive import feed_log

    for f in FEEDS_BY_NAME.values():
        assert [(c.name, c.dataType) for c in feed_log(spark, sf_dir, f).schema] == [(c.name, c.dataType) for c in f.schema]


def test_seed_repeats(spark):
    url, driver, feed = "jdbc:derby:memory:s;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver", FEEDS_BY_NAME["amazon_orders"]
    df = spark.createDataFrame([(1, at(1)), (2, at(2))], 'id long, "LastUpdateDate" timestamp'.replace('"', ""))
    for _ in range(2):
        seed_jdbc(df, feed, url, driver)
    assert read_jdbc_slice(spark, feed, Interval.year(2026), url, driver).count() == 2


def test_snapshot_on_disk(spark):
    from tidemark.operators.snapshot import load_snapshot, save_snapshot

    path = shared_folder(spark, "snapshot")
    state = {"row_count": 3, "key_count": 2, "net_usd": Decimal("4.50"), "duplicate_keys": 1, "hash": "ab"}
    save_snapshot(spark, state, path)
    assert load_snapshot(spark, path) == state


def test_command_line(spark, sf_dir, tmp_path):
    from tidemark import cli

    args = ["--data", sf_dir, "--lake", str(tmp_path / "lake"), "--interval-start", "1996-03-01", "--interval-end", "1996-03-04", "--summary", str(tmp_path / "s.json")]
    for step in ("bronze", "normalize", "silver", "silver"):
        assert cli.main([step, *args]) == 0
        assert json.loads((tmp_path / "s.json").read_text())["ok"]
    assert cli.main(["silver", *args, "--data", str(tmp_path / "nothing")]) == 1
    failed = json.loads((tmp_path / "s.json").read_text())["steps"][0]
    assert not failed["ok"] and "PATH_NOT_FOUND" in failed["reason"]
    assert cli.main(["normalize", *args, "--step-seconds", "0.01"]) == 1
    assert json.loads((tmp_path / "s.json").read_text())["steps"][0]["reason"] == "time limit"
