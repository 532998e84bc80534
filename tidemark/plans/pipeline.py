"""Whole jobs: canonical batches, interval processing and the replay gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.intervals import Interval, default_run_id
from tidemark.operators import snapshot as snap
from tidemark.operators.dedupe import dedupe_latest
from tidemark.operators.merge import merge_into_silver
from tidemark.operators.normalize import NORMALIZERS, convert_to_usd, union_canonical
from tidemark.session import remove, shared_folder, use_utc
from tidemark.sources.bronze import add_metadata
from tidemark.sources.derive import feed_log, fx_rates, version_log, version_years
from tidemark.sources.feeds import FEEDS

REPLAY = 1996
_FX: dict[tuple, DataFrame] = {}


def fx_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates, written once for each session and input, so that counting them reads Parquet footers only."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FX:
        path = shared_folder(spark, "fx")
        fx_rates(spark, sf_dir).coalesce(1).write.parquet(path)
        _FX[key] = spark.read.parquet(path)
    return _FX[key]


def canonical(spark: SparkSession, sf_dir: str, iv: Interval | None = None, run_id: str | None = None, fx: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Canonical batch of one interval, or of the whole log without metadata. Catalyst pushes the interval through the
    union into every branch. ``log`` is a written version log."""
    parts = []
    for feed in FEEDS:
        raw = feed_log(spark, sf_dir, feed, log)
        if iv is not None:
            raw = add_metadata(feed.slice(raw, iv), run_id or default_run_id(iv.start), iv, wall_clock=False)
        parts.append(NORMALIZERS[feed.marketplace](raw))
    return convert_to_usd(union_canonical(parts), fx if fx is not None else fx_dimension(spark, sf_dir))


def silver_batch(batch: DataFrame) -> DataFrame:
    """Latest versions, filed by month of the business date: a day's slice rewrites the few months that it names."""
    return dedupe_latest(batch).withColumn("order_month", F.trunc("order_date", "month"))


def merge_batch(spark: SparkSession, versions: DataFrame, paths: dict[str, bool]) -> list[dict]:
    """Merge the same deduplicated batch into each table of ``paths`` (path -> guarded). The batch is written once, so
    that all tables get identical rows and nothing is computed twice. Counts before and after deduplication are reported."""
    folder, seen = shared_folder(spark, "batch"), Observation()
    silver_batch(versions.observe(seen, F.count(F.lit(1)).alias("n"))).write.parquet(folder)
    batch = spark.read.parquet(folder)
    counts = {"rows_in_batch": seen.get["n"], "rows_deduplicated": batch.count()}
    done = [counts | merge_into_silver(spark, batch, p, guarded=g) for p, g in paths.items()]
    remove(spark, folder)
    return done


def process_interval(spark: SparkSession, sf_dir: str, iv: Interval, paths: dict[str, bool], run_id: str | None = None, log: DataFrame | None = None) -> list[dict]:
    return merge_batch(spark, canonical(spark, sf_dir, iv, run_id, log=log), paths)


_BUILT: dict[tuple, dict] = {}


def silver_tables(spark: SparkSession, sf_dir: str) -> dict:
    """Guarded and naive silver through all intervals and then one replay, by the real merge. Built once for each
    session and input; ``before`` holds the state before the replay."""
    use_utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        root = shared_folder(spark, "silver")
        paths = {f"{root}/guarded": True, f"{root}/naive": False}
        # The feeds' common log is derived once; every interval scans it with its clock pushed down.
        version_log(spark, sf_dir).write.parquet(f"{root}/log")
        log = spark.read.parquet(f"{root}/log")
        for y in version_years(spark, sf_dir):
            process_interval(spark, sf_dir, Interval.year(y), paths, log=log)
        read = lambda name: spark.read.parquet(f"{root}/{name}")
        invariants_before = snap.invariants(read("guarded")).first().asDict()
        for name in ("guarded", "naive"):
            snap.revenue_by_market_day(read(name)).write.parquet(f"{root}/revenue_before_{name}")
            snap.save_snapshot(spark, snap.snapshot(read(name)), f"{root}/snapshot_before_{name}")
        before = {name: snap.load_snapshot(spark, f"{root}/snapshot_before_{name}") for name in ("guarded", "naive")}
        replay = process_interval(spark, sf_dir, Interval.year(REPLAY), paths, run_id="replay", log=log)
        after = {name: snap.snapshot(read(name)) for name in ("guarded", "naive")}
        _BUILT[key] = {"root": root, "before": before, "after": after, "invariants_before": invariants_before, "replay": dict(zip(("guarded", "naive"), replay))}
    return _BUILT[key]


def silver(spark: SparkSession, sf_dir: str, name: str = "guarded") -> DataFrame:
    return spark.read.parquet(f"{silver_tables(spark, sf_dir)['root']}/{name}")


def revenue_change(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Revenue cells that the replay changed."""
    root = silver_tables(spark, sf_dir)["root"]
    b = spark.read.parquet(f"{root}/revenue_before_{name}").select("marketplace", "order_date", F.col("net_usd").alias("before_usd"))
    a = snap.revenue_by_market_day(silver(spark, sf_dir, name)).select("marketplace", "order_date", F.col("net_usd").alias("after_usd"))
    return b.join(a, ["marketplace", "order_date"], "full").where(~F.col("before_usd").eqNullSafe(F.col("after_usd")))


def gate(spark: SparkSession, sf_dir: str) -> dict:
    """The proof: a replay leaves guarded unchanged, changes naive, and back-dated rows exist. ``ok`` is false if any
    of these fails, so the gate can fail."""
    built = silver_tables(spark, sf_dir)
    inv = snap.invariants(silver(spark, sf_dir)).first().asDict()
    n_reverted = snap.reverted(silver(spark, sf_dir), silver(spark, sf_dir, "naive")).count()
    same = {n: built["before"][n] == built["after"][n] for n in ("guarded", "naive")}
    clean = all(x["duplicate_keys"] == 0 and x["wrong_day"] == 0 for x in (inv, built["invariants_before"]))
    return {
        "guarded_unchanged": same["guarded"], "naive_changed": not same["naive"], "back_dated": inv["back_dated"], "reverted": n_reverted,
        "before_usd": built["before"]["naive"]["net_usd"], "after_usd": built["after"]["naive"]["net_usd"],
        "ok": same["guarded"] and not same["naive"] and clean and inv["back_dated"] > 0 and n_reverted > 0,
    }
