"""Command line: ``python -m tidemark.cli bronze|normalize|silver|gate|all`` over the derived feeds.

Bounds are required for interval jobs; nothing reads a clock. Exit code 0 only if every step succeeded.
"""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.intervals import default_run_id, parse_interval
from tidemark.metrics import emit_metric
from tidemark.operators import quality, snapshot as snap
from tidemark.plans.pipeline import canonical, gate, process_interval
from tidemark.session import build_spark
from tidemark.sources.bronze import append_bronze, multiset_fingerprint
from tidemark.sources.derive import feed_log
from tidemark.sources.feeds import pick_feeds


def bronze(spark, a, iv) -> bool:
    total = 0
    for feed in pick_feeds(a.feeds):
        raw = feed.slice(feed_log(spark, a.data, feed), iv)
        print(feed.name, multiset_fingerprint(raw).first())
        total += append_bronze(spark, raw, feed, a.run_id or default_run_id(iv.start), iv, f"{a.lake}/bronze", declared=feed.schema)
    emit_metric(job="bronze", feed="__total__", rows_appended=total)
    return True


def normalize(spark, a, iv) -> bool:
    df = canonical(spark, a.data, iv)
    df.orderBy("order_key").show(a.show, truncate=False)
    quality.market_summary(df).orderBy("marketplace").show()
    parts = [quality.unknown_raw_status(f.slice(feed_log(spark, a.data, f), iv), f) for f in pick_feeds()]
    unknown = reduce(DataFrame.unionByName, parts)
    unknown.orderBy(F.desc("versions")).show(truncate=False)
    report = quality.quality_report(df, unknown)
    emit_metric(job="normalize", **report)
    return report["ok"]


def silver(spark, a, iv) -> bool:
    got = process_interval(spark, a.data, iv, {f"{a.lake}/silver": not a.naive}, a.run_id)[0]
    t = snap.totals(spark.read.parquet(f"{a.lake}/silver")).first().asDict()
    emit_metric(job="silver", **got, **t)
    return t["duplicate_keys"] == 0


def run_gate(spark, a, iv) -> bool:
    report = gate(spark, a.data)
    emit_metric(job="gate", **report)
    return report["ok"]


STEPS = {"bronze": bronze, "normalize": normalize, "silver": silver, "gate": run_gate}


def run_step(spark, step: str, a, iv) -> dict:
    """Run one step; an error or the time limit (its Spark jobs are cancelled) makes it fail, and says why."""
    began, late, why = time.time(), threading.Event(), None
    tag = f"tidemark-{step}"
    spark.addTag(tag)

    def stop():
        late.set()
        spark.interruptTag(tag)

    clock = threading.Timer(a.step_seconds, stop) if a.step_seconds else None
    if clock:
        clock.start()
    try:
        ok = STEPS[step](spark, a, iv) and not late.is_set()
    except Exception as e:  # the runner reports any failure of a step and ends with code 1
        ok, why = False, f"{type(e).__name__}: {e}"[:500]
    finally:
        spark.removeTag(tag)
        if clock:
            clock.cancel()
    return {"step": step, "ok": ok, "seconds": round(time.time() - began, 1), "reason": "time limit" if late.is_set() else why}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser()
    p.add_argument("step", choices=[*STEPS, "all"])
    p.add_argument("--data", required=True)
    p.add_argument("--lake", default=None)
    p.add_argument("--interval-start")
    p.add_argument("--interval-end")
    p.add_argument("--run-id")
    p.add_argument("--feeds", default="all")
    p.add_argument("--show", type=int, default=8)
    p.add_argument("--naive", action="store_true")
    p.add_argument("--step-seconds", type=float, help="time limit of a step")
    p.add_argument("--summary", help="file for the run's summary as JSON")
    a = p.parse_args(argv)
    steps = list(STEPS) if a.step == "all" else [a.step]
    if steps != ["gate"] and not (a.interval_start and a.interval_end and a.lake):
        p.error("--lake, --interval-start and --interval-end are required")
    iv = parse_interval(a.interval_start, a.interval_end) if a.interval_start else None
    pick_feeds(a.feeds)
    spark = build_spark("tidemark")
    done = []
    for step in steps:
        done.append(run_step(spark, step, a, iv))
        emit_metric(job="runner", **done[-1])
        if not done[-1]["ok"]:
            break
    if a.summary:
        with open(a.summary, "w") as f:
            json.dump({"ok": done[-1]["ok"], "steps": done, "skipped": steps[len(done) :]}, f, indent=1)
    return 0 if done[-1]["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
