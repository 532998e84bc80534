"""What a worker's memory comes to while an operator of the pipeline runs over a batch, and what it keeps of it afterwards."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm._spark import BATCH_BYTES, small_batches, written

CODE = """
import re
import numpy as np, pyarrow as pa
from tidemark.llm import _text as t, near_dedup, quality, substring_dedup

def mb(key):
    return int(re.search(key + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = np.random.default_rng(5)
words = np.array(["w%d" % i for i in range(5000)])
texts = [" ".join(words[rng.integers(0, 5000, 500)]) for _ in range(2000)]
n, ids = len(texts), pa.array(np.arange(len(texts)))
batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(np.zeros(n, dtype=np.int64)), pa.array(texts), pa.array(np.ones(n, dtype=np.int32))], names=["doc_id", "_id", "_th", "text", "y"])

def over(size):
    for _ in RUN(iter([batch.slice(0, size)])):
        pass
    return mb("VmHWM"), mb("RssAnon")

over(20)
open("/proc/self/clear_refs", "w").write("5")
rss, before = mb("VmRSS"), mb("RssAnon")
high, after = over(n)
print(high - rss, after - before)
"""


def measured(run: str) -> list[float]:
    out = subprocess.run([sys.executable, "-c", CODE.replace("RUN", run)], cwd=Path(quality.__file__).parents[2], capture_output=True, text=True, timeout=120, check=True)
    return [float(x) for x in out.stdout.split()]


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
@pytest.mark.parametrize("run, most", [("quality._bags", 110), ("near_dedup._signatures", 55), ("substring_dedup._fingerprints(20, 8)", 35)])
def test_peak_of_a_batch(run, most):
    assert measured(run)[0] < most


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_worker_keeps_no_freed_memory():
    assert measured("t.released(quality._bags)")[1] < 25


def test_whole_rows_come_back_unchanged(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("lang", "text", F.lit("x").alias("a.b"), "doc_id").unionByName(docs.limit(2).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"), F.lit("y").alias("a.b"), "doc_id"))
    out = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole=True)
    assert out.columns == ["doc_id", "held_out", "row", "score", "predicted"]
    rows = out.select("row.*")
    assert rows.columns == docs.columns
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_a_text_goes_to_the_workers_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = quality.score(docs, quality.fit([], []), whole=True)._jdf.queryExecution().analyzed()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    assert plan.children().head().schema().json().count('"text"') == 1


def test_small_batches_end_with_their_block(spark):
    """Bounded bytes for the jobs inside, the session's own setting afterwards."""
    rows = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    sizes = lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    with small_batches(spark):
        got = [r[0] for r in written(rows.mapInArrow(sizes, "n bigint"), "sizes").collect()]
    assert sum(got) >= 9000 * 2000 and max(got) < 1.5 * BATCH_BYTES
    assert spark.conf.get(name) == old
