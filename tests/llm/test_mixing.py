import math
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix, targets


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 3000, 10**6]) for i in range(rng.randint(1, 9))} | {None: 7}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and rows and sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs).collect()))
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r["t"] - r["g"]) <= r["m"]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "x y", None), (2, "", "a"), (2, "", "a"), (3, "p q r", "b")], "doc_id long, text string, source string").withColumn("size", F.lit(1))
    rows = mix(docs).collect()
    assert len(rows) == 5 and sum(r["size"] for r in rows) == 5
    assert mix(docs.limit(0)).count() == 0


def brute_taken(rows, seed=17):
    """(doc_id, size, taken) by the definition: whole epochs, then keys in order until the sum is nearest the budget."""
    docs = []
    for d, text, source in rows:
        size = len(re.findall("[^\x20\x09-\x0d]+", text or ""))
        share = 1.0 if not text else 1 - 0.9 * sum(c in "!$%&*#|0123456789_=<>{}[]~^\\/@+" for c in text) / len(text)
        h = xxhash.xxh64_intdigest(struct.pack("<q", -1 if d is None else d), seed=42)
        u = (xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=h) % 2**52 + 0.5) / 2**52
        docs.append((source, -math.log(u) / max(share, 1e-3), d is not None, d or 0, size, d))
    sizes = {}
    for x in docs:
        sizes[x[0]] = sizes.get(x[0], 0) + x[4]
    goal, out = brute_targets(sizes), []
    for s, total in sizes.items():
        whole = min(int(goal[s] // total), 3) if total else 0
        budget, upto = goal[s] - whole * total, 0
        for _, _, _, _, size, d in sorted(x for x in docs if x[0] == s):
            upto += size
            out.append((d, size, size * (whole + (budget > 0 and whole < 3 and upto - size / 2 <= budget))))
    return out


def test_taken_by_brute_force(spark, sf_dir):
    rng = random.Random(5)
    tables = [[tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]]
    words = ["plain", "x1", "$$", "été", "a_b", "\U0001f600"]
    tables.append([(i if i else None, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 900]))), rng.choice(["a", "b", "c", "d", None])) for i in range(300)])
    tables.append([(1, "a b c", "small"), *[(i, "w " * 50, "large") for i in range(2, 40)]])
    for rows in tables:
        out = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        got = [(r["doc_id"], r["size"], r["taken"]) for r in out.select("doc_id", "size", "taken").collect()]
        assert sorted(got, key=repr) == sorted(brute_taken(rows), key=repr)
