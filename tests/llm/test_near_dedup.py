import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import near_dedup
from tidemark.llm.near_dedup import bagminhash, first_of_class, near_classes


def bag(text):
    w = (text or "").split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows, threshold=0.8):
    rows = sorted(set(rows))
    bags = {d: bag(x) for d, x in rows}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            small, large = sorted((sum(bags[a].values()), sum(bags[b].values())))
            if small and small >= threshold * large:
                c = sum((bags[a] & bags[b]).values())
                if x == y or c / (small + large - c) >= threshold:
                    u, v = sorted((find(a), find(b)))
                    root[v] = u
    return {d: find(d) for d, _ in rows}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(4)
    for wa, wb in (([1] * 60, [1] * 60), ([5, 1, 9, 2] * 12, [3, 1, 12, 2] * 12)):
        n = len(wa)
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        wb = list(wb)
        wb[:6] = [0] * 6
        wb = np.array(wb)
        doc = np.concatenate([np.zeros(n, int), np.ones((wb > 0).sum(), int)])
        sig = bagminhash(doc, np.concatenate([h, h[wb > 0]]), np.concatenate([wa, wb[wb > 0]]), 2, m=4096)
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_edge_cases(spark):
    rng = random.Random(7)
    text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    edit = lambda k: " ".join(f"e{rng.randrange(10**6)}" if i in k else x for i, x in enumerate(text))
    rows = [(1, " ".join(text)), (2, edit({20})), (3, edit({50, 120})), (4, " ".join(text)), (5, None), (6, ""), (7, "a b"), (8, "a b"), (9, edit(set(range(0, 200, 9)))), (10, "the " * 3000), (11, "the " * 3010), (12, " ")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, v int")
    assert {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()} == brute(rows)
    assert {r["doc_id"] for r in first_of_class(docs.union(docs)).collect()} == set(brute(rows).values())
    assert near_classes(docs.limit(0)).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_blocks_and_pivot_rounds(spark, monkeypatch):
    """A group of scattered near copies, dealt to many blocks and joined in rounds, has the classes of brute force."""
    rng = random.Random(3)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(f"e{rng.randrange(10**6)}" if rng.random() < 0.002 * (i % 30) else x for x in text)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(set(want.values())) > 5
    monkeypatch.setattr(near_dedup, "SIDE_BYTES", near_dedup.LEAST * 24)
    monkeypatch.setattr(near_dedup, "PAIRS_A_ROW", 0)
    assert {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()} == want


def test_block_product_equals_pairs():
    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 6, rng.integers(0, 60))) for _ in range(70)] + ["", "same words here and now " * 30])
    e, off = near_dedup._elements(texts)
    x, y = np.arange(0, 72, 2), np.arange(72)
    block = near_dedup._shared_of_block(e, off, x, y)
    i, j = np.divmod(np.arange(len(x) * len(y)), len(y))
    assert (near_dedup._shared_of_pairs(e, off, x[i], y[j]).reshape(block.shape) == block).all()
    bags = [bag(w) for w in texts.to_pylist()]
    assert all(block[a, b] == sum((bags[p] & bags[q]).values()) for a, p in enumerate(x) for b, q in enumerate(y))


def test_names_and_blanks(spark):
    rows = [(1, "\t", 5, "a"), (2, "\t", 6, "b"), (3, "  ", 7, "c"), (4, "  ", 8, None), (5, "x y z", 9, "e"), (5, "x y z", 9, "e"), (6, "x y z", 9, "e"), (None, "x y z", 1, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _th string").withColumn("row", F.lit(1)).withColumn("v", F.lit("x"))
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_classes(docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (None, False), 6: (None, False), None: (None, True)}
    kept = first_of_class(docs)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["_id"], r["_th"]) for r in kept.collect()} == {(1, 5, "a"), (2, 6, "b"), (3, 7, "c"), (4, 8, None), (None, 1, "n")}
