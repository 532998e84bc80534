import hashlib
import random
from collections import Counter

import numpy as np

from tidemark.llm import suffix_dedup as sd
from tidemark.llm import _text as t
from tidemark.llm.suffix_array import permuted_prefixes, repeated_starts, suffix_array


def brute(rows, length=200):
    rows = {(d, (t or "").encode()) for d, t in rows}
    count = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = {}
    for d, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())) if len(t) else 0
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        out[d] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmé") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    p, q = text(60), text(100)
    return [
        (1, text(50) + p + text(50)), (2, p), (3, q + text(9) + p[20:]), (4, None), (5, ""), (6, "a" * 700), (7, "ab" * 400), (8, q[:250] + "X" + q[251:]), (9, q), (10, q),
        (None, text(30) + q[100:400]), (11, text(4000) + q), (12, p[3:150]),
    ]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows()], "doc_id long, text string, h int, start int")
    assert result(sd.suffix_dedup(docs)) == brute(rows())
    assert sd.suffix_dedup(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 2").union(docs.where("doc_id = 2"))
    assert [r["n_removed"] for r in sd.suffix_dedup(twice).collect()] == [0, 0]


def test_hot_anchors_by_hash(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_RUNS", 1)
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    assert result(sd.suffix_dedup(docs)) == brute(rows())


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(sd.suffix_dedup(docs)) == brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(200):
        k = rng.choice([1, 2, 3, 200])
        s = np.array([rng.randint(1, k) for _ in range(rng.randint(1, 60))] * (1 + trial % 4 // 3) + [0], dtype=np.uint16)
        sa = suffix_array(s)
        assert list(sa) == sorted(range(len(s)), key=lambda i: list(s[i:]))
        phi, plcp = permuted_prefixes(s, sa, np.array([0]), 1000)
        for i, j in enumerate(phi):
            n = 0
            while j >= 0 and max(i, j) + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            assert plcp[i] == n


def test_repeated_starts():
    rng = random.Random(2)
    for _ in range(80):
        length = rng.randint(2, 9)
        made = lambda: bytes(rng.choice((rng.choices(range(3), k=rng.randint(0, 40)), [rng.randrange(256)] * rng.randint(0, 30))))
        pieces = [made() for _ in range(rng.randint(1, 12))]
        count = Counter(x[i : i + length] for x in pieces for i in range(len(x) - length + 1))
        assert [o.tolist() for o in repeated_starts(pieces, length)] == [[i for i in range(len(x) - length + 1) if count[x[i : i + length]] > 1] for x in pieces]


def test_thue_morse_strings_differ(spark):
    """Hashes modulo a power of two take such strings of 1,024 letters for equal."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer((a + b + a).encode(), dtype=np.uint8)
    at = np.array([0, 4096, 8192])
    h = t.span_hash(raw, at, at + 4096)
    assert h[0] == h[2] != h[1]
    units = t.word_hashes(raw, np.arange(len(raw)), np.arange(len(raw)) + 1)
    h = t.span_hash(units, at, at + 4096)
    assert h[0] == h[2] != h[1]
    texts = [(1, a[:1024]), (2, b[:1024]), (3, a[:2048] + "." + b[:2048])]
    assert result(sd.suffix_dedup(spark.createDataFrame(texts, "doc_id long, text string"))) == brute(texts)
