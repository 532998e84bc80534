import hashlib
import re

from tidemark.llm.substring_dedup import FingerprintIndex, substring_dedup
from tidemark.llm._spark import keyed

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    """(id, text) rows in order of id -> id -> (words, removed, digest)."""
    seen, out = set(), {}
    for d, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            seen.add(k)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_edge_cases(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, a), (2, "x " + a + " y"), (3, None), (4, ""), (5, "same " * 100), (6, " ".join(f"w{i}" for i in range(25, 50))),
        (7, "é ü " + a[40:200]), (None, a), (9, " ".join(f"v{i}" for i in range(5000)) + " " + a), (10, a.replace(" ", "\n\t")),
    ]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, h int, _r string")
    assert result(substring_dedup(docs)) == brute(rows, 20)
    assert result(substring_dedup(docs, batches=1)) == brute(rows, 20)
    assert result(substring_dedup(docs, batches=7)) == brute(rows, 20)


def test_repeated_rows_and_empty_table(spark):
    t = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 30)]
    assert substring_dedup(docs.limit(0)).count() == 0


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(substring_dedup(docs)) == brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], 20)


def test_runs_compact(spark):
    docs = keyed(spark.createDataFrame([(i, " ".join(f"c{j}" for j in range(i, i + 40))) for i in range(9)], "doc_id long, text string"))
    index = FingerprintIndex(spark, fan_in=2)
    for i in range(3):
        index.add(docs.where(f"doc_id % 3 = {i}"))
        index.compact()
    assert len(index.runs) == 1
    other = FingerprintIndex(spark)
    other.add(docs)
    as_sets = lambda x: {(r["_id"], frozenset(r["fps"])) for r in x.shared().collect()}
    assert as_sets(index) == as_sets(other)
    index.drop(), other.drop()


def test_query_compacts_and_leaves_no_run(spark, monkeypatch):
    made = []
    real = FingerprintIndex.drop
    monkeypatch.setattr(FingerprintIndex, "drop", lambda self: (made.append((len(self.made), len(self.runs))), real(self)))
    rows = [(i, " ".join(f"c{j}" for j in range(i, i + 40))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substring_dedup(docs)) == brute(rows, 20)
    # Three batches and one compaction of the first two.
    assert made == [(4, 2)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("run_")]
