import re

import corpus_pipeline
from test_decontaminate import brute as leaks
from test_substring_dedup import brute as passages

from tidemark.llm._spark import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), "test-stage")
        seen.append((name, docs, out))
        if name != "mix":
            assert out.columns == columns
            assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
            docs = out
    stages = {name: (a, b) for name, a, b in seen}
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    a, b = stages["substring_dedup"]
    want, words = passages(rows(a), 20), {d: len(re.findall("[^\x20\x09-\x0d]+", x or "")) for d, x in rows(b)}
    assert words == {d: n - gone for d, (n, gone, _) in want.items() if gone < n or n == 0}
    a, b = stages["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {d for d, _ in rows(b)} == {d for d, _ in rows(a)} - {d for d, _ in leaks(rows(a), items)}
    a, b = stages["quality"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {d for d, _ in rows(b)}
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.9 * len(labels)
    a, b = stages["mix"]
    assert b.count() == a.count() and b.where("taken > 3 * size").count() == 0
