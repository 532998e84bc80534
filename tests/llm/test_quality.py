import zlib

from pyspark.sql import functions as F

from tidemark.llm.quality import quality_scores


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality_scores(docs, labels).cache()
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    held = out.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    right = sum(r[0] == r[1] for r in held) / len(held)
    print("held-out accuracy", right, len(held))
    assert right >= 0.9


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b c"), (2, ""), (3, "word " * 50000), (3, "word " * 50000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert quality_scores(docs, labels).count() == 5
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_contract_columns_and_no_leak_of_labels(spark, sf_dir):
    """held_out and predicted as defined; held-out labels and every column but the text have no influence on a score."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit("")}))
    rows = quality_scores(docs, labels).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7)
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    assert labels.where(held).count() > 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    renamed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("other")})
    again = quality_scores(renamed, flipped).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)
