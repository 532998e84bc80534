"""Training-data pipeline: quality, near duplicates, repeated passages, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir), applies one operator to all that its predecessor kept, and returns the columns of
``documents``; the last returns the mix. ``run`` writes each result to the shared folder and reads it again, so a lost executor
repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, near_dedup, quality, substring_dedup
from tidemark.llm._spark import written

#: No SQL expresses the learned and hashed stages; tests hold each against its operator and a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.7 or more), unchanged."""
    scored = quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), whole=True)
    return scored.where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class, unchanged."""
    return near_dedup.first_of_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that start earlier; a text that loses words keeps the others, joined by one
    space. A document that loses every word goes."""
    out = substring_dedup.substring_dedup(docs, whole=True)
    out = out.where("n_removed < n_words or n_words = 0")
    old = {c: F.col("row").getField(c) for c in docs.columns}
    text = F.coalesce("kept_text", old["text"])
    made = {"text": text, "n_chars": F.when(F.col("kept_text").isNull(), old.get("n_chars")).otherwise(F.length(text)).cast("bigint")}
    return out.select(*[made.get(c, old[c]).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, unchanged."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontaminate", benchmark_leaks),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
