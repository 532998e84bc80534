"""Thin queries opN_<name>: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark, d):
    from tidemark.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, d, "documents"), window=20).drop("kept_text")


@query
def op7_suffix_dedup(spark, d):
    from tidemark.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, d, "documents"), length=200).drop("kept")


@query
def op10_mixing(spark, d):
    from tidemark.llm.mixing import mix

    return mix(table(spark, d, "documents").select("doc_id", "source", "text")).drop("source", "epochs")


@query
def op2_url_filter(spark, d):
    from tidemark.llm.url_filter import url_filter

    return url_filter(table(spark, d, "pages").select("page_id", "url"))


ORACLE["op2_url_filter"] = """
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""


@query
def op5_license_scan(spark, d):
    from tidemark.llm.license_scan import license_scan

    return license_scan(table(spark, d, "documents")).drop("spans")


@query
def op3_quality(spark, d):
    from tidemark.llm.quality import quality_scores

    return quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op6_decontaminate(spark, d):
    from tidemark.llm.decontaminate import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("_id", "_th")


@query
def op4_near_dedup(spark, d):
    from tidemark.llm.near_dedup import near_classes

    return near_classes(table(spark, d, "documents")).select("doc_id", "class_id", "kept")


@query
def op8_lm_score(spark, d):
    from tidemark.llm.lm_score import lm_scores

    return lm_scores(table(spark, d, "documents"), lower=True)


@query
def op9_media(spark, d):
    from tidemark.llm._spark import written
    from tidemark.llm.media import align, fingerprints, recordings, sonified

    prints = written(fingerprints(sonified(table(spark, d, "embeddings")), "id"), "fingerprints")
    each = recordings(prints).select(F.lit("recording").alias("kind"), F.col("class_id").alias("a"), F.col("id").alias("b"), "frames", "digest")
    return align(prints).unionByName(each, allowMissingColumns=True)


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES["pipeline"] = pipeline
