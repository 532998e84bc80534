"""Spark helpers of the operators: row keys, written steps, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that any operator broadcasts (rows are at most a few dozen bytes: tens of MB).
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch inside ``small_batches``.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share; where ``spark.checkpoint.dir`` is unset, it is set in local mode (tests)
    and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def _set(spark: SparkSession, name: str, value: str):
    old = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def freed(spark: SparkSession):
    """Spark drops the shuffle files of each write in here as the write ends: its rows are on shared disk by then."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession):
    """Jobs in here send rows to their Python workers in batches of few bytes: a batch is held whole on both sides, outside
    the heap. For functions over batches whose result does not depend on where batches end."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends, and a lost executor repeats no earlier step."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, text, the internal row key (_id, _th) and, if asked for, ``row``: all columns as one struct, so that their names
    meet no other. A null id counts as the smallest. Where ids are unique (checked over the id column alone) _th is 0; else it
    is a hash of the text, so that rows with equal id and text share a key and a result, and equal ids with different texts
    stay apart."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    own = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    unique = rows.select(own.alias("i")).groupBy("i").count().where("count > 1").isEmpty()
    # Zero, but no literal: the optimizer would push "_th = 0" into one reader of a shared exchange and so split it.
    th = own.bitwiseAND(F.lit(0)) if unique else F.xxhash64("text")
    return rows.select("*", own.alias("_id"), th.alias("_th", metadata={"unique": unique}))


KEY = ["_id", "_th"]


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written side, hinted for broadcast only if its row count (read from Parquet footers) is within the limit;
    beyond it the join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df.hint("merge")


def held_out(mod: int, rest: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == rest
