"""Substring dedup by a log-structured fingerprint index.

Fingerprints are hashes of content-chosen word grams (the smallest gram hash of each window), so equal windows carry
equal fingerprints and about one position in seven is indexed. A batch becomes one immutable run, bucketed and sorted by
fingerprint; it is merge-joined with the older runs bucket by bucket, without an exchange. Windows under a shared
fingerprint are verified by the hash of their whole word sequence; the earliest occurrence stays. Runs that reach the fan-in
are compacted into one sorted run before the next batch.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import _text as t
from tidemark.llm._spark import KEY, freed, keyed, remove, shared_folder, small_batches, written

GRAM = 8
SALTS = 32


def _fingerprints(window: int, gram: int):
    """(key, text) -> one row for each distinct fingerprint of a document and whether it has it twice."""

    def run(batches):
        for batch in batches:
            ids, ths = (np.asarray(batch.column(c)) for c in KEY)
            for a, z, b, off in t.chunks(batch.column("text"), t.SMALL_BYTES):
                s, e, woff = t.words(b, off)
                doc, _, _, h = t.spans(t.word_hashes(b, s, e), woff, window, gram)
                if not len(doc):
                    continue
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(doc))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(t.as_i64(h[first])), pa.array(ids[a:z][doc[first]]), pa.array(ths[a:z][doc[first]]), pa.array(many)], names=["fp", *KEY, "many"])

    return run


def _lists(batch, name: str, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column's rows a..z; null is empty."""
    col = batch.column(name).slice(a, z - a)
    return np.asarray(col.flatten()), np.concatenate(([0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)))))


def shared_mask(doc: np.ndarray, h: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which (document, fingerprint) pairs are in the documents' lists."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.uint64)
    want = np.unique(t.mix(values.view(np.uint64) ^ t.mix(owner)))
    return np.isin(t.mix(h ^ t.mix(doc.astype(np.uint64))), want)


def _shared_spans(window: int, gram: int):
    """(key, text, fps) -> runs of windows under shared fingerprints, with the hash of the whole run's words."""

    def run(batches):
        for batch in batches:
            ids, ths = (np.asarray(batch.column(c)) for c in KEY)
            for a, z, b, off in t.chunks(batch.column("text"), t.SMALL_BYTES):
                s, e, woff = t.words(b, off)
                u = t.word_hashes(b, s, e)
                doc, start, n, h = t.spans(u, woff, window, gram)
                keep = shared_mask(doc, h, *_lists(batch, "fps", a, z))
                doc, start, n = doc[keep], start[keep], n[keep]
                if not len(doc):
                    continue
                sh = t.span_hash(t.mix(u, 3), start, start + n + window - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.as_i64(sh)), pa.array(t.as_i64(h[keep])), pa.array(ids[a:z][doc]), pa.array(ths[a:z][doc]), pa.array((start - woff[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["h", "fp", *KEY, "start", "n"],
                )

    return run


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+count."""
    total = int(counts.sum())
    base = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return base + np.arange(total)


def _window_hashes(window: int):
    """(key, text, runs) -> the hash of every window in the runs."""

    def run(batches):
        for batch in batches:
            ids, ths = (np.asarray(batch.column(c)) for c in KEY)
            for a, z, b, off in t.chunks(batch.column("text"), t.SMALL_BYTES):
                s, e, woff = t.words(b, off)
                flat, loff = _lists(batch, "runs", a, z)
                if not len(flat):
                    continue
                doc = np.repeat(np.arange(z - a), np.diff(loff))
                start, n = flat >> 32, flat & 0xFFFFFFFF
                at = expand(start + woff[doc], n)
                own = np.repeat(doc, n)
                h = t.span_hash(t.mix(t.word_hashes(b, s, e), 5), at, at + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.as_i64(h)), pa.array(ids[a:z][own]), pa.array(ths[a:z][own]), pa.array((at - woff[own]).astype(np.int32))], names=["h", *KEY, "start"]
                )

    return run


def _removed(window: int):
    """(doc_id, text, runs) -> words long, words removed, the kept text and its digest. ``changed`` tells whether any
    word went; the kept text is only made where one did."""

    def run(batches):
        for batch in batches:
            for a, z, b, off in t.chunks(batch.column("text"), t.SMALL_BYTES):
                s, e, woff = t.words(b, off)
                flat, loff = _lists(batch, "runs", a, z)
                gone = np.zeros(len(s) + 1, dtype=np.int32)
                if len(flat):
                    doc = np.repeat(np.arange(z - a), np.diff(loff))
                    first = (flat >> 32) + woff[doc]
                    np.add.at(gone, first, 1)
                    np.add.at(gone, first + (flat & 0xFFFFFFFF) + window - 1, -1)
                keep = np.cumsum(gone[:-1]) == 0
                s, e = s[keep], e[keep]
                koff = np.concatenate(([0], np.cumsum(keep)))[woff]
                # Kept words joined by one space: copy each word and a following space.
                src = np.append(b, np.uint8(32))
                take = expand(s, e - s + 1)
                joined = src[np.minimum(take, len(b))]
                ends = np.cumsum(e - s + 1)
                joined[ends - 1] = 32
                bound = np.concatenate(([0], ends))[koff]
                raw = joined.tobytes()
                texts = [raw[bound[i] : max(bound[i], bound[i + 1] - 1)] for i in range(z - a)]
                n, kept = np.diff(woff), np.diff(koff)
                kept_text = [x.decode() if n[i] != kept[i] else None for i, x in enumerate(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, z - a), pa.array(n.astype(np.int64)), pa.array((n - kept).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(kept_text, type=pa.string()), *(batch.column(c).slice(a, z - a) for c in batch.schema.names if c == "row")],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *(c for c in batch.schema.names if c == "row")],
                )

    return run


def split_first(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (h, key, start, ...) as the earliest occurrence of each hash and all later ones. Two ranks, the first within a
    salt, so that a hash with a third of all rows is ranked by many tasks and only the firsts of a salt meet. The filters
    subtract so that no group limit is planned for one branch alone: all branches share each rank's exchange."""
    order = [*[F.col(c) for c in KEY], F.col("start")]
    salt = F.pmod(F.xxhash64(*KEY), F.lit(SALTS))
    local = rows.withColumn("_salt", salt).withColumn("_r", F.rank().over(Window.partitionBy("h", "_salt").orderBy(*order)))
    lead = local.where("_r - 1 <= 0").withColumn("_q", F.rank().over(Window.partitionBy("h").orderBy(*order)))
    later = local.where("_r - 1 > 0").select(*rows.columns).unionByName(lead.where("_q - 1 > 0").select(*rows.columns))
    return lead.where("_q - 1 <= 0").select(*rows.columns), later


def packed_runs(rows: DataFrame) -> DataFrame:
    """Each document's runs as one array of start << 32 | n; a document's runs are bounded by its length."""
    return rows.groupBy(*KEY).agg(F.collect_list(F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("n")).alias("runs"))


class FingerprintIndex:
    """Log-structured index of fingerprints over immutable runs in a shared folder.

    ``add`` merge-joins a batch with the runs and returns nothing; ``shared`` has, for each document of any batch, the
    fingerprints it shares; ``compact`` rewrites the runs as one; ``drop`` deletes all runs. Runs are Parquet, bucketed and
    sorted by fingerprint, so the merge join reads bucket against bucket with no exchange. Links refer to the runs that they
    were found in, so compacted runs stay until ``drop``.
    """

    def __init__(self, spark: SparkSession, window: int = 20, gram: int = GRAM, buckets: int = 0, fan_in: int = 4, path: str | None = None):
        self.spark, self.window, self.gram, self.fan_in = spark, window, gram, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or shared_folder(spark, "fingerprints")
        self.runs: list[str] = []
        self.made: list[str] = []
        self.links: list[DataFrame] = []

    def _write_run(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        with freed(self.spark), small_batches(self.spark):
            rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        self.made.append(name)
        return name

    def add(self, docs: DataFrame) -> None:
        """Append a batch of keyed documents as one run, and note which documents share a fingerprint through it."""
        schema = "fp bigint, _id bigint, _th bigint, many boolean"
        name = self._write_run(docs.select(*KEY, "text").mapInArrow(t.released(_fingerprints(self.window, self.gram)), schema))
        new = self.spark.table(name)
        groups = new.groupBy("fp").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.min("_th").alias("tl"), F.max("_th").alias("th"), F.max("many").alias("m"))
        twice = groups.where("m or lo <> hi or tl <> th").select("fp").hint("merge")
        own = new.join(twice, "fp", "left_semi")
        for old_name in self.runs:
            old = self.spark.table(old_name)
            known, fresh = old.groupBy("fp").agg(F.lit(1).alias("one")), groups.select("fp")
            own = own.unionByName(new.join(known.hint("merge"), "fp", "left_semi"))
            self.links.append(old.join(fresh.hint("merge"), "fp", "left_semi").select("fp", *KEY))
        self.links.append(own.select("fp", *KEY))
        self.runs.append(name)

    def compact(self, force: bool = False) -> None:
        """Merge all runs into one sorted run once there are as many as the fan-in."""
        if len(self.runs) > 1 and (force or len(self.runs) >= self.fan_in):
            self.runs = [self._write_run(reduce(DataFrame.unionByName, [self.spark.table(r) for r in self.runs]))]

    def shared(self) -> DataFrame:
        """Each document's shared fingerprints, of all batches so far."""
        return reduce(DataFrame.unionByName, self.links).groupBy(*KEY).agg(F.collect_set("fp").alias("fps"))

    def drop(self) -> None:
        """Delete the tables and files of all runs."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.path)
        self.runs, self.made, self.links = [], [], []


def substring_dedup(docs: DataFrame, window: int = 20, batches: int = 3, whole: bool = False, fan_in: int = 2) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts earlier (smaller id, or same document).

    Returns doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing went) and, with ``whole``, the
    row as a struct. Documents are added to the index in ``batches`` by ascending id; ``fan_in`` runs are compacted. Null text has no words; an empty
    table gives no rows; rows equal in id and text count once and each gets the result; other columns are ignored.
    """
    spark = docs.sparkSession
    base = keyed(docs, whole)
    index = FingerprintIndex(spark, window, fan_in=fan_in)
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(edges, edges[1:]):
        part = base
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where((F.col("doc_id") <= hi) | F.col("doc_id").isNull() if lo is None else F.col("doc_id") <= hi)
        index.compact()
        index.add(part)
    shared = written(index.shared(), "shared-fingerprints")
    index.drop()
    # All three joins read the same columns of ``base``, so that its exchange by key is made once and reused.
    spans = base.join(shared.hint("merge"), KEY).mapInArrow(t.released(_shared_spans(window, index.gram)), "h bigint, fp bigint, _id bigint, _th bigint, start int, n int")
    firsts, later = split_first(spans)
    # Equal windows share their fingerprint and one run holds no window twice, so windows need a look only where a
    # fingerprint has several different runs. The aggregate reads all columns, as the join does, to share its exchange.
    firsts = firsts.select("fp", *KEY, "start", "n").repartition(index.buckets, "fp")
    run = F.struct(*KEY, "start", "n")
    several = firsts.groupBy("fp").agg(F.min(run).alias("lo"), F.max(run).alias("hi")).where("lo <> hi").select("fp")
    firsts = packed_runs(firsts.join(several.hint("merge"), "fp", "left_semi"))
    single = base.join(firsts.hint("merge"), KEY).mapInArrow(t.released(_window_hashes(window)), "h bigint, _id bigint, _th bigint, start int")
    again = split_first(single)[1].withColumn("n", F.lit(1))
    # The test of fp always holds; it keeps this branch's exchanges equal to those of ``firsts``.
    gone = later.where("fp is not null").drop("fp").unionByName(again)
    schema = StructType.fromDDL("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    if whole:
        schema = schema.add("row", base.schema["row"].dataType)
    return base.join(packed_runs(gone).hint("merge"), KEY, "left").mapInArrow(t.released(_removed(window)), schema)
