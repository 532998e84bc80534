"""Exact byte-substring dedup with suffix arrays built in shards.

Windows of ``length`` bytes are cut into runs by content-chosen anchors (see ``_text.spans``), so equal windows have equal
anchors. A run that occurs twice as a whole is repeated throughout. Runs that share only their anchor with another run go to the
shard of that anchor: there a suffix array by induced sorting and permuted common prefixes tell which windows repeat.
No text is compared across shards because equal windows are always in one shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _text as t
from tidemark.llm._spark import KEY, keyed
from tidemark.llm.substring_dedup import _lists, expand, packed_runs, shared_mask
from tidemark.llm.suffix_array import repeated_starts

GRAM = 64
#: Bytes of input text for each shard.
SHARD_BYTES = 1 << 20
#: Runs of one anchor above which its shard would be large: their windows are matched by hash, each in its own group.
HOT_RUNS = 2000


def _cut(b, off, length):
    return t.spans(t.byte_units(b), off, length, GRAM)


#: States of a row that is exchanged by a hash: seen once in its chunk, the first of several there, a further one. Only the
#: first of several carries the hash; the others already know that it recurs and are dealt evenly, so no hash makes a hot task.
ONCE, LEAD, FURTHER = 0, 1, 2


def thinned(h: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exchange keys and states of a chunk's rows by their hashes; ``again`` marks rows that recur for another reason."""
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])[: len(h)]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    state = np.empty(len(h), dtype=np.int8)
    state[order] = np.where(np.repeat(size, size) > 1, np.where(new, LEAD, FURTHER), ONCE)
    state[again & (state == ONCE)] = LEAD
    spread = t.mix(h + np.arange(len(h), dtype=np.uint64), 21)
    return np.where(state == FURTHER, spread, h), state


def _fingerprints(length: int):
    def run(batches):
        for batch in batches:
            ids, ths = (np.asarray(batch.column(c)) for c in KEY)
            for a, z, b, off in t.chunks(batch.column("text")):
                doc, _, _, h = _cut(b, off, length)
                if not len(doc):
                    continue
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(doc))) > 1
                key, state = thinned(h[first], many)
                own = doc[first]
                yield pa.RecordBatch.from_arrays([pa.array(t.as_i64(key)), pa.array(t.as_i64(h[first])), pa.array(ids[a:z][own]), pa.array(ths[a:z][own]), pa.array(state)], names=["k", "fp", *KEY, "state"])

    return run


def _shared_runs(length: int):
    def run(batches):
        for batch in batches:
            ids, ths = (np.asarray(batch.column(c)) for c in KEY)
            for a, z, b, off in t.chunks(batch.column("text")):
                doc, start, n, fp = _cut(b, off, length)
                keep = shared_mask(doc, fp, *_lists(batch, "fps", a, z))
                doc, start, n, fp = doc[keep], start[keep], n[keep], fp[keep]
                if not len(doc):
                    continue
                key, state = thinned(t.span_hash(b, start, start + n + length - 1), np.zeros(len(doc), dtype=bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.as_i64(key)), pa.array(t.as_i64(fp)), pa.array(ids[a:z][doc]), pa.array(ths[a:z][doc]), pa.array((start - off[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(state)],
                    names=["h", "fp", *KEY, "start", "n", "state"],
                )

    return run


#: Flag of a run that occurs once as a whole.
SINGLE = 1 << 30


def _own_runs(batch, a: int, z: int, off: np.ndarray):
    """Document, start, windows and flag of the runs listed with a chunk's documents."""
    flat, loff = _lists(batch, "runs", a, z)
    doc = np.repeat(np.arange(z - a), np.diff(loff))
    flags = flat & 0xFFFFFFFF
    return doc, (flat >> 32) + off[doc] if len(flat) else flat, flags & (SINGLE - 1), (flags & SINGLE) > 0


def _pieces(length: int, shards: int):
    """(key, text, runs) -> the text of each run for the shard of its anchor."""

    def run(batches):
        for batch in batches:
            ids, ths = (np.asarray(batch.column(c)) for c in KEY)
            for a, z, b, off in t.chunks(batch.column("text")):
                doc, start, n, single = _own_runs(batch, a, z, off)
                if not len(doc):
                    continue
                _, ss, _, fp = _cut(b, off, length)
                shard = (t.mix(fp[np.searchsorted(ss, start)], 8) % np.uint64(shards)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(ids[a:z][doc]), pa.array(ths[a:z][doc]), pa.array((start - off[doc]).astype(np.int32)), pa.array(single), pa.array([b[s:e].tobytes() for s, e in zip(start, start + n + length - 1)], type=pa.binary())],
                    names=["shard", *KEY, "start", "single", "piece"],
                )

    return run


def _windows(length: int):
    """(key, text, runs) -> the hash of each window of the runs of crowded anchors."""

    def run(batches):
        for batch in batches:
            ids, ths = (np.asarray(batch.column(c)) for c in KEY)
            for a, z, b, off in t.chunks(batch.column("text")):
                doc, start, n, single = _own_runs(batch, a, z, off)
                if not len(doc):
                    continue
                w, who = expand(start, n), np.repeat(doc, n)
                h = t.span_hash(b, w, w + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.as_i64(h)), pa.array(ids[a:z][who]), pa.array(ths[a:z][who]), pa.array((w - off[who]).astype(np.int32)), pa.array(np.repeat(single, n))], names=["w", *KEY, "start", "single"]
                )

    return run


def _shard(length: int):
    """One shard's pieces -> ranges of repeated windows of the pieces that occur once."""

    def run(table: pa.Table) -> pa.Table:
        pieces, single = table.column("piece").to_pylist(), np.asarray(table.column("single"))
        ids, ths, start = (np.asarray(table.column(c)) for c in (*KEY, "start"))
        at, first, count = [], [], []
        if single.any() and len(pieces) > 1:
            for i, o in enumerate(repeated_starts(pieces, length)):
                if single[i] and len(o):
                    s, e = t.merge_ranges(o, o + 1)
                    at.append(np.full(len(s), i)), first.append(s), count.append(e - s)
        at, first, count = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (at, first, count))
        at = at.astype(np.int64)
        return pa.table({"_id": pa.array(ids[at], pa.int64()), "_th": pa.array(ths[at], pa.int64()), "start": pa.array((start[at] + first).astype(np.int32)), "n": pa.array(count.astype(np.int32))})

    return run


def _removed(length: int):
    """(doc_id, text, runs) -> sizes, removed bytes and maximal runs, digest, and the kept bytes where some went."""

    def run(batches):
        for batch in batches:
            for a, z, b, off in t.chunks(batch.column("text")):
                flat, loff = _lists(batch, "runs", a, z)
                raw, rows = b.tobytes(), []
                for i in range(z - a):
                    own = flat[loff[i] : loff[i + 1]]
                    lo, hi = int(off[i]), int(off[i + 1])
                    s, e = t.merge_ranges(own >> 32, (own >> 32) + (own & 0xFFFFFFFF) + length - 1)
                    if len(s):
                        edges = [lo, *np.stack([s, e], axis=1).ravel().tolist(), hi - lo]
                        edges = [lo, *[lo + x for x in edges[1:]]]
                        kept = b"".join(raw[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
                    else:
                        kept = raw[lo:hi]
                    rows.append((hi - lo, int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept if len(s) else None))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, z - a), *(pa.array(c, type=k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def suffix_dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts anywhere else, same document included.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (bytes; null where nothing
    went, since a cut may fall inside a character). Null text is empty; an empty table gives no rows; rows equal in id and
    text count once and each gets the result; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    every = keyed(docs)
    base = every if every.schema["_th"].metadata["unique"] else every.dropDuplicates(KEY)
    # Each exchange below is named, and its readers (an aggregate and a join) share it and the pass over the text under it: the
    # join takes the aggregate's columns under new names, and conditions that always hold make both read every column and state
    # that none is null. (A semi-join would be pushed below the exchange; an inner one against unique keys is not.)
    fps = base.select(*KEY, "text").mapInArrow(_fingerprints(length), "k bigint, fp bigint, _id bigint, _th bigint, state tinyint").where("k is not null and fp is not null and state is not null and _id is not null and _th is not null").repartition(parts, "k")
    seen = fps.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("state").alias("s"), F.max("fp").alias("f"), F.max("_id").alias("i"), F.max("_th").alias("t"))
    shared = seen.where(f"c > 1 or s >= {LEAD}").where("i is not null and t is not null").select(F.col("k").alias("k2"), "s", "f")
    alike = (F.col("k") == F.col("k2")) & (F.col("fp") - F.col("f") == 0) & (F.col("state") - F.col("s") <= 0)
    lists = fps.join(shared.hint("merge"), alike).groupBy(*KEY).agg(F.collect_set("fp").alias("fps"))
    runs = base.join(lists.hint("merge"), KEY).mapInArrow(_shared_runs(length), "h bigint, fp bigint, _id bigint, _th bigint, start int, n int, state tinyint").where("h is not null and fp is not null and state is not null and _id is not null and _th is not null").repartition(parts, "h")
    variants = runs.groupBy("h").agg(F.min("fp").alias("f"), F.min(F.struct(*KEY, "start", "n")).alias("lo"), F.count(F.lit(1)).alias("c"), F.max("state").alias("s"))
    several = F.expr(f"c > 1 or s >= {LEAD}")
    alike = (F.col("h") == F.col("h2")) & (F.col("fp") - F.col("f") == 0) & (F.col("state") - F.col("s") <= 0)
    whole = runs.join(variants.where(several).where("lo is not null").select(F.col("h").alias("h2"), "f", "s").hint("merge"), alike).select(*KEY, "start", "n")
    # Runs whose anchor has another run: partly repeated, perhaps.
    crowd = variants.where(f"s < {FURTHER}").withColumn("runs", F.count(F.lit(1)).over(Window.partitionBy("f"))).where("runs > 1")
    wanted = crowd.select("lo._id", "lo._th", "lo.start", (F.col("lo.n") + F.when(several, 0).otherwise(SINGLE)).alias("n"), "runs")
    few, many = (packed_runs(wanted.where(c)).hint("merge") for c in (f"runs <= {HOT_RUNS}", f"runs > {HOT_RUNS}"))
    pieces = base.join(few, KEY).mapInArrow(_pieces(length, 1 + size // SHARD_BYTES), "shard bigint, _id bigint, _th bigint, start int, single boolean, piece binary")
    found = pieces.groupBy("shard").applyInArrow(_shard(length), "_id bigint, _th bigint, start int, n int")
    windows = base.join(many, KEY).mapInArrow(_windows(length), "w bigint, _id bigint, _th bigint, start int, single boolean")
    twice = windows.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("w").alias("w2"))
    hashed = windows.where("single").join(twice.hint("merge"), F.col("w") == F.col("w2"), "left_semi").select(*KEY, "start", F.lit(1).alias("n"))
    gone = whole.unionByName(found).unionByName(hashed)
    return every.join(packed_runs(gone).hint("merge"), KEY, "left").mapInArrow(_removed(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
