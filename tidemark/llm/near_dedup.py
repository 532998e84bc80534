"""Near-duplicate classes by BagMinHash.

A document is a bag of five-word shingles, its weights their counts. Each shingle has a Poisson process over (time, weight),
split hierarchically into dyadic weight blocks; points below the document's count are dealt to registers, and the earliest
point of each register is the signature, so two registers agree with the weighted Jaccard's probability. Points come in
order of time and stop once they pass the document's latest register. Bands of registers meet in buckets; the first member of each
bucket is verified against the others by exact multiset overlap, and verified links join to classes. Then every remaining
pair of one bucket and different classes is verified: buckets travel as blocks of bounded bytes, in which one sparse product
of shingle incidences gives all overlaps, so that no pair is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text as t
from tidemark.llm._spark import KEY, keyed, small_batches, small_or_shuffled, written

SHINGLE = 5
ROWS, BANDS = 5, 26
WORD = "[^\\x20\\x09-\\x0D]"
CHUNK = 1 << 19
#: Pivots of a bucket in the first extra round, and pairs between classes a bucket row that are verified at once.
PIVOTS, PAIRS_A_ROW = 8, 64
#: Bytes of text in one side of a block and in a shard of blocks; a document counts as LEAST bytes at least, which bounds a
#: block's documents.
SIDE_BYTES, SHARD_BYTES, LEAST = 3 << 20, 6 << 20, 2 << 10
#: Incidences of a dense slice of a block's product, and pairs of a block above which it is used.
SLICE, DENSE_PAIRS = 1 << 19, 256


def bag(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, distinct shingle hashes and counts, sorted by document. A text of one to four words is one shingle."""
    s, e, woff = t.words(b, off)
    u = t.word_hashes(b, s, e)
    at = t.windows_ok(woff, SHINGLE)
    short = np.flatnonzero((np.diff(woff) > 0) & (np.diff(woff) < SHINGLE))
    h = np.concatenate([t.span_hash(u, at, at + SHINGLE), t.span_hash(u, woff[short], woff[short + 1])])
    doc = np.concatenate([np.searchsorted(woff, at, "right") - 1, short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(doc)))


def bagminhash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, docs: int, m: int = ROWS * BANDS) -> np.ndarray:
    """(docs, m) signatures of integer-weighted sets; a document without elements has zeros."""
    # Dyadic blocks of weight: (0, 1], (1, 2], (2, 4], ... as far as the count reaches.
    levels = np.where(count > 1, 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 1)
    which = np.repeat(np.arange(len(doc)), levels)
    block = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(block > 0, 2.0 ** (block - 1), 0.0)
    rate = np.where(block > 0, low, 1.0)
    own, cap, seed = doc[which], count[which].astype(float), t.mix(h[which] ^ t.mix(block.astype(np.uint64), 2), 5)
    least, sig = np.full(docs * m, np.inf), np.zeros(docs * m, dtype=np.uint64)
    time, k = np.zeros(len(own)), 0
    unit = 1.0 / (1 << 53)
    while len(own):
        r = t.mix(seed + np.uint64(k * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-(r >> np.uint64(11)).astype(float) * unit) / rate
        weight = low + rate * (t.mix(r, 2) >> np.uint64(11)).astype(float) * unit
        at = own * m + (t.mix(r, 1) % np.uint64(m)).astype(np.int64)
        hit = np.flatnonzero((weight <= cap) & (time < least[at]))
        hit = hit[np.argsort(-time[hit], kind="stable")]  # the earliest is written last
        least[at[hit]], sig[at[hit]] = time[hit], r[hit]
        live = time < least.reshape(docs, m).max(axis=1)[own]
        own, cap, seed, time, low, rate = own[live], cap[live], seed[live], time[live], low[live], rate[live]
        k += 1
    return sig.reshape(docs, m)


def _signatures(batches):
    for batch in batches:
        for a, z, b, off in t.chunks(batch.column("text"), CHUNK):
            doc, h, c = bag(b, off)
            sig = bagminhash(doc, h, c, z - a)
            has = np.unique(doc)
            if not len(has):
                continue
            key = np.zeros((len(has), BANDS), dtype=np.uint64)
            for r in range(ROWS):
                key = t.mix(key ^ sig[has, r::ROWS], r)
            key = t.mix(key + np.arange(BANDS, dtype=np.uint64), 9)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.asarray(batch.column(n))[a:z][has]) for n in KEY), pa.array(np.diff(off)[has].astype(np.int32)), pa.ListArray.from_arrays(np.arange(len(has) + 1, dtype=np.int32) * BANDS, pa.array(t.as_i64(key.ravel())))], names=[*KEY, "size", "bands"]
            )


def _elements(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle occurrences of each row as distinct elements (shingle, how often before), and the rows' offsets: the overlap of
    two bags is the number of equal elements."""
    parts, sizes = [], []
    for a, z, b, off in t.chunks(column, t.SMALL_BYTES):
        doc, h, c = bag(b, off)
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        parts.append(t.mix(np.repeat(h, c) + t.mix(k.astype(np.uint64), 4)))
        sizes.append(np.bincount(np.repeat(doc, c), minlength=z - a))
    n = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.concatenate(([0], np.cumsum(n)))


def _take(e: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of the rows, one row after the other, and the index into ``rows`` of each."""
    n = off[rows + 1] - off[rows]
    own = np.repeat(np.arange(len(rows)), n)
    return e[np.arange(len(own)) + np.repeat(off[rows] - (np.cumsum(n) - n), n)], own


def _shared_of_pairs(e: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal elements of the rows x[i] and y[i]."""
    out = np.zeros(len(x), dtype=np.int64)
    cost = np.cumsum(off[x + 1] - off[x] + off[y + 1] - off[y])
    for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(cost // SLICE)) + 1):
        (ex, ox), (ey, oy) = _take(e, off, x[part]), _take(e, off, y[part])
        kx, ky = (t.mix(v ^ t.mix(o.astype(np.uint64), 3)) for v, o in ((ex, ox), (ey, oy)))
        _, at, _ = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
        out[part] = np.bincount(ox[at], minlength=len(part))
    return out


def _shared_of_block(e: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(x, y) matrix of equal elements: rare elements by their pairs of rows, common ones by dense slices."""
    (ex, ox), (ey, oy) = _take(e, off, x), _take(e, off, y)
    kinds, at = np.unique(np.concatenate([ex, ey]), return_inverse=True)
    ax, ay = at[: len(ex)], at[len(ex) :]
    fx, fy = np.bincount(ax, minlength=len(kinds)), np.bincount(ay, minlength=len(kinds))
    out = np.zeros(len(x) * len(y))
    rare = (fx > 0) & (fy > 0) & (fx * fy <= max(4, len(out) // 64))
    order_x, order_y = np.argsort(ax, kind="stable"), np.argsort(ay, kind="stable")
    first_x, first_y = np.cumsum(fx) - fx, np.cumsum(fy) - fy
    which = np.flatnonzero(rare)
    for part in np.split(which, np.flatnonzero(np.diff(np.cumsum((fx * fy)[which]) // SLICE)) + 1):
        n = (fx * fy)[part]
        own = np.repeat(part, n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        i, j = ox[order_x[first_x[own] + k // fy[own]]], oy[order_y[first_y[own] + k % fy[own]]]
        out += np.bincount(i * len(y) + j, minlength=len(out))
    out = out.reshape(len(x), len(y))
    dense = np.flatnonzero((fx > 0) & (fy > 0) & ~rare)
    step = max(1, SLICE // (len(x) + len(y)))
    column = np.full(len(kinds), -1)
    for a in range(0, len(dense), step):
        part = dense[a : a + step]
        column[part] = np.arange(len(part))
        mx, my = np.zeros((len(x), len(part)), dtype=np.float32), np.zeros((len(y), len(part)), dtype=np.float32)
        for m, own, kind in ((mx, ox, ax), (my, oy, ay)):
            ok = column[kind] >= 0
            m[own[ok], column[kind[ok]]] = 1
        out += mx @ my.T
        column[part] = -1
    return out


def _nodes(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct key, in the keys' order, and each row's place among them."""
    order = np.lexsort((other, own))
    new = np.append(True, (own[order][1:] != own[order][:-1]) | (other[order][1:] != other[order][:-1]))[: len(own)]
    node = np.empty(len(own), dtype=np.int64)
    node[order] = np.cumsum(new) - 1
    return order[new], node


def _first_reached(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links (x[i], y[i])."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(threshold: float):
    """One shard of blocks -> links between a left and a right row of one block and different classes, reduced to one link of
    each document to the first that it reaches here: as many rows as documents, and the same classes."""

    def run(table: pa.Table) -> pa.Table:
        links = of_shard(table)
        t.release()
        return links

    def of_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("g", "i", "j", *KEY)])
        e, off = _elements(table.column("text"))
        n = np.diff(off)
        g, i, j, left, right, own, other, cls, clsh = (np.asarray(table.column(c)) for c in ("g", "i", "j", "left", "right", *KEY, "c_id", "c_th"))
        cut = np.flatnonzero((np.diff(g) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        a, b, pairs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(g)]):
            x, y = lo + np.flatnonzero(left[lo:hi]), lo + np.flatnonzero(right[lo:hi])
            apart = (cls[x][:, None] != cls[y]) | (clsh[x][:, None] != clsh[y])
            if len(x) * len(y) > DENSE_PAIRS and len(x) > 1:
                shared = _shared_of_block(e, off, x, y)
                hit = np.nonzero(apart & (shared / np.maximum(n[x][:, None] + n[y] - shared, 1) >= threshold))
                a.append(x[hit[0]]), b.append(y[hit[1]])
            else:
                hit = np.nonzero(apart)
                pairs.append((x[hit[0]], y[hit[1]]))
        if pairs:
            x, y = (np.concatenate(p) for p in zip(*pairs))
            shared = _shared_of_pairs(e, off, x, y)
            ok = shared / np.maximum(n[x] + n[y] - shared, 1) >= threshold
            a.append(x[ok]), b.append(y[ok])
        row, node = _nodes(own, other)
        to = _first_reached(node[np.concatenate(a)], node[np.concatenate(b)], len(row))
        x = np.flatnonzero(to != np.arange(len(row)))
        a, b = row[x], row[to[x]]
        return pa.table({"a_id": own[a], "a_th": other[a], "b_id": own[b], "b_th": other[b]})

    return run


def links_of(groups: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of at least ``threshold`` between the chosen members and all members of each group, for different classes.

    ``groups`` has rows (g, v, c, chosen, size). A group of more than SIDE_BYTES is dealt to blocks: each slice of its chosen
    members meets each slice of all members in a block of its own. Blocks are packed to shards of about SHARD_BYTES."""
    weight = F.greatest(F.col("size"), F.lit(LEAST)).cast("bigint")
    sums = groups.groupBy("g").agg(F.sum(weight).alias("s"), F.sum(F.when(F.col("chosen"), weight).otherwise(0)).alias("o"))
    parts = lambda c: F.greatest(F.ceil(F.col(c) / SIDE_BYTES), F.lit(1)).cast("int")
    rows = groups.join(sums.select("g", parts("s").alias("ka"), parts("o").alias("ko")), "g")
    rows = rows.withColumns({"i": F.pmod(F.xxhash64("v"), F.col("ko")).cast("int"), "j": F.pmod(F.xxhash64("v"), F.col("ka")).cast("int")})
    as_left = F.expr("IF(chosen, transform(sequence(0, ka - 1), x -> struct(i AS i, x AS j, true AS left, x = j AS right)), array())")
    as_right = F.expr("transform(filter(sequence(0, ko - 1), x -> NOT chosen OR x <> i), x -> struct(x AS i, j AS j, false AS left, true AS right))")
    rows = rows.select("g", "v", "c", "size", F.explode(F.concat(as_left, as_right)).alias("b")).select("g", "v", "c", "size", "b.*")
    rows = written(rows, "blocks")
    shards = 1 + (rows.agg(F.sum(weight)).first()[0] or 0) // SHARD_BYTES
    shard = F.pmod(F.xxhash64("g", "i", "j"), F.lit(shards)).alias("shard")
    placed = rows.select(shard, "g", "i", "j", "left", "right", "v", F.col("c._id").alias("c_id"), F.col("c._th").alias("c_th")).join(texts, "v")
    placed = placed.select("shard", "g", "i", "j", "left", "right", "v.*", "c_id", "c_th", "text")
    links = placed.groupBy("shard").applyInArrow(_linked(threshold), "a_id bigint, a_th bigint, b_id bigint, b_th bigint")
    end = lambda x: F.struct(F.col(f"{x}_id").alias("_id"), F.col(f"{x}_th").alias("_th"))
    return links.select(F.greatest(end("a"), end("b")).alias("a"), F.least(end("a"), end("b")).alias("b")).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components by alternating large and small stars: (v, root), root the smallest member. ``links`` has
    columns a and b of one ordered type. Every round is written; only its change count reaches the driver."""
    ordered = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = written(links.where("a <> b").select(*ordered("a", "b")).distinct(), name)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = written(small, name)
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def mixed_buckets(bands: DataFrame, root: DataFrame) -> DataFrame:
    """Rows (g, v, size, c, n, big) of the buckets that hold several classes: member, its class, size and largest class of the bucket."""
    own = bands.join(root, "v", "left").select(F.col("band").alias("g"), "v", "size", F.coalesce("root", "v").alias("c"))
    sizes = own.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"))
    several = sizes.groupBy("g").agg(F.sum("k").alias("n"), F.max(F.struct("k", "c")).alias("m"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    return own.join(several.select("g", "n", F.col("m.c").alias("big")), "g")


def between_classes(bands: DataFrame, root: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``root`` after every pair of one bucket and different classes has been verified, so no link is lost to the choice of
    pivots. Where that is many pairs, rounds with ever more pivots a bucket join classes first; the last one takes every member
    outside its bucket's largest class against all members. Only counts reach the driver."""
    rows, pivots, last = bands.count(), PIVOTS, False
    while not last:
        mixed = written(mixed_buckets(bands, root), "mixed")
        left, most = mixed.agg(F.sum(F.expr("if(c <> big, n, 0)")), F.max("n")).first()
        if not left:
            break
        last = left <= PAIRS_A_ROW * rows or pivots >= most
        chosen = F.expr("c <> big") if last else F.pmod(F.xxhash64("v", "g", F.lit(pivots)), F.col("n")) < pivots
        links = links_of(mixed.select("g", "v", "c", chosen.alias("chosen"), "size"), texts, threshold)
        root = components(root.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(links))
        pivots *= 4
    return root


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row a document: doc_id, _id, _th, class_id (smallest doc_id of its class) and kept (it is its class's first).

    Exact copies share a class. Different texts link at a weighted Jaccard of five-word shingles of ``threshold`` or more.
    Null texts and texts without a word (nothing but blanks) are classes of their own; equal texts of one to four words are copies. Rows equal in id and text share a row
    of the result; an empty table gives no rows; other columns are ignored.
    """
    base = keyed(docs)
    node = F.struct(*KEY)
    # Copies: the digest's smallest key stands for all; the minimum is combined before the exchange.
    digest = F.when(F.col("text").rlike(WORD), F.md5(F.col("text").cast("binary")))
    rows = base.select(*KEY, F.coalesce(digest, F.concat(F.lit("-"), F.concat_ws(":", *KEY))).alias("d")).distinct()
    first = rows.groupBy("d").agg(F.min(node).alias("rep"))
    member = written(rows.join(first, "d").select(node.alias("v"), "rep"), "copies")
    reps = member.where("v = rep").select("v._id", "v._th")
    bands = base.select(*KEY, "text").mapInArrow(t.released(_signatures), "_id bigint, _th bigint, size int, bands array<bigint>")
    with small_batches(docs.sparkSession):
        bands = written(bands.join(reps, KEY, "left_semi").select(node.alias("v"), "size", F.explode("bands").alias("band")).distinct(), "bands")
    # First round: the first member of each bucket against the others, grouped by that pivot, so a text travels once a pivot.
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("p")).where("n > 1").select("band", "p")
    met = bands.join(buckets, "band").select("p", "v", "size").distinct()
    groups = written(met.select(F.xxhash64("p").alias("g"), "v", F.col("v").alias("c"), (F.col("v") == F.col("p")).alias("chosen"), "size"), "groups")
    wanted = written(groups.select("v.*").distinct(), "candidates")
    texts = base.join(small_or_shuffled(wanted), KEY).select(node.alias("v"), "text")
    texts = written(texts if base.schema["_th"].metadata["unique"] else texts.dropDuplicates(["v"]), "texts")
    root = components(links_of(groups, texts, threshold))
    root = between_classes(bands, root, texts, threshold)
    out = member.join(root.select(F.col("v").alias("rep"), "root"), "rep", "left").select("v", F.coalesce("root", "rep").alias("root"))
    class_id = F.when(F.col("root._id") != -(2**63), F.col("root._id"))
    doc_id = F.when(F.col("v._id") != -(2**63), F.col("v._id"))
    return out.select(doc_id.alias("doc_id"), "v._id", "v._th", class_id.alias("class_id"), (F.col("v") == F.col("root")).alias("kept"))


def first_of_class(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents, with all columns, that are the first of their class; of rows equal in id and text one stays."""
    kept = written(near_classes(docs, threshold).where("kept").select(*KEY), "kept-documents")
    rows = keyed(docs, whole=True).join(kept, KEY, "left_semi")
    return (rows if rows.schema["_th"].metadata["unique"] else rows.dropDuplicates(KEY)).select("row.*")
