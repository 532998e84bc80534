"""Language-model scoring by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights that depend on the frequency bucket of the context. The weights
are learned by expectation-maximisation on deleted counts: each training token is left out of its own counts.

Text is dealt to blocks of bounded size. A block sends its distinct n-grams, sorted and packed by hash range, each with one count; the
ranges add the counts of all blocks and send each block its totals in its own order. So no vocabulary is broadcast or
collected, and a frequent n-gram costs one entry a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text as t
from tidemark.llm._spark import held_out

BLOCK_BYTES = 12 << 20
END, START = np.uint64(0x5DEECE66D5A5A5A5 | 1), np.uint64(0x2545F4914F6CDD1D | 1)
#: Log-ratio bins of the expectation-maximisation: steps of 1/8 of a factor of two.
STEP = 8
EMPTY = -(10**6)


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, so that sorted keys and small counts compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def _pack_counts(x: np.ndarray) -> bytes:
    """Non-negative counts in the narrowest unsigned type that holds them, after a byte with its size."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + _pack(x.astype(kind))


def _unpack_counts(raw: bytes) -> np.ndarray:
    return _unpack(raw[1:], f"u{raw[0]}").astype(np.int64)


class _Block:
    """Tokens of a block's documents and its sorted distinct keys: unigrams have the lowest bit set, bigrams not."""

    def __init__(self, table: pa.Table, lower: bool):
        tokens, sizes = [], []
        for a, z, b, off in t.chunks(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())):
            if lower:
                b = t.LOWER[b]
            s, e, woff = t.words(b, off)
            w = t.mix(t.word_hashes(b, s, e), 11) | np.uint64(1)
            tokens.append(np.insert(w, woff[1:], END))
            sizes.append(np.diff(woff) + 1)
        self.n = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        self.w = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.uint64)
        self.off = np.concatenate(([0], np.cumsum(self.n)))
        self.train = ~np.asarray(table.column("held_out")).astype(bool)
        self.token_train = np.repeat(self.train, self.n)
        prev = np.empty_like(self.w)
        prev[1:] = self.w[:-1]
        prev[self.off[:-1]] = START
        pair = t.mix(prev * np.uint64(0x9E3779B97F4A7C15) + self.w, 12) & ~np.uint64(1)
        every = np.concatenate([self.w, pair, np.full(len(self.n), START)])
        del prev, pair, tokens
        order = np.argsort(every)
        every = every[order]
        new = np.ones(len(every), dtype=bool)
        new[1:] = every[1:] != every[:-1]
        self.keys, first = every[new], np.flatnonzero(new)
        del every
        self.at = np.empty(len(new), dtype=np.int32 if len(new) < 1 << 31 else np.int64)
        self.at[order] = np.cumsum(new, dtype=self.at.dtype) - 1
        trained = np.concatenate([self.token_train, self.token_train, self.train])[order]
        self.count = np.add.reduceat(trained, first, dtype=np.int64) if len(first) else np.zeros(0, dtype=np.int64)

    def totals(self, rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corpus counts of each token, of its bigram and of its context."""
        total = np.concatenate([_unpack_counts(x) for _, x in sorted(rows)]) if rows else np.zeros(0, dtype=np.int64)
        m = len(self.w)
        c = total[self.at[:m]]
        context = np.empty_like(c)
        context[1:] = c[:-1]
        context[self.off[:-1]] = total[self.at[2 * m :]]
        return c, total[self.at[m : 2 * m]], context


def _send(ranges: int, lower: bool):
    shift = np.uint64(64 - int(math.log2(ranges)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = _Block(table, lower)
        part = (x.keys >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(x.keys), dtype=np.int64)
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, dtype=np.int64)
        end = np.append(cut[1:], len(part))
        number = part[cut]
        if not len(number) or number[0]:
            # Every block has a row of range 0, which carries the model to it.
            number, cut, end = (np.append(0, y).astype(np.int64) for y in (number, cut, end[: len(cut)]))
        return pa.table({
            "part": pa.array(number, pa.int64()), "block": pa.array([key[0].as_py()] * len(cut), pa.int64()),
            "keys": pa.array([_pack(x.keys[a:z]) for a, z in zip(cut, end)], pa.binary()), "counts": pa.array([_pack_counts(x.count[a:z]) for a, z in zip(cut, end)], pa.binary()),
        })

    return run


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One hash range: totals for each block in its order, and the range's tokens and distinct words (block -1)."""
    keys = [_unpack(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([_unpack_counts(x) for x in table.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    word = ((distinct & np.uint64(1)) == 1) & (distinct != START)
    cut = np.cumsum([0, *[len(k) for k in keys]])
    n = len(keys)
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "part": pa.array([key[0].as_py()] * (n + 1), pa.int64()),
        "totals": pa.array([*[_pack_counts(total[at[a:z]]) for a, z in zip(cut, cut[1:])], None], pa.binary()),
        "tokens": pa.array([None] * n + [int(total[word].sum())], pa.int64()), "kinds": pa.array([None] * n + [int((total[word] > 0).sum())], pa.int64()),
    })


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(context, 1))).astype(np.int64)


def _deleted(left: pa.Table, right: pa.Table, lower: bool) -> pa.Table:
    """Binned deleted ratios of a block's training tokens: context bucket, log2 of bigram over unigram estimate (less the
    corpus size), log2 of the unigram count."""
    if not left.num_rows:
        return pa.table({k: pa.array([], pa.int64()) for k in ("bucket", "a", "b", "c")})
    x = _Block(left, lower)
    c, pair, context = (y[x.token_train].astype(float) for y in x.totals(list(zip(right.column("part").to_pylist(), right.column("totals").to_pylist()))))
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.log2((pair - 1) / ((context - 1) * (c - 1)))
        b = np.log2(c - 1)
    # The three are packed into one integer, 21 bits for each ratio, so that one plain sort counts the bins.
    bins = _bucket(context)
    for ratio, known in ((a, pair > 1), (b, c > 1)):
        bins = (bins << 21) + (np.where(known, np.round(STEP * ratio), EMPTY).astype(np.int64) + (1 << 20))
    rows, n = np.unique(bins, return_counts=True)
    low = (1 << 21) - 1
    return pa.table({"bucket": rows >> 42, "a": ((rows >> 21) & low) - (1 << 20), "b": (rows & low) - (1 << 20), "c": n.astype(np.int64)})


def learn_weights(bucket: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: int, v: int, rounds: int = 30, buckets: int = 48) -> np.ndarray:
    """(buckets, 3) weights of bigram, unigram and uniform estimates by expectation-maximisation over the bins."""
    uniform = 1.0 / (v + 1)
    p1 = np.where(b > EMPTY, 2.0 ** (b / STEP) / max(1, n - 1), 0.0)
    p2 = np.where(a > EMPTY, np.minimum(1.0, 2.0 ** (a / STEP + b / STEP)), 0.0)
    p = np.stack([p2, p1, np.full(len(a), uniform)], axis=1)
    weight = np.full((buckets, 3), 1 / 3)
    for _ in range(rounds):
        share = weight[bucket] * p
        share *= (c / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, weights=share[:, i], minlength=buckets) for i in range(3)], axis=1) + 1e-3
        weight = new / new.sum(axis=1, keepdims=True)
    return weight


def _model(table: pa.Table) -> pa.Table:
    """All bins and the corpus sizes -> the model as one row: tokens, distinct tokens, weights."""
    bucket, a, b, c = (np.asarray(table.column(k)) for k in ("bucket", "a", "b", "c"))
    n, v = (int(c[bucket == k].sum()) for k in (-1, -2))
    real = bucket >= 0
    weight = learn_weights(bucket[real], a[real].astype(float), b[real].astype(float), c[real].astype(float), n, v)
    return pa.table({"model": pa.array([np.array([n, v], dtype=np.int64).tobytes() + weight.tobytes()], pa.binary())})


_OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(left: pa.Table, right: pa.Table, lower: bool) -> pa.Table:
    if not left.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")}, **{k: pa.array([], pa.float64()) for k in ("base_score", "score")}})
    model = right.column("model").drop_null()[0].as_py()
    n, v = (int(y) for y in np.frombuffer(model[:16], dtype=np.int64))
    weight = np.frombuffer(model[16:], dtype=np.float64).reshape(-1, 3)
    x = _Block(left, lower)
    c, pair, context = x.totals(list(zip(right.column("part").to_pylist(), right.column("totals").to_pylist())))
    base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    w = weight[_bucket(context)]
    known = context > 0
    # An unseen context has no bigram estimate: the other two share its weight.
    top = np.where(known, w[:, 0], 0.0)
    rest = np.where(known, 1.0, 1 / (w[:, 1] + w[:, 2]))
    p = top * pair / np.maximum(context, 1) + rest * (w[:, 1] * c / max(1, n) + w[:, 2] / (v + 1))
    add = lambda y: np.add.reduceat(y, x.off[:-1])
    return pa.table({
        "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": x.n.astype(np.int64), "n_known": add((c > 0).astype(np.int64)),
        "train_tokens": np.full(len(x.n), n, dtype=np.int64), "base_score": add(base), "score": add(np.log10(p)),
    })


def lm_scores(docs: DataFrame, mod: int = 10, rest: int = 0, lower: bool = False) -> DataFrame:
    """Score every whole text by the model learned from documents outside the held-out part.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score and score (log10). Null text is empty;
    a null id is hashed as empty text; rows stay one to one; an empty table gives no rows; other columns are ignored.
    With ``lower``, words that differ only in the case of A-Z are one token; without, they are different tokens.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    ranges = 1 << max(0, (blocks - 1).bit_length())
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(mod, rest).alias("held_out"), block.alias("block"))
    sent = rows.groupBy("block").applyInArrow(_send(ranges, lower), "part bigint, block bigint, keys binary, counts binary")
    schema = "block bigint, part bigint, totals binary, tokens bigint, kinds bigint"
    added = sent.groupBy("part").applyInArrow(_add, schema).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    bins = rows.groupBy("block").cogroup(added.where("block >= 0").groupBy("block")).applyInArrow(lambda left, right: _deleted(left, right, lower), "bucket bigint, a bigint, b bigint, c bigint")
    bins = bins.groupBy("bucket", "a", "b").agg(F.sum("c").alias("c"))
    size_of = lambda k, c: added.where("block < 0").agg(F.coalesce(F.sum(c), F.lit(0)).alias("c")).select(F.lit(k).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "c")
    # The bins are bounded by their steps, whatever the corpus: one task can learn from them. The model is one value of 1 kB.
    every = bins.unionByName(size_of(-1, "tokens")).unionByName(size_of(-2, "kinds"))
    model = every.groupBy(F.lit(0).alias("one")).applyInArrow(_model, "model binary")
    given = added.where("block >= 0").select("*", F.when(F.col("part") == 0, model.scalar()).alias("model"))
    return rows.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(lambda left, right: _score(left, right, lower), _OUT)
