"""Quality classifier: supervised subword embeddings.

Hashed word, word-pair and character n-gram vectors are averaged over a document and passed to a softmax; vectors and output
are learned by stochastic gradient descent in numpy. Scoring needs one number for each bucket, the vector's product with the
output, so a whole text is scored by gathers and sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import _text as t
from tidemark.llm._spark import held_out, small_batches

BUCKETS = 1 << 16
GRAMS = (3, 4)
#: Bound of the training sample: labelled rows. A row's bag has at most BUCKETS entries, whatever the length of its text.
SAMPLE_ROWS = 3000


def features(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all features of a chunk's documents, document by document, and the documents' offsets."""
    n, ids, owner = len(off) - 1, [], []
    s, e, woff = t.words(b, off)
    wh = t.word_hashes(b, s, e)
    doc = np.repeat(np.arange(n), np.diff(woff))
    ids.append(wh), owner.append(doc)
    if len(wh) > 1:
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        # A repeated word is one feature, whatever the word.
        ids.append(np.where(wh[pair] == wh[pair + 1], np.uint64(1), t.mix(wh[pair] * np.uint64(3) + wh[pair + 1]))), owner.append(doc[pair])
    u = t.byte_units(b)
    for k in GRAMS:
        at = t.windows_ok(off, k)
        ids.append(t.mix(t.roll_hash(u, at, at + k), k)), owner.append(np.searchsorted(off, at, "right") - 1)
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (ids[order] & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def _bags(batches):
    """(id, label, text) -> distinct buckets and counts, at most BUCKETS of them whatever the text's length."""
    for batch in batches:
        for a, z, b, off in t.chunks(batch.column("text"), t.SMALL_BYTES):
            ids, foff = features(b, off)
            bags = [np.unique(ids[foff[i] : foff[i + 1]], return_counts=True) for i in range(z - a)]
            cut = np.cumsum([0, *[len(x[0]) for x in bags]], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([x[k] for x in bags]).astype(np.int32))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), batch.column("y").slice(a, z - a), *lists], names=["doc_id", "y", "ids", "counts"])


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # one number a bucket: vector . (output of class 1 - output of class 0)
    bias: float

    def scores(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        ids, foff = features(b, off)
        sums = np.concatenate(([0.0], np.cumsum(self.weight[ids])))
        n = np.diff(foff)
        return 1 / (1 + np.exp(-np.clip((sums[foff[1:]] - sums[foff[:-1]]) / np.maximum(n, 1) + self.bias, -30, 30)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int = 12, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> Model:
    """SGD over documents in a seeded order. A table without labels gives the neutral model (score 1/2)."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    out, bias = np.zeros((2, dim)), np.zeros(2)
    steps, done = max(1, epochs * len(y)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            lr = rate * (1 - done / steps)
            done += 1
            ids, c = bags[i]
            w = c / max(1, c.sum())
            h = w @ emb[ids] if len(ids) else np.zeros(dim)
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p - np.array([1 - y[i], y[i]])
            back = g @ out
            out -= lr * np.outer(g, h)
            bias -= lr * 0.1 * g
            if len(ids):
                # Steps are scaled by the document's distinct features, so that the mean moves as far for long texts.
                emb[ids] -= lr * np.outer(w * min(len(ids), 400), back)
    return Model((emb @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows: the ``rows`` smallest id hashes among labelled documents outside the held-out
    part. Feature counts stay on the executors."""
    known = labels.where(~held_out(mod, rest) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("_d"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("_d").agg(F.max("y").alias("y"))
    sample = F.broadcast(known.orderBy(F.xxhash64("_d"), "_d").limit(rows))  # bounded by ``rows``
    text = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_d")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "y", "text")
    bags = text.mapInArrow(t.released(_bags), "doc_id bigint, y int, ids array<int>, counts array<int>")
    # One task learns from the bounded sample; the driver gets one number a bucket.
    with small_batches(docs.sparkSession):
        got = bags.groupBy(F.lit(0).alias("all")).applyInArrow(_fit_table, "weight binary, bias double").first()
    return fit([], np.zeros(0, dtype=np.int64)) if got is None else Model(np.frombuffer(bytes(got["weight"])), got["bias"])


def _fit_table(table: pa.Table) -> pa.Table:
    """The model of a sample's bags; rows are put in order first, so that reruns agree."""
    bags = [
        (ids[a:z], counts[a:z])
        for batch in table.select(["ids", "counts"]).to_batches()
        for ids, counts, cut in [(*(np.asarray(batch.column(k).flatten()) for k in ("ids", "counts")), np.concatenate(([0], np.cumsum(np.asarray(batch.column("ids").value_lengths())))))]
        for a, z in zip(cut, cut[1:])
    ]
    y, own = np.asarray(table.column("y")), np.asarray(table.column("doc_id"))
    order = np.lexsort(([int((i.astype(np.int64) * 31 + c).sum()) for i, c in bags], [len(i) for i, _ in bags], own))
    model = fit([bags[i] for i in order], y[order])
    del bags, y, own
    t.release()
    return pa.table({"weight": pa.array([model.weight.tobytes()], pa.binary()), "bias": pa.array([model.bias])})


def score(docs: DataFrame, model: Model, whole: bool = False, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and, with ``whole``, the row as a struct. Null text is empty and gets the bias alone.
    A text goes to the workers and back once: the row's other columns travel beside it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(4, 2).alias("held_out"), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")] * whole)
    kept = ["doc_id", "held_out", *["rest", "text"] * whole]

    def run(batches):
        for batch in batches:
            for a, z, b, off in t.chunks(batch.column("text"), t.SMALL_BYTES):
                p = shared.value.scores(b, off)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, z - a) for c in kept), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = StructType([rows.schema[c] for c in kept]).add("score", "double").add("predicted", "integer")
    scored = rows.mapInArrow(t.released(run), schema)
    if not whole:
        return scored
    row = F.struct(*[(F.col("text") if c == "text" else F.col("rest").getField(c)).alias(c) for c in docs.columns])
    return scored.select("doc_id", "held_out", row.alias("row"), "score", "predicted")


def quality_scores(docs: DataFrame, labels: DataFrame, whole: bool = False) -> DataFrame:
    """Train on ``labels`` and score every whole text. Labels, language, source and id are no inputs of a score. Empty tables
    of documents give no rows; without labels every score is 1/2; labels other than 0 and 1 are ignored; other columns are
    ignored unless ``whole`` asks for them."""
    return score(docs, train(docs, labels), whole)
