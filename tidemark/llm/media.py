"""Chroma audio fingerprints of a media column, and alignment of recordings.

Frames of a recording are folded to twelve pitch classes; sixteen box filters, read from an integral image over (frame, pitch class), are
quantised to two bits each and packed into one 32-bit integer a frame. Recordings meet on equal integers, vote for the
offset between their frames with all of them, and the offsets are verified by their share of differing bits.
"""

from __future__ import annotations

import io
import wave
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import written

#: Four frames overlap, so that a shift of half a hop moves a frame by an eighth.
RATE, FRAME, HOP, SPAN = 4000, 1024, 256, 32
#: Frames that are transformed at a time, whatever a recording's length.
FRAMES_AT_ONCE = 2048
#: A recording of fewer samples a second holds no pitch of most classes and counts as unreadable.
MIN_RATE = 1000
NOTE_SAMPLES = 512
#: Frame pairs of one value in two recordings that are counted one by one; beyond it they are counted by a correlation.
SINGLE_PAIRS = 4096


def sonify(values: np.ndarray) -> bytes:
    """A vector as a mono 16-bit WAV: each value is a note of three octaves above 220 Hz, its fraction a second voice that
    glides over the octave above 880 Hz."""
    v = np.nan_to_num(np.asarray(values, dtype=float))
    part, x = np.modf((v / (np.abs(v).max(initial=0) or 1) + 1) * 18)
    time = np.arange(NOTE_SAMPLES) / RATE
    pitch = 220.0 * 2.0 ** (x / 12)
    tone = np.sin(2 * np.pi * pitch[:, None] * time) * 0.6 + np.sin(2 * np.pi * 880.0 * 2.0 ** part[:, None] * time) * 0.3
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
        w.writeframes((tone.ravel() * 32000).astype("<i2").tobytes())
    return out.getvalue()


def decode(raw: bytes | None) -> np.ndarray:
    """Mono samples at RATE of a WAV of 8 (unsigned), 16, 24 or 32 bits. Media that are null, empty, unreadable or below MIN_RATE
    are silent and have no frames; a last frame that is cut short is dropped."""
    if not raw:
        return np.zeros(0)
    try:
        with wave.open(io.BytesIO(raw)) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            b = np.frombuffer(w.readframes(w.getnframes()), dtype=np.uint8)
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0)
    if rate < MIN_RATE or not 1 <= width <= 4:
        return np.zeros(0)
    b = b[: len(b) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        x = (b[:, 0].astype(float) - 128) * 256
    else:  # bytes as the upper ones of a 32-bit integer, then on the scale of 16 bits
        wide = np.zeros((len(b), 4), dtype=np.uint8)
        wide[:, 4 - width :] = b
        x = wide.view("<i4")[:, 0] / 65536
    x = x.reshape(-1, channels).mean(axis=1)
    return x if rate == RATE else np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)


@cache
def _fold() -> np.ndarray:
    """(frequency bin, pitch class) incidence between 60 and 1900 Hz."""
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    ok = (freq > 60) & (freq < 1900)
    fold = np.zeros((len(freq), 12))
    fold[np.flatnonzero(ok), np.round(12 * np.log2(freq[ok] / 440)).astype(int) % 12] = 1
    return fold


def chroma(x: np.ndarray) -> np.ndarray:
    """(frames, 12) energies of pitch classes, each frame of unit length."""
    c, window, fold = np.zeros((max(0, (len(x) - FRAME) // HOP + 1), 12)), np.hanning(FRAME), _fold()
    for a in range(0, len(c), FRAMES_AT_ONCE):
        part = c[a : a + FRAMES_AT_ONCE]
        at = (a + np.arange(len(part)))[:, None] * HOP + np.arange(FRAME)
        part[:] = np.abs(np.fft.rfft(x[at] * window, axis=1)) ** 2 @ fold
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _filters() -> list[tuple[int, int, int, int]]:
    """Sixteen (kind, first pitch class, height, width) boxes by rule: four kinds at four pitch offsets and growing widths."""
    return [(i % 4, 3 * (i // 4), 3 + 3 * (i % 3 == 0), (SPAN // 4, SPAN // 2, SPAN * 3 // 4, SPAN)[(i // 4 + i) % 4]) for i in range(16)]


def fingerprint(c: np.ndarray) -> np.ndarray:
    """One uint32 a frame: sixteen filter responses quantised to two bits (Gray code)."""
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    wide = np.concatenate([c, c], axis=1)  # pitch classes wrap around
    area = np.zeros((len(c) + 1, 25))
    area[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)
    box = lambda t0, t1, p0, p1: area[t + t1, p1] - area[t + t0, p1] - area[t + t1, p0] + area[t + t0, p0]
    out = np.zeros(n, dtype=np.uint32)
    for kind, p, h, w in _filters():
        half, mid = w // 2, h // 2
        if kind == 0:  # later against earlier
            a, b = box(half, w, p, p + h), box(0, half, p, p + h)
        elif kind == 1:  # upper against lower
            a, b = box(0, w, p + mid, p + h), box(0, w, p, p + mid)
        elif kind == 2:  # checkerboard
            a, b = box(0, half, p, p + mid) + box(half, w, p + mid, p + h), box(half, w, p, p + mid) + box(0, half, p + mid, p + h)
        else:  # middle third against the rest
            third = w // 4
            a, b = box(third, w - third, p, p + h), box(0, third, p, p + h) + box(w - third, w, p, p + h)
        r = np.log((a + 0.1) / (b + 0.1))
        level = np.digitize(r, (-0.25, 0.0, 0.25)).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprints(media: DataFrame, id_column: str, audio: str = "audio") -> DataFrame:
    """(id, print): the fingerprint of each recording as an array of integers; empty for silent or unreadable media."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(chroma(decode(x.as_py()))).view(np.int32).tolist() for x in batch.column("audio")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.list_(pa.int32()))], names=["id", "print"])

    return media.select(F.col(id_column).cast("bigint").alias("id"), F.col(audio).alias("audio")).mapInArrow(run, "id bigint, print array<int>")


def _digest(column: str = "print"):
    return F.md5(F.array_join(column, ",").cast("binary"))


def recordings(prints: DataFrame) -> DataFrame:
    """(id, class_id, frames, digest) of every row: the smallest id with an equal fingerprint, its frames and its digest. An empty
    fingerprint has no class."""
    rows = prints.select("id", F.size("print").alias("frames"), _digest().alias("digest"))
    classes = rows.where("id is not null and frames > 0").groupBy("digest").agg(F.min("id").alias("class_id"))
    return rows.join(classes, "digest", "left").select("id", "class_id", "frames", "digest")


def _places(batches):
    """(rep, asked, print) -> one row for each distinct value of a recording with all its frames."""
    for batch in batches:
        prints = batch.column("print")
        value, n = np.asarray(prints.flatten()), np.asarray(prints.value_lengths())
        rec = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((at, value, rec))
        rec, value, at = rec[order], value[order], at[order]
        first = np.flatnonzero(np.append(True, (rec[1:] != rec[:-1]) | (value[1:] != value[:-1]))[: len(rec)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rec)).astype(np.int32)), pa.array(at.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(rec[first])), pa.array(value[first]), lists], names=["rep", "value", "at"])


def correlate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences y - x of two sets of frames and how often each occurs, without forming the pairs."""
    a, b = np.bincount(x - x.min()).astype(float), np.bincount(y - y.min()).astype(float)
    n = 1 << int(len(a) + len(b) - 1).bit_length()
    c = np.rint(np.fft.irfft(np.fft.rfft(b, n) * np.conj(np.fft.rfft(a, n)), n)).astype(np.int64)
    at = np.flatnonzero(c)
    return np.where(at < len(b), at, at - n) + int(y.min()) - int(x.min()), c[at]


def _votes(batches):
    """(a, b, ap, bp) -> votes of every pair of frames, by offset."""
    for batch in batches:
        (x, nx), (y, ny) = ((np.asarray(c.flatten()).astype(np.int64), np.asarray(c.value_lengths()).astype(np.int64)) for c in (batch.column("ap"), batch.column("bp")))
        sx, sy, pairs = np.cumsum(nx) - nx, np.cumsum(ny) - ny, nx * ny
        few = np.flatnonzero(pairs <= SINGLE_PAIRS)
        parts = np.split(few, np.flatnonzero(np.diff(np.cumsum(pairs[few]) >> 20)) + 1)
        for part in parts:
            row = np.repeat(part, pairs[part])
            k = np.arange(len(row)) - np.repeat(np.cumsum(pairs[part]) - pairs[part], pairs[part])
            yield _vote_rows(batch, (row, y[sy[row] + k % ny[row]] - x[sx[row] + k // ny[row]], np.ones(len(row), dtype=np.int64)))
        for i in np.flatnonzero(pairs > SINGLE_PAIRS):
            offset, votes = correlate(x[sx[i] : sx[i] + nx[i]], y[sy[i] : sy[i] + ny[i]])
            yield _vote_rows(batch, (np.full(len(offset), i), offset, votes))


def _vote_rows(batch, part) -> pa.RecordBatch:
    row, offset, votes = part
    row = pa.array(row)
    return pa.RecordBatch.from_arrays([batch.column("a").take(row), batch.column("b").take(row), pa.array(offset.astype(np.int32)), pa.array(votes)], names=["a", "b", "offset", "votes"])


def _verified(max_error: float):
    """(a, b, offsets by preference, pa, pb) -> the first offset whose share of differing bits is within the bound."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                x, y = (np.asarray(batch.column(c)[i].values).view(np.uint32) for c in ("pa", "pb"))
                at = batch.column("tried")[i].values
                for votes, offset in zip(np.asarray(at.field("votes")).tolist(), np.asarray(at.field("offset")).tolist()):
                    lo = max(0, -offset)
                    n = min(len(x) - lo, len(y) - lo - offset)
                    error = int(np.bitwise_count(x[lo : lo + n] ^ y[lo + offset : lo + offset + n]).sum()) / (32 * n)
                    if error <= max_error:
                        out.append((batch.column("a")[i].as_py(), batch.column("b")[i].as_py(), offset, votes, error))
                        break
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["a", "b", "offset", "votes", "bit_error"])

    return run


def align(prints: DataFrame, query: str = "id % 100 = 0", max_error: float = 0.2, min_votes: int = 4) -> DataFrame:
    """Copies and matches: (kind, a, b, offset, votes, bit_error).

    Recordings with equal fingerprints are one class, its smallest id the representative; ``copy`` rows give each other
    member. ``match`` rows align the classes that hold a query row with every other class: of all offsets with ``min_votes``
    votes (pairs of equal frames) and at most ``max_error`` differing bits, the one with most votes, the smallest shift among equals. A null
    id and an empty fingerprint take no part; rows with an equal id are one recording if their fingerprints are equal.
    """
    rows = prints.where("id is not null and size(print) > 0").withColumn("digest", _digest())
    rows = written(rows.distinct(), "prints")
    first = rows.groupBy("digest").agg(F.min("id").alias("rep"), F.max(F.expr(query)).alias("asked"), F.first("print").alias("print"))
    reps = written(first, "classes")
    copies = rows.select("id", "digest").join(reps.select("digest", "rep"), "digest").where("id <> rep")
    copies = copies.select(F.lit("copy").alias("kind"), F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("offset"), F.lit(0).cast("bigint").alias("votes"), F.lit(0.0).alias("bit_error"))
    # A value has one row in a recording, with all its frames, so the join never forms the square of its frames.
    places = lambda df, rep, at: df.select("rep", "print").mapInArrow(_places, "rep bigint, value int, at array<int>").select(F.col("rep").alias(rep), "value", F.col("at").alias(at))
    hits = places(reps.where("asked"), "a", "ap").join(places(reps, "b", "bp"), "value").where("a <> b").select("a", "b", "ap", "bp")
    votes = hits.mapInArrow(_votes, "a bigint, b bigint, offset int, votes bigint").groupBy("a", "b", "offset").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= min_votes)
    tried = votes.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("votes", (-F.abs("offset")).alias("near"), "offset")), asc=False).alias("tried"))
    both = tried.join(reps.select(F.col("rep").alias("a"), F.col("print").alias("pa")), "a").join(reps.select(F.col("rep").alias("b"), F.col("print").alias("pb")), "b")
    matches = both.mapInArrow(_verified(max_error), "a bigint, b bigint, offset int, votes bigint, bit_error double")
    return copies.unionByName(matches.select(F.lit("match").alias("kind"), "a", "b", "offset", "votes", "bit_error"))


def sonified(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A media column made from vectors, for tables without recordings."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([sonify(x.as_py() or []) for x in part.column("v")], pa.binary())], names=["id", "audio"])

    return vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).alias("v")).mapInArrow(run, "id bigint, audio binary")
