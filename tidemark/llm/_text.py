"""Vectorised text primitives on UTF-8 bytes: words, rolling hashes, content-chosen anchors.

A chunk is a run of whole documents from one Arrow batch, so memory follows the chunk size or the longest single
document, whichever is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Chunk of the operators that the pipeline chains. Their arrays take up to 200 bytes for each byte of a chunk, in every worker.
SMALL_BYTES = 1 << 18
#: Hashes that decide are polynomials modulo the Mersenne prime 2^61 - 1. (Modulo a power of two, Thue-Morse strings of 1,024
#: letters collide whatever the base.)
PRIME = (1 << 61) - 1
_P, _LOW30, _LOW31, _LOW32 = U64(PRIME), U64((1 << 30) - 1), U64((1 << 31) - 1), U64((1 << 32) - 1)
_BASE = 0x9E3779B97F4A7C15 % PRIME
_INV = pow(_BASE, -1, PRIME)
#: Base of the hashes that only choose anchors, modulo 2^64.
_ROLL = U64(0x9E3779B97F4A7C15 | 1)
_UNROLL = U64(pow(int(_ROLL), -1, 1 << 64))
_BLOCK = 1 << 14

SPACE = np.ones(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of the licence scan, after A-Z are lower-cased: digits, a-z and every non-ASCII byte.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_pow: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U64(61))
    x -= _P * (x >= _P)
    return x


def _mulmod(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x1, x0, y1, y0 = x >> U64(31), x & _LOW31, y >> U64(31), y & _LOW31
    mid = x1 * y0
    mid += x0 * y1
    x1 *= y1
    x1 <<= U64(1)
    x0 *= y0
    x1 += x0
    x1 += mid >> U64(30)
    mid &= _LOW30
    mid <<= U64(31)
    x1 += mid
    return _reduce(x1)


def mulmod(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """x * y modulo the prime, for reduced x and y, in 64-bit arithmetic; block by block, so that it stays in cache."""
    y = np.broadcast_to(y, x.shape)
    if len(x) <= _BLOCK:
        return _mulmod(x, y)
    out = np.empty(len(x), dtype=U64)
    for i in range(0, len(x), _BLOCK):
        out[i : i + _BLOCK] = _mulmod(x[i : i + _BLOCK], y[i : i + _BLOCK])
    return out


def _grown(kind: str, n: int, make) -> tuple[np.ndarray, np.ndarray]:
    """Cached tables of at least n powers; a very long text's are not kept."""
    if kind not in _pow or len(_pow[kind][0]) < n:
        made = make(1 << max(16, int(n).bit_length()))
        if len(made[0]) > 1 << 23:
            return made
        _pow[kind] = made
    return _pow[kind]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime."""

    def make(size):
        made = []
        for base in (_BASE, _INV):
            p, done = np.ones(size, dtype=U64), 1
            while done < size:
                p[done : 2 * done] = mulmod(p[:done], U64(pow(base, done, PRIME)))
                done *= 2
            made.append(p)
        return made[0], made[1]

    return _grown("prime", n, make)


def roll_hash(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of ``units[start:end]`` modulo 2^64: fast, and good enough to choose and meet on anchors, where
    a collision costs a comparison; never to decide that texts are equal."""

    def make(size):
        made = []
        for base in (_ROLL, _UNROLL):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        return made[0], made[1]

    p, inv = _grown("roll", len(units) + 1, make)
    cum = np.zeros(len(units) + 1, dtype=U64)
    np.cumsum(units * p[: len(units)], out=cum[1:])
    return mix((cum[end] - cum[start]) * inv[start] + (end - start).astype(U64))


def _cumulated(x: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, dtype=U64)
    np.cumsum(x, out=c[1:])
    return c


def span_hash(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of ``units[start:end]``, each in constant time. Units are bytes or uint64 hashes (61 bits of
    which count). Sums of the halves of each term are exact, as no sum reaches 2^64."""
    p, inv = powers(len(units) + 1)
    p = p[: len(units)]
    if units.dtype == np.uint8 and len(units) < 1 << 24:
        u = units.astype(U64) + U64(1)
        low, high, half = _cumulated(u * (p & _LOW31)), _cumulated(u * (p >> U64(31))), 31
    else:
        term = mulmod(units.astype(U64) + U64(1) if units.dtype == np.uint8 else _reduce(units), p)
        low, high, half = _cumulated(term & _LOW32), _cumulated(term >> U64(32)), 32
    own = _reduce(high[end] - high[start])
    own = ((own << U64(half)) & _P) + (own >> U64(61 - half)) + _reduce(low[end] - low[start])  # a power of two rotates
    return mix(mulmod(_reduce(own), inv[start]) + (end - start).astype(U64))


def byte_units(b: np.ndarray, seed: int = 0) -> np.ndarray:
    return mix(np.arange(256, dtype=U64), 7 + seed)[b]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if len(column) else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        z = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        z = min(z, n)
        yield a, z, raw[off[a] : off[z]], off[a : z + 1] - off[a]
        a = z


def release() -> None:
    """Give the memory of freed arrays back to the system, where its allocator can be asked to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable) -> Callable:
    """A function over batches after whose task the worker keeps no freed memory. A worker lives on, idle, beside the stages that
    follow, and all that it holds counts as its executor's."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def words(b: np.ndarray, off: np.ndarray, table: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and each document's offsets into them. Words never cross documents."""
    if not len(b):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(off), dtype=np.int64)
    keep = table[b]
    before = np.zeros(len(b) + 1, dtype=bool)
    before[1:] = keep
    cut = off[off < len(b)]
    before[cut] = False
    start = np.flatnonzero(keep & ~before[:-1])
    after = np.zeros(len(b) + 1, dtype=bool)
    after[:-1] = keep
    after[off] = False
    end = np.flatnonzero(keep & ~after[1:]) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(b, start, end)


def doc_of(off: np.ndarray) -> np.ndarray:
    """The document index of each unit, from unit offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def windows_ok(off: np.ndarray, n: int) -> np.ndarray:
    """Unit positions at which n units of one document start."""
    lens = np.maximum(np.diff(off) - n + 1, 0)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.repeat(off[:-1] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    return first + np.arange(total)


def spans(units: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Cut every document's windows into runs that share an anchor.

    The anchor of a window is its gram with the smallest hash, the leftmost among equals, so it depends on the window's
    content alone: equal windows have equal anchors wherever they stand. Returns document, first window, number of
    windows, anchor hash. A run is a contiguous range of window starts.
    """
    at = windows_ok(off, window)
    z = np.zeros(0, dtype=np.int64)
    if not len(at):
        return z, z, z, z.astype(U64)
    n = len(units)
    pos = np.arange(n - gram + 1)
    h = roll_hash(units, pos, pos + gram)
    m = (h & U64(0xFFFFFFFF00000000)) | pos.astype(U64)
    width, done = window - gram + 1, 1
    while done < width:  # sliding minimum by doubling
        step = min(done, width - done)
        m = np.minimum(m[: len(m) - step], m[step:])
        done += step
    low = (m[at] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    return np.searchsorted(off, start, "right") - 1, start, count, h[low[first]]


def merge_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal disjoint ranges."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def as_i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)
