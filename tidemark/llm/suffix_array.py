"""Suffix arrays by induced sorting, and permuted common prefixes.

A path is the run of (character, type) pairs from a position to the next leftmost-smaller position, inclusive. At equal
characters a larger-type suffix precedes a smaller-type one, so suffixes compare as their paths do and, for equal paths, as the
leftmost-smaller suffixes in which these end. Paths of leftmost-smaller positions are their substrings: they are sorted and named,
the string of names is sorted recursively, and its ranks induce the order of all suffixes. Both sorts are radix
passes over packed paths, linear in the length.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _radix(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of unsigned keys of so many bits, 16 bits a pass."""
    order = np.argsort((key & U64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digit = (key >> U64(shift)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def _next_true(flags: np.ndarray) -> np.ndarray:
    """For each position the first set position at or after it (the length if none)."""
    n = len(flags)
    return np.minimum.accumulate(np.where(flags, np.arange(n), n)[::-1])[::-1]


def _smaller(s: np.ndarray) -> np.ndarray:
    """S-type flags: the suffix is smaller than the next one. Equal runs take the type of the first difference to the
    right; the last position, a unique smallest sentinel, is S-type."""
    less = np.ones(len(s), dtype=bool)
    less[:-1] = s[:-1] < s[1:]
    differs = np.ones(len(s), dtype=bool)
    differs[:-1] = s[:-1] != s[1:]
    return less[_next_true(differs)]


class _Paths:
    """The paths of a string, read in layers of as many codes as a 64-bit word holds."""

    def __init__(self, s: np.ndarray):
        small = _smaller(s)
        first = np.zeros(len(s), dtype=bool)
        first[1:] = small[1:] & ~small[:-1]
        self.lms = np.flatnonzero(first)
        self.code = s.astype(U64) * U64(2) + small + U64(1)
        self.bits = int(self.code.max()).bit_length()
        self.per = max(1, 63 // self.bits)
        # The sentinel's path is itself; every other path ends at the next leftmost-smaller position.
        self.end = np.append(_next_true(first)[1:], len(s) - 1)

    def layer(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Codes depth*per .. of the paths from ``at``, packed; 0 beyond a path's end."""
        out, end = np.zeros(len(at), dtype=U64), self.end[at]
        for k in range(depth * self.per, (depth + 1) * self.per):
            here = at + k
            inside = here <= end
            out <<= U64(self.bits)
            out |= np.where(inside, self.code[np.minimum(here, end)], U64(0))
        return out

    def order(self, at: np.ndarray, tie: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``at`` sorted by path (then by ``tie`` of the path's end), and the slot where each run of equal ones begins."""
        m, depth = len(at), 1
        key = self.layer(at, 0)
        order = _radix(key, self.per * self.bits)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[:m]
        group = _slots(new, np.arange(m))
        rest = np.flatnonzero(_several(new))
        # Equal codes end together, so groups stay whole: in ``rest`` or out of it.
        while len(rest := rest[self.end[at[order[rest]]] - at[order[rest]] >= depth * self.per]):
            who, old = order[rest], group[rest]
            key = self.layer(at[who], depth)
            by = np.lexsort((key, old))
            order[rest] = who[by]
            key = key[by]
            new = np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1]))
            group[rest] = _slots(new, rest)
            rest = rest[_several(new)]
            depth += 1
        if tie is not None:
            rest = np.flatnonzero(_several(np.append(True, group[1:] != group[:-1])[:m]))
            if len(rest):
                who = order[rest]
                width = int(len(tie)).bit_length()
                key = (group[rest].astype(U64) << U64(width)) | tie[self.end[at[who]]].astype(U64)
                order[rest] = who[_radix(key, width + int(m).bit_length())]
        return order, group


def _slots(new: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The slot of the first member of each element's group."""
    at = np.flatnonzero(new)
    return np.repeat(slot[at], np.diff(np.append(at, len(new))))


def _several(new: np.ndarray) -> np.ndarray:
    """Elements of groups with several members, where ``new`` marks the first of each."""
    again = ~new
    again[:-1] |= ~new[1:]
    return again


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers whose last element is a unique smallest 0."""
    if len(s) < 2:
        return np.arange(len(s))
    paths = _Paths(s)
    order, group = paths.order(paths.lms)
    name = np.empty(len(order), dtype=np.int64)
    name[order] = np.cumsum(np.append(0, group[1:] != group[:-1]))
    # The last name is the sentinel's, the smallest and unique, so the names are such a string again.
    sub = np.argsort(name) if name.max() + 1 == len(name) else suffix_array(name)
    rank = np.zeros(len(s), dtype=np.int64)
    rank[paths.lms[sub]] = np.arange(len(sub))
    return paths.order(np.arange(len(s)), rank)[0]


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, starts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text position the preceding suffix in order (-1 for the first) and their common prefix, in text order.

    Where the characters before both are equal, the common prefix is one less than its left neighbour's; only at the other
    positions, and at ``starts``, characters are compared, up to ``cap``. So values are exact within ``cap`` less the distance
    from the last start."""
    n = len(s)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    own = np.ones(n, dtype=bool)
    own[1:] = (phi[1:] <= 0) | (s[:-1] != s[phi[1:] - 1])
    own[starts] = True
    at = np.flatnonzero(own)
    other, length = phi[at], np.zeros(len(at), dtype=np.int64)
    padded = np.concatenate([s.astype(np.uint64), np.zeros(4, dtype=np.uint64)])
    four = padded[:n] | padded[1 : n + 1] << U64(16) | padded[2 : n + 2] << U64(32) | padded[3 : n + 3] << U64(48)
    live = np.flatnonzero(other >= 0)
    while len(live):
        a, b = at[live] + length[live], other[live] + length[live]
        inside = (a < n) & (b < n)
        diff = np.where(inside, four[np.minimum(a, n - 1)] ^ four[np.minimum(b, n - 1)], U64(1))
        equal = diff == 0
        low = diff & (~diff + U64(1))  # the lowest differing bit tells how many characters are equal
        length[live] += np.where(equal, 4, (low >= U64(1 << 16)).astype(np.int64) + (low >= U64(1 << 32)) + (low >= U64(1 << 48)))
        live = live[equal & (length[live] < cap)]
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    value = np.zeros(n, dtype=np.int64)
    value[at] = length
    return phi, np.maximum(value[last] - (np.arange(n) - last), 0)


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the offsets at which a ``length``-byte string starts that also starts elsewhere in the pieces."""
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    s = np.ones(len(text) + len(pieces) + 1, dtype=np.uint16)  # a separator follows each piece
    s[np.arange(len(text)) + np.repeat(np.arange(len(pieces)), sizes)] = text.astype(np.uint16) + 2
    s[-1] = 0
    phi, plcp = permuted_prefixes(s, suffix_array(s), first, int(sizes.max(initial=0)) + length)
    hit = np.zeros(len(s), dtype=bool)
    long = np.flatnonzero(plcp >= length)
    hit[long] = True
    hit[phi[long]] = True
    return [np.flatnonzero(hit[f : f + max(0, int(n) - length + 1)]) for f, n in zip(first, sizes)]
