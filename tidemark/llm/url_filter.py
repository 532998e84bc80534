"""URL filter: glob rules packed into multiword Shift-And masks, all patterns simulated at once.

A rule is a glob over the canonical URL ``.host/path``: ``*`` matches any run without ``/``, ``**`` any run, ``?`` one
character. Each pattern is a row of bits: a start bit and one bit for each character; a star is a self-loop on the bit before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _text as t

CHUNK_URLS = 4096


@dataclass(frozen=True)
class Rule:
    name: str
    glob: str
    action: str
    rank: int


def host_rule(name: str, action: str) -> Rule:
    """``host/path-prefix``: fits the host and its subdomains where the path starts with the prefix; longer wins."""
    host, _, path = name.partition("/")
    return Rule(name, f"**.{host}/{path}**" if not host else f"*.{host}/{path}**", action, len(name))


#: The rules of the registered query, as given.
CONTRACT_RULES = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))


class ShiftAnd:
    """Compiled masks: ``step[c]`` bits enterable on byte c, ``loop[c]`` bits that stay on byte c, per 64-bit word."""

    def __init__(self, globs: Sequence[str]):
        items: list[tuple[set[int] | None, set[int]]] = []  # (bytes that enter, bytes that loop); None: a start bit
        starts, ends = [], []
        every = set(range(256))
        for g in globs:
            starts.append(len(items))
            items.append((None, set()))
            b, i = g.encode(), 0
            while i < len(b):
                if b[i : i + 2] == b"**":
                    items[-1][1].update(every)
                    i += 2
                elif b[i : i + 1] == b"*":
                    items[-1][1].update(every - {ord("/")})
                    i += 1
                else:
                    items.append((set(every) if b[i : i + 1] == b"?" else {b[i]}, set()))
                    i += 1
            ends.append(len(items) - 1)
        n = (len(items) + 63) // 64
        self.words, self.ends = n, ends
        self.step, self.loop, self.first = np.zeros((256, n), np.uint64), np.zeros((256, n), np.uint64), np.zeros(n, np.uint64)
        for j, (enter, stay) in enumerate(items):
            w, bit = j // 64, np.uint64(1 << (j % 64))
            for c in enter or ():
                self.step[c, w] |= bit
            for c in stay:
                self.loop[c, w] |= bit
        for s in starts:
            self.first[s // 64] |= np.uint64(1 << (s % 64))

    def match(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each text the patterns that match it whole, as booleans (texts, patterns)."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        state = np.tile(self.first, (len(size), 1))
        live = -size[order]
        for i in range(int(size.max(initial=0))):
            active = order[: np.searchsorted(live, -i, "left")]  # texts longer than i
            c = b[off[active] + i]
            d = state[active]
            carry = np.zeros_like(d)
            carry[:, 1:] = d[:, :-1] >> np.uint64(63)
            state[active] = (((d << np.uint64(1)) | carry) & self.step[c]) | (d & self.loop[c])
        return np.stack([(state[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1) for e in self.ends], axis=1).astype(bool)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(pages: DataFrame, rules: Sequence[Rule] = CONTRACT_RULES, default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """Judge every URL: id, host, path, rule (null if none fits), verdict. The longest rule wins, then block, then the
    order given. Null URLs and those without ``://`` have empty host and path and take the default. Rows stay one to one; an empty
    table gives no rows; other columns are ignored."""
    rules = sorted(rules, key=lambda r: (-r.rank, r.action != "block"))
    machine = ShiftAnd([r.glob for r in rules])
    names, actions = np.array([*[r.name for r in rules], None], dtype=object), np.array([*[r.action for r in rules], default], dtype=object)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_URLS):
                part = batch.slice(a, CHUNK_URLS)
                best = []
                for _, _, b, off in t.chunks(part.column("canon"), 1 << 20):
                    hit = machine.match(b, off)
                    best.append(np.where(hit.any(axis=1), hit.argmax(axis=1), len(rules)))
                k = np.concatenate(best) if best else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "host", "path")), pa.array(names[k], pa.string()), pa.array(actions[k], pa.string())], names=[id_column, "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_column).cast("bigint").alias("id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    return rows.withColumn("canon", F.concat(F.lit("."), "host", "path")).mapInArrow(run, f"{id_column} bigint, host string, path string, rule string, verdict string")
