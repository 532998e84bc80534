"""Licence scan by diagonal voting.

Rolling word k-gram hashes of every text are joined to the positions of licence templates. A hit votes for its offset
diagonal (text position minus template position); votes are aggregated by diagonal, neighbouring diagonals merge, and a span
is kept if the template words verified under it cover enough of the template. A short notice is one gram of all its words, so it
is found whole or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _text as t

# The phrases and labels of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening or defining sentences of public licences, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# Short notices that name a licence, by label; forms with a version only where the label has one.
NOTICES = {
    "apache-2.0": ("apache license version 2 0", "apache license v2 0", "apache license 2 0", "apache 2 0 license", "license identifier apache 2 0"),
    "mit": ("mit license", "mit licence", "mit licensed", "license identifier mit"),
    "bsd": ("bsd license", "bsd licence", "bsd licensed", "license bsd", "bsd 2 clause", "bsd 3 clause"),
    "mpl-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "license mpl 2 0", "mpl 2 0 license", "license identifier mpl 2 0"),
    "cc-by-text": ("creative commons attribution 4 0",),
    "isc": ("isc license", "isc licence", "isc licensed", "license isc", "license identifier isc"),
    "unlicense": ("under the unlicense", "license unlicense", "license identifier unlicense"),
}
GRAM = 4


@dataclass(frozen=True)
class _Table:
    """Template k-grams: hash -> their words, for emission, and (hash, template, position) rows for the join."""

    rows: list[tuple[int, int, str, int, int, int, bool]]  # hash, template, label, position, gram size, template words, base

    @property
    def hashes(self) -> dict[int, np.ndarray]:
        sizes = sorted({r[4] for r in self.rows})
        return {k: np.unique(np.array([r[0] for r in self.rows if r[4] == k], dtype=np.int64).view(np.uint64)) for k in sizes}


def _grams(units: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return t.mix(t.span_hash(units, at, at + k), k)


def _template_table(base: dict[str, str], templates: dict[str, str], notices: dict[str, tuple[str, ...]]) -> _Table:
    rows = []
    items = [(v, k, True, True) for k, v in base.items()] + [(k, v, False, False) for k, v in templates.items()] + [(k, v, False, True) for k, vs in notices.items() for v in vs]
    for n, (label, text, is_base, whole) in enumerate(items):
        b = np.frombuffer(text.encode(), dtype=np.uint8)
        s, e, off = t.words(b, np.array([0, len(b)]), t.ALNUM)
        k = len(s) if whole else min(GRAM, len(s))
        at = t.windows_ok(off, k)
        rows += [(int(h), n, label, int(i), k, len(s), is_base) for h, i in zip(t.as_i64(_grams(t.word_hashes(b, s, e), at, k)), at)]
    return _Table(rows)


def _scan(hashes: dict[int, np.ndarray]):
    """(doc, text) -> one row for each document (its words, no hash) and one for each k-gram that a template has."""

    def run(batches):
        for batch in batches:
            ids = batch.column("row")
            for a, z, b, off in t.chunks(batch.column("text")):
                b = t.LOWER[b]
                s, e, woff = t.words(b, off, t.ALNUM)
                u = t.word_hashes(b, s, e)
                doc, pos, gram = [np.arange(z - a)], [np.diff(woff)], [np.zeros(z - a, dtype=np.int64)]
                real = [np.zeros(z - a, dtype=bool)]
                for k, want in hashes.items():
                    at = t.windows_ok(woff, k)
                    h = _grams(u, at, k)
                    i = np.minimum(np.searchsorted(want, h), len(want) - 1)
                    at, h = at[want[i] == h], h[want[i] == h]
                    own = np.searchsorted(woff, at, "right") - 1
                    doc.append(own), pos.append(at - woff[own]), gram.append(t.as_i64(h)), real.append(np.ones(len(at), dtype=bool))
                doc, pos, gram, real = (np.concatenate(x) for x in (doc, pos, gram, real))
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a).take(pa.array(doc)), pa.array(pos.astype(np.int64)), pa.array(gram, mask=~real)], names=["row", "pos", "gram"])

    return run


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None, cover: float = 0.6, drift: int = 3, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Base phrases, licence templates and short notices in every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels (comma-joined, sorted, '' if none), score (1
    for a base phrase or a notice, else the best template cover) and spans (label, start, end, cover). Null text is empty; rows with equal
    ids are told apart by text; rows equal in both give equal rows, one each; an empty table gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    table = _template_table(BASE if base is None else base, TEMPLATES if templates is None else templates, NOTICES if notices is None else notices)
    # A fixed, small table (a few hundred rows, bounded by the templates given): it is broadcast.
    positions = F.broadcast(spark.createDataFrame(table.rows, "gram bigint, tmpl int, label string, at int, k int, size int, base boolean"))
    row = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"))
    hits = docs.select(row.alias("row"), "text").mapInArrow(_scan(table.hashes), "row struct<doc_id:bigint,th:bigint>, pos bigint, gram bigint")
    joined = hits.join(positions, "gram", "left")
    # Votes of each diagonal, combined before the exchange; the document's own row and base places ride along.
    diag = F.when(~F.col("base"), F.col("pos") - F.col("at"))
    by_diag = joined.groupBy("row", "tmpl", "label", "base", diag.alias("diag")).agg(
        F.max(F.when(F.col("gram").isNull(), F.col("pos"))).alias("words"), F.count(F.when(F.col("gram").isNull(), 1)).alias("copies"), F.count("gram").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
        F.max("size").alias("size"), F.max("k").alias("k"), F.collect_set(F.when(~F.col("base"), F.col("at"))).alias("ats"),
    )
    # Template words under the grams of each diagonal.
    by_diag = by_diag.withColumn("ats", F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1))))
    w = Window.partitionBy("row", "tmpl", "label", "base").orderBy("diag")
    step = F.coalesce(F.col("diag") - F.lag("diag").over(w) > drift, F.lit(True)).cast("int")
    chained = by_diag.withColumn("step", step).withColumn("chain", F.sum("step").over(w))
    spans = chained.groupBy("row", "tmpl", "label", "base", "chain").agg(
        F.max("words").alias("words"), F.sum("copies").alias("copies"), F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("size").alias("size"), F.max("k").alias("k"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"),
    )
    part = F.least(F.col("covered") / F.col("size"), F.lit(1.0))
    found = ~F.col("base") & (part >= cover)
    is_base = F.coalesce(F.col("base"), F.lit(False))
    out = spans.groupBy("row").agg(
        F.max("words").alias("n_words"), F.sum("copies").alias("copies"), F.coalesce(F.sum(F.when(is_base, F.col("votes"))), F.lit(0)).alias("n_base"),
        F.min(F.when(is_base, F.col("lo"))).alias("first_word"), F.max(F.when(is_base, F.col("hi"))).alias("last_word"),
        F.collect_set(F.when(is_base, F.col("label"))).alias("b"), F.collect_set(F.when(is_base | found, F.col("label"))).alias("l"),
        F.max(F.when(is_base, F.lit(1.0)).when(~is_base & F.col("label").isNotNull(), part)).alias("score"),
        F.collect_list(F.when(found, F.struct("label", F.col("lo").alias("start"), (F.col("hi") + F.col("k")).alias("end"), part.alias("cover")))).alias("spans"),
    )
    joined_text = lambda c: F.array_join(F.sort_array(c), ",")
    # Rows equal in id and text were counted together: each gets its share, in a row of its own.
    out = out.withColumn("n_base", F.expr("n_base div copies")).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return out.select(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word", joined_text("b").alias("base_labels"), joined_text("l").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
