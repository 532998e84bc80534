"""Benchmark decontamination in DataFrame operations alone.

A window as long as a benchmark item that reaches the threshold holds at least a known number of positions whose shingles the
item has. All windows with that many are laid, and no other. Each gets a SimHash; a multi-index over blocks of the fingerprint finds
the item fingerprints within the radius (radius + 1 blocks: two fingerprints within the radius agree on one whole block);
the exact weighted-shingle similarity then decides. Where shingles repeat, or are so few that a fingerprint says little, windows
go to the exact similarity without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import KEY, keyed, small_or_shuffled, written

SHINGLE = 5
#: At similarity 0.8 two 64-bit fingerprints differ in 10 bits on average (standard deviation 3).
RADIUS = 24
#: Items of fewer shingles than this are compared without fingerprints.
FEW = 24
#: Key of an item: a null id counts as the smallest, and such items are told apart by a hash of their text.
ITEM = ["_iid", "_ith"]

_SHARED = "IF(size(array_distinct({a})) = size({a}) OR size(array_distinct({b})) = size({b}), size(array_intersect({a}, {b})), aggregate(array_intersect({a}, {b}), 0, (acc, s) -> acc + least(size(filter({a}, y -> y = s)), size(filter({b}, y -> y = s)))))"


def simhash(name: str, most: int) -> Column:
    """SimHash of the array column of hashes, of at most ``most`` entries. The 64 counters are kept bit-sliced: plane k has bit k
    of every counter, so a hash is added to all of them by a carry through the planes; a bit is set where its counter
    exceeds half the entries."""
    planes = max(1, int(most).bit_length())
    carry, add = "x", []
    for k in range(planes):
        add.append(f"acc.p{k} ^ ({carry}) AS p{k}")
        carry = f"acc.p{k} & ({carry})"
    counters = f"aggregate({name}, named_struct({', '.join(f"'p{k}', 0L" for k in range(planes))}), (acc, x) -> named_struct({', '.join(f"'p{k}', " + a.rpartition(' AS ')[0] for k, a in enumerate(add))}), acc -> {{more}})"
    # Compare every counter with half, from the highest plane: more so far, and equal so far.
    more, equal = "0L", "-1L"
    for k in range(planes - 1, -1, -1):
        half = f"-((shiftright(CAST(size({name}) AS BIGINT), {k + 1})) & 1L)"
        more = f"({more} | ({equal} & acc.p{k} & ~({half})))"
        equal = f"({equal} & ~(acc.p{k} ^ ({half})))"
    return F.expr(counters.replace("{more}", more))


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words; null text has none."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)), lambda w: F.xxhash64(w))


def shingles(name: str) -> Column:
    """Shingle hashes of the array column of word hashes; none for fewer than SHINGLE words."""
    at = ", ".join(f"{name}[i + {j}]" for j in range(SHINGLE))
    return F.expr(f"IF(size({name}) < {SHINGLE}, CAST(array() AS array<bigint>), transform(sequence(0, greatest(size({name}) - {SHINGLE}, 0)), i -> xxhash64({at})))")


def _blocks(fp: str) -> Column:
    """The RADIUS + 1 blocks of a fingerprint as (block, value)."""
    n, edges = RADIUS + 1, [round(i * 64 / (RADIUS + 1)) for i in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.expr(f"shiftright({fp}, {edges[i]}) & {(1 << (edges[i + 1] - edges[i])) - 1}L").alias("value")) for i in range(n)])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, _id, _th, item_id, start, n_words, similarity): each document and item with a window at or above the threshold, the
    best window, the earliest among equals.

    The similarity is the weighted Jaccard of five-word shingles with their counts as weights, words lower-cased. Items of fewer
    than five words have no shingles and never match; an item of null id is an item of its own, by text, with a null item_id; a document shorter than an item is one window. Null text has no words; rows equal
    in id and text give one result; empty tables give no rows; other columns are ignored.
    """
    base = keyed(docs)
    items = benchmark.select(F.expr("coalesce(CAST(item_id AS bigint), -9223372036854775808L)").alias("_iid"), F.expr("IF(item_id IS NULL, xxhash64(text), 0L)").alias("_ith"), word_hashes(F.col("text")).alias("w"))
    items = items.withColumn("ish", shingles("w")).where(F.size("ish") > 0).select(*ITEM, F.size("w").alias("len"), "ish").dropDuplicates([*ITEM, "ish"])
    items = written(items, "benchmark-items")
    most = items.agg(F.max(F.size("ish"))).first()[0] or 1
    items = items.withColumn("ifp", simhash("ish", most))
    # A document's places are counted for each item once, however often the item repeats a shingle.
    grams = written(items.select(*ITEM, "len", F.size("ish").alias("m"), F.explode(F.array_distinct("ish")).alias("s")), "benchmark-shingles")
    hashed = base.select(*KEY, word_hashes(F.col("text")).alias("w"))
    places = hashed.select(*KEY, F.size("w").alias("n"), F.posexplode(shingles("w")).alias("pos", "s"))
    hits = places.join(small_or_shuffled(grams), "s")
    # A window of v shingles is at the threshold only if it shares need = t (v + m) / (1 + t) of them with the item's m.
    need = F.expr(f"CAST(ceil({threshold!r}D * (least(m, n - {SHINGLE - 1}) + m) / (1 + {threshold!r}D) - 1e-9) AS INT)")
    near = hits.groupBy(*KEY, *ITEM, "len", "m", "n").agg(F.collect_set("pos").alias("at")).withColumn("need", need).where("size(at) >= need").withColumn("at", F.array_sort("at"))
    # All starts whose window has that many places: those with at[j] as their first place reach from the place before it, or as
    # far left as place j + need - 1 allows, up to at[j].
    low, high = "greatest(0, IF(j = 0, 0, at[j - 1] + 1), at[j + need - 1] - m + 1)", "least(at[j], greatest(n - len, 0))"
    starts = F.expr(f"flatten(transform(sequence(0, size(at) - need), j -> IF({low} <= {high}, sequence({low}, {high}), CAST(array() AS array<int>))))")
    # The last window also counts for places beyond its start.
    near = near.select(*KEY, *ITEM, "len", starts.alias("starts")).where("size(starts) > 0")
    near = written(near, "leak-candidates")
    wanted = written(near.groupBy(*KEY, "len").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "leak-windows")
    texts = base.join(small_or_shuffled(wanted), KEY).select("doc_id", *KEY, "len", "starts", word_hashes(F.col("text")).alias("dw")).withColumn("dsh", shingles("dw"))
    windows = texts.select("doc_id", *KEY, "len", "dsh", F.explode("starts").alias("start")).withColumn("wsh", F.expr(f"slice(dsh, start + 1, len - {SHINGLE - 1})")).drop("dsh")
    windows = written(windows.withColumn("wfp", simhash("wsh", most)), "leak-window-shingles")
    # The multi-index, on fingerprints alone: each pair of a window's and an item's that is within the radius.
    lookup = windows.select("len", "wfp").distinct().withColumn("b", F.explode(_blocks("wfp"))).select("len", "wfp", "b.block", "b.value")
    right = items.select("len", "ifp").distinct().withColumn("b", F.explode(_blocks("ifp"))).select("len", "ifp", "b.block", "b.value")
    within = lookup.join(right, ["len", "block", "value"]).where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("len", "wfp", "ifp").distinct()
    laid = near.select(*KEY, *ITEM, "len", F.explode("starts").alias("start")).join(windows, [*KEY, "len", "start"]).join(items, [*ITEM, "len"])
    plain = F.expr(f"size(ish) < {FEW} OR size(array_distinct(wsh)) < size(wsh) OR size(array_distinct(ish)) < size(ish)")
    laid = laid.withColumn("plain", plain)
    pairs = laid.where("plain").unionByName(laid.where("NOT plain").join(within, ["len", "wfp", "ifp"], "left_semi"))
    shared = F.expr(_SHARED.format(a="wsh", b="ish"))
    scored = pairs.withColumn("c", shared).withColumn("similarity", F.col("c") / (F.size("wsh") + F.size("ish") - F.col("c"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", *KEY, *ITEM).agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "len")).alias("t"))
    item_id = F.when(F.col("_ith") == 0, F.col("_iid")).alias("item_id")
    return best.select("doc_id", *KEY, item_id, (-F.col("t.s")).cast("bigint").alias("start"), F.col("t.len").cast("bigint").alias("n_words"), F.col("t.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents, with all their columns, that hold no passage of the benchmark."""
    found = written(leaks(docs, benchmark, threshold).select(*KEY).distinct(), "leaky-documents")
    return keyed(docs, whole=True).join(small_or_shuffled(found), KEY, "left_anti").select("row.*")
