"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._spark import small_or_shuffled, written

#: Slices of the key range within a source, so that a running sum never sees a whole source in one task.
SLICES = 4096
#: A document is taken at most this often.
MAX_EPOCHS = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def letter_share(text: Column) -> Column:
    """A quality weight from the text alone, 0.1 to 1: the share of characters that are not symbols or digits."""
    symbols = F.length(text) - F.length(F.translate(text, "!$%&*#|0123456789_=<>{}[]~^\\/@+", ""))
    return F.coalesce(F.lit(1.0) - 0.9 * symbols / F.nullif(F.length(text), F.lit(0)), F.lit(1.0))


def targets(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, source_size) -> target. Sources by code point, null last, weigh 1..cycle in turn and share all words; a
    target stops at MAX_EPOCHS times its source, the excess reshared by weight. Closed form of that resharing: the target
    is min(cap, level * weight); sources reach their cap in order of cap / weight. One row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("w", (F.row_number().over(order) - 1) % cycle + 1).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every),
        "cap_before": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_before": F.coalesce(F.sum("w").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    # With the sources before this one at their caps, the level that it and the rest would share. The level is that of the
    # first source whose cap is above its share; from there on no cap binds.
    share = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("all_w") - F.col("w_before"))
    fill = (F.col("cap") / F.col("w")).cast("double")
    s = s.withColumns({"share": share, "fill": fill})
    s = s.withColumn("level", F.min_by("share", F.when(F.col("fill") > F.col("share"), F.col("fill"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, seed: int = 17, text: str = "text") -> DataFrame:
    """Choose how often each document is taken, so that each source's words come to its target.

    Whole epochs of a source come first; the fraction that is left takes documents by exponential keys -ln(u)/weight in
    ascending order until the prefix sum of words is nearest the budget. u depends on seed and doc_id, so reruns agree.
    Returns doc_id, source, size, source_size, target, epochs and taken (words, repeats counted). Null text has size 0, null source
    is a source of its own, a null or non-positive weight counts as the smallest; repeated rows are rows of their own; an
    empty table gives no rows; other columns are ignored.
    """
    w = letter_share(F.col(text)) if weight is None else weight
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source"), word_count(F.col(text)).alias("size"), F.greatest(w.cast("double"), F.lit(1e-3)).alias("w"))
    u = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    rows = written(rows.withColumn("key", -F.log(u) / F.coalesce("w", F.lit(1e-3))).drop("w"), "mixing-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes).withColumn("whole", F.least(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(MAX_EPOCHS)))
    goal = goal.withColumn("whole", F.coalesce("whole", F.lit(0))).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = written(goal.withColumnRenamed("source", "_source"), "mixing-targets")
    part = F.floor((1 - F.exp(-F.col("key"))) * SLICES).cast("int")
    rows = rows.withColumn("slice", F.least(part, F.lit(SLICES - 1)))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(ahead), F.lit(0)))
    slices = slices.select(F.col("source").alias("_s"), F.col("slice").alias("_slice"), "before")
    within = Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    rows = rows.join(slices.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_slice")))
    rows = rows.join(small_or_shuffled(goal), F.col("source").eqNullSafe(F.col("_source")))
    upto = F.col("before") + F.col("upto")
    # A document is in if more than half of it lies below the budget: the sum ends nearest the budget.
    chosen = (F.col("budget") > 0) & (upto - F.col("size") / 2.0 <= F.col("budget")) & (F.col("whole") < MAX_EPOCHS)
    epochs = F.col("whole").cast("bigint") + chosen.cast("bigint")
    return rows.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"))
