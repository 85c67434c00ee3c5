"""Mixing sources to target weights, by Efraimidis-Spirakis sampling; DataFrame functions only.

Each source gets a target of words.  A source's whole documents are taken as many full epochs as fit
in the target; the rest of the target is drawn without replacement: documents sorted by the
exponential key -ln(u) / w (u from a hash of doc_id, w the document's quality weight), sizes summed
in that order up to the budget.  The sum runs in two levels, bins of the key first, so a source
with a third of all rows is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words as the corpus tables count them
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the SHA-256 of seed and id: the first 52 bits, centred."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Add target to one row per source (source, source_size).

    Sources in order of code point, null last, weigh weights[0], weights[1], .. in turn, and share
    `share` times all sizes; a target stops at `most` times its source's size, and what it leaves is shared again.
    In the order of most * size / weight, the sources that stop are a leading run, so one pass finds them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("left", F.col("goal") - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rate", F.col("left") / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    # the first source that does not stop sets the rate of all after it
    level = F.first(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("rate")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("target", F.coalesce(level * F.col("weight"), F.col("cap"))).select("source", "source_size", "target")


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, bins: int = 1024, size: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, source, text; size names a column of word counts to use instead of counting.  quality: doc_id, weight > 0, one row per doc_id; others weigh 1.
    One row per row of docs: doc_id, size, source, source_size, target, taken, a multiple of size.
    A source's taken words are within half a document of its target, when that document's words straddle it.
    A null text has no words; a null source is a source; rows that repeat a doc_id have the
    same key and are drawn one after the other, by size, then by the columns of docs named in `more`, which come along.  An empty table gives no rows, a source without words a target of 0.
    """
    rows = docs.select("doc_id", "source", (F.col(size).cast("long") if size else word_count(F.col("text"))).alias("size"), *more)
    if quality is not None:
        rows = rows.join(quality.select(F.col("doc_id"), F.col("weight").alias("quality_weight")), "doc_id", "left")
    else:
        rows = rows.withColumn("quality_weight", F.lit(1.0))
    key = -F.ln(_uniform(F.col("doc_id"), seed)) / F.coalesce("quality_weight", F.lit(1.0))
    # 1 - exp(-key) spreads the keys evenly; any rising map into bins keeps their order
    rows = rows.withColumn("key", key).withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * bins), F.lit(bins - 1)).cast("int"))
    by_bin = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), list(weights), share, most)
    earlier = Window.partitionBy("source").orderBy("bin")
    plan = by_bin.withColumn("before", F.sum("bin_size").over(earlier) - F.col("bin_size")).withColumnRenamed("source", "s").withColumnRenamed("bin", "b")
    plan = plan.join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    inside = Window.partitionBy("s", "b").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", *more).rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    joined = joined.withColumn("epochs", epochs).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    # a document is drawn if at least half of it lies within the budget
    drawn = F.col("upto") - F.col("size") / 2 <= budget
    taken = (F.col("epochs") + F.when(drawn & (budget > 0), 1).otherwise(0)) * F.col("size")
    return joined.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *more)
