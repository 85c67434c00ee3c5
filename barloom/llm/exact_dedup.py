"""Exact dedup by distributed MSD radix partitioning.

Texts are split on successive digits: first the byte length with the leading 64 bytes, then runs of
bytes eight times as long at each level.  A group that is a singleton, or whose bytes have all been
read, leaves; only the rest goes to the next level, and carries only its unread bytes.  Groups are
told apart by the bytes themselves, never by a digest.

A level is an aggregation by (group, digit), combined before its shuffle, and a join back that splits
groups too large for a task (see hot).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import join_groups
from .shared import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _level(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with n, keep_id and next_grp of their group by keys."""
    groups = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id")).withColumn("next_grp", F.monotonically_increasing_id()))
    return join_groups(rows, groups, keys, "n", total, F.col("doc_id"), F.octet_length(keys[-1]) + 32)


def exact_groups(docs: DataFrame, first: int = 64, factor: int = 8) -> DataFrame:
    """Group rows whose texts are identical after lower-casing A-Z only.

    One row per row of docs (doc_id, text): doc_id, keep_id (largest doc_id of the group),
    group_size, kept, text_sha256.  A null text counts as empty, and all empty texts are equal.  If
    rows of a group repeat the largest doc_id, each of them is kept = true.  A null doc_id is smaller than any
    other.  Texts of any length are read whole, and an empty table gives no rows.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    folded = F.when(text.rlike("[A-Z]"), F.translate(text, _UPPER, _LOWER)).otherwise(text)
    # lower() agrees with folding A-Z on pure ASCII and is much faster
    folded = F.when(text.rlike("[^\\x00-\\x7F]"), folded).otherwise(F.lower(text))
    rows = docs.select("doc_id", folded.cast("binary").alias("rest"))
    rows = rows.select("doc_id", F.sha2("rest", 256).alias("text_sha256"), F.octet_length("rest").alias("grp"), F.substring("rest", 1, first).alias("digit"), "rest")
    total = docs.count()
    done, size = [], first
    while True:
        found = _level(rows, ["grp", "digit"], total)
        ended = F.octet_length("rest") <= size
        out = found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256", (F.col("n") == 1).alias("single"), ended.alias("ended"), F.col("next_grp").alias("grp"), F.when((F.col("n") > 1) & ~ended, F.expr(f"substring(rest, {size + 1})")).alias("rest"))
        level = cut(out)
        done.append(level.where("single or ended").select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
        rows = level.where("not (single or ended)")
        total = rows.count()
        if not total:
            return reduce(DataFrame.unionByName, done)
        size *= factor
        rows = rows.select("doc_id", "text_sha256", "grp", F.substring("rest", 1, size).alias("digit"), "rest")
