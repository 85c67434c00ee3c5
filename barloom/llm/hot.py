"""Joining rows with what is known of their groups when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group is hot above the lesser of MOST rows and 1/SHARE of all rows, though not below LEAST
MOST, SHARE, LEAST = 100_000, 128, 500
#: Bytes of all hot groups' rows up to which they are broadcast; beyond, they are joined in SALTS parts each
BROADCAST_LIMIT, SALTS = 8 << 20, 64


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: Column, width: Column) -> DataFrame:
    """rows joined with groups on keys (inner), so that no group, however large, lands in one task.

    groups has one row for each value of keys, its number of rows in `size` (not null) and its bytes, about, in `width`.  Hot
    groups are broadcast while their bytes allow; beyond, they go in parts by a hash of `spread`.  All others are joined by shuffle.
    """
    limit = min(MOST, max(LEAST, total // SHARE))
    # by shuffle also where Spark would broadcast: what is cold grows with the input
    hot, cold = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit).hint("merge")
    held = hot.agg(F.sum(width)).first()[0]
    if held is None:
        return rows.join(cold, keys)
    if held <= BROADCAST_LIMIT:
        known = rows.join(F.broadcast(hot), keys, "left")
    else:
        parts = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(parts, [*keys, "_salt"], "left").drop("_salt")
    added = [c for c in groups.columns if c not in keys]
    rest = known.where(F.col(size).isNull()).drop(*added).join(cold, keys)
    return known.where(F.col(size).isNotNull()).unionByName(rest)
