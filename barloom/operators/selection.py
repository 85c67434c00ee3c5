"""Evaluating features against forward returns, on a long table (symbol, ts, features.., label)."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import by_symbol, correlation, ratio
from ..plans.state import cut


def forward_return(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """Add label: the return over the next `horizon` bars.  The only operator that looks ahead."""
    return bars.withColumn("label", ratio(F.lead("close", horizon).over(by_symbol()), F.col("close")) - 1)


#: Parts that a key's values are dealt into, by value, before they are summed up
PARTS = 128
#: Rows up to which each key is ranked by one window.  Beyond, values are counted first, and parts of them summed: results are the same
ONE_WINDOW = 2_000_000
#: A value is hot above this share of all rows, so there are at most so many of them; hot values' ranks are broadcast
HOT = 4096


def _placed(counts: DataFrame, value: str, key: list[str]) -> DataFrame:
    """counts (key, value, _n) with _part, which ascends in value within a key, _before, the rows of lower parts, and _all, the key's rows.

    Parts are cut at approximate quantiles, so no task orders a key's whole history.
    """
    edges = counts.groupBy(*key).agg(F.percentile_approx(value, F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), 1000).alias("_edges"))
    dealt = counts.join(edges, key).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    sizes = dealt.groupBy(*key, "_part").agg(F.sum("_n").alias("_rows"))
    before = (F.sum("_rows").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_rows")).alias("_before")
    return dealt.join(sizes.select(*key, "_part", before, F.sum("_rows").over(Window.partitionBy(*key)).alias("_all")), [*key, "_part"])


def counted(rows: DataFrame, value: str, key: list[str]) -> DataFrame:
    """One row for each value of a key, with _n, its rows, _upto, the rows up to it, and _all: a flag is two rows, however many there are of it."""
    placed = _placed(rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n")), value, key)
    inside = Window.partitionBy(*key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside)).drop("_part", "_before")


def _met(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows with the columns of table (_n and others, by value): hot values by broadcast, the others by shuffle."""
    table = cut(table)
    limit = total // HOT
    known = rows.join(F.broadcast(table.where(F.col("_n") > limit)), on, "left")
    cold = known.where("_n is null").select(rows.columns).join(table.where(F.col("_n") <= limit).hint("merge"), on)
    return known.where("_n is not null").unionByName(cold)


def _ranked(rows: DataFrame, ranks: dict[str, str], key: list[str], total: int) -> DataFrame:
    """rows with a column of ranks within key for each value, ties at their mean."""
    for out, value in ranks.items():
        if total <= ONE_WINDOW:
            ties = F.count(F.lit(1)).over(Window.partitionBy(*key, value))
            rows = rows.withColumn(out, F.rank().over(Window.partitionBy(*key).orderBy(value)) + (ties - 1) / 2.0)
        else:
            table = counted(rows, value, key).select(*key, value, "_n", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
            rows = _met(rows, table, [*key, value], total).drop("_n")
    return rows


def _chunked(rows: DataFrame, key: list[str], time: str, tie: str, chunks: int, total: int) -> DataFrame:
    """rows with chunk, 1 to chunks: runs of time of equal size, of which the first are one longer."""
    if total <= ONE_WINDOW:
        return rows.withColumn("chunk", F.ntile(chunks).over(Window.partitionBy(*key).orderBy(time, tie)))
    placed = _met(rows, counted(rows, time, key), [*key, time], total)
    at = F.col("_upto") - F.col("_n") + F.row_number().over(Window.partitionBy(*key, time).orderBy(tie))
    base = F.floor(F.col("_all") / chunks)
    longer = (F.col("_all") % chunks) * (base + 1)
    chunk = F.when(at <= longer, F.ceil(at / (base + 1))).otherwise(F.col("_all") % chunks + F.ceil((at - longer) / F.greatest(base, F.lit(1))))
    return placed.withColumn("chunk", chunk.cast("int")).drop("_n", "_upto", "_all")


def _long(rows: DataFrame, features: list[str], label: str, *keep: str, name: str = "feature") -> DataFrame:
    """One row per feature and observation where both values are known."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias(name), F.col(f"`{f}`").alias("x")) for f in features]))
    return rows.select(*keep, F.col(label).alias("y"), pairs.alias("p")).select(*keep, f"p.{name}", "p.x", "y").where("x is not null and y is not null")


def rank_ic(rows: DataFrame, features: list[str], label: str = "label", groups: tuple[str, ...] = (), least: int = 30, name: str = "feature") -> DataFrame:
    """feature (per groups), n, ic: Spearman correlation with the label; NULL under `least` observations.  name: what the column of features is called."""
    long = cut(_long(rows, features, label, *groups, name=name))
    key = [*groups, name]
    ranked = _ranked(long, {"rx": "x", "ry": "y"}, key, long.count())
    return ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("rx"), F.col("ry")).alias("ic")).withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def ic_stability(rows: DataFrame, features: list[str], label: str = "label", chunks: int = 5) -> DataFrame:
    """feature, ic_mean, ic_sd, sign_consistency over contiguous chunks of time; the first chunks are one longer."""
    long = cut(_long(rows, features, label, "symbol", "ts"))
    key, total = ["feature", "chunk"], long.count()
    ranked = _ranked(_chunked(long, ["feature"], "ts", "symbol", chunks, total), {"rx": "x", "ry": "y"}, key, total)
    per = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("rx"), F.col("ry")).alias("ic")).where("n >= 30 and ic is not null")
    return per.groupBy("feature").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_sd"), F.greatest(F.avg((F.col("ic") > 0).cast("double")), F.avg((F.col("ic") < 0).cast("double"))).alias("sign_consistency"))


def redundancy(rows: DataFrame, features: list[str], threshold: float = 0.9) -> DataFrame:
    """a, b, rho of feature pairs whose rank correlation is at least threshold either way, strongest first."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in combinations(sorted(features), 2)]))
    long = cut(rows.select(pairs.alias("p")).select("p.*").where("x is not null and y is not null"))
    ranked = _ranked(long, {"rx": "x", "ry": "y"}, ["a", "b"], long.count())
    return ranked.groupBy("a", "b").agg(correlation(F.col("rx"), F.col("ry")).alias("rho")).where(F.abs("rho") >= threshold).orderBy(F.abs("rho").desc(), "a", "b")


def ridge(rows: DataFrame, features: list[str], label: str = "label", penalty: float = 1.0) -> dict:
    """Coefficients of a ridge fit, its intercept free of penalty: sums of products in one aggregation, solved on the driver."""
    known = rows.select(*[F.col(f"`{f}`").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).alias("y")).dropna()
    cols = ["1", *[f"x{i}" for i in range(len(features))], "y"]
    at = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = known.agg(*[F.sum(F.expr(f"cast({cols[i]} as double) * {cols[j]}")).alias(f"s{i}_{j}") for i, j in at]).first()
    full = np.zeros((len(cols), len(cols)))
    for i, j in at:
        full[i, j] = full[j, i] = sums[f"s{i}_{j}"] or 0.0
    n = len(features) + 1
    left = full[:n, :n] + penalty * np.diag([0.0] + [1.0] * len(features))
    solved = np.linalg.solve(left, full[:n, n])
    return {"intercept": float(solved[0]), "coef": dict(zip(features, map(float, solved[1:]), strict=True))}


def predict(rows: DataFrame, fit: dict) -> DataFrame:
    """Add prediction."""
    return rows.withColumn("prediction", sum((F.col(f"`{f}`") * c for f, c in fit["coef"].items()), F.lit(fit["intercept"])))


#: Rounds of a permutation, and walks back into its domain: a walk ends outside with a chance of about 1 / sqrt(n)
ROUNDS, WALKS, FEW_ROWS = 6, 16, 10_000


def permuted(k: Column, n: int, *key: Column) -> Column:
    """A permutation of 0 .. n - 1 for each value of key, by arithmetic alone: a Feistel network on pairs of digits that just hold n, walked until it is back below n.

    Rows are shuffled by a join on this number, in parts, without an order of all of them.
    """
    a = math.isqrt(max(n - 1, 0)) + 1
    b = -(-max(n, 1) // a)

    def turn(pair: Column, i: Column) -> Column:
        left = F.pmod(pair.l + F.xxhash64(pair.r, i, *key) % a, F.lit(a))
        right = F.pmod(pair.r + F.xxhash64(pair.l, i, *key) % b, F.lit(b))
        return F.when(i % 2 == 0, F.struct(left.alias("l"), pair.r.alias("r"))).otherwise(F.struct(pair.l.alias("l"), right.alias("r")))

    def step(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("long").alias("l"), (v % b).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda p: p.l * b + p.r)

    walks = F.sequence(F.lit(1), F.lit(64 if n < FEW_ROWS else WALKS))
    return F.aggregate(walks, step(k.cast("long")), lambda v, _: F.when(v >= n, step(v)).otherwise(v))


def row_numbers(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """rows (cut) with numbers from 0 without gaps, and how many there are: a partition's rows follow those of the partitions before."""
    held = cut(rows.withColumn("_id", F.monotonically_increasing_id()))
    sizes = held.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    line = Window.orderBy("_part")  # a row a partition
    starts = cut(sizes.select("_part", (F.sum("_n").over(line) - F.col("_n")).alias("_start"), "_n"))
    total = starts.agg(F.sum("_n")).first()[0] or 0
    met = held.join(F.broadcast(starts.select("_part", "_start")), F.shiftright("_id", 33) == F.col("_part"))
    return met.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start"), total


def importance(train: DataFrame, test: DataFrame, features: list[str], label: str = "label", repeats: int = 10, seed: int = 0) -> DataFrame:
    """feature, permutation, ablation: loss of rank correlation on test when a feature is shuffled, or left out of the fit.

    Features are standardised by the training table.  All shuffles of all features are one join, of each row's number under a keyed permutation with the row of that
    number; since the fit is linear, a shuffle changes a prediction by the feature's coefficient times the change of the feature.
    """
    stats = train.agg(*[F.avg(f"`{f}`").alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_samp(f"`{f}`").alias(f"d{i}") for i, f in enumerate(features)]).first()
    scale = lambda df: df.select("symbol", "ts", label, *[((F.col(f"`{f}`") - stats[f"m{i}"]) / (stats[f"d{i}"] or 1.0)).alias(f) for i, f in enumerate(features)]).dropna()
    fitted = cut(scale(train))
    fit = ridge(fitted, features, label)
    rests = {f: ridge(fitted, [x for x in features if x != f], label) for f in features} if len(features) > 1 else {}
    # numbered in order of time and symbol, range by range, so a shuffle is the same however rows are dealt
    held, n = row_numbers(cut(predict(scale(test), fit)).repartitionByRange("ts", "symbol").sortWithinPartitions("ts", "symbol", label), "_k")
    held = held.withColumnRenamed("prediction", "_base")
    known = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("x"), F.lit(fit["coef"][f]).alias("c")) for f in features])
    long = held.select("_k", F.col(label).alias("y"), "_base", F.explode(known).alias("p")).select("_k", "y", "_base", "p.*")
    asked = long.withColumn("turn", F.explode(F.sequence(F.lit(seed), F.lit(seed + repeats - 1))))
    asked = asked.withColumn("_from", permuted(F.col("_k"), n, F.col("feature"), F.col("turn")))
    given = long.select(F.col("feature").alias("_feature"), F.col("_k").alias("_from"), F.col("x").alias("_x"))
    moved = asked.join(given, (asked.feature == F.col("_feature")) & (asked._from == given._from)).select("feature", "turn", "y", (F.col("_base") + F.col("c") * (F.col("_x") - F.col("x"))).alias("prediction"))
    shuffled = rank_ic(moved, ["prediction"], "y", ("feature", "turn"), least=2, name="of").groupBy("feature").agg(F.avg(F.coalesce("ic", F.lit(0.0))).alias("shuffled"))
    score = lambda df: rank_ic(df, ["prediction"], label, least=2).first()
    whole = score(held.withColumnRenamed("_base", "prediction"))
    base = (whole and whole.ic) or 0.0
    without = [(f, base - ((r.ic if (r := score(predict(held, rests[f]))) else None) or 0.0) if rests else base) for f in features]  # a fit for each feature
    left = train.sparkSession.createDataFrame(without, "feature string, ablation double")
    return left.join(shuffled, "feature", "left").select("feature", (F.lit(base) - F.coalesce("shuffled", F.lit(0.0))).alias("permutation"), "ablation")


def select(rows: DataFrame, features: list[str], label: str = "label", min_ic: float = 0.01, min_consistency: float = 0.6, max_rho: float = 0.9) -> dict[str, str]:
    """feature -> kept, weak, unstable or redundant; of a redundant pair the one with the weaker IC goes, strongest pairs first."""
    found = {r.feature: r for r in ic_stability(rows, features, label).collect()}  # one row a feature
    out = {}
    for f in features:
        r = found.get(f)
        out[f] = "weak" if r is None or abs(r.ic_mean) < min_ic else "unstable" if r.sign_consistency < min_consistency else "kept"
    for r in redundancy(rows, [f for f in features if out[f] == "kept"], max_rho).collect() if sum(v == "kept" for v in out.values()) > 1 else []:
        if out[r.a] == out[r.b] == "kept":
            out[r.a if abs(found[r.a].ic_mean) < abs(found[r.b].ic_mean) else r.b] = "redundant"
    return out
