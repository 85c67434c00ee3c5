"""Ranks and chunks by counts of values are those of one window."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import selection
from barloom.operators.selection import ic_stability, rank_ic, redundancy

from .helpers import sessions


def table(spark, n=600):
    """A flag of which most values are equal, rounded and unique values, a constant, nulls, and times shared by symbols."""
    rng = random.Random(3)
    days = sessions(200)
    rows = []
    for k in range(n):
        y = rng.gauss(0, 1)
        rows.append(("ABC"[k % 3], days[k // 3], float(rng.random() < 0.1), round(y + rng.gauss(0, 2), 1), y * 3 + rng.gauss(0, 1), 5.0, None if k % 9 else y, None if k % 50 == 0 else y))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, flag double, coarse double, fine double, same double, rare double, label double")


FEATURES = ["flag", "coarse", "fine", "same", "rare"]


@pytest.mark.parametrize("hot", [4096, 4])
def test_counted_ranks(spark, monkeypatch, hot):
    rows = table(spark)
    run = lambda: [sorted(map(tuple, df.collect()), key=repr) for df in (rank_ic(rows, FEATURES), rank_ic(rows, FEATURES, groups=("symbol",)), ic_stability(rows, FEATURES, chunks=4), redundancy(rows, FEATURES, 0.1))]
    want = run()
    monkeypatch.setattr(selection, "ONE_WINDOW", 0)
    monkeypatch.setattr(selection, "HOT", hot)
    for a, b in zip(run(), want, strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, abs=1e-12, nan_ok=True) if not isinstance(x[0], str) else x[:1] == y[:1] and [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)] and [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)], abs=1e-12)


def test_ranks_against_pandas(spark):
    rows = table(spark)
    known = rows.toPandas()
    got = {r.feature: r.ic for r in rank_ic(rows, FEATURES).collect()}
    for f in ("flag", "coarse", "fine", "rare"):
        both = known[[f, "label"]].dropna()
        assert abs(got[f] - both[f].rank().corr(both["label"].rank())) < 1e-12
    assert got["same"] is None


def test_a_flag_is_two_rows(spark):
    counts = selection.counted(table(spark).withColumn("k", F.lit(1)), "flag", ["k"]).orderBy("flag").collect()
    assert [r.flag for r in counts] == [0.0, 1.0] and counts[0]._upto == counts[0]._n and counts[1]._upto == counts[1]._all == 600


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 100, 1000, 1021])
def test_keyed_permutations(spark, n):
    rows = spark.range(n).select(F.col("id").alias("k"), F.explode(F.array(*map(F.lit, ("a", "b")))).alias("key"), F.lit(7).alias("turn"))
    got = {}
    for r in rows.select("key", "k", selection.permuted(F.col("k"), n, F.col("key"), F.col("turn")).alias("p")).collect():
        got.setdefault(r.key, {})[r.k] = r.p
    assert all(sorted(x.values()) == list(range(n)) for x in got.values()) and (n < 100 or sum(got["a"][k] == got["b"][k] for k in range(n)) < n / 10 and sum(got["a"][k] == k for k in range(n)) < n / 10)


def test_row_numbers_have_no_gaps(spark):
    rows, n = selection.row_numbers(spark.range(1000).repartition(7), "k")
    assert n == 1000 and sorted(r.k for r in rows.collect()) == list(range(1000)) and selection.row_numbers(spark.range(0), "k")[1] == 0


def test_importance_against_pandas(spark):
    """The same fits and shuffles by pandas and numpy."""
    import numpy as np

    features = ["coarse", "fine", "flag"]
    rows = table(spark, 500).dropna(subset=["label"])
    train, test = rows.where("ts < '2021-06-01'"), rows.where("ts >= '2021-06-01'")
    got = {r.feature: r for r in selection.importance(train, test, features, repeats=3).collect()}
    a, b = train.toPandas(), test.toPandas()
    mean, sd = a[features].mean(), a[features].std()

    def fit(names):
        x = np.column_stack([np.ones(len(a)), *[(a[f] - mean[f]) / sd[f] for f in names]])
        return np.linalg.solve(x.T @ x + np.diag([0.0] + [1.0] * len(names)), x.T @ a["label"])

    ic = lambda p: p.rank().corr(b["label"].rank())
    z = (b[features] - mean) / sd
    w = fit(features)
    base = ic(w[0] + z[features] @ w[1:])
    for f in features:
        rest = [x for x in features if x != f]
        v = fit(rest)
        assert got[f].ablation == pytest.approx(base - ic(v[0] + z[rest] @ v[1:]), abs=1e-9)
    assert got["fine"].permutation > 0.5 > abs(got["flag"].permutation) and got["fine"].permutation <= base + 0.3
    again = {r.feature: r.permutation for r in selection.importance(train.repartition(3), test, features, repeats=3).collect()}
    assert again == pytest.approx({f: r.permutation for f, r in got.items()}, abs=1e-9)


def test_selection_drops_the_weaker_of_a_pair(spark):
    rows = table(spark).withColumn("twin", F.col("fine") * 2 + 1).withColumn("noise", F.xxhash64("ts", "symbol", "fine") % 1000 / 1.0)
    got = selection.select(rows, ["fine", "twin", "noise", "same"], min_ic=0.2, max_rho=0.95)
    assert sorted([got["fine"], got["twin"]]) == ["kept", "redundant"] and got["noise"] == got["same"] == "weak"
