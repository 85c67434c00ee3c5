"""Long histories in slices give what whole symbols give."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.features import compute, feature, names
from barloom.functions.recurrences import Mean, add_recurrences, smooth
from barloom.functions.slices import Slicing, buckets, carried, split, whole
from barloom.operators.align import as_of_join

from .helpers import BAR, sessions, walk


def stepped(n, wilder, values):
    """The recurrence value by value."""
    x, seed, broken, seen, out = None, [], False, 0, []
    for v in values:
        if wilder:
            if x is not None:
                x = x if v is None else x + (v - x) / n
            elif v is None:
                broken = broken or bool(seed)
            elif not broken:
                seed.append(v)
                x = sum(seed) / n if len(seed) == n else None
            out.append(x)
        else:
            if v is not None:
                x, seen = v if x is None else x + 2 / (n + 1) * (v - x), seen + 1
            out.append(x if seen >= n else None)
    return out


def same(a, b):
    return (a is None or math.isnan(a)) == (b is None or math.isnan(b)) and (a is None or math.isnan(a) or abs(a - b) <= 1e-9 * max(1, abs(a)))


@pytest.mark.parametrize("n", [1, 2, 3, 14, 200])
@pytest.mark.parametrize("wilder", [False, True])
def test_a_mean_over_any_blocks_is_the_mean_value_by_value(n, wilder):
    rng = random.Random(n)
    for turn in range(60):
        lead, gaps = rng.choice([0, 0, 3, 40]), rng.choice([0, 0.02, 0.3])
        values = [None] * lead + [None if rng.random() < gaps else rng.uniform(-5, 50) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 700]))]
        mean, state, folded, got = Mean(n, wilder), Mean.start, Mean.start, []
        at = 0
        while at < len(values):
            to = at + rng.choice([1, 2, 7, 30, 300])
            v = np.array([math.nan if x is None else x for x in values[at:to]])
            folded = mean.fold(folded, mean.summary(v))
            x, state = mean.apply(v, state)
            got += x.tolist()
            assert folded[0] == state[0] and (state[0] not in (1, 3) or abs(folded[2] - state[2]) <= 1e-9 * max(1, abs(state[2]))) and (wilder or folded[1] == state[1])
            at = to
        assert all(map(same, stepped(n, wilder, values), got)), (turn, n, wilder)


def test_blocks_of_blocks():
    v = np.random.default_rng(1).normal(size=64 * 64 * 3 + 5)
    want, x = [], 2.0
    for a in v:
        x = 0.9 * x + 0.1 * a
        want.append(x)
    assert np.allclose(smooth(v, 0.9, 2.0), want, rtol=1e-12)


def ragged(spark):
    """Walks of different lengths, one bar alone, a flat one, and one without a name."""
    rows = [r for s, n in (("A", 300), ("B", 170), ("C", 1), ("D", 40)) for r in walk(spark, n, (s,), n).collect()]
    rows += [("F", ts, 5.0, 5.0, 5.0, 5.0, 10.0) for ts in sessions(90)]
    rows += [(None, *r[1:]) for r in rows[:60]]
    return spark.createDataFrame(rows, BAR).repartition(3)


def close_to(got, want, columns):
    order = lambda df: sorted(df.collect(), key=lambda r: (r.symbol or "", r.ts))
    a, b = order(got), order(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x.symbol, x.ts) == (y.symbol, y.ts)
        for c in columns:
            assert same(x[c], y[c]), (c, x, y)


@pytest.mark.parametrize("slicing,chosen", [(Slicing(25, "week"), names()), (Slicing(10_000, "year"), ["adx", "structure", "beta"]), (Slicing(1, "week"), ["macd_hist", "supertrend_dir", "adx"])])
def test_every_feature(spark, slicing, chosen):
    wanted = [*map(feature, chosen), feature("structure", k=1), feature("ema", n=3)]
    bars, bench = ragged(spark), walk(spark, 320, ("M",), 9).select("ts", "close")
    close_to(compute(bars, wanted, bench, slicing), compute(bars, wanted, bench), map(str, wanted))


def test_the_session_can_ask_for_slices(spark):
    bars, wanted = walk(spark, 80), [feature("sma", n=5), feature("ema", n=5)]
    try:
        spark.conf.set("spark.barloom.slice.rows", "10")
        got = compute(bars, wanted)
        assert Slicing.of(spark) == Slicing(10, "month") and got.columns == [*bars.columns, "sma(n=5)", "ema(n=5)"]
    finally:
        spark.conf.unset("spark.barloom.slice.rows")
    close_to(got, compute(bars, wanted), ["sma(n=5)", "ema(n=5)"])
    assert Slicing.of(spark) is None


def test_no_task_has_more_than_a_slice_and_its_halo(spark):
    bars = walk(spark, 400, ("A",))
    dealt = split(bars, Slicing(50, "week"), before=20)
    sizes = dealt.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_kept").cast("int")).alias("own")).collect()
    assert len(sizes) >= 7 and all(r.own <= 55 and (r.n - r.own >= 20 or r.symbol.slice == 1) and r.n - r.own <= 25 for r in sizes)
    assert sorted(whole(dealt).collect()) == sorted(bars.collect())


def test_halos_longer_than_slices(spark):
    got = buckets(walk(spark, 100, ("A",)), Slicing(1, "week"), before=42).orderBy("bucket").collect()
    assert [r.slice for r in got] == list(range(1, 21)) and [r.upto for r in got[:3]] == [10, 11, 12]


def test_a_value_is_carried_over_slices_without_one(spark):
    rows = [("A", ts, 1.0 if k == 3 else None) for k, ts in enumerate(sessions(60))] + [("B", sessions(1)[0], None)]
    dealt = split(spark.createDataFrame(rows, "symbol string, ts timestamp, x double"), Slicing(5, "week"))
    got = whole(carried(dealt, ["x"], ["ts"])).orderBy("symbol", "ts").collect()
    assert [r.x for r in got] == [None] * 3 + [1.0] * 57 + [None]


@pytest.mark.parametrize("slicing", [Slicing(1, "week"), Slicing(40, "month")])
def test_as_of_joins(spark, slicing):
    rng = random.Random(2)
    days = sessions(200)
    decisions = spark.createDataFrame([(rng.choice("AB"), rng.choice(days), k) for k in range(300)] + [("N", days[3], -1)], "symbol string, ts timestamp, k long")
    higher = spark.createDataFrame([(rng.choice("ABZ"), rng.choice(days), rng.choice([*days, None]), float(k)) for k in range(60)], "symbol string, ts timestamp, available_at timestamp, close double")
    a, b = (sorted(map(tuple, as_of_join(decisions, higher, ["close"], slicing=s).collect()), key=repr) for s in (None, slicing))
    assert a == b and any(r[-1] is not None for r in a)


def test_an_empty_table(spark):
    none = walk(spark, 5).limit(0)
    assert compute(none, [feature("adx"), feature("structure"), feature("supertrend_dir")], slicing=Slicing(5)).count() == 0 == add_recurrences(none, {"x": ("ema", {"n": 3})}).count()
