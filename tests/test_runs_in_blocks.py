"""Runs that are followed in blocks measure as whole runs do."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.slices import Slicing, running, split, whole
from barloom.operators import metrics as m

from .helpers import sessions


def curves(spark):
    """A wild run, one that only rises, one that never recovers, one of a single bar, one flat."""
    rng = random.Random(4)
    rows = []
    for name, n, move in (("wild", 260, lambda k: rng.gauss(0, 0.05)), ("up", 130, lambda k: 0.01), ("down", 90, lambda k: -0.01), ("one", 1, lambda k: 0.0), ("flat", 40, lambda k: 0.0)):
        value = 100.0
        for k, ts in enumerate(sessions(n)):
            value *= 1 + move(k)
            rows.append((name, ts, value, 0.5 if k % 3 else 0.0))
    return spark.createDataFrame(rows, "run_id string, ts timestamp, equity double, gross_exposure double").repartition(3)


def trades(spark):
    rng = random.Random(5)
    rows = [(run, k, sessions(200)[k // 2], pnl, pnl / 5, 3, 1.0, 10.0, 11.0, 0.1) for run, n in (("a", 300), ("b", 7), ("c", 120)) for k in range(n) for pnl in [10.0 if run == "c" else rng.choice([5.0, -5.0, 0.0, 9.0])]]
    return spark.createDataFrame(rows, "run_id string, seq long, exit_ts timestamp, pnl double, r_multiple double, bars_held int, qty double, entry_price double, exit_price double, costs double").repartition(4)


def same(got, want):
    a, b = (sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr) for df in (got, want))
    assert a == b and a


@pytest.mark.parametrize("blocks", [Slicing(1, "week"), Slicing(60, "month")])
def test_curves(spark, blocks):
    equity = curves(spark)
    same(m.drawdowns(equity, blocks), m.drawdowns(equity))
    same(m.drawdown_episodes(equity, blocks), m.drawdown_episodes(equity))
    same(m.equity_metrics(equity, slicing=blocks), m.equity_metrics(equity))


@pytest.mark.parametrize("blocks", [Slicing(1, "week"), Slicing(60, "month")])
def test_streaks(spark, blocks):
    same(m.trade_metrics(trades(spark), blocks), m.trade_metrics(trades(spark)))


def test_running_aggregates_skip_nulls(spark):
    rows = [("A", ts, float(k) if k in (2, 30) else None) for k, ts in enumerate(sessions(50))]
    dealt = split(spark.createDataFrame(rows, "symbol string, ts timestamp, x double"), Slicing(4, "week"), before=3)
    got = whole(running(dealt, {"s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x"))}, ["ts"])).orderBy("ts").collect()
    assert [(r.s, r.hi, r.lo) for r in got] == [(None, None, None)] * 2 + [(2.0, 2.0, 2.0)] * 28 + [(32.0, 30.0, 2.0)] * 20
