"""Scanning many strategies in one projection finds what each finds alone."""

import pytest
from pyspark.sql import functions as F

from barloom.plans.scan import Slot, entries, scan
from barloom.plans.strategy import Condition, Stop, Strategy, TakeProfit, decide, feat, from_dict, trend_baseline, val
from barloom.operators.align import with_availability
from barloom.sources.calendar import weekday_calendar

from .helpers import walk

PORTFOLIO = "portfolio_id int, equity double, cash double, peak_equity double, day_start_equity double, week_start_equity double, consecutive_losses int"
POSITION = "portfolio_id int, symbol string, direction int, qty double, price double, stop double, sector string"


def slots():
    out = [Slot("trend", trend_baseline(), status="ACTIVE"), Slot("short", Strategy("s", direction="short", entry_short=(Condition(feat("close"), "<", feat("sma", n=30)),), stop=Stop("percent", 0.05), take_profit=TakeProfit("r_multiple", 3.0)), health=0.5)]
    for n in range(5, 23):
        out.append(Slot(f"cross {n}", Strategy("c", entry_long=(Condition(feat("close"), ">", feat("sma", n=n)), Condition(feat("rsi"), ">", val(40.0))), stop=Stop("atr", 1.0 + n / 10, 7 + n % 3), rank_by=feat("roc", n=n))))
    return out + [Slot("swing", Strategy("w", entry_long=(Condition(feat("close"), ">", val(0.0)),), stop=Stop("structure"))), Slot("regimes", Strategy("r", entry_long=(Condition(feat("close"), ">", val(0.0)),), stop=Stop("percent", 0.1), allowed_regimes=("BULL",)))]


def test_entries(spark):
    bars = walk(spark, 260, tuple("ABCDE")).withColumn("available_at", F.col("ts")).cache()
    trend = bars.where("symbol = 'A'").select("ts", F.lit("BULL").alias("trend"))
    want = []
    for s in slots():
        rows = decide(s.strategy, bars, trend).orderBy("symbol", F.desc("ts")).dropDuplicates(["symbol"]).where("long_entry or short_entry").collect()
        want += [(s.strategy_id, r.symbol, 1 if r.long_entry else -1, round(r.close, 9), round(r.close - (1 if r.long_entry else -1) * r.stop_dist, 9), s.health) for r in rows]
    got = [(r.strategy_id, r.symbol, r.direction, round(r.entry, 9), round(r.stop, 9), r.strategy_health) for r in entries(bars, slots(), trend).collect()]
    assert sorted(got) == sorted(want) and len({g[0] for g in got}) > 10
    assert "regimes" not in {r.strategy_id for r in entries(bars, slots()).collect()} and entries(bars, []).count() == 0 and entries(bars, slots()[-1:]).count() == 0


def test_portfolios_follow_strategies_by_key(spark):
    cal = weekday_calendar(spark, "2020-12-01", "2022-03-01")
    bars = with_availability(walk(spark, 260, tuple("ABC")), cal, "1d")
    asof = F.lit("2021-12-31 23:00:00").cast("timestamp")
    always = Strategy("a", entry_long=(Condition(feat("close"), ">", val(0.0)),), stop=Stop("percent", 0.05))
    chosen = [Slot("one", always), Slot("two", always), Slot("draft", always, status="RESEARCH")]
    portfolios = spark.createDataFrame([(k, 1e6, 1e6, 1e6, 1e6, 1e6, 0) for k in (1, 2, 3)], PORTFOLIO)
    positions = spark.createDataFrame([(1, "A", 1, 5.0, 100.0, 90.0, None)], POSITION)
    follows = spark.createDataFrame([("one", 1), ("two", 1), ("two", 3), ("draft", 2), ("gone", 2)], "strategy_id string, portfolio_id int")
    found = lambda f: sorted((r.symbol, r.strategy_id, r.portfolio_id) for r in scan(bars, cal, asof, chosen, portfolios, positions, follows=f)[0].collect())
    assert found(follows) == sorted((s, k, p) for s in "ABC" for k, p in (("one", 1), ("two", 1), ("two", 3)))
    assert found(None) == sorted((s, k, p) for s in "ABC" for k in ("one", "two") for p in (1, 2, 3))


def test_json_of_other_makers():
    tree = {"name": "j", "family": "f", "hypothesis": "h", "timeframe": "4h", "entry_long": [{"left": {"feature": "rsi"}, "op": "<", "right": {"value": 27}}]}
    from barloom.plans.strategy import bind

    for given in ({}, {"take_profit": {}}, {"take_profit": None}):
        assert bind(from_dict(tree | given)).target == ("r_multiple", 2.0)
    assert bind(from_dict(tree | {"take_profit": {"kind": "none"}})).target[0] == "none" and bind(from_dict(tree | {"take_profit": {"value": 3}})).target == ("r_multiple", 3.0)
    assert from_dict(tree).timeframe == "4h"
    with pytest.raises(ValueError):
        bind(from_dict(tree | {"timeframe": "5m"}))
