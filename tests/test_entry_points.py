"""From CSV files to features and trades."""

import pytest

from barloom.plans import entry
from barloom.plans.strategy import Condition, Stop, Strategy, feat, val
from barloom.sources.calendar import weekday_calendar

from .helpers import sessions


def test_ingest_to_backtest(spark, tmp_path):
    days = sessions(60)
    (tmp_path / "csv" / "1d").mkdir(parents=True)
    for name, base in (("AAA", 100), ("BBB", 50)):
        rows = [f"{d:%Y-%m-%d},{base + k % 7},{base + k % 7 + 2},{base + k % 7 - 2},{base + k % 7 + 1},{0 if name == 'BBB' and k == 3 else 1000000}" for k, d in enumerate(days) if not (name == "BBB" and k % 3 == 0)]
        (tmp_path / "csv" / "1d" / f"{name}.csv").write_text("\n".join(["ts,open,high,low,close,volume", *rows]))
    cal = weekday_calendar(spark, "2021-01-01", "2021-06-01")
    store = str(tmp_path / "store")
    for _ in range(2):
        got = entry.ingest(spark, str(tmp_path / "csv"), store, ["AAA", "BBB"], cal, str(days[-1]))
    assert [r.symbol for r in got.failed.collect()] == ["BBB"] and entry.symbols(spark, store) == ["AAA"]
    shown = entry.features_as_of(spark, store, "AAA", "sma:5, rsi:14, inside_bar", asof=f"{days[29]:%Y-%m-%d} 23:00:00").collect()
    assert len(shown) == 30 and shown[-1]["sma(n=5)"] is not None and "rsi(n=14)" in shown[0].asDict()
    s = Strategy("up", entry_long=(Condition(feat("close"), ">", val(103.5)),), stop=Stop("percent", 0.02))
    trades, equity, _ = entry.backtest(spark, store, s, ["AAA"])
    assert trades.count() > 0 and equity.count() == 60
    with pytest.raises(KeyError):
        entry.features_of("nothing:3")
