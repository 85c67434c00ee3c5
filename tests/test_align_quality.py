"""Calendar, availability, resampling, as-of, adjustment, point-in-time facts, stores and quality rules."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barloom.operators import align
from barloom.operators.quality import Limits, validate
from barloom.sources import bars as src
from barloom.sources.calendar import early_closes, exchange_calendar, holidays, weekday_calendar

from .helpers import BAR, micro, sessions, values


def test_exchange_days(spark):
    assert date(2021, 4, 2) in holidays(2021) and date(2022, 6, 20) in holidays(2022) and date(2021, 12, 24) in holidays(2021)
    assert date(2022, 1, 1) not in {d for d in holidays(2022) if d.weekday() < 5} and date(2021, 12, 31) not in holidays(2021)
    assert date(2021, 11, 26) in early_closes(2021)
    rows = {r.session: r for r in exchange_calendar(spark, date(2021, 11, 1), date(2021, 11, 30)).collect()}
    assert rows[date(2021, 11, 26)].close_at == datetime(2021, 11, 26, 18) and rows[date(2021, 11, 29)].close_at == datetime(2021, 11, 29, 21)
    assert date(2021, 11, 25) not in rows and len(rows) == 21
    assert exchange_calendar(spark, date(2021, 1, 1), date(2021, 12, 31)).count() == 252


def test_availability(spark):
    cal = exchange_calendar(spark, date(2021, 11, 22), date(2021, 12, 3))
    daily = spark.createDataFrame([("X", datetime(2021, 11, d), 1.0, 1.0, 1.0, 1.0, 1.0) for d in (25, 26)], BAR)
    assert [r.available_at for r in align.with_availability(daily, cal, "1d").orderBy("ts").collect()] == [None, datetime(2021, 11, 26, 18)]
    hours = spark.createDataFrame([("X", datetime(2021, 11, 26, h, 30), 1.0, 1.0, 1.0, 1.0, 1.0) for h in (14, 17, 20)], BAR)
    assert [r.available_at for r in align.with_availability(hours, cal, "1h").orderBy("ts").collect()] == [datetime(2021, 11, 26, 15, 30), datetime(2021, 11, 26, 18), None]


def test_seven_hours_make_two_blocks(spark):
    bars = spark.createDataFrame([("X", datetime(2021, 1, 4, 14 + k, 30), float(k), k + 1.0, k - 1.0, k + 0.5, 1.0) for k in range(7)], BAR)
    got = align.to_four_hours(bars).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(0.0, 4.0, -1.0, 3.5, 4.0), (4.0, 7.0, 3.0, 6.5, 3.0)]


def test_as_of_takes_ties_and_keeps_repeats(spark):
    t = lambda h: datetime(2021, 1, 4, h)
    decisions = spark.createDataFrame([("X", t(1), 1), ("X", t(3), 2), ("X", t(3), 2), ("Y", t(9), 3)], "symbol string, ts timestamp, k int")
    higher = spark.createDataFrame([("X", t(0), t(2), 10.0), ("X", t(1), t(3), 20.0), ("X", t(2), None, 99.0), ("X", t(0), t(3), 15.0)], "symbol string, ts timestamp, available_at timestamp, close double")
    got = sorted((r.k, r.close_htf) for r in align.as_of_join(decisions, higher, ["close"]).collect())
    assert got == [(1, None), (2, 20.0), (2, 20.0), (3, None)]


def test_adjustment(spark):
    bars = micro(spark, [(100, 100, 100, 100)] * 5 + [(25, 25, 25, 25)] * 5)
    days = sessions(10)
    split = spark.createDataFrame([("X", days[5].date(), "split", 4.0)], "symbol string, ex_date date, kind string, value double")
    got = align.adjust(bars, split).orderBy("ts").collect()
    assert all(abs(r.close - 25) < 1e-9 for r in got) and got[0].volume == pytest.approx(4e6) and got[0].raw_close == 100 and got[-1].adj_factor == 1
    dividend = spark.createDataFrame([("X", days[5].date(), "dividend", 1.0), ("X", date(2000, 1, 1), "split", 9.0)], split.schema)
    assert align.adjust(bars, dividend, total=True).orderBy("ts").first().close == pytest.approx(99.0)
    assert align.adjust(bars, dividend).orderBy("ts").first().close == 100.0
    bad = spark.createDataFrame([("X", days[5].date(), "split", -1.0)], split.schema)
    with pytest.raises(Exception, match="positive"):
        align.adjust(bars, bad).collect()


def test_members_and_facts(spark):
    m = spark.createDataFrame([("u", "OLD", date(2010, 1, 1), date(2015, 6, 1)), ("u", "NEW", date(2015, 6, 1), None), ("u", "STAY", date(2000, 1, 1), None)], "universe string, symbol string, start_date date, end_date date")
    at = lambda d: [r.symbol for r in align.members(m, "u", d).collect()]
    assert at("2012-01-01") == ["OLD", "STAY"] and at("2020-01-01") == ["NEW", "STAY"] and at("2015-06-01") == ["NEW", "STAY"]
    assert align.has_history(m, "u") and not align.has_history(m.where("end_date is null"), "u")
    f = spark.createDataFrame([("eps", 1.0, datetime(2021, 4, 28, 20, 5), 1), ("eps", 2.0, datetime(2021, 5, 28), 2)], "metric string, value double, available_at timestamp, id int")
    seen = lambda t: [r.value for r in align.latest_facts(f, F.lit(t).cast("timestamp"), ["metric"], ["available_at", "id"]).collect()]
    assert seen("2021-04-28 19:00:00") == [] and seen("2021-04-28 21:00:00") == [1.0] and seen("2021-06-01") == [2.0]


def test_csv_and_store(spark, tmp_path):
    (tmp_path / "1d").mkdir()
    (tmp_path / "1d" / "ABC.csv").write_text("ts,open,high,low,close,volume\n2021-01-04,1,2,0.5,1.5,10\n2021-01-05,x,2,0.5,nan,10\n2021-01-06,3,4,2,3,5\n")
    bars = src.read_csv_bars(spark, str(tmp_path), "1d", ["ABC"], end="2021-01-05")
    assert values(bars, "open") == [1.0, None] and values(bars, "close") == [1.5, None] and values(bars, "symbol") == ["ABC", "ABC"]
    with pytest.raises(Exception):
        src.read_csv_bars(spark, str(tmp_path), "1d", ["NONE"]).collect()
    assert src.read_csv_actions(spark, str(tmp_path), "ABC").count() == 0 and src.supported_timeframes(spark, str(tmp_path)) == ["1d"]
    with pytest.raises(ValueError):
        align.canonical(bars.drop("open"), "1d")
    store = str(tmp_path / "store")
    first = micro(spark, [(k, k, k, k) for k in range(1, 11)])
    src.store_bars(first, store, "1d")
    src.store_bars(micro(spark, [(k, k, k, k) for k in range(1, 3)], "Y"), store, "1d")
    new = first.where(F.col("ts").between(sessions(10)[3], sessions(10)[5])).withColumn("close", F.lit(77.0))
    for _ in range(2):  # a second time changes nothing
        src.store_bars(new, store, "1d")
    got = values(src.load_bars(spark, store, "X", "1d"), "close")
    assert got == [1.0, 2.0, 3.0, 77.0, 77.0, 77.0, 7.0, 8.0, 9.0, 10.0]
    assert src.load_bars(spark, store, start="2021-01-05").where("symbol = 'Y'").count() == 1


def test_quality_codes(spark):
    cal = weekday_calendar(spark, "2021-01-01", "2021-03-01")
    days = sessions(12)
    rows = [("OK", d, 10.0, 11.0, 9.0, 10.0, 5.0, k) for k, d in enumerate(days)]
    rows += [("BAD", d, 10.0, 11.0, 9.0, 10.0, 5.0, k) for k, d in enumerate(days)]
    rows += [("BAD", days[0], 10.0, 12.0, 9.0, 10.0, 5.0, 99)]
    rows += [("GAPS", d, 10.0, 11.0, 9.0, 30.0 if k == 6 else None if k == 3 else 10.0, 0.0 if k > 7 else 5.0, k) for k, d in enumerate(days) if k != 5]
    rows += [("SUN", datetime(2021, 1, 10), 10.0, 11.0, 9.0, 10.0, 5.0, 0)]
    raw = spark.createDataFrame(rows, BAR + ", ord int")
    bars = align.with_availability(raw, cal, "1d")
    v = validate(bars, cal, "1d", F.lit(str(days[-1])).cast("timestamp"), universe=spark.createDataFrame([("NONE",), ("OK",)], "symbol string"), ordinal="ord")
    got = {(r.symbol, r.code): (r.severity, r.n) for r in v.issues.collect()}
    assert got[("BAD", "CONFLICTING_DUPLICATES")] == ("ERROR", 1) and got[("BAD", "DUPLICATES")] == ("WARNING", 1) and got[("BAD", "UNSORTED")] == ("WARNING", 1)
    assert got[("GAPS", "NAN_VALUES")][1] == 1 and got[("GAPS", "IMPOSSIBLE_OHLC")][1] == 1 and got[("GAPS", "ZERO_VOLUME_RUN")][1] == 4 and got[("GAPS", "MISSING_SESSIONS")] == ("ERROR", 3)
    assert got[("SUN", "NON_SESSION_BARS")][1] == 1 and got[("SUN", "EMPTY_AFTER_CLEAN")][0] == "ERROR" and got[("NONE", "EMPTY")][0] == "ERROR"
    assert {r.symbol for r in v.bars.select("symbol").distinct().collect()} == {"OK"} and not [k for k in got if k[0] == "OK"]
    late = validate(bars, cal, "1d", F.lit("2021-02-15").cast("timestamp"), limits=Limits())
    assert {r.symbol for r in late.issues.where("code = 'STALE'").collect()} >= {"OK"}
    assert v.version() == validate(bars.repartition(5), cal, "1d", F.lit(str(days[-1])).cast("timestamp"), ordinal="ord").version()
