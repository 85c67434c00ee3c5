"""Bars, calendar, resampling, as-of joins, adjustment, point-in-time facts and data quality."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.slices import Slicing
from ..operators import align
from ..operators.quality import Limits, validate
from ..plans.state import shared_path
from ..sources import bars as src
from ..sources.calendar import exchange_calendar, weekday_calendar
from .base import BARS, CALENDAR, CALENDAR_SPAN, HOUR_BARS, NATION_BARS, SHIP_BARS, rounded, table, tidy

_OHLCV = ["open", "high", "low", "close", "volume"]


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(src.order_bars(spark, sf))


def bars_daily_nation(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(src.nation_bars(spark, sf))


def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(src.event_bars(spark, sf))


def bars_shipments(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(src.shipment_bars(spark, sf))


def bars_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """A scan with a pushed range."""
    items = table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1996-07-01'")
    return tidy(src.derive_bars(items, F.col("l_returnflag"), F.date_trunc("day", "l_shipdate"), F.col("l_extendedprice"), F.struct("l_orderkey", "l_linenumber"), F.col("l_quantity")))


def canonical_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Odd names and text values become canonical bars."""
    raw = src.order_bars(spark, sf).select("symbol", F.col("ts").alias("TS"), F.col("open").cast("string").alias("Open"), F.col("high").cast("string").alias("HIGH"), F.when(F.dayofmonth("ts") == 13, "n/a").otherwise(F.col("low").cast("string")).alias("Low"), F.when(F.dayofmonth("ts") == 14, "NaN").otherwise(F.col("close").cast("string")).alias("Close"), F.col("volume").alias("Volume"))
    return tidy(align.canonical(raw, "1d"))


def stored_bars(spark: SparkSession, sf: str) -> DataFrame:
    """A store of all bars, the range of 1996 replaced twice, read back."""
    bars, path = src.order_bars(spark, sf), shared_path(spark, "store")
    src.store_bars(bars, path, "1d")
    for _ in range(2):
        src.store_bars(bars.where("year(ts) = 1996").withColumn("volume", F.col("volume") + 0.5), path, "1d")
    return tidy(src.load_bars(spark, path, timeframe="1d").select("symbol", "ts", *_OHLCV))


def exchange_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Trading days and early closes of each year."""
    cal = exchange_calendar(spark, date(2019, 1, 1), date(2024, 12, 31))
    early = (F.hour(F.from_utc_timestamp("close_at", "America/New_York")) == 13).cast("int")
    return cal.groupBy(F.year("session").alias("year")).agg(F.count(F.lit(1)).alias("sessions"), F.sum(early).alias("early"))


def universe_history(spark: SparkSession, sf: str) -> DataFrame:
    """Which universes are more than a snapshot."""
    rows = _membership(spark, sf).withColumn("universe", F.concat_ws("-", "universe", (F.right("symbol", F.lit(1)).cast("int") % 3).cast("string")))
    return align.histories(rows.withColumn("end_date", F.when(~F.col("universe").endswith("-1"), F.col("end_date"))))


def symbols_with_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Assets that have prices, by a semi join."""
    assets = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NONE",)], "symbol string")
    return assets.join(src.order_bars(spark, sf), "symbol", "left_semi").distinct()


def calendar_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions and their closes."""
    return tidy(weekday_calendar(spark, *CALENDAR_SPAN).select("session", "close_at"))


def available_daily(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(align.with_availability(src.order_bars(spark, sf), weekday_calendar(spark, *CALENDAR_SPAN), "1d").select("symbol", "ts", "available_at"))


def available_weekly(spark: SparkSession, sf: str) -> DataFrame:
    weeks = align.to_weeks(src.order_bars(spark, sf))
    return tidy(align.with_availability(weeks, weekday_calendar(spark, *CALENDAR_SPAN), "1w").select("symbol", "ts", "available_at"))


def available_hourly(spark: SparkSession, sf: str) -> DataFrame:
    cal = weekday_calendar(spark, "2024-01-01", "2024-02-15")
    return tidy(align.with_availability(src.event_bars(spark, sf), cal, "1h").select("symbol", "ts", "available_at"))


def resample_4h(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(align.to_four_hours(src.event_bars(spark, sf)))


def resample_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(align.to_weeks(src.order_bars(spark, sf)))


def asof_join(spark: SparkSession, sf: str, slicing: Slicing | None = None) -> DataFrame:
    """Each daily bar with the latest week that had closed."""
    daily = src.order_bars(spark, sf).select("symbol", F.expr("ts + interval 21 hours").alias("ts"), "close")
    weekly = align.with_availability(align.to_weeks(src.order_bars(spark, sf)), weekday_calendar(spark, *CALENDAR_SPAN), "1w")
    return tidy(align.as_of_join(daily, weekly, ["close", "volume"], "_week", slicing))


def asof_join_sliced(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with every symbol's timeline in slices of a month or two."""
    return asof_join(spark, sf, Slicing(30, "month"))


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    """Actions derived from the bars: a split of 3 each March 1, a dividend of 1 % of the low each September 1."""
    bars = src.order_bars(spark, sf)
    ends = bars.groupBy("symbol").agg(F.min("low").alias("least"))
    years = F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("y")
    rows = ends.select("symbol", "least", years)
    split = rows.select("symbol", F.make_date("y", F.lit(3), F.lit(1)).alias("ex_date"), F.lit("split").alias("kind"), F.lit(3.0).alias("value"))
    return split.unionByName(rows.select("symbol", F.make_date("y", F.lit(9), F.lit(1)).alias("ex_date"), F.lit("dividend").alias("kind"), (F.col("least") * 0.01).alias("value")))


def adjust_splits(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(align.adjust(src.order_bars(spark, sf), _actions(spark, sf)).select("symbol", "ts", "close", "volume", "adj_factor", "raw_close"))


def adjust_total(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(align.adjust(src.order_bars(spark, sf), _actions(spark, sf), total=True).select("symbol", "ts", "close", "volume", "adj_factor", "raw_close"))


def _membership(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as members of their segment from the day derived from their key."""
    c = table(spark, sf, "customer")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int"))
    return c.select(F.col("c_mktsegment").alias("universe"), F.col("c_name").alias("symbol"), start.alias("start_date"), F.when(F.col("c_custkey") % 3 == 0, F.date_add(start, 400)).alias("end_date"))


def universe_at(spark: SparkSession, sf: str) -> DataFrame:
    return align.members(_membership(spark, sf), "BUILDING", "1998-06-01")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts on customers: metric = priority, period = quarter, known a few days after."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("asset"), F.col("o_orderpriority").alias("metric"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.expr("cast(o_orderdate as timestamp) + make_interval(0, 0, 0, cast(o_orderkey % 30 as int))").alias("available_at"))


def facts_as_of(spark: SparkSession, sf: str) -> DataFrame:
    found = align.latest_facts(_facts(spark, sf), F.lit("1997-05-05").cast("timestamp"), ["asset", "metric"], ["available_at", "id"])
    return tidy(found.select("asset", "metric", "id", "value"))


def news_in_window(spark: SparkSession, sf: str) -> DataFrame:
    news = table(spark, sf, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("available_at"))
    return tidy(align.news_window(news, F.lit("2024-01-20 12:00:00").cast("timestamp"), symbol="click"))


def macro_vintages(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    macro = o.select(F.col("o_orderpriority").alias("series"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("observation_date"), F.expr("cast(o_orderdate as timestamp) + make_interval(0, 0, 0, cast(o_orderkey % 60 as int))").alias("available_at"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    found = align.latest_facts(macro, F.lit("1999-09-09").cast("timestamp"), ["series"], ["observation_date", "available_at", "id"])
    return tidy(found.select("series", "observation_date", "id", "value"))


def upsert_actions(spark: SparkSession, sf: str) -> DataFrame:
    """A second load of actions replaces rows of equal key."""
    old = _actions(spark, sf).withColumn("load", F.lit(1))
    new = _actions(spark, sf).where("kind = 'split' and year(ex_date) >= 1999").withColumns({"value": F.lit(4.0), "load": F.lit(2)})
    return tidy(src.upsert(old, new, ["symbol", "ex_date", "kind"], "load"))


def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Registrations that are not there yet."""
    o = table(spark, sf, "orders").select(F.sha2(F.concat_ws("|", F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM")), 256).alias("id"))
    return src.append_missing(o.where("id < '8'"), o, "id")


def _defects(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with defects by day of month: gaps on the 3rd, impossible highs on the 5th, repeats on the 7th, conflicts on the 9th (of symbols 1 and 2), no volume in late June."""
    b = src.order_bars(spark, sf)
    d, m = F.dayofmonth("ts"), F.month("ts")
    b = b.withColumns({"close": F.when(d == 3, None).otherwise(F.col("close")), "high": F.when(d == 5, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when((m == 6) & (d > 20), 0.0).otherwise(F.col("volume")), "ord": F.lit(0)})
    again = b.where(F.dayofmonth("ts") == 7).withColumn("ord", F.lit(1))
    odd = b.where((F.dayofmonth("ts") == 9) & (F.substring("symbol", 1, 1) < "3")).withColumns({"open": F.col("open") + 1, "ord": F.lit(1)})
    return align.with_availability(b.unionByName(again).unionByName(odd), weekday_calendar(spark, *CALENDAR_SPAN), "1d")


def _checked(spark: SparkSession, sf: str, asof: str = "2001-06-01", limits: Limits = Limits()):
    return validate(_defects(spark, sf), weekday_calendar(spark, *CALENDAR_SPAN), "1d", F.lit(asof).cast("timestamp"), limits=limits)


def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Q4 to Q14 per symbol."""
    return tidy(_checked(spark, sf).issues)


def quality_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Q16: bars of the symbols without an error."""
    return tidy(_checked(spark, sf, "2001-08-03", Limits(missing_ratio=0.9)).bars.select("symbol", "ts", *_OHLCV))


def quality_short_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Q15 on hourly bars."""
    cal = weekday_calendar(spark, "2024-01-01", "2024-02-15")
    bars = align.with_availability(src.event_bars(spark, sf), cal, "1h")
    return tidy(validate(bars, cal, "1h", F.lit("2024-03-01").cast("timestamp")).issues)


def quality_arrival(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 to Q3 and Q10: times without a zone, bars that arrive out of order, a symbol of which nothing is left, and one that never came."""
    b = src.order_bars(spark, sf)
    symbols = b.select("symbol").distinct()
    b = b.withColumns({"ord": F.datediff("ts", F.lit("1970-01-01")).cast("long") * 37 % 10007, "close": F.when(F.col("symbol") != "5-LOW", F.col("close"))})
    cal = weekday_calendar(spark, *CALENDAR_SPAN)
    bars = align.with_availability(b, cal, "1d").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    universe = symbols.unionByName(symbols.agg(F.lit("ABSENT").alias("symbol")))
    found = validate(bars, cal, "1d", F.lit("2001-06-01").cast("timestamp"), universe, ordinal="ord").issues
    return tidy(found.where(F.col("code").isin("EMPTY", "NAIVE_TIMESTAMPS", "UNSORTED", "EMPTY_AFTER_CLEAN")))


def csv_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The daily bars written as a tree of CSV files, a folder a symbol, and read back between two days."""
    b = src.order_bars(spark, sf)
    root = shared_path(spark, "csv")
    src.write_csv_bars(b, root, "1d")
    symbols = [r.symbol for r in b.select("symbol").distinct().collect()]  # a folder each
    return tidy(src.read_csv_bars(spark, root, "1d", symbols, "1996-03-01", "1999-10-31").select("symbol", "timeframe", "ts", *_OHLCV))


QUERIES = {f.__name__: f for f in (
    bars_daily, bars_daily_nation, bars_hourly, bars_shipments, bars_in_range, canonical_bars, symbols_with_prices, calendar_sessions, available_daily, available_weekly, available_hourly, resample_4h,
    resample_weekly, asof_join, asof_join_sliced, adjust_splits, adjust_total, universe_at, facts_as_of, news_in_window, macro_vintages, upsert_actions, insert_if_absent, quality_issues, quality_clean, quality_short_sessions,
    stored_bars, exchange_sessions, universe_history, quality_arrival, csv_bars,
)}

_R = rounded(_OHLCV)
_WEEKS = "weeks AS (SELECT symbol, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, date_trunc('week', ts))"
_WEEK_CLOSE = "wk AS (SELECT w.*, (SELECT max(close_at) FROM cal WHERE session BETWEEN w.ts::DATE AND w.ts::DATE + 6) AS available_at FROM weeks w)"
_ACTIONS = """acts AS (SELECT symbol, make_date(y, 3, 1) AS ex_date, 'split' AS kind, 3.0::DOUBLE AS value FROM (SELECT DISTINCT symbol FROM bars), range(1995, 2002) t(y)
    UNION ALL SELECT symbol, make_date(y, 9, 1), 'dividend', least_ * 0.01 FROM (SELECT symbol, min(low) AS least_ FROM bars GROUP BY symbol), range(1995, 2002) t(y))"""
_FACTORS = "f AS (SELECT a.symbol, ex_date, kind, CASE kind WHEN 'split' THEN 1 / value ELSE 1 - value / (SELECT arg_max(close, ts) FROM bars b WHERE b.symbol = a.symbol AND b.ts::DATE < ex_date) END AS f FROM acts a WHERE EXISTS (SELECT 1 FROM bars b WHERE b.symbol = a.symbol AND b.ts::DATE < ex_date))"
_ADJUST = """SELECT b.symbol, b.ts, round(close * coalesce(p, 1), 6) + 0.0 AS close, round(volume / coalesce(s, 1), 6) + 0.0 AS volume, round(coalesce(p, 1), 6) + 0.0 AS adj_factor, round(close, 6) + 0.0 AS raw_close
    FROM bars b LEFT JOIN (SELECT b.symbol, b.ts, product(f) FILTER ({used}) AS p, product(f) FILTER (kind = 'split') AS s FROM bars b JOIN f ON f.symbol = b.symbol AND f.ex_date > b.ts::DATE GROUP BY ALL) x ON x.symbol = b.symbol AND x.ts = b.ts"""
_DEFECTS = """d0 AS (SELECT symbol, ts, open, CASE WHEN day(ts) = 5 THEN low - 1 ELSE high END AS high, low, CASE WHEN day(ts) <> 3 THEN close END AS close, CASE WHEN month(ts) = 6 AND day(ts) > 20 THEN 0.0 ELSE volume END AS volume, 0 AS ord FROM bars),
    d AS (SELECT x.*, close_at AS available_at FROM (SELECT * FROM d0 UNION ALL SELECT * REPLACE (1 AS ord) FROM d0 WHERE day(ts) = 7 UNION ALL SELECT * REPLACE (open + 1 AS open, 1 AS ord) FROM d0 WHERE day(ts) = 9 AND symbol[1] < '3') x LEFT JOIN cal ON session = ts::DATE),
    u AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY ord, open) AS nth, min(open) OVER (PARTITION BY symbol, ts) <> max(open) OVER (PARTITION BY symbol, ts) AS differs FROM d),
    s AS (SELECT * FROM u WHERE nth = 1 AND available_at IS NOT NULL), k AS (SELECT * FROM s WHERE close IS NOT NULL),
    bad AS (SELECT *, high < greatest(open, close) OR low > least(open, close) OR high < low OR least(open, high, low, close) <= 0 OR volume < 0 AS bad FROM k), clean AS (SELECT * FROM bad WHERE NOT bad),
    line AS (SELECT *, abs(ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts))) AS move, sum(CASE WHEN volume = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts) AS island FROM clean),
    runs AS (SELECT *, count(*) OVER (PARTITION BY symbol, island) AS k FROM line WHERE volume = 0),
    span AS (SELECT symbol, min(ts::DATE) AS lo, max(ts::DATE) AS hi FROM clean GROUP BY symbol), ex AS (SELECT symbol, session FROM span JOIN cal ON session BETWEEN lo AND hi),
    gone AS (SELECT * FROM ex WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.symbol = ex.symbol AND c.ts::DATE = session)), ne AS (SELECT symbol, count(*) AS e FROM ex GROUP BY symbol),
    iss AS (SELECT symbol, 'CONFLICTING_DUPLICATES' AS code, 'ERROR' AS severity, ts FROM u WHERE differs AND nth = 1 UNION ALL SELECT symbol, 'DUPLICATES', 'WARNING', ts FROM u WHERE nth > 1
      UNION ALL SELECT symbol, 'FUTURE_TIMESTAMPS', 'ERROR', ts FROM u WHERE nth = 1 AND ts > TIMESTAMP '2001-06-01' UNION ALL SELECT symbol, 'NON_SESSION_BARS', 'WARNING', ts FROM u WHERE nth = 1 AND available_at IS NULL
      UNION ALL SELECT symbol, 'NAN_VALUES', 'WARNING', ts FROM s WHERE close IS NULL UNION ALL SELECT symbol, 'IMPOSSIBLE_OHLC', 'WARNING', ts FROM bad WHERE bad
      UNION ALL SELECT symbol, 'EXTREME_MOVE', 'WARNING', ts FROM line WHERE move > 0.4 UNION ALL SELECT symbol, 'ZERO_VOLUME_RUN', 'WARNING', ts FROM runs WHERE k >= 3
      UNION ALL SELECT g.symbol, 'MISSING_SESSIONS', CASE WHEN count(*) OVER (PARTITION BY g.symbol) / e > 0.02 THEN 'ERROR' ELSE 'WARNING' END, session::TIMESTAMP FROM gone g JOIN ne USING (symbol)),
    st AS (SELECT symbol, 'STALE' AS code, 'ERROR' AS severity, count(*) - 1 AS n, max(hi)::TIMESTAMP AS first_ts, max(hi)::TIMESTAMP AS last_ts FROM span JOIN cal ON session BETWEEN hi AND DATE '2001-06-01' GROUP BY symbol HAVING count(*) - 1 > 3),
    issues AS (SELECT symbol, code, severity, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM iss GROUP BY ALL UNION ALL SELECT * FROM st)"""
_HOUR_CAL = "cal AS (SELECT d::DATE AS session, d + INTERVAL 14 HOUR AS from_at, d + INTERVAL 21 HOUR AS close_at FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-16', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)"
_HOUR_AVAIL = "av AS (SELECT b.*, CASE WHEN ts >= from_at AND ts < close_at THEN least(ts + INTERVAL 1 HOUR, close_at) END AS available_at FROM bars b LEFT JOIN cal ON session = ts::DATE)"

ORACLES = {
    "bars_daily": f"WITH {BARS} SELECT symbol, ts, {_R} FROM bars",
    "bars_daily_nation": f"WITH {NATION_BARS} SELECT symbol, ts, {_R} FROM bars",
    "bars_hourly": f"WITH {HOUR_BARS} SELECT symbol, ts, {_R} FROM bars",
    "bars_shipments": f"WITH {SHIP_BARS} SELECT symbol, ts, {_R} FROM bars",
    "bars_in_range": f"""WITH bars AS (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
        arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close, sum(l_quantity)::DOUBLE AS volume FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1996-07-01' GROUP BY ALL) SELECT symbol, ts, {_R} FROM bars""",
    "canonical_bars": f"WITH {BARS} SELECT symbol, ts, {rounded(['open', 'high', 'volume'])}, CASE WHEN day(ts) <> 13 THEN round(low, 6) + 0.0 END AS low, CASE WHEN day(ts) <> 14 THEN round(close, 6) + 0.0 END AS close FROM bars",
    "symbols_with_prices": "SELECT DISTINCT o_orderpriority AS symbol FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '9-NONE')",
    "calendar_sessions": f"WITH {CALENDAR} SELECT * FROM cal",
    "available_daily": f"WITH {BARS}, {CALENDAR} SELECT symbol, ts, close_at AS available_at FROM bars LEFT JOIN cal ON session = ts::DATE",
    "available_weekly": f"WITH {BARS}, {CALENDAR}, {_WEEKS}, {_WEEK_CLOSE} SELECT symbol, ts, available_at FROM wk",
    "available_hourly": f"WITH {HOUR_BARS}, {_HOUR_CAL}, {_HOUR_AVAIL} SELECT symbol, ts, available_at FROM av",
    "resample_4h": f"""WITH {HOUR_BARS}, p AS (SELECT *, (row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) - 1) // 4 AS slot FROM bars),
        r AS (SELECT symbol, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM p GROUP BY symbol, p.ts::DATE, slot) SELECT symbol, ts, {_R} FROM r""",
    "resample_weekly": f"WITH {BARS}, {_WEEKS} SELECT symbol, ts, {_R} FROM weeks",
    "asof_join": f"""WITH {BARS}, {CALENDAR}, {_WEEKS}, {_WEEK_CLOSE}, d AS (SELECT symbol, ts + INTERVAL 21 HOUR AS ts, close FROM bars)
        SELECT d.symbol, d.ts, {rounded(['d.close']).replace('AS d.close', 'AS close')}, round(w.close, 6) + 0.0 AS close_week, round(w.volume, 6) + 0.0 AS volume_week FROM d ASOF LEFT JOIN (SELECT * FROM wk WHERE available_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, available_at ORDER BY ts DESC) = 1) w ON d.symbol = w.symbol AND d.ts >= w.available_at""",
    "adjust_splits": f"WITH {BARS}, {_ACTIONS}, {_FACTORS} " + _ADJUST.format(used="kind = 'split'"),
    "adjust_total": f"WITH {BARS}, {_ACTIONS}, {_FACTORS} " + _ADJUST.format(used="true"),
    "stored_bars": f"WITH {BARS} SELECT symbol, ts, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _OHLCV[:4])}, volume + CASE WHEN year(ts) = 1996 THEN 0.5 ELSE 0 END AS volume FROM bars",
    # published numbers of trading days; New York closes early after Thanksgiving, before Independence Day and on Christmas Eve
    "exchange_sessions": "SELECT y::INT AS year, n::BIGINT AS sessions, e::BIGINT AS early FROM (VALUES (2019, 252, 3), (2020, 253, 2), (2021, 252, 1), (2022, 251, 1), (2023, 250, 2), (2024, 252, 3)) t(y, n, e)",
    "universe_history": """WITH m AS (SELECT c_mktsegment || '-' || (right(c_name, 1)::INT % 3) AS universe, c_custkey % 3 = 0 AS closed FROM customer) SELECT universe, bool_or(closed AND NOT universe LIKE '%-1') AS has_history FROM m GROUP BY universe""",
    "universe_at": """WITH m AS (SELECT c_name AS symbol, DATE '1995-01-01' + (c_custkey % 2000)::INT AS s, CASE WHEN c_custkey % 3 = 0 THEN DATE '1995-01-01' + (c_custkey % 2000)::INT + 400 END AS e FROM customer WHERE c_mktsegment = 'BUILDING')
        SELECT DISTINCT symbol FROM m WHERE s <= '1998-06-01' AND (e IS NULL OR e > '1998-06-01')""",
    "facts_as_of": """WITH f AS (SELECT o_custkey AS asset, o_orderpriority AS metric, o_orderkey AS id, o_totalprice AS value, o_orderdate + to_days((o_orderkey % 30)::INT) AS a FROM orders)
        SELECT asset, metric, id, round(value, 6) + 0.0 AS value FROM f WHERE a <= '1997-05-05' QUALIFY row_number() OVER (PARTITION BY asset, metric ORDER BY a DESC, id DESC) = 1""",
    "news_in_window": "SELECT event_id, event_type AS symbol, ts AS available_at FROM events WHERE event_type = 'click' AND ts <= '2024-01-20 12:00:00' AND ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY",
    "macro_vintages": """WITH m AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS observation_date, o_orderdate + to_days((o_orderkey % 60)::INT) AS a, o_orderkey AS id, o_totalprice AS value FROM orders)
        SELECT series, observation_date, id, round(value, 6) + 0.0 AS value FROM m WHERE a <= '1999-09-09' QUALIFY row_number() OVER (PARTITION BY series ORDER BY observation_date DESC, a DESC, id DESC) = 1""",
    "upsert_actions": f"""WITH {BARS}, {_ACTIONS} SELECT symbol, ex_date, kind, CASE WHEN kind = 'split' AND year(ex_date) >= 1999 THEN 4.0 ELSE round(value, 6) + 0.0 END AS value, CASE WHEN kind = 'split' AND year(ex_date) >= 1999 THEN 2 ELSE 1 END AS load FROM acts""",
    "insert_if_absent": "SELECT DISTINCT id FROM (SELECT sha256(o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m')) AS id FROM orders) WHERE id >= '8'",
    "quality_issues": f"WITH {BARS}, {CALENDAR}, {_DEFECTS} SELECT * FROM issues",
    "quality_clean": f"WITH {BARS}, {CALENDAR}, {_DEFECTS.replace('2001-06-01', '2001-08-03').replace('0.02', '0.9')} SELECT symbol, ts, {_R} FROM clean WHERE symbol NOT IN (SELECT symbol FROM issues WHERE severity = 'ERROR')",
    "quality_short_sessions": f"""WITH {HOUR_BARS}, {_HOUR_CAL}, {_HOUR_AVAIL}, c AS (SELECT * FROM av WHERE available_at IS NOT NULL AND NOT (high < greatest(open, close) OR low > least(open, close) OR high < low OR least(open, high, low, close) <= 0 OR volume < 0)),
        iss AS (SELECT symbol, 'NON_SESSION_BARS' AS code, 'WARNING' AS severity, ts FROM av WHERE available_at IS NULL
          UNION ALL SELECT symbol, 'IMPOSSIBLE_OHLC', 'WARNING', ts FROM av WHERE available_at IS NOT NULL AND (high < greatest(open, close) OR low > least(open, close) OR high < low OR least(open, high, low, close) <= 0 OR volume < 0)
          UNION ALL SELECT symbol, 'EXTREME_MOVE', 'WARNING', ts FROM (SELECT *, abs(ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts))) AS move FROM c) WHERE move > 0.4
          UNION ALL SELECT symbol, 'SHORT_SESSIONS', 'INFO', min(ts) FROM c GROUP BY symbol, ts::DATE HAVING count(*) < 4)
        SELECT symbol, code, severity, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM iss GROUP BY ALL""",
}
ORACLES["asof_join_sliced"] = ORACLES["asof_join"]
ORACLES["quality_arrival"] = f"""WITH {BARS}, x AS (SELECT *, (ts::DATE - DATE '1970-01-01') * 37 % 10007 AS ord FROM bars), y AS (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ord) AS before FROM x)
    SELECT symbol, 'UNSORTED' AS code, 'WARNING' AS severity, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM y WHERE ts < before GROUP BY symbol
    UNION ALL SELECT symbol, 'NAIVE_TIMESTAMPS', 'WARNING', count(*), min(ts), max(ts) FROM bars GROUP BY symbol
    UNION ALL SELECT DISTINCT symbol, 'EMPTY_AFTER_CLEAN', 'ERROR', 1, NULL::TIMESTAMP, NULL::TIMESTAMP FROM bars WHERE symbol = '5-LOW' UNION ALL SELECT 'ABSENT', 'EMPTY', 'ERROR', 1, NULL, NULL"""
ORACLES["csv_bars"] = f"WITH {BARS} SELECT symbol, '1d' AS timeframe, ts, {_R} FROM bars WHERE ts BETWEEN '1996-03-01' AND '1999-10-31'"
