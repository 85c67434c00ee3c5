"""What queries share: tables, rounding, and the SQL of the derived bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Daily bars of the orders table, as order_bars() makes them
BARS = """bars AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY ALL)"""
NATION_BARS = """bars AS (SELECT c_nationkey::VARCHAR AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
HOUR_BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, event_id) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL)"""
SHIP_BARS = """bars AS (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, arg_min(l_extendedprice * (1 - l_discount), (l_orderkey, l_linenumber)) AS open, max(l_extendedprice * (1 - l_discount)) AS high,
    min(l_extendedprice * (1 - l_discount)) AS low, arg_max(l_extendedprice * (1 - l_discount), (l_orderkey, l_linenumber)) AS close, sum(l_quantity)::DOUBLE AS volume FROM lineitem GROUP BY ALL)"""
#: Weekday sessions that close at 21:00
CALENDAR = "cal AS (SELECT d::DATE AS session, d + INTERVAL 21 HOUR AS close_at FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2001-09-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)"
CALENDAR_SPAN = ("1995-01-01", "2001-08-31")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded and times without a zone, so that two engines can be compared."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(c, places) + 0.0 if kind == "double" else c.cast("timestamp_ntz") if kind == "timestamp" else c).alias(name))
    return df.select(*out)


def rounded(columns: list[str], places: int = 6) -> str:
    """The same for a SQL select list."""
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in columns)
