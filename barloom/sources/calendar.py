"""Session calendars as small DataFrames: session DATE, open_at and close_at TIMESTAMP (UTC)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days on which the New York exchange was closed outside its rules
AD_HOC_CLOSURES = """
1985-09-27 1994-04-27 2001-09-11 2001-09-12 2001-09-13 2001-09-14 2004-06-11 2007-01-02 2012-10-29 2012-10-30 2018-12-05 2025-01-09
""".split()


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th given weekday of a month; n < 0 counts from its end."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7 + 7 * (-n - 1))


def _easter(year: int) -> date:
    """Gregorian Easter Sunday (the anonymous computus)."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (a + 11 * h) // 319
    r = (2 * e + 2 * i - k - h + m + 32) % 7
    month = (h - m + r + 90) // 25
    return date(year, month, (h - m + r + month + 19) % 32)


def _observed(day: date, saturday: bool = True) -> date | None:
    """A fixed-date holiday as kept: Sunday's on Monday, Saturday's on Friday or not at all."""
    if day.weekday() == 6:
        return day + timedelta(1)
    if day.weekday() == 5:
        return day - timedelta(1) if saturday else None
    return day


def holidays(year: int) -> set[date]:
    found = {
        _observed(date(year, 1, 1), saturday=False), _nth(year, 2, 0, 3), _easter(year) - timedelta(2), _nth(year, 5, 0, -1),
        _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25)),
    }
    if year >= 1998:
        found.add(_nth(year, 1, 0, 3))
    if year >= 2022:
        found.add(_observed(date(year, 6, 19)))
    return {d for d in found if d} | {date.fromisoformat(d) for d in AD_HOC_CLOSURES if d.startswith(str(year))}


def early_closes(year: int) -> set[date]:
    """Sessions that close at 13:00: after Thanksgiving, before Independence Day and Christmas Eve."""
    found = {_nth(year, 11, 3, 4) + timedelta(1), date(year, 12, 24)}
    if date(year, 7, 4).weekday() in (1, 2, 3, 4):
        found.add(date(year, 7, 3))
    return {d for d in found if d.weekday() < 5} - holidays(year)


def exchange_calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """New York sessions from start to end; about 252 rows a year, small enough to broadcast."""
    rows, day = [], start
    shut = {d for y in range(start.year, end.year + 1) for d in holidays(y)}
    early = {d for y in range(start.year, end.year + 1) for d in early_closes(y)}
    while day <= end:
        if day.weekday() < 5 and day not in shut:
            rows.append((day, "13:00:00" if day in early else "16:00:00"))
        day += timedelta(1)
    plain = spark.createDataFrame(rows, "session date, close string")
    at = lambda clock: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("session").cast("string"), clock)), "America/New_York")
    return plain.select("session", at(F.lit("09:30:00")).alias("open_at"), at(F.col("close")).alias("close_at"))


def weekday_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every weekday from start to end, 14:30 to 21:00 UTC."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("session")).where("weekday(session) < 5")
    at = lambda clock: F.to_timestamp(F.concat(F.col("session").cast("string"), F.lit(f" {clock}")))
    return days.select("session", at("14:30:00").alias("open_at"), at("21:00:00").alias("close_at"))
