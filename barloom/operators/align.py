"""Time alignment: canonical bars, availability, resampling, as-of joins, adjustment, point-in-time facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import clean_number
from ..functions.slices import Slicing, carried, split, whole

#: How long a bar of each intraday timeframe lasts
DURATIONS = {"1h": "INTERVAL 1 HOUR", "4h": "INTERVAL 4 HOURS"}
REQUIRED = ["open", "high", "low", "close", "volume"]


def canonical(raw: DataFrame, timeframe: str) -> DataFrame:
    """Names lower-cased with _ for spaces, the five value columns as clean doubles, daily ts at midnight.

    A missing column is an error.  Other columns pass through.
    """
    names = {c: c.lower().replace(" ", "_") for c in raw.columns}
    if missing := set(REQUIRED) - set(names.values()):
        raise ValueError(f"missing columns: {sorted(missing)}")
    bars = raw.withColumnsRenamed(names)
    ts = F.col("ts").cast("timestamp")
    bars = bars.withColumn("ts", F.date_trunc("day", ts) if timeframe in ("1d", "1w") else ts)
    return bars.withColumns({c: clean_number(F.col(c)) for c in REQUIRED})


def with_availability(bars: DataFrame, calendar: DataFrame, timeframe: str) -> DataFrame:
    """Add available_at: when a bar is known.

    1d: its session's close.  1w: the last close from ts to six days later.  Intraday: open plus duration, at
    most the session's close; a bar that opens outside its session has none (the safe reading: a bar is never
    known before it ends).  NULL where the calendar has no session.
    """
    days = F.broadcast(calendar.select("session", "open_at", "close_at"))
    if timeframe == "1d":
        return bars.join(days, F.to_date("ts") == F.col("session"), "left").withColumn("available_at", F.col("close_at")).drop("session", "open_at", "close_at")
    if timeframe == "1w":
        week = calendar.select(F.explode(F.sequence(F.date_sub("session", 6), F.col("session"))).alias("wk"), "close_at").groupBy("wk").agg(F.max("close_at").alias("available_at"))
        return bars.join(F.broadcast(week), F.to_date("ts") == F.col("wk"), "left").drop("wk")
    ends = F.least(F.col("ts") + F.expr(DURATIONS[timeframe]), F.col("close_at"))
    inside = (F.col("ts") >= F.date_trunc("hour", "open_at")) & (F.col("ts") < F.col("close_at"))
    return bars.join(days, F.to_date("ts") == F.col("session"), "left").withColumn("available_at", F.when(inside, ends)).drop("session", "open_at", "close_at")


def _fold(bars: DataFrame, *keys: str) -> DataFrame:
    known = [F.max("available_at").alias("available_at")] if "available_at" in bars.columns else []
    return bars.groupBy("symbol", *keys).agg(
        F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), *known
    ).drop(*keys)


def to_four_hours(bars: DataFrame) -> DataFrame:
    """Hourly bars into blocks of four by their place in the UTC day; the last block of a day may hold fewer."""
    place = F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts"))
    return _fold(bars.withColumn("day", F.to_date("ts")).withColumn("slot", F.floor((place - 1) / 4)), "day", "slot")


def to_weeks(bars: DataFrame) -> DataFrame:
    """Daily bars into weeks from Monday; ts is the first session."""
    return _fold(bars.withColumn("week", F.to_date(F.date_trunc("week", "ts"))), "week")


def as_of_join(decisions: DataFrame, higher: DataFrame, columns: list[str], suffix: str = "_htf", slicing: Slicing | None = None) -> DataFrame:
    """To each decision (symbol, ts) the latest row of higher (symbol, ts, available_at) with available_at <= ts.

    Decisions and higher rows are put in one timeline per symbol and the last higher row is carried forward: one shuffle and
    sort, no range join.  Ties count as available; of rows available at once the later ts wins.  Rows without
    available_at are ignored; repeated decisions stay, each with its match.
    With slicing, given here or in the session's settings, a symbol is many tasks: a slice of its timeline takes over the last row of those before it.
    """
    own = [c for c in decisions.columns if c not in ("symbol", "ts")]
    payload = F.struct(*[F.col(c).alias(c) for c in columns])
    left = decisions.select("symbol", F.col("ts").alias("_at"), F.lit(1).alias("_side"), F.col("ts").alias("_then"), F.struct(*([F.col(c) for c in own] or [F.lit(0).alias("_none")])).alias("_own"), F.lit(None).cast(higher.select(payload).schema[0].dataType).alias("_value"))
    right = higher.where("available_at is not null").select("symbol", F.col("available_at").alias("_at"), F.lit(0).alias("_side"), F.col("ts").alias("_then"), F.lit(None).cast(left.schema["_own"].dataType).alias("_own"), payload.alias("_value"))
    both = left.unionByName(right)
    slicing = slicing or Slicing.of(decisions.sparkSession)
    if slicing:
        joined = whole(carried(split(both, slicing, time="_at"), ["_value"], ["_at", "_side", "_then"])).where("_side = 1")
    else:
        line = Window.partitionBy("symbol").orderBy("_at", "_side", "_then").rowsBetween(Window.unboundedPreceding, 0)
        joined = both.withColumn("_value", F.last("_value", ignorenulls=True).over(line)).where("_side = 1")
    return joined.select("symbol", F.col("_at").alias("ts"), *[F.col(f"_own.{c}").alias(c) for c in own], *[F.col(f"_value.{c}").alias(c + suffix) for c in columns])


def adjust(bars: DataFrame, actions: DataFrame, total: bool = False) -> DataFrame:
    """Backward adjustment: prices times, and volume over, the product of factors of all later ex-dates.

    A split of ratio r has factor 1 / r; with total = True a dividend d has 1 - d / c, c the last raw close before
    its ex-date.  Actions before the first bar have no effect.  A ratio <= 0 or a factor outside (0, 1] raises.
    Adds raw_close and adj_factor.  One window per symbol over bars and actions: no join by range.
    """
    value = F.when((F.col("kind") == "split") & (F.col("value") <= 0), F.raise_error(F.lit("a split's ratio must be positive"))).otherwise(F.col("value"))
    line = Window.partitionBy("symbol").orderBy("_at", "_side")
    both = bars.withColumns({"_at": F.to_date("ts"), "_side": F.lit(1), "_kind": F.lit(None).cast("string"), "_value": F.lit(None).cast("double")})
    acts = actions.select("symbol", F.col("ex_date").alias("_at"), F.lit(0).alias("_side"), F.col("kind").alias("_kind"), value.cast("double").alias("_value"))
    rows = both.unionByName(acts, allowMissingColumns=True).withColumn("_prev", F.last("close", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    cut_ = 1 - F.col("_value") / F.col("_prev")
    cut_ = F.when((cut_ <= 0) | (cut_ > 1), F.raise_error(F.lit("a dividend's factor must be in (0, 1]"))).otherwise(cut_)
    split = F.when((F.col("_kind") == "split") & F.col("_prev").isNotNull(), 1 / F.col("_value"))
    dividend = F.when(F.lit(total) & (F.col("_kind") == "dividend") & F.col("_prev").isNotNull(), cut_)
    after = line.rowsBetween(1, Window.unboundedFollowing)
    product = lambda c: F.exp(F.coalesce(F.sum(F.ln(c)).over(after), F.lit(0.0)))
    rows = rows.withColumns({"_split": split, "_div": dividend}).withColumns({"_sf": product(F.col("_split")), "_df": product(F.col("_div"))}).where("_side = 1")
    factor = F.col("_sf") * F.col("_df")
    out = rows.withColumns({"adj_factor": factor, "raw_close": F.col("close")})
    out = out.withColumns({c: F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") / F.col("_sf")})
    return out.drop("_at", "_side", "_kind", "_value", "_prev", "_split", "_div", "_sf", "_df")


def members(membership: DataFrame, universe: str, day: str) -> DataFrame:
    """Symbols of a universe on a day: start <= day < end, or no end."""
    at = F.to_date(F.lit(day))
    return membership.where((F.col("universe") == universe) & (F.col("start_date") <= at) & (F.col("end_date").isNull() | (F.col("end_date") > at))).select("symbol").distinct().orderBy("symbol")


def histories(membership: DataFrame) -> DataFrame:
    """universe, has_history: whether it has closed intervals, and so is more than a snapshot of today."""
    return membership.groupBy("universe").agg(F.max(F.col("end_date").isNotNull()).alias("has_history"))


def has_history(membership: DataFrame, universe: str) -> bool:
    """The same for one universe; False for an unknown one."""
    return bool(histories(membership.where(F.col("universe") == universe)).where("has_history").limit(1).count())


def latest_facts(facts: DataFrame, at: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Per keys the row latest in `order` of those available at `at`: restatements replace what they restate."""
    rest = [c for c in facts.columns if c not in keys]
    last = facts.where(F.col("available_at") <= at).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def news_window(news: DataFrame, at: Column, lookback: str = "INTERVAL 7 DAYS", symbol: str | None = None) -> DataFrame:
    """News available in (at - lookback, at], in order."""
    found = news.where((F.col("available_at") <= at) & (F.col("available_at") > at - F.expr(lookback)))
    return (found.where(F.col("symbol") == symbol) if symbol else found).orderBy("available_at")


def macro_vintage(macro: DataFrame, at: Column) -> DataFrame:
    """Per series the newest observation known at `at`, in its latest vintage known then."""
    return latest_facts(macro, at, ["series"], ["observation_date", "available_at"])
