"""Data-quality rules over a long bars table: verdicts per symbol, never for the batch as a whole."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import yes
from ..plans.state import cut

VALUES = ["open", "high", "low", "close", "volume"]
#: Severity of each rule
SEVERITY = {
    "EMPTY": "ERROR", "NAIVE_TIMESTAMPS": "WARNING", "UNSORTED": "WARNING", "CONFLICTING_DUPLICATES": "ERROR", "DUPLICATES": "WARNING", "FUTURE_TIMESTAMPS": "ERROR",
    "NON_SESSION_BARS": "WARNING", "NAN_VALUES": "WARNING", "IMPOSSIBLE_OHLC": "WARNING", "EMPTY_AFTER_CLEAN": "ERROR", "EXTREME_MOVE": "WARNING",
    "ZERO_VOLUME_RUN": "WARNING", "STALE": "ERROR", "SHORT_SESSIONS": "INFO",
}


@dataclass(frozen=True)
class Limits:
    extreme_move: float = 0.4
    zero_run: int = 3
    missing_ratio: float = 0.02
    stale_sessions: int = 3
    short_session: int = 4


@dataclass(frozen=True)
class Validated:
    """What only validate() makes: clean bars of symbols without an ERROR, all issues, and the symbols that failed."""

    bars: DataFrame
    issues: DataFrame
    failed: DataFrame

    def version(self) -> str:
        """A digest of the bars that does not depend on their order."""
        columns = sorted(self.bars.columns)
        row = F.xxhash64(*columns)
        parts = self.bars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s"))
        return parts.select(F.sha2(F.concat_ws("|", F.lit(",".join(columns)), "n", "x", "s"), 256)).first()[0]


def _flag(code: str, rows: DataFrame) -> DataFrame:
    """One issue row per symbol of rows (symbol, ts)."""
    sums = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return sums.select("symbol", F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), "n", "first_ts", "last_ts")


def impossible() -> Column:
    """Prices or volume that no trade can have made."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return (F.col("high") < top) | (F.col("low") > bottom) | (F.col("high") < F.col("low")) | (F.least("open", "high", "low", "close") <= 0) | (F.col("volume") < 0)


def validate(bars: DataFrame, calendar: DataFrame, timeframe: str, asof: Column, universe: DataFrame | None = None, limits: Limits = Limits(), ordinal: str | None = None) -> Validated:
    """Apply all rules to bars (symbol, ts, five values, available_at; optionally an arrival ordinal).

    Rules run on what the ones before left, in the order of SEVERITY.  issues has one row per symbol and code: n rows
    concerned, the first and the last of them.  A symbol with an ERROR is left out of the clean bars and
    listed in failed; others are not touched by it.
    """
    naive = dict(bars.dtypes)["ts"] == "timestamp_ntz"
    rows = bars.withColumns({"_ord": F.col(ordinal) if ordinal else F.lit(0), "ts": F.col("ts").cast("timestamp")})
    stamp, arrival = Window.partitionBy("symbol", "ts"), Window.partitionBy("symbol").orderBy("_ord")
    differs = reduce(Column.__or__, [F.coalesce(F.min(c).over(stamp) != F.max(c).over(stamp), F.lit(False)) for c in VALUES])
    rows = rows.withColumns({"_differs": differs, "_nth": F.row_number().over(stamp.orderBy("_ord", *VALUES)), "_back": yes(F.col("ts") < F.lag("ts").over(arrival)) if ordinal else F.lit(False)})
    first, placed = F.col("_nth") == 1, F.col("available_at").isNotNull()
    gaps = reduce(Column.__or__, [F.col(c).isNull() | F.isnan(c) for c in VALUES])
    whole = first & placed & ~gaps
    alive = whole & ~yes(impossible())
    rows = rows.withColumn("_alive", alive)
    # what was dropped stands in a partition of its own, so clean rows follow one another
    line = Window.partitionBy("symbol", "_alive").orderBy("ts")
    rows = rows.withColumns({"_move": F.abs(F.ln("close") - F.ln(F.lag("close").over(line))), "_quiet": F.col("_alive") & (F.col("volume") == 0)})
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_quiet"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_run", F.count(F.when(F.col("_quiet"), 1)).over(Window.partitionBy("symbol", "_alive", "_island")))
    flags = {
        "NAIVE_TIMESTAMPS": F.lit(naive), "UNSORTED": F.col("_back"), "CONFLICTING_DUPLICATES": F.col("_differs") & first, "DUPLICATES": ~first, "FUTURE_TIMESTAMPS": first & (F.col("ts") > asof), "NON_SESSION_BARS": first & ~placed,
        "NAN_VALUES": first & placed & gaps, "IMPOSSIBLE_OHLC": whole & yes(impossible()), "EXTREME_MOVE": F.col("_alive") & (F.col("_move") > limits.extreme_move), "ZERO_VOLUME_RUN": F.col("_quiet") & (F.col("_run") >= limits.zero_run),
    }
    codes = F.filter(F.array(*[F.when(yes(cond), F.lit(code)) for code, cond in flags.items()]), lambda c: c.isNotNull())
    # every rule and every later reader uses these rows; they are computed once
    judged = cut(rows.withColumn("_codes", codes).drop("_ord", "_differs", "_nth", "_back", "_move", "_quiet", "_island", "_run"))
    clean = judged.where("_alive").drop("_alive", "_codes")
    each = judged.select("symbol", "ts", F.explode("_codes").alias("code"))
    kinds = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    found = [each.groupBy("symbol", "code").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("symbol", "code", kinds[F.col("code")].alias("severity"), "n", "first_ts", "last_ts")]
    if universe is not None:
        none = universe.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti").withColumn("ts", F.lit(None).cast("timestamp"))
        found.append(_flag("EMPTY", none))
    lost = judged.groupBy("symbol").agg(F.max("_alive").alias("any")).where("not any").select("symbol", F.lit(None).cast("timestamp").alias("ts"))
    found.append(_flag("EMPTY_AFTER_CLEAN", lost))
    if timeframe == "1d":
        found += _session_rules(clean, calendar, asof, limits)
    if timeframe == "1h":
        short = clean.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("k"), F.min("ts").alias("ts")).where(F.col("k") < limits.short_session)
        found.append(_flag("SHORT_SESSIONS", short))
    issues = cut(reduce(DataFrame.unionByName, found))  # a few rows a symbol
    failed = issues.where("severity = 'ERROR'").select("symbol").distinct()
    return Validated(clean.join(failed, "symbol", "left_anti"), issues, failed)


def numbered(calendar: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Every day from the calendar's first session to its last: _day, _upto (sessions up to it), _open (1 if it is one); and that last day and number, for days beyond.

    A row a day, a few thousand for decades: this is what is broadcast, and no session meets a symbol.
    """
    sessions = calendar.select("session").distinct()
    ends = sessions.agg(F.min("session").alias("a"), F.max("session").alias("b"), F.count(F.lit(1)).alias("n")).first()
    days = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.lit(ends.a), F.lit(ends.b))).alias("_day")) if ends.n else sessions.select(F.col("session").alias("_day"))
    marked = days.join(sessions, F.col("_day") == F.col("session"), "left").select("_day", F.col("session").isNotNull().cast("int").alias("_open"))
    return marked.withColumn("_upto", F.sum("_open").over(Window.orderBy("_day"))), F.lit(ends.b), F.lit(ends.n)


def _session_rules(clean: DataFrame, calendar: DataFrame, asof: Column, limits: Limits) -> list[DataFrame]:
    """MISSING_SESSIONS: sessions between a symbol's ends without a bar; STALE: too many since its last.

    Sessions are numbered, so a gap is a difference between the numbers of a symbol's neighbouring days.
    """
    days, final, total = numbered(calendar)
    counted = lambda rows, day, pre: rows.join(F.broadcast(days.withColumnsRenamed({"_day": f"{pre}_day", "_upto": f"{pre}_upto", "_open": f"{pre}_open"})), F.col(day) == F.col(f"{pre}_day"), "left").withColumns({f"{pre}_upto": F.coalesce(f"{pre}_upto", F.when(F.col(day) > final, total).otherwise(0)), f"{pre}_open": F.coalesce(f"{pre}_open", F.lit(0))}).drop(f"{pre}_day")
    own = counted(clean.select("symbol", F.to_date("ts").alias("day")).distinct(), "day", "")
    last = F.lag("_upto").over(Window.partitionBy("symbol").orderBy("day"))
    gaps = own.withColumn("_from", last + 1).withColumn("_lost", F.coalesce(F.col("_upto") - F.col("_open") - F.col("_from") + 1, F.lit(0)))
    lost = F.col("_lost") > 0
    sums = gaps.groupBy("symbol").agg(
        F.sum("_lost").alias("n"), F.min(F.when(lost, F.col("_from"))).alias("_first"), F.max(F.when(lost, F.col("_upto") - F.col("_open"))).alias("_last"),
        F.max("day").alias("hi"), (F.max("_upto") - F.min("_upto") + F.min_by("_open", "day")).alias("expected"), F.max("_upto").alias("_to"), F.max_by("_open", "day").alias("_at_end"),
    )
    dated = lambda rows, number, name: rows.join(F.broadcast(days.where("_open = 1").select(F.col("_upto").alias(number), F.col("_day").cast("timestamp").alias(name))), number)
    missing = dated(dated(sums.where("n > 0"), "_first", "first_ts"), "_last", "last_ts")
    kind = F.when(F.col("n") / F.col("expected") > limits.missing_ratio, "ERROR").otherwise("WARNING")
    missing = missing.select("symbol", F.lit("MISSING_SESSIONS").alias("code"), kind.alias("severity"), "n", "first_ts", "last_ts")
    now = counted(sums.withColumn("_now", F.to_date(asof)), "_now", "_asof")
    since = now.select("symbol", (F.col("_asof_upto") - F.col("_to") + F.col("_at_end") - 1).alias("n"), F.col("hi").cast("timestamp").alias("first_ts")).where(F.col("n") > limits.stale_sessions)
    return [missing, since.select("symbol", F.lit("STALE").alias("code"), F.lit("ERROR").alias("severity"), "n", "first_ts", F.col("first_ts").alias("last_ts"))]
