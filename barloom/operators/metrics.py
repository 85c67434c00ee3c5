"""Performance of equity curves and trades, for all runs of a table at once.

Curves are (run_id, ts, equity[, gross_exposure]), trades (run_id, exit_ts, pnl, ...).  Each measure is one or two
aggregations by run; nothing is collected.  Where a measure follows a run bar by bar (peaks, falls, streaks), a run can be many
tasks: with slicing, given or in the session's settings, blocks of it are summed up, merged, and each starts from the blocks before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import ratio, yes
from ..functions.slices import Slicing, running, split, whole


def followed(rows: DataFrame, wanted: dict[str, tuple[str, Column]], order: list[str], slicing: Slicing | None, turned: dict[str, Column] | None = None, before: int = 0) -> DataFrame:
    """rows (run_id, ..) with running aggregates over each run, and before them the columns `turned`, which may look back over `before` rows by by_run(order)."""
    slicing = slicing or Slicing.of(rows.sparkSession)
    rows = rows.withColumnRenamed("run_id", "symbol")
    time = order[0]
    if slicing:
        rows = split(rows, slicing, before, time)
    rows = rows.withColumns({k: c for k, c in (turned or {}).items()})
    if slicing:
        return whole(running(rows, wanted, order)).withColumnRenamed("symbol", "run_id")
    line = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: getattr(F, how)(c).over(line) for name, (how, c) in wanted.items()}).withColumnRenamed("symbol", "run_id")


def _ahead(column: str, order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy("symbol").orderBy(*order))


def drawdowns(equity: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """Add drawdown: the curve over its highest value so far, less 1."""
    return followed(equity, {"_peak": ("max", F.col("equity"))}, ["ts"], slicing).withColumn("drawdown", F.col("equity") / F.col("_peak") - 1).drop("_peak")


def drawdown_episodes(equity: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """run_id, max_drawdown, avg_drawdown (mean of episodes' lows), max_recovery_bars (longest recovered), unrecovered_at_end."""
    dd = drawdowns(equity, slicing).withColumn("_in", F.col("drawdown") < 0)
    dd = followed(dd, {"_n": ("sum", F.lit(1)), "_island": ("sum", F.when(F.col("_in"), 0).otherwise(1))}, ["ts"], slicing)
    size = dd.groupBy("run_id").agg(F.max("_n").alias("_last"), F.min("drawdown").alias("max_drawdown"))
    low = dd.where("_in").groupBy("run_id", "_island").agg(F.min("drawdown").alias("_low"), F.count(F.lit(1)).alias("_len"), F.max("_n").alias("_end")).join(size.select("run_id", "_last"), "run_id")
    open_ = F.col("_end") == F.col("_last")
    found = low.groupBy("run_id").agg(F.avg("_low").alias("avg_drawdown"), F.max(F.when(~open_, F.col("_len"))).alias("_rec"), F.max(open_).alias("_open"))
    return size.join(found, "run_id", "left").select("run_id", "max_drawdown", F.coalesce("avg_drawdown", F.lit(0.0)).alias("avg_drawdown"), F.coalesce("_rec", F.lit(0)).alias("max_recovery_bars"), yes(F.col("_open")).alias("unrecovered_at_end"))


def _moves(equity: DataFrame, slicing: Slicing | None) -> DataFrame:
    """Add _r, the change from the bar before."""
    return followed(equity, {}, ["ts"], slicing, {"_r": ratio(F.col("equity"), _ahead("equity", ["ts"])) - 1}, before=1)


def equity_metrics(equity: DataFrame, bars_per_year: int = 252, risk_free: float = 0.0, slicing: Slicing | None = None) -> DataFrame:
    """One row per run; a run with fewer than two bars has insufficient_data = true and no measures."""
    per_bar = (1 + risk_free) ** (1 / bars_per_year) - 1
    root = math.sqrt(bars_per_year)
    if "gross_exposure" not in equity.columns:
        equity = equity.withColumn("gross_exposure", F.lit(None).cast("double"))
    rows = _moves(equity, slicing)
    excess = F.col("_r") - per_bar
    agg = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_bars"), F.min_by("equity", "ts").alias("_first"), F.max_by("equity", "ts").alias("_last"), F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_sd"),
        F.avg(excess).alias("_ex"), F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2))).alias("_down"), F.avg(F.when(F.col("gross_exposure") > 0, 1.0).otherwise(0.0)).alias("_exposed"), F.avg("gross_exposure").alias("_gross"),
    )
    agg = agg.join(drawdown_episodes(equity, slicing), "run_id")
    enough = F.col("n_bars") >= 2
    growth = F.col("_last") / F.col("_first")
    cagr = F.when(F.col("_last") > 0, F.pow(growth, F.lit(float(bars_per_year)) / F.col("n_bars")) - 1).otherwise(-1.0)
    down = F.col("_down") * root
    values = {
        "total_return": growth - 1, "cagr": cagr, "annualized_return": F.col("_mean") * bars_per_year, "volatility": F.col("_sd") * root,
        "sharpe": F.when(F.col("_sd") > 0, F.col("_ex") / F.col("_sd") * root), "sortino": F.when(down > 0, F.col("_ex") * bars_per_year / down),
        "max_drawdown": F.col("max_drawdown"), "avg_drawdown": F.col("avg_drawdown"), "max_recovery_bars": F.col("max_recovery_bars"), "unrecovered_at_end": F.col("unrecovered_at_end"),
        "calmar": F.when(F.col("max_drawdown") < 0, cagr / F.abs("max_drawdown")), "exposure": F.when(F.col("_gross").isNotNull(), F.col("_exposed")), "avg_gross_exposure": F.col("_gross"),
    }
    return agg.select("run_id", "n_bars", (~enough).alias("insufficient_data"), *[F.when(enough, v).alias(k) for k, v in values.items()])


def streaks(trades: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """run_id, max_win_streak, max_loss_streak, in order of exit; a trade without gain is a loss."""
    order = ["exit_ts", *[c for c in ("seq", "symbol") if c in trades.columns]]
    kept = trades.select("run_id", "exit_ts", "pnl", *[F.col(c).alias(f"_{c}") for c in order[1:]], (F.col("pnl") > 0).alias("_won"))
    order = ["exit_ts", *[f"_{c}" for c in order[1:]]]
    turn = F.when(F.col("_won") == _ahead("_won", order), 0).otherwise(1)
    won = followed(kept, {"_island": ("sum", F.col("_turn"))}, order, slicing, {"_turn": turn}, before=1)
    runs = won.groupBy("run_id", "_island", "_won").agg(F.count(F.lit(1)).alias("_n"))
    longest = lambda c: F.coalesce(F.max(F.when(c, F.col("_n"))), F.lit(0))
    return runs.groupBy("run_id").agg(longest(F.col("_won")).alias("max_win_streak"), longest(~F.col("_won")).alias("max_loss_streak"))


def trade_metrics(trades: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """One row per run with trades; profit_factor is infinite where nothing was lost."""
    p, won = F.col("pnl"), F.col("pnl") > 0
    gain, loss = F.coalesce(F.sum(F.when(won, p)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(~won, p)), F.lit(0.0)))
    avg_win, avg_loss = F.avg(F.when(won, p)), F.avg(F.when(~won, p))
    agg = trades.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(F.when(won, 1.0).otherwise(0.0)).alias("win_rate"), F.coalesce(avg_win, F.lit(0.0)).alias("avg_win"), F.coalesce(avg_loss, F.lit(0.0)).alias("avg_loss"),
        F.avg(p).alias("expectancy"), F.avg("r_multiple").alias("expectancy_r"), F.when(loss > 0, gain / F.nullif(loss, F.lit(0.0))).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        F.when(avg_loss < 0, avg_win / F.abs(avg_loss)).alias("payoff_ratio"), F.avg("bars_held").alias("avg_bars_held"), F.sum(F.col("qty") * (F.col("entry_price") + F.col("exit_price"))).alias("turnover"), F.sum("costs").alias("total_costs"),
    )
    return agg.join(streaks(trades, slicing), "run_id")


def periodic_returns(equity: DataFrame, period: str = "month") -> DataFrame:
    """run_id, period, ret: change of the last value of each month or year, the first against the first value."""
    rows = equity.groupBy("run_id", F.to_date(F.date_trunc(period, "ts")).alias("period")).agg(F.max_by("equity", "ts").alias("_last"), F.min_by("equity", "ts").alias("_first"))
    before = F.lag("_last").over(Window.partitionBy("run_id").orderBy("period"))
    return rows.select("run_id", "period", (F.col("_last") / F.coalesce(before, F.col("_first")) - 1).alias("ret"))


def by_regime(equity: DataFrame, regime: DataFrame, bars_per_year: int = 252) -> DataFrame:
    """run_id, trend, n, ann_return, sharpe, hit_rate of the bars under each label (ts, trend), where two or more."""
    rows = _moves(equity, None).where("_r is not null").join(F.broadcast(regime.select("ts", "trend")), "ts").where("trend is not null")
    sd = F.stddev_samp("_r")
    return rows.groupBy("run_id", "trend").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("_r") * bars_per_year).alias("ann_return"), F.when(sd > 0, F.avg("_r") / sd * math.sqrt(bars_per_year)).alias("sharpe"), F.avg(F.when(F.col("_r") > 0, 1.0).otherwise(0.0)).alias("hit_rate")
    ).where("n >= 2")


def profit_concentration(trades: DataFrame, top: float = 0.05) -> DataFrame:
    """run_id, concentration: share of the net profit that the best `top` of trades made; NULL without a profit."""
    k = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("pnl")))
    n = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    rows = trades.withColumns({"_k": k, "_most": F.greatest(F.lit(1), F.ceil(n * top))})
    total = F.sum("pnl")
    return rows.groupBy("run_id").agg(F.when(total > 0, F.sum(F.when(F.col("_k") <= F.col("_most"), F.col("pnl"))) / total).alias("concentration"))


def return_moments(equity: DataFrame) -> DataFrame:
    """run_id, n, mean, sd, skew, kurt of bar returns: biased skewness, non-excess kurtosis."""
    rows = _moves(equity, None)
    return rows.groupBy("run_id").agg(F.count("_r").alias("n"), F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("sd"), F.skewness("_r").alias("skew"), (F.kurtosis("_r") + 3).alias("kurt"))
