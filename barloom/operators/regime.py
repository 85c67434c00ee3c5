"""Market regimes: trend and volatility labels per bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.common import by_symbol, ratio, yes
from ..functions.indicators import close
from ..functions.staged import Staged


def percentile_rank(s: Staged, col, window: int = 252, least: int | None = None):
    """Share of the earlier rows in the window below the current value; rows without a value stay in the denominator.

    NULL unless `least` values (a quarter of the window, 20 at least) are known, or if the current is not.
    """
    least = least or max(20, window // 4)
    w = by_symbol().rowsBetween(-(window - 1), 0)
    listed = s.keep(F.collect_list(F.struct(col.alias("v"))).over(w))
    known = s.keep(F.count(col).over(w))
    below = F.size(F.filter(listed, lambda x: x.v < col))
    return F.when((known >= least) & col.isNotNull() & (F.size(listed) > 1), below / (F.size(listed) - 1))


def classify(bars: DataFrame, ma: int = 200, slope: int = 20, band: float = 0.02, transition: int = 5, vol_window: int = 20, rank_window: int = 252, vix: DataFrame | None = None, vix_high: float | None = None) -> DataFrame:
    """symbol, ts, trend (BULL, BEAR, SIDEWAYS, TRANSITION or NULL), volatility (HIGH_VOLATILITY, LOW_VOLATILITY, NORMAL_VOLATILITY or NULL), dist_ma, ma_slope, vol_pct.

    TRANSITION covers `transition` bars from each change of label, the first of a history not being one.
    vix (ts, close) from vix_high on makes a bar HIGH_VOLATILITY, whatever its rank.
    """
    s = Staged(bars)
    mean = ind.sma(s, close(), ma)
    dist = s.keep(ratio(close(), mean) - 1)
    tilt = s.keep(ind.change(mean, slope))
    raw = s.keep(F.when((dist > band) & (tilt > 0), "BULL").when((dist < -band) & (tilt < 0), "BEAR").when(dist.isNotNull() & tilt.isNotNull(), "SIDEWAYS"))
    flip = s.keep(F.when(yes(raw != ind.lag(raw)), 1).otherwise(0))
    recent = s.keep(F.sum(flip).over(by_symbol().rowsBetween(-(transition - 1), 0)))
    vol = ind.historical_volatility(s, vol_window)
    rank = s.keep(percentile_rank(s, vol, rank_window))
    level = F.when(rank >= 0.8, "HIGH_VOLATILITY").when(rank <= 0.2, "LOW_VOLATILITY").when(rank.isNotNull(), "NORMAL_VOLATILITY")
    if vix is not None and vix_high is not None:
        s.df = s.df.join(F.broadcast(vix.select("ts", F.col("close").alias("_vix"))), "ts", "left")
        level = F.when(rank.isNotNull() & (F.col("_vix") >= vix_high), "HIGH_VOLATILITY").otherwise(level)
    return s.df.select("symbol", "ts", F.when(raw.isNotNull() & (recent > 0), "TRANSITION").otherwise(raw).alias("trend"), level.alias("volatility"), dist.alias("dist_ma"), tilt.alias("ma_slope"), rank.alias("vol_pct"))
