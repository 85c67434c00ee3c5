"""Indicators as columns of a Staged frame.  All are causal: a row uses itself and rows before it.

Those that need a running recurrence (smoothed averages and what builds on them) are in recurrences.py.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .common import by_symbol, ratio, rolled, trailing, yes
from .staged import Staged




def open_() -> Column:
    return F.col("open")


def high() -> Column:
    return F.col("high")


def low() -> Column:
    return F.col("low")


def close() -> Column:
    return F.col("close")


def volume() -> Column:
    return F.col("volume")


def lag(col: Column, n: int = 1) -> Column:
    return F.lag(col, n).over(by_symbol())


def change(col: Column, n: int = 1) -> Column:
    """Relative change over n rows."""
    return ratio(col, lag(col, n)) - 1


def true_range(s: Staged) -> Column:
    """Bar range widened by the gap from the previous close; the first bar has its own range."""
    return s.keep(F.greatest(high() - low(), F.abs(high() - lag(close())), F.abs(low() - lag(close()))))


def sma(s: Staged, col: Column, n: int) -> Column:
    return s.keep(rolled(F.avg, col, n))


def wma(s: Staged, col: Column, n: int) -> Column:
    """Linear weights, newest heaviest; NULL unless all n values are known."""
    return s.keep(sum((lag(col, k) if k else col) * float(n - k) for k in range(n)) / (n * (n + 1) / 2))


def hma(s: Staged, col: Column, n: int) -> Column:
    fast, slow = wma(s, col, max(n // 2, 1)), wma(s, col, n)
    return wma(s, s.keep(2 * fast - slow), max(int(math.sqrt(n)), 1))


def typical(s: Staged) -> Column:
    return s.keep((high() + low() + close()) / 3)


def vwap(s: Staged, n: int) -> Column:
    return s.keep(ratio(rolled(F.sum, typical(s) * volume(), n), rolled(F.sum, volume(), n)))


def session_vwap(s: Staged) -> Column:
    """Volume-weighted average since the start of the UTC day."""
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return s.keep(ratio(F.sum(typical(s) * volume()).over(day), F.sum(volume()).over(day)))


def middle(s: Staged, n: int) -> Column:
    return s.keep((rolled(F.max, high(), n) + rolled(F.min, low(), n)) / 2)


def ichimoku(s: Staged, fast: int = 9, slow: int = 26, span: int = 52) -> dict[str, Column]:
    """Lines as computed at each bar, without plotting shifts."""
    tenkan, kijun = middle(s, fast), middle(s, slow)
    return {"tenkan": tenkan, "kijun": kijun, "senkou_a": (tenkan + kijun) / 2, "senkou_b": middle(s, span)}


def stochastic(s: Staged, k: int = 14, d: int = 3) -> tuple[Column, Column]:
    lowest, highest = s.keep(rolled(F.min, low(), k)), s.keep(rolled(F.max, high(), k))
    fast = s.keep(100 * ratio(close() - lowest, highest - lowest))
    return fast, sma(s, fast, d)


def roc(col: Column, n: int = 10) -> Column:
    return 100 * change(col, n)


def cci(s: Staged, n: int = 20) -> Column:
    """Distance from the mean, over 0.015 mean absolute deviations around the window's own mean."""
    tp = typical(s)
    mean = sma(s, tp, n)
    window = s.keep(F.collect_list(tp).over(trailing(n)))
    spread = F.aggregate(window, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return ratio(tp - mean, 0.015 * spread)


def williams_r(s: Staged, n: int = 14) -> Column:
    lowest, highest = s.keep(rolled(F.min, low(), n)), s.keep(rolled(F.max, high(), n))
    return -100 * ratio(highest - close(), highest - lowest)


def bollinger(s: Staged, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = sma(s, close(), n), s.keep(rolled(F.stddev_pop, close(), n))
    return {"mid": mid, "upper": mid + k * sd, "lower": mid - k * sd, "pct_b": ratio(close() - (mid - k * sd), 2 * k * sd)}


def historical_volatility(s: Staged, n: int = 20, periods: int = 252) -> Column:
    move = s.keep(F.ln(close()) - F.ln(lag(close())))
    return s.keep(rolled(F.stddev_samp, move, n) * math.sqrt(periods))


def obv(s: Staged) -> Column:
    step = s.keep(F.coalesce(F.signum(close() - lag(close())), F.lit(0.0)) * volume())
    return s.keep(F.sum(step).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))


def relative_volume(n: int = 20) -> Column:
    """Volume over the mean of the n bars before this one."""
    return ratio(volume(), rolled(F.avg, volume(), n, by_symbol().rowsBetween(-n, -1)))


def swings(s: Staged, k: int = 3) -> dict[str, Column]:
    """Pivots k bars back, known at this bar once k bars on both sides have passed; ties count as pivots."""
    w = 2 * k + 1
    sides = {"high": (high(), F.max), "low": (low(), F.min)}
    confirmed = {name: s.keep(yes(lag(col, k) == rolled(agg, col, w))) for name, (col, agg) in sides.items()}
    last = dict(zip(sides, s.carry(*[F.when(confirmed[name], lag(col, k)) for name, (col, _) in sides.items()]), strict=True))
    # a pivot's own predecessor is what the bar before its confirmation knew
    own = [F.when(confirmed[name], F.struct(lag(last[name]).alias("p"))) for name in sides]
    previous = dict(zip(sides, s.carry(*own), strict=True))
    out: dict[str, Column] = {}
    for name in sides:
        out |= {f"{name}_confirmed": confirmed[name], f"last_{name}": last[name], f"higher_{name}": yes(last[name] > previous[name].p), f"lower_{name}": yes(last[name] < previous[name].p)}
    out["structure"] = F.when(out["higher_high"] & out["higher_low"], 1.0).when(out["lower_high"] & out["lower_low"], -1.0).otherwise(0.0)
    return out


def breakout(n: int = 20) -> tuple[Column, Column]:
    """Close above, and below, the range of the n bars before."""
    before = by_symbol().rowsBetween(-n, -1)
    return yes(rolled(F.max, high(), n, before) < close()), yes(rolled(F.min, low(), n, before) > close())


def pullback(s: Staged, trend: int = 50, fast: int = 10) -> Column:
    t, f = sma(s, close(), trend), sma(s, close(), fast)
    return F.when(yes((close() > t) & (close() < f)), 1.0).when(yes((close() < t) & (close() > f)), -1.0).otherwise(0.0)


def inside_bar() -> Column:
    return yes((lag(high()) > high()) & (lag(low()) < low()))


def engulfing() -> Column:
    o, c = lag(open_()), lag(close())
    bull = (close() > open_()) & (c < o) & (o <= close()) & (c >= open_())
    bear = (close() < open_()) & (c > o) & (o >= close()) & (c <= open_())
    return F.when(yes(bull), 1.0).when(yes(bear), -1.0).otherwise(0.0)


def gap() -> Column:
    return ratio(open_(), lag(close())) - 1
