"""The feature catalogue, regimes, strategy conditions and feature evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.features import compute, feature
from ..functions.slices import Slicing
from ..functions.staged import Staged
from ..operators import regime, selection
from ..plans.strategy import Condition, Stop, Strategy, TakeProfit, decide, feat, val
from ..sources import bars as src
from .base import BARS, HOUR_BARS, tidy

_W = "PARTITION BY symbol ORDER BY ts"


def _rows(n: int, what: str, end: int = 0) -> str:
    """what over the last n rows, NULL unless all are there; end = 1 leaves the current row out."""
    frame = f"({_W} ROWS BETWEEN {n - 1 + end} PRECEDING AND {'CURRENT ROW' if not end else f'{end} PRECEDING'})"
    inner = what[what.index("(") + 1 : -1]
    return f"CASE WHEN count({inner}) OVER {frame} = {n} THEN {what} OVER {frame} END"


def _lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({_W})"


def _features(spark: SparkSession, sf: str, *names: str, slicing: Slicing | None = None, places: int = 6) -> DataFrame:
    """Features by name, in columns named by the feature."""
    wanted = [feature(n) for n in names]
    got = compute(src.order_bars(spark, sf), wanted, slicing=slicing)
    return tidy(got.select("symbol", "ts", *[f.column.alias(f.name) for f in wanted]), places)


def _sql(columns: dict[str, str], stages: list[dict[str, str]] | None = None, bars: str = BARS) -> str:
    """A select of rounded columns over bars with staged helper columns."""
    at, ctes = "bars", [bars]
    for i, stage in enumerate(stages or []):
        ctes.append(f"s{i} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in stage.items())} FROM {at})")
        at = f"s{i}"
    ctes.append(f"out AS (SELECT symbol, ts, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {at})")
    return f"WITH {', '.join(ctes)} SELECT symbol, ts, {', '.join(f'round({k}::DOUBLE, 6) + 0.0 AS {k}' for k in columns)} FROM out"


def _wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"{_lag(x, k) if k else x} * {n - k}" for k in range(n)) + f") / {n * (n + 1) / 2}"


_TP = "(high + low + close) / 3"
_MID = lambda n: f"({_rows(n, 'max(high)')} + {_rows(n, 'min(low)')}) / 2"
_SWING = [
    {f"{p}c": f"coalesce({_lag(c, 3)} = ({_rows(7, f'{a}({c})')}), false)" for p, c, a in (("h", "high", "max"), ("l", "low", "min"))},
    {f"{p}p": f"CASE WHEN {p}c THEN {_lag(c, 3)} END" for p, c in (("h", "high"), ("l", "low"))},
    {f"{p}l": f"last_value({p}p IGNORE NULLS) OVER ({_W})" for p in "hl"} | {f"{p}q": f"CASE WHEN {p}c THEN last_value({p}p IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END" for p in "hl"} | {f"{p}k": f"max(CASE WHEN {p}c THEN ts END) OVER ({_W})" for p in "hl"},
    {f"{p}v": f"first_value({p}q) OVER (PARTITION BY symbol, {p}k ORDER BY ts)" for p in "hl"},
]


def features_trend(spark, sf):
    return _features(spark, sf, "sma", "hma", "dist_sma", "sma_slope", "dist_vwap", "ichimoku_tk")


def features_momentum(spark, sf):
    return _features(spark, sf, "stoch_k", "roc", "cci", "williams_r")


def features_volatility(spark, sf):
    return _features(spark, sf, "hist_vol", "bb_pct_b", "bb_width", "vol_ratio")


def features_volume(spark, sf):
    return _features(spark, sf, "rel_volume", "volume_roc", "obv_slope")


def features_returns(spark, sf):
    return _features(spark, sf, "ret", "log_ret", "drawdown", "gap", "gap_abs_mean")


def features_structure(spark, sf):
    return _features(spark, sf, "structure", "dist_resistance", "dist_support", "breakout_up", "breakout_down", "pullback")


def features_price_action(spark, sf):
    return _features(spark, sf, "inside_bar", "engulfing")


def features_relative(spark, sf):
    """Against the bars of all priorities together, by equal ts."""
    bars = src.order_bars(spark, sf)
    bench = bars.groupBy("ts").agg(F.avg("close").alias("close"))
    wanted = [feature(n) for n in ("rel_strength", "beta", "corr_bench")]
    got = compute(bars, wanted, bench)
    return tidy(got.select("symbol", "ts", *[f.column.alias(f.name) for f in wanted]))


def features_recurrence(spark, sf):
    """The ten running features, in one pass."""
    return _features(spark, sf, "ema", "dist_ema", "rsi", "macd_hist", "atr", "atr_pct", "adx", "di_diff", "supertrend_dir", "keltner_pos", places=_PLACES)


#: Sums in blocks differ from sums bar by bar in the last digits, and prices here have six before the point
_PLACES = 4
#: Whole months, until there are this many bars: some 17 slices a symbol at sf0.01
_SLICES = Slicing(100, "month")


def features_recurrence_sliced(spark, sf):
    """The ten running features, with every symbol's history in slices: states are folded along them."""
    return _features(spark, sf, "ema", "dist_ema", "rsi", "macd_hist", "atr", "atr_pct", "adx", "di_diff", "supertrend_dir", "keltner_pos", slicing=_SLICES, places=_PLACES)


def features_structure_sliced(spark, sf):
    """Pivots carried over slices, and trailing windows over a halo."""
    return _features(spark, sf, "structure", "dist_resistance", "dist_support", "breakout_up", "breakout_down", "pullback", slicing=_SLICES)


def features_returns_sliced(spark, sf):
    """Trailing windows of a year, longer than many slices."""
    return _features(spark, sf, "ret", "log_ret", "drawdown", "gap", "gap_abs_mean", slicing=_SLICES)


def indicators_session_vwap(spark, sf):
    s = Staged(src.event_bars(spark, sf))
    return tidy(s.select(vwap=ind.session_vwap(s)).select("symbol", "ts", "vwap"))


def indicators_bands(spark, sf):
    """Bollinger edges, Ichimoku lines, WMA, slow stochastic and running volume."""
    s = Staged(src.order_bars(spark, sf))
    band, lines = ind.bollinger(s), ind.ichimoku(s)
    out = s.select(upper=band["upper"], lower=band["lower"], tenkan=lines["tenkan"], kijun=lines["kijun"], senkou_a=lines["senkou_a"], senkou_b=lines["senkou_b"], wma=ind.wma(s, F.col("close"), 10), stoch_d=ind.stochastic(s)[1], obv=ind.obv(s), tr=ind.true_range(s))
    return tidy(out.drop("open", "high", "low", "close", "volume"))


def regime_labels(spark, sf):
    return tidy(regime.classify(src.order_bars(spark, sf)))


_STRATEGY = Strategy(
    "cross with filters", direction="both", entry_long=(Condition(feat("close"), "cross_above", feat("sma", n=20)), Condition(feat("rel_volume", n="$vol"), ">", val(0.5))), exit_long=(Condition(feat("close"), "<", feat("sma", n=20)), Condition(feat("ret"), "<", val("$drop"))),
    entry_short=(Condition(feat("close"), "cross_below", feat("sma", n=20)),), exit_short=(Condition(feat("close"), ">", feat("sma", n=20)),), stop=Stop("percent", "$stop"), take_profit=TakeProfit("r_multiple", 2.0), rank_by=feat("roc", n=10), params={"vol": 20, "drop": -0.5, "stop": 0.05},
)


def strategy_decisions(spark, sf):
    """DS1 to DS4, DS6 to DS11 on one strategy for both sides."""
    return tidy(decide(_STRATEGY, src.order_bars(spark, sf)).drop("open", "high", "low", "close", "volume"))


def strategy_regime_filter(spark, sf):
    """DS5 and DS10: entries in trends up or sideways only, stops at the last swing low."""
    bars = src.order_bars(spark, sf)
    trend = regime.classify(bars.where("symbol = '1-URGENT'"))
    s = Strategy("breakout", entry_long=(Condition(feat("breakout_up", n=5), ">", val(0.0)),), stop=Stop("structure"), allowed_regimes=("BULL", "SIDEWAYS"))
    return tidy(decide(s, bars, trend).select("symbol", "ts", "long_entry", "stop_dist"))


def entries_per_symbol(spark, sf):
    """The flagship: scan, bars, windows, conditions, aggregation."""
    s = Strategy("cross", entry_long=(Condition(feat("close"), "cross_above", feat("sma", n=20)),), stop=Stop("percent", 0.05))
    return decide(s, src.order_bars(spark, sf)).where("long_entry").groupBy("symbol").agg(F.count(F.lit(1)).alias("entries"), F.sum("volume").alias("volume"))


_EVAL = ["ret", "roc", "drawdown", "rel_volume"]


def _labelled(spark, sf):
    wanted = [feature(n) for n in _EVAL]
    got = compute(selection.forward_return(src.order_bars(spark, sf), 1), wanted)
    return got.select("symbol", "ts", "label", *[F.round(f.column, 9).alias(f.name) for f in wanted])


def forward_returns(spark, sf):
    return tidy(selection.forward_return(src.order_bars(spark, sf), 3).select("symbol", "ts", "label"))


def feature_ic(spark, sf):
    return tidy(selection.rank_ic(_labelled(spark, sf), _EVAL))


def feature_ic_stability(spark, sf):
    return tidy(selection.ic_stability(_labelled(spark, sf), _EVAL))


def feature_redundancy(spark, sf):
    return tidy(selection.redundancy(_labelled(spark, sf), _EVAL, 0.0))


def feature_ridge(spark, sf):
    """coefficients of a fit on standard columns."""
    fit = selection.ridge(_labelled(spark, sf), ["ret", "drawdown"], penalty=2.0)
    return tidy(spark.createDataFrame([("intercept", fit["intercept"]), *fit["coef"].items()], "term string, value double"))


def feature_importance(spark, sf):
    """fitted on the bars before 1999, judged on those after; ten shuffles of each feature in one join."""
    rows = _labelled(spark, sf)
    split = F.lit("1999-01-01").cast("timestamp")
    return tidy(selection.importance(rows.where(F.col("ts") < split), rows.where(F.col("ts") >= split), _EVAL))


def feature_selection(spark, sf):
    """which features are kept, weak, unstable or redundant."""
    return spark.createDataFrame(sorted(selection.select(_labelled(spark, sf), _EVAL, max_rho=0.5).items()), "feature string, verdict string")


QUERIES = {f.__name__: f for f in (
    features_trend, features_momentum, features_volatility, features_volume, features_returns, features_structure, features_price_action, features_relative, features_recurrence, features_recurrence_sliced, features_structure_sliced, features_returns_sliced, indicators_session_vwap, indicators_bands,
    regime_labels, strategy_decisions, strategy_regime_filter, entries_per_symbol, forward_returns, feature_ic, feature_ic_stability, feature_redundancy, feature_ridge, feature_importance, feature_selection,
)}

_REL = "CASE WHEN c IS NOT NULL AND b IS NOT NULL THEN"
_REGIME_STAGES = [
    {"ma": _rows(200, "avg(close)"), "lr": f"ln(close) - ln({_lag('close')})"},
    {"dist_ma": "close / ma - 1", "ma_slope": f"ma / {_lag('ma', 20)} - 1", "vol": f"({_rows(20, 'stddev_samp(lr)')}) * sqrt(252)", "rn": f"row_number() OVER ({_W})"},
    {"raw": "CASE WHEN dist_ma > 0.02 AND ma_slope > 0 THEN 'BULL' WHEN dist_ma < -0.02 AND ma_slope < 0 THEN 'BEAR' WHEN dist_ma IS NOT NULL AND ma_slope IS NOT NULL THEN 'SIDEWAYS' END", "vols": f"list(vol) OVER ({_W} ROWS 251 PRECEDING)", "nv": f"count(vol) OVER ({_W} ROWS 251 PRECEDING)"},
    {"flip": f"CASE WHEN raw <> {_lag('raw')} THEN 1 ELSE 0 END", "vol_pct": "CASE WHEN nv >= 63 AND vol IS NOT NULL THEN len(list_filter(vols, lambda v: v < vol)) / (least(rn, 252) - 1)::DOUBLE END"},
    {"recent": f"sum(flip) OVER ({_W} ROWS 4 PRECEDING)"},
]
_TREND = "CASE WHEN raw IS NOT NULL AND recent > 0 THEN 'TRANSITION' ELSE raw END"


def _stages(stages: list[dict[str, str]], bars: str = BARS) -> str:
    at, ctes = "bars", [bars]
    for i, stage in enumerate(stages):
        ctes.append(f"r{i} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in stage.items())} FROM {at})")
        at = f"r{i}"
    return "WITH " + ", ".join(ctes)


_LABELLED = _sql({"label": f"lead(close) OVER ({_W}) / close - 1", "ret": f"close / {_lag('close')} - 1", "roc": f"100 * (close / {_lag('close', 10)} - 1)", "drawdown": f"close / max(close) OVER ({_W} ROWS 251 PRECEDING) - 1", "rel_volume": f"volume / ({_rows(20, 'avg(volume)', 1)})"})
_LABELLED = _LABELLED[: _LABELLED.rindex("SELECT symbol, ts,")]
_LONG = _LABELLED + ", z AS (SELECT symbol, ts, label, " + ", ".join(f"round({n}, 9) AS {n}" for n in _EVAL) + " FROM out), long AS (" + " UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS feature, {n} AS x, label AS y FROM z WHERE {n} IS NOT NULL AND label IS NOT NULL" for n in _EVAL) + ")"


def _ranks(source: str, key: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {key} ORDER BY {c}) + (count(*) OVER (PARTITION BY {key}, {c}) - 1) / 2.0"
    return f"rk AS (SELECT *, {rank('x')} AS rx, {rank('y')} AS ry FROM {source})"


_DEC = _stages([{"m": _rows(20, "avg(close)"), "rv": f"volume / ({_rows(20, 'avg(volume)', 1)})"}, {"up": f"coalesce(close > m AND {_lag('close')} <= {_lag('m')}, false)", "dn": f"coalesce(close < m AND {_lag('close')} >= {_lag('m')}, false)", "rt": f"close / {_lag('close')} - 1", "rk": f"100 * (close / {_lag('close', 10)} - 1)"}, {"le": "up AND coalesce(rv > 0.5, false)"}])
_STEP = lambda n, x, prev, seed: f"CASE WHEN b.rn = {seed} THEN (SELECT avg(q.{x}) FROM base q WHERE q.symbol = b.symbol AND q.rn BETWEEN {seed} - {n} + 1 AND {seed}) WHEN b.rn > {seed} THEN {prev} + (b.{x} - {prev}) / {n} END"
_EMA = lambda n, prev, x="b.close": f"CASE WHEN {prev} IS NULL THEN {x} ELSE {prev} + 2.0 / {n + 1} * ({x} - {prev}) END"
_RECURRENCE = f"""WITH RECURSIVE {BARS}, d AS (SELECT *, row_number() OVER ({_W}) AS rn, {_lag('close')} AS pc, high - {_lag('high')} AS up, {_lag('low')} - low AS dn FROM bars),
    base AS (SELECT symbol, ts, rn, high, low, close, pc, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
      CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM d),
    r AS (SELECT symbol, 0::BIGINT AS rn, NULL::DOUBLE AS e20, NULL::DOUBLE AS e12, NULL::DOUBLE AS e26, NULL::DOUBLE AS g, NULL::DOUBLE AS l, NULL::DOUBLE AS a14, NULL::DOUBLE AS a10, NULL::DOUBLE AS p, NULL::DOUBLE AS m FROM base WHERE rn = 1
      UNION ALL SELECT b.symbol, b.rn, {_EMA(20, 'r.e20')}, {_EMA(12, 'r.e12')}, {_EMA(26, 'r.e26')}, {_STEP(14, 'gain', 'r.g', 15)}, {_STEP(14, 'loss', 'r.l', 15)}, {_STEP(14, 'tr', 'r.a14', 14)}, {_STEP(10, 'tr', 'r.a10', 10)}, {_STEP(14, 'pdm', 'r.p', 14)}, {_STEP(14, 'mdm', 'r.m', 14)}
      FROM r JOIN base b ON b.symbol = r.symbol AND b.rn = r.rn + 1),
    q AS (SELECT b.symbol, b.ts, b.rn, b.high, b.low, b.close, e20, CASE WHEN b.rn >= 26 THEN e12 - e26 END AS line, g, l, a14, a10, 100 * p / a14 AS pdi, 100 * m / a14 AS mdi FROM r JOIN base b USING (symbol, rn)),
    q2 AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx, (high + low) / 2 + 3.0 * a10 AS ub, (high + low) / 2 - 3.0 * a10 AS lb FROM q),
    r2 AS (SELECT symbol, 0::BIGINT AS rn, NULL::DOUBLE AS sig, NULL::DOUBLE AS adx, NULL::DOUBLE AS fu, NULL::DOUBLE AS fl, NULL::DOUBLE AS pc, 1 AS way FROM q2 WHERE rn = 1
      UNION ALL SELECT symbol, rn, sig, adx, fu, fl, close, CASE WHEN fu IS NULL THEN 1 WHEN way = 1 THEN CASE WHEN close < fl THEN -1 ELSE 1 END ELSE CASE WHEN close > fu THEN 1 ELSE -1 END END FROM (
        SELECT b.symbol, b.rn, b.close, r2.way, CASE WHEN b.line IS NULL THEN NULL WHEN r2.sig IS NULL THEN b.line ELSE r2.sig + 0.2 * (b.line - r2.sig) END AS sig,
          CASE WHEN b.rn = 27 THEN (SELECT avg(x.dx) FROM q2 x WHERE x.symbol = b.symbol AND x.rn BETWEEN 14 AND 27) WHEN b.rn > 27 THEN r2.adx + coalesce((b.dx - r2.adx) / 14, 0) END AS adx,
          CASE WHEN r2.fu IS NULL OR b.ub < r2.fu OR r2.pc > r2.fu THEN b.ub ELSE r2.fu END AS fu, CASE WHEN r2.fl IS NULL OR b.lb > r2.fl OR r2.pc < r2.fl THEN b.lb ELSE r2.fl END AS fl
        FROM r2 JOIN q2 b ON b.symbol = r2.symbol AND b.rn = r2.rn + 1) z),
    o AS (SELECT q2.symbol, ts, CASE WHEN rn >= 20 THEN e20 END AS ema, CASE WHEN rn >= 20 THEN close / e20 - 1 END AS dist_ema, CASE WHEN g IS NOT NULL THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi,
      CASE WHEN rn >= 34 THEN (line - sig) / close END AS macd_hist, a14 AS atr, a14 / close AS atr_pct, adx, pdi - mdi AS di_diff, CASE WHEN fu IS NOT NULL THEN way::DOUBLE END AS supertrend_dir, CASE WHEN rn >= 20 THEN (close - e20) / (2.0 * a10) END AS keltner_pos
      FROM q2 JOIN r2 USING (symbol, rn))
    SELECT symbol, ts, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ('ema', 'dist_ema', 'rsi', 'macd_hist', 'atr', 'atr_pct', 'adx', 'di_diff', 'supertrend_dir', 'keltner_pos'))} FROM o"""

ORACLES = {
    "features_trend": _sql(
        {"sma": _rows(20, "avg(close)"), "hma": _wma("hd", 4), "dist_sma": "close / m50 - 1", "sma_slope": f"m50 / {_lag('m50', 5)} - 1", "dist_vwap": f"close / (({_rows(20, 'sum(tv)')}) / ({_rows(20, 'sum(volume)')})) - 1", "ichimoku_tk": f"({_MID(9)} - {_MID(26)}) / close"},
        [{"m50": _rows(50, "avg(close)"), "tv": f"{_TP} * volume", "wf": _wma("close", 10), "ws": _wma("close", 20)}, {"hd": "2 * wf - ws"}],
    ),
    "features_momentum": _sql(
        {"stoch_k": "100 * (close - lo) / nullif(hi - lo, 0)", "roc": f"100 * (close / {_lag('close', 10)} - 1)", "cci": "(tp - mean) / nullif(0.015 * list_sum(list_transform(win, lambda x: abs(x - mean))) / 20, 0)", "williams_r": "-100 * (hi - close) / nullif(hi - lo, 0)"},
        [{"tp": _TP, "lo": _rows(14, "min(low)"), "hi": _rows(14, "max(high)")}, {"mean": _rows(20, "avg(tp)"), "win": f"list(tp) OVER ({_W} ROWS 19 PRECEDING)"}],
    ),
    "features_volatility": _sql(
        {"hist_vol": f"({_rows(20, 'stddev_samp(lr)')}) * sqrt(252)", "bb_pct_b": "(close - (m - 2 * sd)) / nullif(4 * sd, 0)", "bb_width": "4 * sd / m", "vol_ratio": f"({_rows(10, 'stddev_samp(lr)')}) / ({_rows(60, 'stddev_samp(lr)')})"},
        [{"lr": f"ln(close) - ln({_lag('close')})", "m": _rows(20, "avg(close)"), "sd": _rows(20, "stddev_pop(close)")}],
    ),
    "features_volume": _sql(
        {"rel_volume": f"volume / ({_rows(20, 'avg(volume)', 1)})", "volume_roc": f"100 * (volume / {_lag('volume', 10)} - 1)", "obv_slope": f"(obv - {_lag('obv', 20)}) / ({_rows(20, 'sum(volume)')})"},
        [{"step": f"coalesce(sign(close - {_lag('close')}), 0) * volume"}, {"obv": f"sum(step) OVER ({_W})"}],
    ),
    "features_returns": _sql(
        {"ret": f"close / {_lag('close')} - 1", "log_ret": f"ln(close) - ln({_lag('close')})", "drawdown": f"close / max(close) OVER ({_W} ROWS 251 PRECEDING) - 1", "gap": "g", "gap_abs_mean": _rows(20, "avg(ag)")},
        [{"g": f"open / {_lag('close')} - 1"}, {"ag": "abs(g)"}],
    ),
    "features_structure": _sql(
        {"structure": "CASE WHEN hl > hv AND ll > lv THEN 1.0 WHEN hl < hv AND ll < lv THEN -1.0 ELSE 0.0 END", "dist_resistance": "close / hl - 1", "dist_support": "close / ll - 1", "breakout_up": f"CASE WHEN close > ({_rows(20, 'max(high)', 1)}) THEN 1.0 ELSE 0.0 END", "breakout_down": f"CASE WHEN close < ({_rows(20, 'min(low)', 1)}) THEN 1.0 ELSE 0.0 END",
         "pullback": f"CASE WHEN close > ({_rows(50, 'avg(close)')}) AND close < ({_rows(10, 'avg(close)')}) THEN 1.0 WHEN close < ({_rows(50, 'avg(close)')}) AND close > ({_rows(10, 'avg(close)')}) THEN -1.0 ELSE 0.0 END"},
        _SWING,
    ),
    "features_price_action": _sql(
        {"inside_bar": "CASE WHEN high < ph AND low > pl THEN 1.0 ELSE 0.0 END", "engulfing": "CASE WHEN close > open AND pc < po AND close >= po AND open <= pc THEN 1.0 WHEN close < open AND pc > po AND close <= po AND open >= pc THEN -1.0 ELSE 0.0 END"},
        [{"ph": _lag("high"), "pl": _lag("low"), "po": _lag("open"), "pc": _lag("close")}],
    ),
    "features_relative": _sql(
        {"rel_strength": f"(close / {_lag('close', 63)} - 1) - (bench / {_lag('bench', 63)} - 1)", "beta": f"CASE WHEN count(x) OVER ({_W} ROWS 125 PRECEDING) = 126 THEN covar_samp(x, y) OVER ({_W} ROWS 125 PRECEDING) / var_samp(y) OVER ({_W} ROWS 125 PRECEDING) END", "corr_bench": f"CASE WHEN count(x) OVER ({_W} ROWS 62 PRECEDING) = 63 THEN corr(x, y) OVER ({_W} ROWS 62 PRECEDING) END"},
        [{"bench": "avg(close) OVER (PARTITION BY ts)"}, {"x": f"close / {_lag('close')} - 1", "y": f"bench / {_lag('bench')} - 1"}],
    ),
    "features_recurrence": _RECURRENCE,
    "indicators_session_vwap": f"WITH {HOUR_BARS}, o AS (SELECT symbol, ts, sum({_TP} * volume) OVER w / sum(volume) OVER w AS vwap FROM bars WINDOW w AS (PARTITION BY symbol, ts::DATE ORDER BY ts)) SELECT symbol, ts, round(vwap, 6) + 0.0 AS vwap FROM o",
    "indicators_bands": _sql(
        {"upper": "m + 2 * sd", "lower": "m - 2 * sd", "tenkan": "tk", "kijun": "kj", "senkou_a": "(tk + kj) / 2", "senkou_b": _MID(52), "wma": _wma("close", 10), "stoch_d": _rows(3, "avg(pk)"), "obv": f"sum(step) OVER ({_W})", "tr": f"greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')}))"},
        [{"m": _rows(20, "avg(close)"), "sd": _rows(20, "stddev_pop(close)"), "tk": _MID(9), "kj": _MID(26), "step": f"coalesce(sign(close - {_lag('close')}), 0) * volume", "pk": f"100 * (close - ({_rows(14, 'min(low)')})) / nullif(({_rows(14, 'max(high)')}) - ({_rows(14, 'min(low)')}), 0)"}],
    ),
    "regime_labels": _stages(_REGIME_STAGES) + f" SELECT symbol, ts, {_TREND} AS trend, CASE WHEN vol_pct >= 0.8 THEN 'HIGH_VOLATILITY' WHEN vol_pct <= 0.2 THEN 'LOW_VOLATILITY' WHEN vol_pct IS NOT NULL THEN 'NORMAL_VOLATILITY' END AS volatility, round(dist_ma, 6) + 0.0 AS dist_ma, round(ma_slope, 6) + 0.0 AS ma_slope, round(vol_pct, 6) + 0.0 AS vol_pct FROM r4",
    "strategy_decisions": _DEC + " SELECT symbol, ts, le AND NOT dn AS long_entry, dn AND NOT le AS short_entry, coalesce(close < m, false) OR coalesce(rt < -0.5, false) AS long_exit, coalesce(close > m, false) AS short_exit, round(close * 0.05, 6) + 0.0 AS stop_dist, round(close * 0.05 * 2.0, 6) + 0.0 AS tp_dist, round(rk, 6) + 0.0 AS rank FROM r2",
    "strategy_regime_filter": (
        _stages(_SWING) + ", reg0 AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _REGIME_STAGES[0].items()) + " FROM bars WHERE symbol = '1-URGENT')" + "".join(f", reg{i} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in st.items())} FROM reg{i - 1})" for i, st in enumerate(_REGIME_STAGES[1:], 1))
        + f", lab AS (SELECT ts, {_TREND} AS trend FROM reg4), x AS (SELECT r3.*, CASE WHEN close - ll > 0 THEN close - ll END AS sd, coalesce(close > ({_rows(5, 'max(high)', 1)}), false) AS up FROM r3)"
        + " SELECT symbol, x.ts, up AND coalesce(trend IN ('BULL', 'SIDEWAYS'), false) AND sd IS NOT NULL AS long_entry, round(sd, 6) + 0.0 AS stop_dist FROM x LEFT JOIN lab ON lab.ts = x.ts"),
    "entries_per_symbol": _DEC + " SELECT symbol, count(*) AS entries, sum(volume) AS volume FROM r1 WHERE up GROUP BY symbol",
    "forward_returns": _sql({"label": f"lead(close, 3) OVER ({_W}) / close - 1"}),
    "feature_ic": _LONG + ", " + _ranks("long", "feature") + " SELECT feature, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN corr(rx, ry) END, 6) + 0.0 AS ic FROM rk GROUP BY feature",
    "feature_ic_stability": _LONG + ", ch AS (SELECT *, ntile(5) OVER (PARTITION BY feature ORDER BY ts, symbol) AS chunk FROM long), " + _ranks("ch", "feature, chunk") + ", per AS (SELECT feature, chunk, corr(rx, ry) AS ic FROM rk GROUP BY ALL HAVING count(*) >= 30) SELECT feature, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) + 0.0 AS ic_sd, round(greatest(avg((ic > 0)::INT), avg((ic < 0)::INT)), 6) + 0.0 AS sign_consistency FROM per GROUP BY feature",
    "feature_redundancy": _LABELLED + ", z AS (SELECT symbol, ts, " + ", ".join(f"round({n}, 9) AS {n}" for n in _EVAL) + " FROM out), pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM z WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(sorted(_EVAL)) for b in sorted(_EVAL)[i + 1 :]) + "), " + _ranks("pr", "a, b") + " SELECT a, b, round(corr(rx, ry), 6) + 0.0 AS rho FROM rk GROUP BY a, b",
    "feature_ridge": _LABELLED + """, z AS (SELECT round(ret, 9) AS a, round(drawdown, 9) AS b, label AS y FROM out WHERE ret IS NOT NULL AND drawdown IS NOT NULL AND label IS NOT NULL),
        s AS (SELECT count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) + 2.0 AS saa, sum(b * b) + 2.0 AS sbb, sum(a * b) AS sab, sum(y) AS sy, sum(a * y) AS say, sum(b * y) AS sby FROM z),
        t AS (SELECT *, saa - sa * sa / n AS caa, sbb - sb * sb / n AS cbb, sab - sa * sb / n AS cab, say - sa * sy / n AS cay, sby - sb * sy / n AS cby FROM s),
        k AS (SELECT *, (cay * cbb - cby * cab) / (caa * cbb - cab * cab) AS ka, (cby * caa - cay * cab) / (caa * cbb - cab * cab) AS kb FROM t)
        SELECT term, round(value, 6) + 0.0 AS value FROM (SELECT 'intercept' AS term, (sy - ka * sa - kb * sb) / n AS value FROM k UNION ALL SELECT 'ret', ka FROM k UNION ALL SELECT 'drawdown', kb FROM k)""",
}
ORACLES |= {f"features_{k}_sliced": ORACLES[f"features_{k}"] for k in ("recurrence", "structure", "returns")}
