"""Metrics, simulation, research, risk, portfolio, lifecycle, scan and streaming queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import compute, feature
from ..functions.slices import Slicing
from ..operators import lifecycle, portfolio, regime, risk, simulate
from ..operators import metrics as m
from ..operators.align import with_availability
from ..plans import research as rs
from ..plans.scan import Slot, scan
from ..plans.strategy import Condition, Stop, Strategy, TakeProfit, decide, feat, trend_baseline, val, with_params
from ..sources import bars as src
from ..sources.calendar import weekday_calendar
from ..streaming.bars import stream_bars, stream_sessions
from ..streaming.paper import replay
from .base import BARS, CALENDAR_SPAN, HOUR_BARS, SHIP_BARS, table, tidy

_W = "PARTITION BY run_id ORDER BY ts"
#: Each priority's closes as an equity curve, and each order as a trade
_EQUITY = f"{BARS}, eq AS (SELECT symbol AS run_id, ts, close AS equity, CASE WHEN volume > 1 THEN volume / 10 ELSE 0.0 END AS gross_exposure FROM bars)"
_TRADES = "trades AS (SELECT o_orderpriority AS run_id, o_orderkey AS seq, o_orderdate AS exit_ts, o_totalprice - 150000 AS pnl, (o_totalprice - 150000) / 50000 AS r_multiple, (o_orderkey % 17)::INT AS bars_held, 2.0::DOUBLE AS qty, 10.0::DOUBLE AS entry_price, 11.0::DOUBLE AS exit_price, 0.5::DOUBLE AS costs FROM orders)"


def _equity(spark: SparkSession, sf: str) -> DataFrame:
    b = src.order_bars(spark, sf)
    return b.select(F.col("symbol").alias("run_id"), "ts", F.col("close").alias("equity"), F.when(F.col("volume") > 1, F.col("volume") / 10).otherwise(0.0).alias("gross_exposure"))


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pnl = F.col("o_totalprice") - 150000
    return o.select(F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("exit_ts"), pnl.alias("pnl"), (pnl / 50000).alias("r_multiple"), (F.col("o_orderkey") % 17).cast("int").alias("bars_held"), F.lit(2.0).alias("qty"), F.lit(10.0).alias("entry_price"), F.lit(11.0).alias("exit_price"), F.lit(0.5).alias("costs"))


def metrics_equity(spark, sf):
    return tidy(m.equity_metrics(_equity(spark, sf)), 5)


def metrics_drawdowns(spark, sf):
    return tidy(m.drawdowns(_equity(spark, sf)).select("run_id", "ts", "drawdown"))


def metrics_trades(spark, sf):
    return tidy(m.trade_metrics(_trades(spark, sf)), 4)


#: Blocks of a run: whole months until there are so many rows
_BLOCKS = Slicing(60, "month")


def metrics_drawdowns_sliced(spark, sf):
    """Peaks merged over some 30 blocks of a run."""
    return tidy(m.drawdowns(_equity(spark, sf), _BLOCKS).select("run_id", "ts", "drawdown"))


def metrics_equity_sliced(spark, sf):
    return tidy(m.equity_metrics(_equity(spark, sf), slicing=_BLOCKS), 5)


def metrics_trades_sliced(spark, sf):
    return tidy(m.trade_metrics(_trades(spark, sf), _BLOCKS), 4)


def metrics_monthly(spark, sf):
    return tidy(m.periodic_returns(_equity(spark, sf), "month"))


def metrics_yearly(spark, sf):
    return tidy(m.periodic_returns(_equity(spark, sf), "year"))


def metrics_by_regime(spark, sf):
    trend = regime.classify(src.order_bars(spark, sf).where("symbol = '1-URGENT'"))
    return tidy(m.by_regime(_equity(spark, sf), trend))


def metrics_concentration(spark, sf):
    return tidy(m.profit_concentration(_trades(spark, sf)))


def metrics_moments(spark, sf):
    return tidy(m.return_moments(_equity(spark, sf)))


def trade_report_cube(spark, sf):
    """Extension: trades by priority and month, with all subtotals."""
    rows = _trades(spark, sf).withColumn("year", F.year("exit_ts"))
    return tidy(rows.cube("run_id", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.grouping_id().cast("int").alias("level")), 2)


def baseline_buy_and_hold(spark, sf):
    return tidy(simulate.buy_and_hold(src.order_bars(spark, sf), fees=simulate.Fees(pct=0.001)))


def baseline_risk_free(spark, sf):
    return tidy(simulate.risk_free(src.order_bars(spark, sf), 0.03))


def _returns(spark, sf):
    ret = feature("ret")
    got = compute(src.shipment_bars(spark, sf), [ret])
    return got.select("ts", F.col("symbol").alias("name"), ret.column.alias("ret")).where("ret is not null")


_NAMES = ["A", "N", "R"]


def portfolio_covariance(spark, sf):
    """The shrunk matrix as rows."""
    return tidy(portfolio.shrunk_pairs(_returns(spark, sf), _NAMES))


def portfolio_allocation(spark, sf):
    """O2: three methods."""
    rows = [(k, n, w) for k in ("inverse_vol", "min_variance", "risk_parity") for n, w in portfolio.allocate(_returns(spark, sf), {"R": 0.8}, method=k).items()]
    return tidy(spark.createDataFrame(rows, "method string, name string, weight double"))


def portfolio_concentration(spark, sf):
    """O3 to O5."""
    got = portfolio.concentration({n: 100.0 * (i + 1) for i, n in enumerate(_NAMES)}, _returns(spark, sf), {_NAMES[0]: "A", _NAMES[1]: "A"}, _returns(spark, sf).groupBy("ts").agg(F.avg("ret").alias("ret")))
    rows = [("largest_cluster_share", got["largest_cluster_share"]), ("effective_bets", got["effective_bets"]), ("portfolio_beta", got["portfolio_beta"])] + [(f"sector {k}", v) for k, v in got["sector_exposure"].items()]
    return tidy(spark.createDataFrame(rows, "what string, value double"))


def _signals(spark, sf):
    return table(spark, sf, "events").select(F.col("value").alias("score"), (F.col("event_id") % 3 == 0).alias("won"))


def calibration_table(spark, sf):
    """Bins by exact quantiles, Wilson intervals."""
    return tidy(portfolio.calibrate(_signals(spark, sf)))


def calibrated_confidence(spark, sf):
    table_ = portfolio.calibrate(_signals(spark, sf))
    scores = table(spark, sf, "events").select("event_id", F.col("value").alias("score"))
    return tidy(portfolio.confidence(scores, table_))


def strategy_decay(spark, sf):
    """O7 on each priority's trades, all in one plan; how often a trade should come and what it should cost, too."""
    o = table(spark, sf, "orders")
    trades = _trades(spark, sf).withColumn("slippage_bps", F.col("seq") % 11)
    expected = o.groupBy(F.col("o_orderpriority").alias("run_id")).agg(F.countDistinct("o_orderdate").cast("double").alias("days")).select("run_id", F.lit(0.55).alias("win_rate"), F.lit(0.02).alias("expectancy_r"), F.lit(1e7).alias("equity"), F.when(F.col("run_id") != "5-LOW", -0.3).alias("mc_p5_drawdown"), F.lit(1.2).alias("trades_per_day"), "days", F.lit(4.0).alias("slippage_bps"))
    return tidy(portfolio.decay(trades, expected), 5)


def _risk_tables(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    n = c.count()
    portfolios = c.where("c_acctbal > 100").select(k.alias("portfolio_id"), F.col("c_acctbal").alias("equity"), (F.col("c_acctbal") * 0.6).alias("cash"), (F.col("c_acctbal") * (1 + (k % 5) * 0.06)).alias("peak_equity"), (F.col("c_acctbal") * (1 + (k % 7) * 0.006)).alias("day_start_equity"), (F.col("c_acctbal") * (1 + (k % 11) * 0.007)).alias("week_start_equity"), (k % 7).cast("int").alias("consecutive_losses"))
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", "p_brand")
    q = F.col("p_partkey")
    intents = p.select(q.alias("intent_id"), (q % n + 1).alias("portfolio_id"), F.concat(F.lit("S"), (q % 9).cast("string")).alias("symbol"), F.when(q % 4 == 0, -1).otherwise(1).alias("direction"), (F.col("p_retailprice") / 20).alias("entry"), (F.col("p_retailprice") / 20 * F.when(q % 4 == 0, 1.05).otherwise(0.95)).alias("stop"), F.col("p_brand").alias("sector"), F.when(q % 6 == 0, 0.4).otherwise(1.0).alias("strategy_health"), (F.col("p_size") / 50).alias("confidence"), F.when(q % 5 == 0, 20000.0).alias("adv"), (F.col("p_size") * 1.0).alias("spread_bps"), (q % 8 == 0).alias("shortable"), (q % 13).cast("int").alias("days_to_earnings"), (q % 29 != 0).alias("data_valid"))
    positions = p.select((q * 3 % n + 1).alias("portfolio_id"), F.concat(F.lit("S"), ((q + 1) % 9).cast("string")).alias("symbol"), F.lit(1).alias("direction"), F.lit(5.0).alias("qty"), (F.col("p_retailprice") / 30).alias("price"), (F.col("p_retailprice") / 32).alias("stop"), F.col("p_brand").alias("sector"))
    return intents, portfolios, positions


def risk_decisions(spark, sf):
    """K1 to K4 over many portfolios at once."""
    got = risk.evaluate(*_risk_tables(spark, sf))
    return tidy(got.withColumns({"reasons": F.concat_ws("; ", "reasons"), "adjustments": F.concat_ws("; ", "adjustments")}))


def risk_decisions_micro(spark, sf):
    """K5: the small-account preset."""
    got = risk.evaluate(*_risk_tables(spark, sf), limits=risk.MICRO)
    return tidy(got.select("intent_id", "approved", "tier", "qty"))


def lifecycle_requests(spark, sf):
    """L1: requests derived from suppliers against a history."""
    s = table(spark, sf, "supplier").select("s_suppkey")
    states = F.array(*[F.lit(x) for x in sorted(lifecycle.FOLLOWS)])
    pick = lambda k: F.element_at(states, (k % 11 + 1).cast("int"))
    history = s.select(F.concat(F.lit("st"), F.col("s_suppkey").cast("string")).alias("strategy_id"), F.lit(1).alias("seq"), F.lit(None).cast("string").alias("from_status"), pick(F.col("s_suppkey")).alias("to_status"), F.lit("ann").alias("actor"))
    requests = s.select(F.concat(F.lit("st"), F.col("s_suppkey").cast("string")).alias("strategy_id"), pick(F.col("s_suppkey") * 3 + 1).alias("to_status"), F.when(F.col("s_suppkey") % 2 == 0, "ai").otherwise("ann").alias("actor"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("backtest_experiment_id"), F.lit("paper_trading_report_id"))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    return lifecycle.judge(requests, history)


_CROSS = Strategy("cross", entry_long=(Condition(feat("close"), "cross_above", feat("sma", n="$n")),), exit_long=(Condition(feat("close"), "cross_below", feat("sma", n="$n")),), stop=Stop("percent", 0.3), take_profit=TakeProfit("r_multiple", 2.0), max_holding_bars=20, params={"n": 20})
_SETUP = simulate.Setup(market=simulate.Market(participation=1.0), sizing=simulate.Sizing(max_positions=3))


def _decisions(spark, sf):
    return decide(_CROSS, src.order_bars(spark, sf)).withColumn("run_id", F.lit("base"))


def simulated_trades(spark, sf):
    """B1 to B13."""
    return tidy(simulate.records(simulate.simulate(_decisions(spark, sf), {"base": replace(_SETUP, max_holding=20)}))[0])


def simulated_equity(spark, sf):
    return tidy(simulate.records(simulate.simulate(_decisions(spark, sf), {"base": replace(_SETUP, max_holding=20)}))[1])


def conservation(spark, sf):
    """Profits of all trades are the change of equity; the differences, which are 0."""
    runs = {f"n{n}": (with_params(_CROSS, n=n), None, None) for n in (10, 20, 50)}
    trades, equity, _ = rs.Bench(src.order_bars(spark, sf), _SETUP).wave(runs)
    last = equity.groupBy("run_id").agg(F.max_by("equity", "ts").alias("last"))
    gap = trades.groupBy("run_id").agg(F.sum("pnl").alias("pnl")).join(last, "run_id")
    return gap.select("run_id", (F.abs(F.col("last") - _SETUP.capital - F.col("pnl")) < 1e-6).alias("conserved"))


def truncation_check(spark, sf):
    """Decisions that change when later bars are taken away; none."""
    return rs.Bench(src.order_bars(spark, sf), _SETUP).causal(_CROSS, ["1997-03-03", "1999-09-09"]).groupBy("cut").agg(F.count(F.lit(1)).alias("n"))


def truncation_caught(spark, sf):
    """B14 on decisions that look ahead, to a rise on the next bar: they change at the last bar before each cut."""

    def ahead(bars):
        rise = F.lead("close").over(Window.partitionBy("symbol").orderBy("ts")) > F.col("close")
        none = F.lit(None).cast("double")
        return bars.select("symbol", "ts", F.coalesce(rise, F.lit(False)).alias("long_entry"), *[F.lit(False).alias(c) for c in ("short_entry", "long_exit", "short_exit")], *[none.alias(c) for c in ("stop_dist", "tp_dist", "rank")])

    return tidy(rs.changed(ahead, src.order_bars(spark, sf), ["1997-03-03", "1999-09-09"]))


def _rows(spark, found: dict) -> DataFrame:
    rows = [(k, (v or {}).get("n_trades"), (v or {}).get("total_return"), (v or {}).get("sharpe")) for k, v in found.items()]
    return tidy(spark.createDataFrame(rows, "run string, n_trades long, total_return double, sharpe double"))


def cost_sensitivity(spark, sf):
    """R10, one wave."""
    got = rs.Bench(src.order_bars(spark, sf), _SETUP).cost_sensitivity(_CROSS, None, None)
    return _rows(spark, {str(x["cost_multiplier"]): x for x in got})


def rule_ablation(spark, sf):
    """R11."""
    return _rows(spark, rs.Bench(src.order_bars(spark, sf), _SETUP).ablation(_CROSS, None, None))


def walk_forward_folds(spark, sf):
    """Fold edges as dates."""
    bars = src.order_bars(spark, sf)
    n = bars.select("ts").distinct().count()
    plan = rs.fold_dates(bars, rs.folds(n, 504, 126, 126))
    rows = [(i, part, str(a)[:10], str(b)[:10]) for i, f in enumerate(plan) for part, (a, b) in f.items()]
    return spark.createDataFrame(rows, "fold int, part string, first_day string, last_day string")


def walk_forward(spark, sf):
    """Grid, shortlist, validation and test of all folds in three waves."""
    bars = src.order_bars(spark, sf)
    n = bars.select("ts").distinct().count()
    plan = rs.fold_dates(bars, rs.folds(n, 504, 126, 126))
    got = rs.Bench(bars, _SETUP).walk_forward(_CROSS, {"n": [5, 20, 50]}, plan)
    rows = [(r["fold"], r["status"], str(r.get("params")), (r.get("test") or {}).get("total_return")) for r in got["folds"]]
    return tidy(spark.createDataFrame(rows, "fold int, status string, params string, test_return double"))


def parameter_robustness(spark, sf):
    """R7, R8."""
    got = rs.Bench(src.order_bars(spark, sf), _SETUP).robustness(_CROSS, None, None)
    return tidy(spark.createDataFrame([(k, v) for k, v in ({"centre": got["centre"]} | got["neighbours"]).items() if v > float("-inf")], "run string, score double"))


def monte_carlo_shuffle(spark, sf):
    """Shuffled orders of trades; the final return is the same in all."""
    trades = _trades(spark, sf).withColumn("pnl", F.col("pnl") / 1e4)
    got = rs.monte_carlo(trades, 10_000.0, sims=200, method="shuffle")
    return tidy(got.select("run_id", "n_trades", (F.abs(F.col("return_p5") - F.col("return_p95")) < 1e-9).alias("fixed"), F.round("return_p50", 4).alias("final")))


def monte_carlo_bootstrap(spark, sf):
    trades = _trades(spark, sf).withColumn("pnl", F.col("pnl") / 1e4)
    return tidy(rs.monte_carlo(trades, 10_000.0, sims=2000))


def sharpe_scores(spark, sf):
    """R12 from moments of each curve, in one plan."""
    return tidy(rs.sharpe_scores(m.return_moments(_equity(spark, sf)), 20))


def _runs(spark, sf):
    """Customers as runs that were measured in part."""
    k, known = F.col("c_custkey"), lambda n, x: F.when(F.col("c_custkey") % n != 0, x)
    made = {
        "run_id": k.cast("string"), "n_trades": k % 200, "sharpe": F.col("c_acctbal") / 4000 - 0.3, "profit_factor": known(7, (k % 50) / 10), "win_rate": (k % 100) / 100, "cagr": F.col("c_acctbal") / 40000, "max_drawdown": -(k % 60) / 100,
        "n_params": (k % 6).cast("int"), "complexity": (k % 25).cast("int"), "dsr": known(3, (k % 97) / 97), "efficiency": known(4, (k % 13) / 10), "stability": known(5, (k % 11) / 10), "concentration": known(6, (k % 17) / 17),
        "oos_sharpe": known(8, (k % 31) / 10 - 1), "oos_return": known(8, (k % 31) / 100 - 0.1), "walked": k % 2 == 0, "return_p5": known(9, (k % 23) / 50 - 0.2), "good_months": known(10, (k % 12) / 12), "good_regimes": known(11, (k % 5) / 5), "best_baseline": known(2, (k % 19) / 10),
    }
    return table(spark, sf, "customer").select(*[c.alias(n) for n, c in made.items()])


def strategy_scores(spark, sf):
    """Overfitting risk, gates and score of many runs at once."""
    got = rs.strategy_score(rs.overfitting(_runs(spark, sf)))
    texts = [F.concat_ws(", ", c).alias(c) for c in ("risk_unknown", "unknown", "failed_gates")]
    return tidy(got.select("run_id", "risk", "level", "raw_score", "score", "decision", *texts))


def walk_forward_summary(spark, sf):
    """Suppliers of a nation as the folds of a run; returns chained, and the deepest fall of the chain."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    folds = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("run_id"), k.cast("int").alias("fold"), (k % 9 != 0).alias("ok"), (k % 3).cast("string").alias("params"), (b / 5000).alias("train_sharpe"), F.when(k % 7 != 0, b / 9000).alias("test_sharpe"), F.when(k % 11 != 0, b / 100000 - 0.03).alias("test_return"))
    return tidy(rs.summarise(folds))


def market_scan(spark, sf):
    """All symbols and two strategies at one time."""
    cal = weekday_calendar(spark, *CALENDAR_SPAN)
    bars = with_availability(src.order_bars(spark, sf).where("weekday(ts) < 5"), cal, "1d")
    from ..operators.quality import Limits as Quality

    always = Strategy("always", entry_long=(Condition(feat("close"), ">", val(0.0)),), stop=Stop("percent", 0.05))
    portfolios = spark.createDataFrame([(1, 1e6, 1e6, 1e6, 1e6, 1e6, 0)], "portfolio_id int, equity double, cash double, peak_equity double, day_start_equity double, week_start_equity double, consecutive_losses int")
    positions = spark.createDataFrame([], "portfolio_id int, symbol string, direction int, qty double, price double, stop double, sector string")
    signals, _ = scan(bars, cal, F.lit("2001-07-20 22:00:00").cast("timestamp"), [Slot("always", always), Slot("trend", trend_baseline(), status="ACTIVE"), Slot("draft", always, status="RESEARCH")], portfolios, positions, limits=risk.Limits(), quality=Quality(missing_ratio=0.99, stale_sessions=99))
    return tidy(signals.drop("snapshot", "notes"))


def stream_bars_batch(spark, sf):
    """The streaming plan run on a batch; tests hold the stream against it."""
    return tidy(stream_bars(table(spark, sf, "events")))


def stream_session_windows(spark, sf):
    return tidy(stream_sessions(table(spark, sf, "events")))


def paper_fills(spark, sf):
    """Orders and bars replayed through the paper broker, one account per event type."""
    bars = src.event_bars(spark, sf).withColumns({"account": F.col("symbol"), "at": F.col("ts"), "seq": F.lit(1).cast("long"), "kind": F.lit("bar")})
    e = table(spark, sf, "events")
    kind = F.element_at(F.array(F.lit("MARKET"), F.lit("LIMIT"), F.lit("STOP")), (F.col("event_id") % 3 + 1).cast("int"))
    orders = e.select(F.col("event_type").alias("account"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.lit("order").alias("kind"), F.col("event_type").alias("symbol"), F.col("event_id").cast("string").alias("order_id"), F.when(F.col("event_id") % 4 == 0, "SELL").otherwise("BUY").alias("side"), kind.alias("order_type"), F.lit(1.0).alias("qty"), F.col("value").alias("limit_price"), F.col("value").alias("stop_price"))
    rows = orders.unionByName(bars.select("account", "at", "seq", "kind", "symbol", "open", "high", "low", "close", "volume"), allowMissingColumns=True)
    cols = "account at seq kind symbol order_id side order_type qty limit_price stop_price open high low close volume".split()
    return tidy(replay(rows.select(*cols), 1e5, market=simulate.Market(participation=0.1)).drop("reason"))


QUERIES = {f.__name__: f for f in (
    metrics_equity, metrics_drawdowns, metrics_trades, metrics_equity_sliced, metrics_drawdowns_sliced, metrics_trades_sliced, metrics_monthly, metrics_yearly, metrics_by_regime, metrics_concentration, metrics_moments, trade_report_cube, baseline_buy_and_hold, baseline_risk_free,
    portfolio_covariance, portfolio_allocation, portfolio_concentration, calibration_table, calibrated_confidence, strategy_decay, risk_decisions, risk_decisions_micro, lifecycle_requests, simulated_trades, simulated_equity,
    conservation, truncation_check, truncation_caught, cost_sensitivity, rule_ablation, walk_forward_folds, walk_forward, parameter_robustness, monte_carlo_shuffle, monte_carlo_bootstrap, sharpe_scores, strategy_scores, walk_forward_summary, market_scan,
    stream_bars_batch, stream_session_windows, paper_fills,
)}



def _regime_sql() -> str:
    """The regime labels of the first priority as CTE lab, over bars."""
    from . import features as ft

    first = f", reg0 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in ft._REGIME_STAGES[0].items())} FROM bars WHERE symbol = '1-URGENT')"
    rest = "".join(f", reg{i} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in st.items())} FROM reg{i - 1})" for i, st in enumerate(ft._REGIME_STAGES[1:], 1))
    return f"WITH {BARS}{first}{rest}, lab AS (SELECT ts, {ft._TREND} AS trend FROM reg4)"


_DD = f"dd AS (SELECT *, equity / max(equity) OVER ({_W} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown, row_number() OVER ({_W}) AS n, count(*) OVER (PARTITION BY run_id) AS total FROM eq)"
_EPISODES = f"""{_DD}, isl AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS island FROM dd),
    ep AS (SELECT run_id, island, min(drawdown) AS low, count(*) AS len, max(n) = max(total) AS open_ FROM isl WHERE drawdown < 0 GROUP BY ALL),
    ds AS (SELECT run_id, (SELECT min(drawdown) FROM dd WHERE dd.run_id = r.run_id) AS mdd, coalesce(avg(low), 0) AS avg_dd, coalesce(max(len) FILTER (NOT open_), 0) AS rec, coalesce(bool_or(open_), false) AS unrec FROM (SELECT DISTINCT run_id FROM eq) r LEFT JOIN ep USING (run_id) GROUP BY run_id)"""
_RET = f"ret AS (SELECT *, equity / lag(equity) OVER ({_W}) - 1 AS r FROM eq)"
_PERIOD = "SELECT run_id, p::DATE AS period, round(l / coalesce(lag(l) OVER (PARTITION BY run_id ORDER BY p), f) - 1, 6) + 0.0 AS ret FROM (SELECT run_id, date_trunc('{0}', ts) AS p, arg_max(equity, ts) AS l, arg_min(equity, ts) AS f FROM eq GROUP BY ALL)"
_STREAKS = """w AS (SELECT run_id, seq, exit_ts, pnl > 0 AS won, CASE WHEN (pnl > 0) = lag(pnl > 0) OVER (PARTITION BY run_id ORDER BY exit_ts, seq) THEN 0 ELSE 1 END AS turn FROM trades),
    i AS (SELECT *, sum(turn) OVER (PARTITION BY run_id ORDER BY exit_ts, seq) AS island FROM w), k AS (SELECT run_id, island, won, count(*) AS n FROM i GROUP BY ALL),
    sk AS (SELECT run_id, coalesce(max(n) FILTER (won), 0) AS max_win_streak, coalesce(max(n) FILTER (NOT won), 0) AS max_loss_streak FROM k GROUP BY run_id)"""
_CAL = """e AS (SELECT value AS score, (event_id % 3 = 0)::INT AS won FROM events), q AS (SELECT list_distinct(quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS raw FROM e), edges AS (SELECT list_sort(raw) AS edges FROM q),
    b AS (SELECT e.*, edges, greatest(0, least(len(list_filter(edges, lambda x: x <= score)) - 1, len(edges) - 2))::INT AS bin FROM e, edges),
    g AS (SELECT bin, edges[bin + 1] AS lo_edge, edges[bin + 2] AS hi_edge, count(*) AS n, sum(won) AS k FROM b GROUP BY bin, edges),
    c AS (SELECT *, k / n AS p, 1 + 1.96 * 1.96 / n AS d FROM g)"""
_L = {"R": 0.01, "MR": 0.02, "OR": 0.06, "POS": 0.2, "N": 10, "SEC": 0.4, "SHORT": 0.3, "ALLOW": "false", "DAY": 0.03, "WEEK": 0.06, "LOSS": 5, "HIGH": 1.5}
_M = {"R": 0.01, "MR": 0.01, "OR": 0.03, "POS": 0.5, "N": 2, "SEC": 0.5, "SHORT": 0.0, "ALLOW": "true", "DAY": 0.02, "WEEK": 0.05, "LOSS": 3, "HIGH": 1.0}


def _risk_sql(v: dict) -> str:
    """The limits' arithmetic written out step by step."""
    caps = [
        ("true", f"{v['POS']} * equity / entry", "max position size"), ("true", f"({v['OR']} * equity - open_) / dist", "total open risk"), ("true", "(equity - gross) / entry", "gross exposure"), ("direction > 0", "cash / entry", "available cash"),
        ("direction < 0", f"({v['SHORT']} * equity - short_) / entry", "short exposure"), ("true", f"({v['SEC']} * equity - in_sector) / entry", "sector exposure"), ("coalesce(adv > 0, false)", "0.01 * adv / entry", "liquidity (ADV)"),
    ]
    steps, at = [], "x3"
    for i, (on, most, why) in enumerate(caps):
        steps.append(f"c{i} AS (SELECT * REPLACE (CASE WHEN {on} AND {most} < qty THEN greatest({most}, 0) ELSE qty END AS qty, CASE WHEN {on} AND {most} < qty THEN list_append(adj, '{why}') ELSE adj END AS adj) FROM {at})")
        at = f"c{i}"
    blocks = [
        ("NOT data_valid", "data invalid/incomplete"), ("health < 0.5", "strategy health"), ("NOT dist > 0", "stop on wrong side of entry"), (f"direction < 0 AND {v['ALLOW']}", "shorting disabled"), ("direction < 0 AND NOT shortable", "short availability not confirmed"),
        ("spread_bps > 30", "spread"), ("days BETWEEN 0 AND 1", "earnings"), ("held", "already positioned in symbol"), (f"n_pos >= {v['N']}", "max positions reached"), (f"equity / day_start - 1 <= -{v['DAY']}", "daily loss limit hit"),
        (f"equity / week_start - 1 <= -{v['WEEK']}", "weekly loss limit hit"), (f"losses >= {v['LOSS']}", "consecutive losses"), ("ddm <= 0", "drawdown beyond de-risk stop"),
    ]
    listed = ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{w}' END" for c, w in blocks)
    return f"""WITH pf AS (SELECT c_custkey AS pid, c_acctbal AS equity, c_acctbal * 0.6 AS cash, c_acctbal * (1 + (c_custkey % 5) * 0.06) AS peak, c_acctbal * (1 + (c_custkey % 7) * 0.006) AS day_start, c_acctbal * (1 + (c_custkey % 11) * 0.007) AS week_start, c_custkey % 7 AS losses FROM customer WHERE c_acctbal > 100), nc AS (SELECT count(*) AS n FROM customer),
        it AS (SELECT p_partkey AS intent_id, p_partkey % n + 1 AS pid, 'S' || (p_partkey % 9) AS symbol, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE 1 END AS direction, p_retailprice / 20 AS entry, p_retailprice / 20 * CASE WHEN p_partkey % 4 = 0 THEN 1.05 ELSE 0.95 END AS stop, p_brand AS sector,
          CASE WHEN p_partkey % 6 = 0 THEN 0.4 ELSE 1.0 END::DOUBLE AS health, p_size / 50 AS confidence, CASE WHEN p_partkey % 5 = 0 THEN 20000.0 END::DOUBLE AS adv, p_size::DOUBLE AS spread_bps, p_partkey % 8 = 0 AS shortable, p_partkey % 13 AS days, p_partkey % 29 <> 0 AS data_valid FROM part, nc),
        ps AS (SELECT p_partkey * 3 % n + 1 AS pid, 'S' || ((p_partkey + 1) % 9) AS symbol, 5.0::DOUBLE * p_retailprice / 30 AS notional, greatest(p_retailprice / 30 - p_retailprice / 32, 0) * 5.0::DOUBLE AS risk, p_brand AS sector FROM part, nc),
        sm AS (SELECT pid, count(*) AS n_pos, sum(notional) AS gross, 0.0::DOUBLE AS short_, sum(risk) AS open_ FROM ps GROUP BY pid), sc AS (SELECT pid, sector, sum(notional) AS in_sector FROM ps GROUP BY ALL),
        x AS (SELECT it.*, equity, cash, peak, day_start, week_start, losses, coalesce(n_pos, 0) AS n_pos, coalesce(gross, 0) AS gross, coalesce(short_, 0) AS short_, coalesce(open_, 0) AS open_, coalesce(in_sector, 0) AS in_sector, EXISTS (SELECT 1 FROM ps WHERE ps.pid = it.pid AND ps.symbol = it.symbol) AS held
          FROM it JOIN pf USING (pid) LEFT JOIN sm USING (pid) LEFT JOIN sc USING (pid, sector)),
        x1 AS (SELECT *, direction * (entry - stop) AS dist, greatest(0, least(1, 1 - (1 - equity / peak - 0.05) / 0.15)) AS ddm, least(greatest(health, 0), 1) AS ease FROM x),
        x2 AS (SELECT *, list_filter([{listed}], lambda b: b IS NOT NULL) AS blocks, CASE WHEN confidence < 0.5 THEN 'SMALL' WHEN confidence > 0.65 THEN 'HIGH_CONVICTION' ELSE 'NORMAL' END AS t0, CASE WHEN confidence < 0.5 THEN 0.5 WHEN confidence > 0.65 THEN {v['HIGH']} ELSE 1.0 END AS times FROM x1),
        x3 AS (SELECT *, least({v['R']} * times * ddm, {v['MR']}) * ease * equity / nullif(dist, 0) AS qty, list_filter([CASE WHEN ddm < 1 THEN 'drawdown multiplier' END, CASE WHEN ease < 1 THEN 'strategy health multiplier' END], lambda b: b IS NOT NULL) AS adj FROM x2), {', '.join(steps)},
        y AS (SELECT *, CASE WHEN len(blocks) > 0 THEN blocks WHEN coalesce(qty <= 0 OR qty * entry < 1, false) THEN ['size too small after limits'] ELSE [] END AS reasons FROM {at}), z AS (SELECT *, len(reasons) = 0 AS approved FROM y)
        SELECT intent_id, approved, CASE WHEN NOT approved THEN 'NO_TRADE' WHEN t0 = 'NORMAL' AND qty * dist < 0.75 * {v['R']} * equity THEN 'SMALL' ELSE t0 END AS tier, round(CASE WHEN approved THEN qty ELSE 0 END, 6) + 0.0 AS qty"""


def _mean_sql(parts: dict[str, tuple[float, str]], name: str) -> str:
    """A weighted mean of what is known, and the names of what isn't."""
    weight = " + ".join(f"CASE WHEN ({x}) IS NULL THEN 0 ELSE {w} END" for w, x in parts.values())
    total = " + ".join(f"coalesce({w} * ({x}), 0)" for w, x in parts.values())
    missing = ", ".join(f"CASE WHEN ({x}) IS NULL THEN '{k}' END" for k, (_, x) in sorted(parts.items()))
    return f"CASE WHEN {weight} > 0 THEN ({total}) / ({weight}) ELSE 0 END AS {name}, concat_ws(', ', {missing}) AS {name}_missing"


def _score_sql() -> str:
    unit, logistic = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(1.0, {x})) END", lambda x, s: f"1 / (1 + exp(-({x}) / {s}))"
    known = lambda n, x: f"CASE WHEN c_custkey % {n} <> 0 THEN {x} END"
    runs = f"""r AS (SELECT c_custkey::VARCHAR AS run_id, (c_custkey % 200)::DOUBLE AS n, c_acctbal / 4000 - 0.3 AS sharpe, {known(7, 'c_custkey % 50 / 10')} AS factor, c_custkey % 100 / 100 AS wins, c_acctbal / 40000 AS cagr, -(c_custkey % 60) / 100 AS deep, c_custkey % 6 AS n_params, (c_custkey % 25)::DOUBLE AS complexity,
        {known(3, 'c_custkey % 97 / 97')} AS dsr, {known(4, 'c_custkey % 13 / 10')} AS eff, {known(5, 'c_custkey % 11 / 10')} AS stab, {known(6, 'c_custkey % 17 / 17')} AS conc, {known(8, 'c_custkey % 31 / 10 - 1')} AS oos_sharpe, {known(8, 'c_custkey % 31 / 100 - 0.1')} AS oos_return, c_custkey % 2 = 0 AS walked,
        {known(9, 'c_custkey % 23 / 50 - 0.2')} AS p5, {known(10, 'c_custkey % 12 / 12')} AS months, {known(11, 'c_custkey % 5 / 5')} AS regimes, {known(2, 'c_custkey % 19 / 10')} AS best FROM customer)"""
    risk = {
        "trades_per_param": (1.0, unit("1 - n / greatest(n_params, 1) / 30")), "low_trade_count": (1.0, unit("1 - n / 100")), "deflated_sharpe": (1.5, "1 - dsr"), "is_oos_degradation": (1.5, unit("1 - eff")), "parameter_sensitivity": (1.0, "1 - stab"),
        "profit_concentration": (1.0, unit("(conc - 0.5) / 0.5")), "complexity": (0.5, unit("complexity / 15")), "too_perfect": (1.0, "(coalesce(sharpe > 3, false) OR coalesce(factor > 4, false) OR coalesce(wins > 0.8, false))::INT"),
    }
    merit = {
        "return": (1.0, logistic("cagr", 0.1)), "risk_adjusted": (2.0, logistic("sharpe", 0.5)), "drawdown": (1.5, unit("1 + deep / 0.35")), "consistency": (1.0, "months"), "robustness": (1.5, "stab"), "oos": (2.0, logistic("oos_sharpe", 0.5)), "walk_forward": (1.5, unit("eff")),
        "monte_carlo": (1.0, f"CASE WHEN p5 > 0 THEN 1.0 ELSE {logistic('p5', 0.1)} END"), "complexity": (0.5, unit("1 - complexity / 15")), "trade_count": (0.5, unit("n / 100")), "regime_stability": (1.0, "regimes"),
    }
    gates = {"beats_baselines": "best IS NOT NULL AND NOT sharpe > best", "max_drawdown": "deep < -0.35", "min_trades": "n < 30", "oos_positive": "NOT coalesce(oos_return > 0, false)", "overfit_risk": "risk > 0.6", "walk_forward": "walked AND NOT coalesce(eff >= 0.3, false)"}
    failed = ", ".join(f"CASE WHEN {x} THEN '{k}' END" for k, x in gates.items())
    return f"""WITH {runs}, a AS (SELECT *, {_mean_sql(risk, 'risk')}, {_mean_sql(merit, 'raw_score')} FROM r), b AS (SELECT *, concat_ws(', ', {failed}) AS failed_gates FROM a)
        SELECT run_id, round(risk, 6) + 0.0 AS risk, CASE WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS level, risk_missing AS risk_unknown, round(raw_score, 6) + 0.0 AS raw_score, raw_score_missing AS unknown,
          round(raw_score * (1 - risk), 6) + 0.0 AS score, failed_gates, CASE WHEN failed_gates = '' THEN 'CANDIDATE' ELSE 'REJECTED' END AS decision FROM b"""


ORACLES = {
    "strategy_scores": _score_sql(),
    "walk_forward_summary": """WITH f AS (SELECT s_nationkey::VARCHAR AS run_id, s_suppkey AS fold, s_suppkey % 9 <> 0 AS ok, s_suppkey % 3 AS params, s_acctbal / 5000 AS tr, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 9000 END AS te, CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal / 100000 - 0.03 ELSE 0 END AS g FROM supplier),
        d AS (SELECT *, product(1 + g) OVER (w ROWS UNBOUNDED PRECEDING) AS level, params <> lag(params) OVER w AS moved FROM f WHERE ok WINDOW w AS (PARTITION BY run_id ORDER BY fold)),
        p AS (SELECT *, greatest(1, max(level) OVER (PARTITION BY run_id ORDER BY fold ROWS UNBOUNDED PRECEDING)) AS peak FROM d),
        s AS (SELECT run_id, count(*) AS n_ok, avg(tr) AS a, avg(te) AS b, avg((g > 0)::INT) AS won, coalesce(sum(moved::INT), 0)::BIGINT AS param_changes, arg_max(level, fold) - 1 AS total, min(level / peak - 1) AS deep FROM p GROUP BY run_id)
        SELECT run_id, n_folds, coalesce(n_ok, 0) AS n_ok, round(a, 6) + 0.0 AS mean_train_sharpe, round(b, 6) + 0.0 AS mean_test_sharpe, round(won, 6) + 0.0 AS pct_profitable_folds, param_changes, round(total, 6) + 0.0 AS stitched_total_return, round(deep, 6) + 0.0 AS stitched_drawdown,
          round(CASE WHEN a > 0 THEN b / a END, 6) + 0.0 AS wf_efficiency FROM (SELECT run_id, count(*) AS n_folds FROM f GROUP BY run_id) LEFT JOIN s USING (run_id)""",
    "metrics_equity": f"""WITH {_EQUITY}, {_EPISODES}, {_RET}, a AS (SELECT run_id, count(*) AS n_bars, arg_min(equity, ts) AS f, arg_max(equity, ts) AS l, avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(least(r, 0) ** 2)) AS down, avg((gross_exposure > 0)::INT) AS exposure, avg(gross_exposure) AS gross FROM ret GROUP BY run_id),
        b AS (SELECT *, (l / f) ** (252.0 / n_bars) - 1 AS cagr, down * sqrt(252) AS dn FROM a JOIN ds USING (run_id))
        SELECT run_id, n_bars, false AS insufficient_data, {', '.join(f'round({e}, 5) + 0.0 AS {k}' for k, e in {'total_return': 'l / f - 1', 'cagr': 'cagr', 'annualized_return': 'mean * 252', 'volatility': 'sd * sqrt(252)', 'sharpe': 'mean / sd * sqrt(252)', 'sortino': 'mean * 252 / dn', 'max_drawdown': 'mdd', 'avg_drawdown': 'avg_dd', 'calmar': 'cagr / abs(mdd)', 'exposure': 'exposure', 'avg_gross_exposure': 'gross'}.items())}, rec AS max_recovery_bars, unrec AS unrecovered_at_end FROM b""",
    "metrics_drawdowns": f"WITH {_EQUITY}, {_DD} SELECT run_id, ts, round(drawdown, 6) + 0.0 AS drawdown FROM dd",
    "metrics_trades": f"""WITH {_TRADES}, {_STREAKS}, a AS (SELECT run_id, count(*) AS n_trades, avg((pnl > 0)::INT) AS win_rate, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS avg_loss, avg(pnl) AS expectancy, avg(r_multiple) AS expectancy_r,
        sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)) AS profit_factor, avg(pnl) FILTER (pnl > 0) / abs(avg(pnl) FILTER (pnl <= 0)) AS payoff_ratio, avg(bars_held) AS avg_bars_held, sum(qty * (entry_price + exit_price)) AS turnover, sum(costs) AS total_costs FROM trades GROUP BY run_id)
        SELECT run_id, n_trades, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in ('win_rate', 'avg_win', 'avg_loss', 'expectancy', 'expectancy_r', 'profit_factor', 'payoff_ratio', 'avg_bars_held', 'turnover', 'total_costs'))}, max_win_streak, max_loss_streak FROM a JOIN sk USING (run_id)""",
    "metrics_monthly": f"WITH {_EQUITY} " + _PERIOD.format("month"),
    "metrics_yearly": f"WITH {_EQUITY} " + _PERIOD.format("year"),
    "metrics_by_regime": _regime_sql() + f", eq AS (SELECT symbol AS run_id, ts, close AS equity FROM bars), {_RET} SELECT run_id, trend, count(*) AS n, round(avg(r) * 252, 6) + 0.0 AS ann_return, round(avg(r) / stddev_samp(r) * sqrt(252), 6) + 0.0 AS sharpe, round(avg((r > 0)::INT), 6) + 0.0 AS hit_rate FROM ret JOIN lab USING (ts) WHERE r IS NOT NULL AND trend IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
    "metrics_concentration": f"WITH {_TRADES}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pnl DESC) AS k, greatest(1, ceil(count(*) OVER (PARTITION BY run_id) * 0.05)) AS most FROM trades) SELECT run_id, round(CASE WHEN sum(pnl) > 0 THEN sum(pnl) FILTER (k <= most) / sum(pnl) END, 6) + 0.0 AS concentration FROM k GROUP BY run_id",
    "metrics_moments": f"WITH {_EQUITY}, {_RET}, c AS (SELECT *, r - avg(r) OVER (PARTITION BY run_id) AS d FROM ret) SELECT run_id, count(r) AS n, round(avg(r), 6) + 0.0 AS mean, round(stddev_samp(r), 6) + 0.0 AS sd, round(avg(d ** 3) / avg(d ** 2) ** 1.5, 6) + 0.0 AS skew, round(avg(d ** 4) / avg(d ** 2) ** 2, 6) + 0.0 AS kurt FROM c GROUP BY run_id",
    "trade_report_cube": f"WITH {_TRADES}, t AS (SELECT *, year(exit_ts)::INT AS year FROM trades) SELECT run_id, year, count(*) AS n, round(sum(pnl), 2) + 0.0 AS pnl, grouping(run_id, year)::INT AS level FROM t GROUP BY CUBE (run_id, year)",
    "baseline_buy_and_hold": f"WITH {BARS}, f AS (SELECT symbol, arg_min(close, ts) * (1 + 7.5 / 1e4) AS px FROM bars GROUP BY symbol), q AS (SELECT *, 10000 / (px * 1.001) AS q0 FROM f), h AS (SELECT *, least(q0, (10000 - q0 * px * 0.001) / px) AS qty FROM q), c AS (SELECT *, 10000 - qty * px - qty * px * 0.001 AS cash FROM h) SELECT symbol, ts, round(cash + qty * close, 6) + 0.0 AS equity, round(qty * close / (cash + qty * close), 6) + 0.0 AS gross_exposure FROM bars JOIN c USING (symbol)",
    "baseline_risk_free": f"WITH {BARS} SELECT symbol, ts, round(10000 * (1.03 ** (1.0 / 252)) ** (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1), 6) + 0.0 AS equity FROM bars",
    "portfolio_covariance": f"""WITH {SHIP_BARS}, r AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars), d AS (SELECT ts FROM r WHERE ret IS NOT NULL GROUP BY ts HAVING count(*) = 3), x AS (SELECT * FROM r SEMI JOIN d USING (ts) WHERE ret IS NOT NULL),
        p AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.ret, b.ret) AS c, corr(a.ret, b.ret) AS k, stddev_samp(a.ret) AS sa, stddev_samp(b.ret) AS sb, count(*) AS n FROM x a JOIN x b USING (ts) GROUP BY ALL), m AS (SELECT avg(k) FILTER (a <> b) AS k FROM p)
        SELECT a, b, round((1 - 3.0 / (3 + n)) * c + 3.0 / (3 + n) * CASE WHEN a = b THEN sa * sa ELSE m.k * sa * sb END, 6) + 0.0 AS cov FROM p, m""",
    "calibration_table": f"WITH {_CAL} SELECT bin, round(lo_edge, 6) + 0.0 AS lo_edge, round(hi_edge, 6) + 0.0 AS hi_edge, n, round(p, 6) + 0.0 AS win_rate, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / d, 6) + 0.0 AS ci_low, round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / d, 6) + 0.0 AS ci_high, n >= 30 AS usable FROM c",
    "calibrated_confidence": f"WITH {_CAL} SELECT event_id, round(value, 6) + 0.0 AS score, round((SELECT p FROM c WHERE c.bin = greatest(0, least(len(list_filter(edges, lambda x: x <= value)) - 1, len(edges) - 2))::INT), 6) + 0.0 AS confidence FROM events, edges",
    "risk_decisions": _risk_sql(_L) + ", round(CASE WHEN approved THEN qty * dist ELSE 0 END, 6) + 0.0 AS risk_amount, round(CASE WHEN approved THEN qty * entry ELSE 0 END, 6) + 0.0 AS notional, array_to_string(reasons, '; ') AS reasons, CASE WHEN len(blocks) > 0 THEN '' ELSE array_to_string(adj, '; ') END AS adjustments FROM z",
    "risk_decisions_micro": _risk_sql(_M) + " FROM z",
    "lifecycle_requests": """WITH st AS (SELECT ['ACTIVE', 'APPROVED', 'BACKTESTED', 'CANDIDATE', 'DEGRADED', 'DISABLED', 'PAPER', 'REJECTED', 'RESEARCH', 'UNDER_REVIEW', 'VALIDATING'] AS s),
        r AS (SELECT 'st' || s_suppkey AS strategy_id, s[s_suppkey % 11 + 1] AS from_status, s[(s_suppkey * 3 + 1) % 11 + 1] AS to_status, CASE WHEN s_suppkey % 2 = 0 THEN 'ai' ELSE 'ann' END AS actor, s_suppkey % 3 = 0 AS has FROM supplier, st),
        p AS (SELECT *, CASE WHEN NOT list_contains(CASE from_status """ + " ".join(f"WHEN '{a}' THEN {b.split()!r}" for a, b in lifecycle.FOLLOWS.items()) + """ END, to_status) THEN 'not allowed' WHEN to_status IN ('APPROVED', 'ACTIVE') AND actor = 'ai' THEN 'needs a human'
          WHEN to_status = 'BACKTESTED' AND NOT has THEN 'missing evidence: backtest_experiment_id' WHEN to_status = 'APPROVED' AND NOT has THEN 'missing evidence: paper_trading_report_id'
          WHEN to_status = 'CANDIDATE' THEN 'missing evidence: monte_carlo_experiment_id, oos_experiment_id, robustness_passed, walk_forward_experiment_id' END AS problem FROM r)
        SELECT strategy_id, from_status, to_status, actor, problem IS NULL AS allowed, problem FROM p""",
    "conservation": "SELECT * FROM (VALUES ('n10', true), ('n20', true), ('n50', true)) t(run_id, conserved)",
    "truncation_check": "SELECT '' AS cut, 0::BIGINT AS n WHERE false",
    "walk_forward_folds": f"""WITH {BARS}, l AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)), f AS (SELECT i::INT AS fold, i * 126 AS s FROM range(0, 1000) t(i) WHERE i * 126 + 504 + 5 + 126 + 5 + 126 <= (SELECT max(n) FROM l)),
        p AS (SELECT fold, 'train' AS part, s AS a, s + 503 AS b FROM f UNION ALL SELECT fold, 'validate', s + 509, s + 634 FROM f UNION ALL SELECT fold, 'test', s + 640, s + 765 FROM f)
        SELECT fold, part, strftime(x.ts, '%Y-%m-%d') AS first_day, strftime(y.ts, '%Y-%m-%d') AS last_day FROM p JOIN l x ON x.k = a JOIN l y ON y.k = b""",
    "monte_carlo_shuffle": f"""WITH {_TRADES}, t AS (SELECT run_id, pnl / 1e4 AS pnl, 10000 + sum(pnl / 1e4) OVER (PARTITION BY run_id ORDER BY exit_ts, seq) - pnl / 1e4 AS before FROM trades) SELECT run_id, count(*)::INT AS n_trades, CASE WHEN count(*) >= 30 THEN true END AS fixed, CASE WHEN count(*) >= 30 THEN round(product(1 + pnl / before) - 1, 4) + 0.0 END AS final FROM t GROUP BY run_id""",
    "stream_bars_batch": f"WITH {HOUR_BARS} SELECT symbol, ts, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, volume FROM bars",
    "stream_session_windows": """WITH e AS (SELECT event_type AS symbol, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM e)
        SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM s GROUP BY symbol, k""",
}
ORACLES |= {f"metrics_{k}_sliced": ORACLES[f"metrics_{k}"] for k in ("drawdowns", "equity", "trades")}


def _simpson(z: str, density: str) -> str:
    """0.5 + the integral from 0 to z of a density of x."""
    return f"0.5 + {z} / 1200.0 * list_sum([(CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density.replace('x', f'({z} * i / 400.0)')}) FOR i IN range(401)])"


_NORMAL = "pow(2.718281828459045, -x * x / 2) / sqrt(2 * pi())"
_BEST = (1 - rs.EULER) * rs.NORMAL.inv_cdf(1 - 1 / 20) + rs.EULER * rs.NORMAL.inv_cdf(1 - 1 / (20 * 2.718281828459045))
ORACLES["sharpe_scores"] = f"""WITH {_EQUITY}, {_RET}, c AS (SELECT *, r - avg(r) OVER (PARTITION BY run_id) AS d FROM ret),
    k AS (SELECT run_id, count(r) AS n, avg(r) / stddev_samp(r) AS sr, avg(d ** 3) / avg(d ** 2) ** 1.5 AS skew, avg(d ** 4) / avg(d ** 2) ** 2 AS kurt FROM c GROUP BY run_id),
    z AS (SELECT run_id, sr * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS a, (sr - sqrt(1.0 / n) * {_BEST!r}) * sqrt(n - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS b FROM k)
    SELECT run_id, round({_simpson('a', _NORMAL)}, 6) + 0.0 AS psr, round({_simpson('b', _NORMAL)}, 6) + 0.0 AS dsr FROM z"""
ORACLES["strategy_decay"] = f"""WITH {_TRADES}, days AS (SELECT o_orderpriority AS run_id, count(DISTINCT o_orderdate)::DOUBLE AS days FROM orders GROUP BY 1),
    e AS (SELECT *, 1e7 + sum(pnl) OVER (PARTITION BY run_id ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING) AS eq FROM trades), d AS (SELECT *, eq / max(eq) OVER (PARTITION BY run_id ORDER BY exit_ts, seq ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
    a AS (SELECT run_id, count(*) AS n, count(*) FILTER (pnl > 0) AS w, avg(r_multiple) AS mean, stddev_samp(r_multiple) AS sd, min(dd) AS drawdown, avg(seq % 11) - 4 AS excess FROM d GROUP BY run_id),
    b AS (SELECT *, (mean - 0.02) / (sd / sqrt(n)) AS t, n - 1.0 AS v, -abs(n - 1.2 * days) / sqrt(1.2 * days) AS z, lgamma(n / 2.0) - lgamma((n - 1) / 2.0) - ln((n - 1) * pi()) / 2 AS c, run_id <> '5-LOW' AND drawdown < -0.3 AS breach FROM a JOIN days USING (run_id)),
    p AS (SELECT *, list_sum([exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.55) + (n - i) * ln(0.45)) FOR i IN range(w + 1)]) AS pw, {_simpson('t', 'exp(c - (v + 1) / 2 * ln(1 + (x * x) / v))'.replace('exp(', 'pow(2.718281828459045, '))} AS pe, 2 * ({_simpson('z', _NORMAL)}) AS pf FROM b),
    q AS (SELECT *, least(pw, pe) AS worst FROM p)
    SELECT run_id, n AS n_trades, round(pw, 5) + 0.0 AS p_win_rate, round(pe, 5) + 0.0 AS p_expectancy, round(pf, 5) + 0.0 AS p_frequency, round(excess, 5) + 0.0 AS slippage_excess_bps, round(drawdown, 5) + 0.0 AS drawdown, breach, round(least(1, worst / 0.05) * CASE WHEN breach THEN 0.5 ELSE 1 END, 5) + 0.0 AS health,
      CASE WHEN breach AND worst < 0.01 THEN 'DISABLE' WHEN breach OR worst < 0.01 THEN 'UNDER_REVIEW' WHEN worst < 0.05 OR pf < 0.01 THEN 'DEGRADED' ELSE 'KEEP' END AS recommendation FROM q"""
ORACLES["truncation_caught"] = f"""WITH {BARS}, c AS (SELECT unnest(['1997-03-03', '1999-09-09']) AS cut), n AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS after FROM bars)
    SELECT symbol, ts, cut FROM (SELECT n.*, cut FROM n JOIN c ON ts <= cut::TIMESTAMP QUALIFY row_number() OVER (PARTITION BY symbol, cut ORDER BY ts DESC) = 1) WHERE after > close"""
