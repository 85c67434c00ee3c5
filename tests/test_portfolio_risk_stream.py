"""Metrics, selection, portfolio, risk, lifecycle, scan and streaming."""

import math
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.stats import binomial_cdf, student_cdf
from barloom.operators import lifecycle, metrics, portfolio, risk, selection
from barloom.operators.simulate import Fees, Market
from barloom.streaming import bars as sb
from barloom.streaming import paper
from barloom.streaming.paper import INPUT, match_stream, reconcile, replay

from .helpers import sessions


def test_distributions():
    assert student_cdf(0.0, 5) == pytest.approx(0.5) and student_cdf(2.015, 5) == pytest.approx(0.95, abs=1e-4) and student_cdf(-12.706, 1) == pytest.approx(0.025, abs=1e-4)
    for k, n, p in ((3, 10, 0.5), (0, 4, 0.3), (7, 7, 0.2)):
        assert binomial_cdf(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_metrics(spark):
    eq = spark.createDataFrame([("r", d, float(v), 1.0) for d, v in zip(sessions(5), (100, 110, 99, 120, 120), strict=True)] + [("one", sessions(1)[0], 5.0, 0.0)], "run_id string, ts timestamp, equity double, gross_exposure double")
    r = {x.run_id: x for x in metrics.equity_metrics(eq).collect()}
    assert r["r"].total_return == pytest.approx(0.2) and r["r"].max_drawdown == pytest.approx(99 / 110 - 1) and r["r"].max_recovery_bars == 1 and not r["r"].unrecovered_at_end
    assert r["one"].insufficient_data and r["one"].sharpe is None
    t = spark.createDataFrame([("r", k, sessions(3)[k], p, 0.1, 2, 1.0, 1.0, 1.0, 0.0) for k, p in enumerate((10.0, -11.0, 21.0))] + [("w", 0, sessions(1)[0], 5.0, 0.1, 2, 1.0, 1.0, 1.0, 0.0)], "run_id string, seq int, exit_ts timestamp, pnl double, r_multiple double, bars_held int, qty double, entry_price double, exit_price double, costs double")
    m = {x.run_id: x for x in metrics.trade_metrics(t).collect()}
    assert m["r"].win_rate == pytest.approx(2 / 3) and m["r"].profit_factor == pytest.approx(31 / 11) and (m["r"].max_win_streak, m["r"].max_loss_streak) == (1, 1) and m["w"].profit_factor == math.inf


def test_selection_finds_the_signal(spark):
    rng = np.random.default_rng(0)
    n = 3000
    signal, noise = rng.normal(size=n), rng.normal(size=n)
    y = 0.2 * signal + rng.normal(size=n)
    start = datetime(2020, 1, 1).timestamp()
    rows = [("A", datetime.fromtimestamp(start + 3600 * k), float(signal[k]), float(noise[k]), float(signal[k] + rng.normal(0, 0.05)), float(y[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, signal double, noise double, copy double, label double").cache()
    ic = {r.feature: r.ic for r in selection.rank_ic(df, ["signal", "noise"]).collect()}
    assert ic["signal"] > 0.12 > abs(ic["noise"])
    kept = selection.select(df, ["signal", "noise", "copy"], min_ic=0.05)
    assert kept["noise"] == "weak" and sorted((kept["signal"], kept["copy"])) == ["kept", "redundant"]
    weights = {r.feature: r for r in selection.importance(df.where("ts < '2020-03-01'"), df.where("ts >= '2020-03-01'"), ["signal", "noise"], repeats=2).collect()}
    assert weights["signal"].permutation > 0.1 > abs(weights["noise"].permutation)


def test_portfolio(spark):
    rng = np.random.default_rng(1)
    factor = rng.normal(0, 0.01, 500)
    names = {f"C{k}": factor + rng.normal(0, 0.002, 500) for k in range(3)} | {f"I{k}": rng.normal(0, 0.01, 500) for k in range(2)}
    days = sessions(500)
    returns = spark.createDataFrame([(d, n, float(x)) for n, v in names.items() for d, x in zip(days, v, strict=True)], "ts timestamp, name string, ret double").cache()
    label = portfolio.clusters(returns, sorted(names))
    assert len({label[f"C{k}"] for k in range(3)}) == 1 and len(set(label.values())) == 3
    for method in ("inverse_vol", "min_variance", "risk_parity"):
        w = portfolio.allocate(returns, {"I1": 0.2}, method)
        assert w["I1"] == 0 and 0 < sum(w.values()) <= 1 + 1e-9 and max(w.values()) <= 0.4
    w = portfolio.allocate(returns, method="risk_parity", cap=1.0)
    cov = portfolio.shrunk_covariance(returns, sorted(names))
    x = np.array([w[n] for n in sorted(names)])
    share = x * (cov @ x)
    assert np.allclose(share / share.sum(), 0.2, atol=1e-6)
    got = portfolio.concentration({"C0": 50.0, "C1": -30.0, "I0": 20.0}, returns, {"C0": "tech"}, returns.where("name = 'C2'").select("ts", "ret"))
    assert got["largest_cluster_share"] == pytest.approx(0.8) and got["sector_exposure"] == {"tech": 0.5, "UNKNOWN": 0.5} and got["betas"]["C0"] == pytest.approx(1, abs=0.1) and 1 < got["effective_bets"] < 3


def test_calibration_and_decay(spark):
    rng = np.random.default_rng(2)
    score = rng.random(3000)
    df = spark.createDataFrame([(float(s), bool(rng.random() < 0.3 + 0.4 * s)) for s in score], "score double, won boolean").cache()
    table = portfolio.calibrate(df).cache()
    assert portfolio.calibration_quality(df, table)["monotonic"] and table.count() == 5
    got = {r.score: r.confidence for r in portfolio.confidence(spark.createDataFrame([(-1.0,), (0.99,), (7.0,)], "score double"), table).collect()}
    assert got[-1.0] < 0.5 < got[0.99] == got[7.0]
    assert portfolio.confidence(spark.createDataFrame([(0.5,)], "score double"), portfolio.calibrate(df.limit(40))).first().confidence is None
    trades = lambda win: spark.createDataFrame([(sessions(100)[k], 10.0 if k % 10 < win else -10.0, 1.0 if k % 10 < win else -1.0) for k in range(100)], "exit_ts timestamp, pnl double, r_multiple double")
    made = trades(6).withColumn("run_id", F.lit("good")).unionByName(trades(2).withColumn("run_id", F.lit("bad"))).unionByName(trades(6).limit(5).withColumn("run_id", F.lit("young")))
    expected = spark.createDataFrame([("good", 0.55, 0.1, 1000.0, None), ("bad", 0.6, 0.3, 1000.0, -0.1), ("young", 0.9, 2.0, 1000.0, -0.1), ("none", 0.5, 0.1, 1000.0, -0.1)], "run_id string, win_rate double, expectancy_r double, equity double, mc_p5_drawdown double")
    got = {r.run_id: r for r in portfolio.decay(made, expected).collect()}
    assert got["good"].recommendation == "KEEP" and got["bad"].recommendation == "DISABLE" and got["bad"].health < 1e-9
    assert [(got[k].recommendation, got[k].n_trades, got[k].health, got[k].p_win_rate) for k in ("young", "none")] == [("KEEP", 5, 1.0, None), ("KEEP", 0, 1.0, None)]


def test_a_breach_or_weak_results_alone(spark):
    """A breach alone is one step; a number of trades far off is weak evidence; costs are compared where both are known."""
    rows = [(run, sessions(60)[k], pnl(k), 0.0 if run == "flat" else float(k % 3), 9.0) for run, pnl in (("deep", lambda k: -900.0 if k == 30 else 30.0), ("many", lambda k: 30.0), ("flat", lambda k: 30.0)) for k in range(60)]
    made = spark.createDataFrame(rows, "run_id string, exit_ts timestamp, pnl double, r_multiple double, slippage_bps double")
    expected = spark.createDataFrame([("deep", 0.5, 0.1, 100.0, -0.5, None, None, 5.0), ("many", 0.5, 0.1, 100.0, -0.5, 1.0, 10.0, None), ("flat", 0.5, 0.1, 100.0, None, 1.0, 60.0, None)], "run_id string, win_rate double, expectancy_r double, equity double, mc_p5_drawdown double, trades_per_day double, days double, slippage_bps double")
    got = {r.run_id: r for r in portfolio.decay(made, expected).collect()}
    assert (got["deep"].recommendation, got["deep"].health, got["deep"].slippage_excess_bps) == ("UNDER_REVIEW", 0.5, 4.0)
    assert got["many"].recommendation == "DEGRADED" and got["many"].p_frequency < 1e-9 and got["many"].slippage_excess_bps is None
    assert got["flat"].recommendation == "KEEP" and got["flat"].p_expectancy is None and got["flat"].p_frequency == 1.0


PORTFOLIO = "portfolio_id int, equity double, cash double, peak_equity double, day_start_equity double, week_start_equity double, consecutive_losses int"
POSITION = "portfolio_id int, symbol string, direction int, qty double, price double, stop double, sector string"


def judge(spark, intent: dict, equity=10_000.0, peak=10_000.0, positions=(), limits=risk.Limits(), correlations=None):
    row = {"intent_id": 1, "portfolio_id": 1, "symbol": "X", "direction": 1, "entry": 100.0, "stop": 95.0} | intent
    intents = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in row.items()))
    book = spark.createDataFrame([(1, equity, equity, peak, equity, equity, 0)], PORTFOLIO)
    return risk.evaluate(intents, book, spark.createDataFrame(list(positions), POSITION), limits, correlations).first()


def test_risk(spark):
    r = judge(spark, {})
    assert r.approved and r.tier == "NORMAL" and r.qty == pytest.approx(20) and r.risk_amount == pytest.approx(100)
    assert judge(spark, {}, equity=8750.0).risk_amount == pytest.approx(43.75)
    assert judge(spark, {"stop": 101.0}).reasons == ["stop on wrong side of entry"]
    many = judge(spark, {"direction": -1, "stop": 105.0, "spread_bps": 99.0, "days_to_earnings": 1, "data_valid": False}, equity=7000.0).reasons
    assert many == ["data invalid/incomplete", "short availability not confirmed", "spread", "earnings", "drawdown beyond de-risk stop"]
    held = [(1, "Y", 1, 40.0, 100.0, 95.0, None)]
    corr = spark.createDataFrame([("X", "Y", 0.9), ("Y", "X", 0.9)], "a string, b string, corr double")
    linked = judge(spark, {}, positions=held, correlations=corr, limits=risk.Limits(risk_per_trade=0.02, max_position=1.0))
    assert linked.risk_amount == pytest.approx(100) and "correlated exposure" in linked.adjustments
    tiny = judge(spark, {"entry": 200.0, "stop": 190.0}, equity=100.0, peak=100.0, limits=risk.MICRO)
    assert tiny.approved and tiny.risk_amount <= 1 and tiny.notional <= 50
    from dataclasses import replace

    assert not judge(spark, {"entry": 200.0, "stop": 190.0}, equity=100.0, peak=100.0, limits=replace(risk.MICRO, fractional=False)).approved
    assert judge(spark, {"confidence": 0.4}).tier == "SMALL" and judge(spark, {"confidence": 0.7}).tier == "HIGH_CONVICTION"


def test_lifecycle(spark):
    history = spark.createDataFrame([("a", 1, None, "RESEARCH", "ann"), ("b", 1, None, "PAPER", "ann")], "strategy_id string, seq int, from_status string, to_status string, actor string")
    ask = lambda *rows: spark.createDataFrame(list(rows), "strategy_id string, to_status string, actor string, evidence array<string>")
    got = {(r.strategy_id, r.to_status): r.problem for r in lifecycle.judge(ask(("a", "BACKTESTED", "ai", []), ("a", "ACTIVE", "ann", []), ("b", "APPROVED", "ai", ["paper_trading_report_id"]), ("c", "PAPER", "ann", [])), history).collect()}
    assert got == {("a", "BACKTESTED"): "missing evidence: backtest_experiment_id", ("a", "ACTIVE"): "not allowed", ("b", "APPROVED"): "needs a human", ("c", "PAPER"): "unknown strategy"}
    after = lifecycle.apply(ask(("b", "APPROVED", "ann", ["paper_trading_report_id"])), history)
    assert {r.strategy_id: r.status for r in lifecycle.status(after).collect()} == {"a": "RESEARCH", "b": "APPROVED"} and after.count() == 3


def test_stream_bars_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.unionByName(events.limit(20)).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    query = sb.stream_bars(stream, lateness="40 days").writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = {(r.symbol, r.ts): r for r in sb.stream_bars(events).collect()}
    got = spark.table("bars_out").collect()
    assert all(batch[r.symbol, r.ts] == r for r in got)
    whole = sb.stream_bars(stream, lateness="1 hour").writeStream.format("memory").queryName("bars_all").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    whole.processAllAvailable()
    whole.stop()
    got = spark.table("bars_all").collect()
    assert got and all(batch[r.symbol, r.ts] == r for r in got)


NAN = None


def order(at, seq, oid, side="BUY", kind="MARKET", qty=10.0, limit=None, stop=None):
    return ("acc", datetime(2021, 1, at), seq, "order", "X", oid, side, kind, qty, limit, stop, None, None, None, None, None)


def bar(at, o, h, low, c, v=1e6):
    return ("acc", datetime(2021, 1, at), 100, "bar", "X", None, None, None, None, None, None, float(o), float(h), float(low), float(c), float(v))


def test_paper_broker(spark):
    rows = [order(1, 0, "m"), order(1, 1, "m"), order(1, 2, "s", "SELL", "STOP", stop=95.0), order(1, 3, "l", kind="LIMIT", qty=1000.0, limit=80.0), order(1, 4, "bad", kind="LIMIT"), bar(2, 100, 101, 99, 100), order(2, 101, "s", "SELL", "STOP", stop=95.0), order(2, 102, "s2", "SELL", "STOP", stop=95.0), bar(3, 90, 91, 88, 89), bar(4, 85, 86, 79, 80, 2000)]
    df = spark.createDataFrame(rows, INPUT)
    got = replay(df, 1e6, market=Market(spread_bps=10, slippage_bps=0, participation=0.1)).collect()
    fills = {(r.order_id, r.status): (r.qty, r.price) for r in got}
    assert fills["m", "FILLED"] == (10.0, pytest.approx(100.05)) and sum(r.order_id == "m" and r.status == "NEW" for r in got) == 1
    assert ("s", "REJECTED") in fills and ("bad", "REJECTED") in fills
    assert fills["s2", "FILLED"][1] == pytest.approx(90 * (1 - 0.0005)) and fills["l", "PARTIALLY_FILLED"] == (200.0, 80.0)


def test_paper_stream_equals_replay(spark, tmp_path):
    rows = [order(1, k, f"o{k}", qty=5.0) for k in range(4)] + [bar(d, 100 + d, 101 + d, 99 + d, 100 + d, 100) for d in range(2, 9)]
    for k, part in enumerate((rows[:6], rows[6:])):
        spark.createDataFrame(part, INPUT).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = match_stream(stream, 1e5, market=Market(participation=0.05)).writeStream.format("memory").queryName("fills_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = replay(spark.createDataFrame(rows, INPUT), 1e5, market=Market(participation=0.05)).collect()
    assert sorted(map(str, spark.table("fills_out").collect())) == sorted(map(str, want))


def test_replay_streams_accounts(spark):
    """Many batches an account, orders sent again in other batches: rows as of one walk that remembers all ids, and each batch's rows before the next is taken."""
    names = [f.split()[0] for f in INPUT.split(", ")]
    market = Market(participation=0.05)
    rows = []
    for account in ("a", "b", None):
        for d in range(1, 13):
            rows.append((account, *bar(d, 100 + d, 103 + d, 97 + d, 100 + d, 100)[1:]))
            for k in range(4):
                n = (3 * d + k) % 20  # ids come again, some with another type
                rows.append((account, *order(d, 200 + k, f"o{n}", "SELL" if n % 5 == 4 else "BUY", ["MARKET", "LIMIT", "STOP"][(n + d) % 3], qty=2.0 + n, limit=99.0 + n, stop=104.0 + n)[1:]))
    table = pd.DataFrame(rows, columns=names)
    want = [r for account, own in table.groupby("account", dropna=False) for r in paper._run(None if pd.isna(account) else account, paper.fresh(2e3), own, Fees(), market).itertuples(index=False)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = replay(spark.createDataFrame(rows, INPUT).repartition(7), 2e3, market=market).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = lambda r: tuple(None if pd.isna(x) else str(x) for x in r)
    assert sorted(map(plain, got), key=str) == sorted(map(plain, want), key=str) and {r.status for r in got} == {"NEW", "REJECTED", "FILLED", "PARTIALLY_FILLED"}

    taken = []
    own = table[table.account == "a"].drop_duplicates("order_id").sort_values(["at", "seq"])
    batches = (taken.append(k) or own[k : k + 5] for k in range(0, len(own), 5))
    for out in paper._walked(2e3, Fees(), market)(batches):
        assert list(out.columns) == paper._NAMES and set(out["at"]) <= set(own[taken[-1] : taken[-1] + 5]["at"])
    assert len(taken) == -(-len(own) // 5)


def test_closed_orders_leave_nothing(spark):
    """An account whose orders come once keeps its open ones only."""
    names = [f.split()[0] for f in INPUT.split(", ")]
    state = paper.fresh(1e6, once=True)
    for d in range(1, 20):
        for row in (order(d, 2, f"m{d}", qty=1.0), order(d, 3, f"bad{d}", kind="LIMIT"), bar(d, 100, 101, 99, 100, 1e6)):
            paper.step(state, SimpleNamespace(**dict(zip(names, row, strict=True))), Fees(), Market())
    assert state["orders"] == {} and not state["done"] and state["held"]["X"] == 19


def test_reconcile(spark):
    q = lambda *rows: spark.createDataFrame(list(rows), "symbol string, qty double")
    assert {r.symbol for r in reconcile(q(("A", 1.0), ("B", 2.0)), q(("A", 1.0), ("C", 3.0))).collect()} == {"B", "C"}
    assert F
