"""Research queries take every row of their tables."""

from collections import Counter

from pyspark.sql import functions as F

from barloom.plans import research as rs
from barloom.queries import research


def _orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderpriority", "o_orderkey", "o_orderdate", "o_totalprice").collect()


def test_bootstrap_draws_from_all_trades(spark, sf):
    want = Counter(r.o_orderpriority for r in _orders(spark, sf))
    assert {r.run_id: r.n_trades for r in research.monte_carlo_bootstrap(spark, sf).collect()} == want


def test_decay_judges_all_trades_of_all_runs(spark, sf):
    rows = research.strategy_decay(spark, sf).collect()
    orders = _orders(spark, sf)
    want = []
    for name in sorted({r.o_orderpriority for r in orders}):
        mine = sorted((r for r in orders if r.o_orderpriority == name), key=lambda r: (r.o_orderdate, r.o_orderkey))
        equity, peak, worst = 1e7, float("-inf"), 0.0
        for r in mine:
            equity += r.o_totalprice - 150000
            peak = max(peak, equity)
            worst = min(worst, equity / peak - 1)
        want.append((name, len(mine), round(worst, 5)))
    assert [(r.run_id, r.n_trades, r.drawdown) for r in sorted(rows)] == want


def test_paper_broker_gets_every_order(spark, sf, monkeypatch):
    seen = []
    replay = research.replay
    monkeypatch.setattr(research, "replay", lambda rows, *a, **k: seen.append(rows) or replay(rows, *a, **k))
    research.paper_fills(spark, sf)
    assert seen[0].where("kind = 'order'").count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_walk_forward_runs_every_fold(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(rs.Bench, "walk_forward", lambda self, strategy, grid, plan: seen.append(plan) or {"folds": [{"fold": 0, "status": "OK", "test": {"total_return": 0.0}}]})
    research.walk_forward(spark, sf)
    want = research.walk_forward_folds(spark, sf).where(F.col("part") == "test").orderBy("fold").collect()
    assert [(str(f["test"][0])[:10], str(f["test"][1])[:10]) for f in seen[0]] == [(r.first_day, r.last_day) for r in want]
