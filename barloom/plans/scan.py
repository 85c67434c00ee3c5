"""Market scan at a time T: one plan over all symbols and strategies, from rows known at T only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import compute
from ..functions.staged import Staged
from ..operators import regime as regimes
from ..operators.quality import Limits as QualityLimits
from ..operators.quality import validate
from ..operators.risk import Limits, evaluate
from .state import cut
from .strategy import Strategy, bind, decisions, version

TRADABLE = ("PAPER", "APPROVED", "ACTIVE")


@dataclass(frozen=True)
class Slot:
    strategy_id: str
    strategy: Strategy
    status: str = "PAPER"
    health: float = 1.0


def entries(universe: DataFrame, slots: list[Slot], trend: DataFrame | None = None) -> DataFrame:
    """One row per symbol and slot whose last bar decides to enter; a symbol needs two bars.

    All features are computed once; all strategies are columns of one projection over them, of which each symbol's last row is kept and
    taken apart: more strategies mean a wider row, not more passes.  A strategy that restricts regimes is left out where trend is not given.
    """
    bound = [(s, bind(s.strategy)) for s in slots if s.strategy.allowed_regimes is None or trend is not None]
    rows = compute(universe, [f for _, plan in bound for f in plan.features])
    if trend is not None:
        rows = rows.join(trend.select("ts", F.col("trend").alias("_regime")), "ts", "left")
    staged = Staged(rows)
    made = []
    for slot, plan in bound:
        d = decisions(plan, staged)
        fixed = [F.lit(slot.strategy_id).alias("strategy_id"), F.lit(version(slot.strategy)).alias("strategy_version"), F.lit(float(slot.health)).alias("strategy_health")]
        made.append(F.struct(*fixed, *[d[c].alias(c) for c in ("long_entry", "short_entry", "stop_dist", "tp_dist", "rank")]))
    if not made:
        made = [F.lit(None).cast("struct<strategy_id: string, strategy_version: string, strategy_health: double, long_entry: boolean, short_entry: boolean, stop_dist: double, tp_dist: double, rank: double>")]
    last = staged.df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("ts", "available_at", "close", F.array(*made).alias("slots")), "ts").alias("b")).where("n >= 2")
    hit = last.select("symbol", "b.ts", "b.available_at", "b.close", F.explode("b.slots").alias("s")).where("s.long_entry or s.short_entry")
    side = F.when(F.col("s.long_entry"), 1).otherwise(-1)
    return hit.select(
        "s.strategy_id", "s.strategy_version", "s.strategy_health", "symbol", side.alias("direction"), F.col("close").alias("entry"),
        (F.col("close") - side * F.col("s.stop_dist")).alias("stop"), (F.col("close") + side * F.col("s.tp_dist")).alias("target"), "s.rank", F.col("ts").alias("bar_ts"), "available_at",
    )


def scan(bars: DataFrame, calendar: DataFrame, asof: Column, slots: list[Slot], portfolios: DataFrame, positions: DataFrame, benchmark: str | None = None, sectors: DataFrame | None = None, limits: Limits = Limits(), correlations: DataFrame | None = None, quality: QualityLimits = QualityLimits(), follows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, invalid) at asof.

    signals: one row per symbol, tradable strategy whose last known bar decides to enter and portfolio that follows it: side, entry, stop, target,
    the risk verdict and a snapshot.  follows (strategy_id, portfolio_id): who follows what; unless given, every portfolio follows all.
    invalid: symbols left out, with their error codes; none stops the others.
    The benchmark is cut at asof like all others, and is not scanned itself.
    """
    known = bars.where(F.col("available_at") <= asof)
    checked = validate(known, calendar, "1d", asof, limits=quality)
    clean = checked.bars
    errors = checked.issues.where("severity = 'ERROR'").groupBy("symbol").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    trend = None
    universe = clean
    if benchmark is not None:
        trend = regimes.classify(clean.where(F.col("symbol") == benchmark))
        universe = clean.where(F.col("symbol") != benchmark)
    active = [s for s in slots if s.status in TRADABLE]
    # what was found is read twice: by the verdict, and to be told with it
    found = cut(entries(universe, active, trend))
    if follows is None:
        follows = portfolios.select(F.explode(F.array(*[F.lit(s.strategy_id) for s in active]).cast("array<string>")).alias("strategy_id"), "portfolio_id")
    found = found.join(follows.select("strategy_id", "portfolio_id"), "strategy_id")
    found = found.withColumns({"intent_id": F.concat_ws("|", "symbol", "strategy_id", "portfolio_id"), "shortable": F.when(F.col("direction") > 0, True)})
    if sectors is not None:
        found = found.join(sectors.select("symbol", "sector"), "symbol", "left")
    verdict = evaluate(found, portfolios, positions, limits, correlations)
    out = found.join(verdict, "intent_id")
    label = F.when(~F.col("approved"), "NO_TRADE").when(F.col("direction") > 0, "LONG").otherwise("SHORT")
    reward = F.abs(F.col("target") - F.col("entry")) / F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0))
    signals = out.select("symbol", "strategy_id", "portfolio_id", label.alias("signal"), "entry", "stop", "target", reward.alias("reward_risk"), "qty", "risk_amount", "tier", F.concat("reasons", "adjustments").alias("notes"), F.struct("bar_ts", "available_at", "strategy_version", "rank").alias("snapshot"))
    return signals, errors


def report(signals: DataFrame, invalid: DataFrame) -> str:
    """A few lines of text: counts and the trades."""
    rows = signals.where("signal <> 'NO_TRADE'").orderBy("symbol", "strategy_id").collect()
    lines = [f"{len(rows)} signals, {signals.count() - len(rows)} refused, {invalid.count()} symbols invalid"]
    return "\n".join(lines + [f"{r.signal:5} {r.symbol} {r.strategy_id}: entry {r.entry:.2f} stop {r.stop:.2f} qty {r.qty:.4f} [{r.tier}]" for r in rows])
