"""Pre-trade risk as columns: every intent of a table is judged against its portfolio in one projection.

intents: intent_id, portfolio_id, symbol, direction (1, -1), entry, stop, and optionally sector, strategy_health,
confidence, adv (daily dollar volume), spread_bps, shortable, days_to_earnings, data_valid, broker_available, regime_compatible.
portfolios: portfolio_id, equity, cash, peak_equity, day_start_equity, week_start_equity, consecutive_losses.
positions: portfolio_id, symbol, direction, qty, price, stop, sector.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import yes


@dataclass(frozen=True)
class Limits:
    """Shares of equity unless named otherwise."""

    risk_per_trade: float = 0.01
    max_risk_per_trade: float = 0.02
    max_total_open_risk: float = 0.06
    max_position: float = 0.20
    max_positions: int = 10
    max_sector: float = 0.40
    max_correlated_risk: float = 0.03
    correlation: float = 0.7
    max_gross: float = 1.0
    max_short: float = 0.30
    allow_short: bool = True
    daily_loss: float = 0.03
    weekly_loss: float = 0.06
    max_consecutive_losses: int = 5
    dd_start: float = 0.05
    dd_stop: float = 0.20
    max_adv: float = 0.01
    max_spread_bps: float = 30.0
    min_days_to_earnings: int = 2
    min_notional: float = 1.0
    fractional: bool = True
    min_health: float = 0.5
    small_below: float = 0.5
    high_above: float = 0.65
    high_multiplier: float = 1.5
    small_multiplier: float = 0.5


MICRO = Limits(risk_per_trade=0.01, max_risk_per_trade=0.01, max_total_open_risk=0.03, max_position=0.5, max_positions=2, max_sector=0.5, allow_short=False, max_short=0.0, daily_loss=0.02, weekly_loss=0.05, max_consecutive_losses=3, high_multiplier=1.0)

_OPTIONAL = {
    "sector": "string", "strategy_health": "double", "confidence": "double", "adv": "double", "spread_bps": "double", "shortable": "boolean",
    "days_to_earnings": "int", "data_valid": "boolean", "broker_available": "boolean", "regime_compatible": "boolean",
}


def drawdown_multiplier(limits: Limits, drawdown: Column) -> Column:
    """1 up to dd_start, 0 from dd_stop, a straight line between."""
    x = -drawdown
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (x - limits.dd_start) / (limits.dd_stop - limits.dd_start)))


def _context(intents: DataFrame, portfolios: DataFrame, positions: DataFrame, correlations: DataFrame | None, limits: Limits) -> DataFrame:
    """intents with their portfolio's row and sums over its positions."""
    rows = intents
    for name, kind in _OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    held = positions.select("portfolio_id", F.col("symbol").alias("_sym"), F.col("direction").alias("_dir"), F.abs(F.col("qty") * F.col("price")).alias("_notional"), (F.greatest(F.col("direction") * (F.col("price") - F.col("stop")), F.lit(0.0)) * F.col("qty")).alias("_risk"), F.col("sector").alias("_sector"))
    sums = held.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("_notional").alias("_gross"), F.sum(F.when(F.col("_dir") < 0, F.col("_notional"))).alias("_short"), F.sum("_risk").alias("_open"))
    same = held.select("portfolio_id", F.col("_sym").alias("symbol")).distinct().withColumn("_held", F.lit(True))
    sector = held.groupBy("portfolio_id", F.col("_sector").alias("sector")).agg(F.sum("_notional").alias("_in_sector"))
    rows = rows.join(portfolios, "portfolio_id").join(sums, "portfolio_id", "left").join(same, ["portfolio_id", "symbol"], "left").join(sector, ["portfolio_id", "sector"], "left")
    if correlations is not None:  # a, b, corr of trailing returns known at decision time, both ways
        close = correlations.where(F.col("corr") >= limits.correlation)
        linked = rows.select("intent_id", "portfolio_id", F.col("symbol").alias("a")).join(close, "a").join(held.withColumnRenamed("_sym", "b"), ["portfolio_id", "b"]).groupBy("intent_id").agg(F.sum("_risk").alias("_linked"))
        known = correlations.select(F.col("a").alias("symbol")).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(linked, "intent_id", "left").join(known, "symbol", "left")
    else:
        rows = rows.withColumns({"_linked": F.lit(None).cast("double"), "_known": F.lit(False)})
    return rows.fillna(0, ["_n", "_gross", "_short", "_open", "_in_sector", "_linked"])


def evaluate(intents: DataFrame, portfolios: DataFrame, positions: DataFrame, limits: Limits = Limits(), correlations: DataFrame | None = None, trading_allowed: bool = True) -> DataFrame:
    """intent_id, approved, tier, qty, risk_amount, notional, reasons (of a refusal, all of them), adjustments (binding caps, in order)."""
    L, c = limits, F.col
    rows = _context(intents, portfolios, positions, correlations, L)
    health = F.coalesce("strategy_health", F.lit(1.0))
    drawdown = F.when(c("peak_equity") > 0, c("equity") / c("peak_equity") - 1).otherwise(0.0)
    rows = rows.withColumns({"_dist": c("direction") * (c("entry") - c("stop")), "_dd": drawdown_multiplier(L, drawdown), "_health": health})
    short = c("direction") < 0
    blocks = [
        (F.lit(not trading_allowed), "kill switch engaged"), (~F.coalesce("broker_available", F.lit(True)), "broker unavailable"), (~F.coalesce("data_valid", F.lit(True)), "data invalid/incomplete"),
        (~F.coalesce("regime_compatible", F.lit(True)), "regime incompatible"), (c("_health") < L.min_health, "strategy health"), (~yes(c("_dist") > 0), "stop on wrong side of entry"),
        (short & F.lit(not L.allow_short), "shorting disabled"), (short & ~yes(c("shortable")), "short availability not confirmed"), (c("spread_bps") > L.max_spread_bps, "spread"),
        ((c("days_to_earnings") >= 0) & (c("days_to_earnings") < L.min_days_to_earnings), "earnings"), (c("_held"), "already positioned in symbol"), (c("_n") >= L.max_positions, "max positions reached"),
        (c("equity") / c("day_start_equity") - 1 <= -L.daily_loss, "daily loss limit hit"), (c("equity") / c("week_start_equity") - 1 <= -L.weekly_loss, "weekly loss limit hit"),
        (c("consecutive_losses") >= L.max_consecutive_losses, "consecutive losses"), (c("_dd") <= 0, "drawdown beyond de-risk stop"),
    ]
    rows = rows.withColumn("_blocks", F.filter(F.array(*[F.when(yes(cond), F.lit(why)) for cond, why in blocks]), lambda x: x.isNotNull()))
    tier = F.when(c("confidence") < L.small_below, "SMALL").when(c("confidence") > L.high_above, "HIGH_CONVICTION").otherwise("NORMAL")
    times = F.when(c("confidence") < L.small_below, L.small_multiplier).when(c("confidence") > L.high_above, L.high_multiplier).otherwise(1.0)
    ease = F.least(F.greatest("_health", F.lit(0.0)), F.lit(1.0))
    share = F.least(L.risk_per_trade * times * c("_dd"), F.lit(L.max_risk_per_trade)) * ease
    rows = rows.withColumns({"_tier": tier, "_qty": share * c("equity") / F.nullif(c("_dist"), F.lit(0.0)), "_adj": F.array(F.when(c("_dd") < 1, "drawdown multiplier"), F.when(ease < 1, "strategy health multiplier"))})
    caps = [
        (F.lit(True), L.max_position * c("equity") / c("entry"), "max position size"), (F.lit(True), (L.max_total_open_risk * c("equity") - c("_open")) / F.nullif(c("_dist"), F.lit(0.0)), "total open risk"),
        (F.lit(True), (L.max_gross * c("equity") - c("_gross")) / c("entry"), "gross exposure"), (~short, c("cash") / c("entry"), "available cash"), (short, (L.max_short * c("equity") - c("_short")) / c("entry"), "short exposure"),
        (c("sector").isNotNull(), (L.max_sector * c("equity") - c("_in_sector")) / c("entry"), "sector exposure"), (yes(c("_known")) & (c("_n") > 0), (L.max_correlated_risk * c("equity") - c("_linked")) / F.nullif(c("_dist"), F.lit(0.0)), "correlated exposure"),
        (yes(c("adv") > 0), L.max_adv * c("adv") / c("entry"), "liquidity (ADV)"),
    ]
    for on, most, why in caps:
        binds = yes(on & (most < c("_qty")))
        rows = rows.withColumns({"_adj": F.concat("_adj", F.array(F.when(binds, F.lit(why)))), "_qty": F.when(binds, F.greatest(most, F.lit(0.0))).otherwise(c("_qty"))})
    qty = c("_qty") if L.fractional else F.floor("_qty").cast("double")
    rows = rows.withColumn("_qty", qty)
    tiny = (c("_qty") <= 0) | (c("_qty") * c("entry") < L.min_notional)
    reasons = F.when(F.size("_blocks") > 0, c("_blocks")).when(yes(tiny), F.array(F.lit("size too small after limits"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("reasons", reasons).withColumn("approved", F.size("reasons") == 0)
    less = (c("_tier") == "NORMAL") & (c("_qty") * c("_dist") < 0.75 * L.risk_per_trade * c("equity"))
    final = F.when(~c("approved"), "NO_TRADE").when(less, "SMALL").otherwise(c("_tier"))
    given = lambda x: F.when(c("approved"), x).otherwise(0.0)
    adjustments = F.when(F.size("_blocks") > 0, F.array().cast("array<string>")).otherwise(F.filter("_adj", lambda x: x.isNotNull()))
    return rows.select("intent_id", "approved", final.alias("tier"), given(c("_qty")).alias("qty"), given(c("_qty") * c("_dist")).alias("risk_amount"), given(c("_qty") * c("entry")).alias("notional"), "reasons", adjustments.alias("adjustments"))
