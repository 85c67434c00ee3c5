"""Entry points: ingest a CSV tree, look at features as of a time, research and search over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import Feature, compute, defaults, feature
from ..operators.align import canonical, with_availability
from ..operators.quality import Limits, Validated, validate
from ..operators.simulate import Setup
from ..sources.bars import load_bars, read_csv_bars, store_bars
from .research import Bench, evolve, pipeline
from .strategy import Strategy, momentum_baseline, trend_baseline, version


def ingest(spark: SparkSession, root: str, store: str, symbols: list[str], calendar: DataFrame, asof: str, timeframe: str = "1d", start: str | None = None, end: str | None = None, limits: Limits = Limits()) -> Validated:
    """Read bars of symbols, check them and replace their range in the store; symbols with errors are left out and reported."""
    raw = read_csv_bars(spark, root, timeframe, symbols, start, end)
    bars = with_availability(canonical(raw, timeframe).drop("timeframe"), calendar, timeframe)
    universe = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    checked = validate(bars, calendar, timeframe, F.lit(asof).cast("timestamp"), universe, limits)
    store_bars(checked.bars, store, timeframe)
    return checked


def features_of(text: str) -> list[Feature]:
    """Features from tokens like "rsi:14, sma:50": a name, and a value for its first parameter."""
    out = []
    for token in filter(None, (t.strip() for t in text.split(","))):
        name, _, value = token.partition(":")
        first = next(iter(defaults(name)), None)
        out.append(feature(name, **({first: float(value)} if value and first else {})))
    return out


def features_as_of(spark: SparkSession, store: str, symbol: str, features: str, asof: str | None = None, timeframe: str = "1d") -> DataFrame:
    """Bars and features of a symbol as they were known at asof."""
    bars = load_bars(spark, store, symbol, timeframe)
    if asof:
        bars = bars.where(F.col("available_at") <= F.lit(asof).cast("timestamp"))
    return compute(bars, features_of(features)).orderBy("ts")


def symbols(spark: SparkSession, store: str) -> list[str]:
    """Symbols that have bars."""
    return [r.symbol for r in load_bars(spark, store).select("symbol").distinct().orderBy("symbol").collect()]


def research(spark: SparkSession, store: str, strategy: Strategy, names: list[str], oos_start: str, space: dict[str, list], setup: Setup = Setup(), **options) -> dict:
    """The whole research pipeline over stored symbols, against both baselines."""
    bars = load_bars(spark, store, timeframe="1d").where(F.col("symbol").isin(names))
    return pipeline(strategy, bars, oos_start, space, setup, baselines={"momentum": momentum_baseline(), "trend": trend_baseline()}, **options)


def backtest(spark: SparkSession, store: str, strategy: Strategy, names: list[str], start: str | None = None, end: str | None = None, setup: Setup = Setup()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades, equity, rejects) of one strategy over stored symbols."""
    bars = load_bars(spark, store, timeframe="1d").where(F.col("symbol").isin(names))
    return Bench(bars, setup).wave({version(strategy): (strategy, start, end)})


def search(spark: SparkSession, store: str, names: list[str], train: tuple[str, str], check: tuple[str, str], features: list[str], **options) -> list[tuple[float, Strategy]]:
    """Evolutionary search over stored symbols."""
    bars = load_bars(spark, store, timeframe="1d").where(F.col("symbol").isin(names))
    return evolve(bars, train, check, features, **options)
