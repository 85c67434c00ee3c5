"""Where bars come from and go to: CSV trees, Parquet stores, and bars derived from event tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import clean_number
from .storage import exists, names, publish, remove

PRICES = ["open", "high", "low", "close", "volume"]
BAR_SCHEMA = "ts string, open string, high string, low string, close string, volume string"
ACTION_SCHEMA = "ex_date string, kind string, value double"


def read_csv_bars(spark: SparkSession, root: str, timeframe: str, symbols: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from <root>/<timeframe>/<SYMBOL>.csv, a file or a folder of them, start and end included; a missing one is an error."""
    raw = spark.read.schema(BAR_SCHEMA).option("header", True).csv([f"{root}/{timeframe}/{s}.csv" for s in symbols])
    symbol = F.regexp_extract(F.input_file_name(), rf"/{timeframe}/([^/]+)\.csv(?:/[^/]*)?$", 1)
    ts = F.to_timestamp(F.col("ts"))
    bars = raw.select(F.url_decode(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), ts.alias("ts"), *[clean_number(F.col(c)).alias(c) for c in PRICES])
    if start:
        bars = bars.where(F.col("ts") >= F.to_timestamp(F.lit(start)))
    return bars.where(F.col("ts") <= F.to_timestamp(F.lit(end))) if end else bars


def write_csv_bars(bars: DataFrame, root: str, timeframe: str) -> None:
    """What read_csv_bars reads: a folder <root>/<timeframe>/<SYMBOL>.csv for each symbol; existing ones are replaced."""
    symbols = [r.symbol for r in bars.select("symbol").distinct().collect()]  # a folder each
    rows = bars.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *PRICES)
    for symbol in symbols:
        rows.where(F.col("symbol") == symbol).drop("symbol").write.mode("overwrite").option("header", True).csv(f"{root}/{timeframe}/{symbol}.csv")


def read_csv_actions(spark: SparkSession, root: str, symbol: str) -> DataFrame:
    """Corporate actions from <root>/actions/<SYMBOL>.csv; none if the file is missing."""
    path = f"{root}/actions/{symbol}.csv"
    raw = spark.read.schema(ACTION_SCHEMA).option("header", True).csv(path) if exists(spark, path) else spark.createDataFrame([], ACTION_SCHEMA)
    return raw.select(F.lit(symbol).alias("symbol"), F.to_date("ex_date").alias("ex_date"), "kind", "value")


def supported_timeframes(spark: SparkSession, root: str) -> list[str]:
    """The timeframes that have a folder under root."""
    return sorted(t for t in ("1h", "4h", "1d", "1w") if exists(spark, f"{root}/{t}"))


def derive_bars(events: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, volume: Column | None = None) -> DataFrame:
    """Bars from priced events: one row per (symbol, ts); the first and last price by `order`.

    One hash aggregation with map-side combine; min_by and max_by make open and close independent of arrival.
    """
    rows = events.select(symbol.cast("string").alias("symbol"), ts.cast("timestamp").alias("ts"), price.cast("double").alias("p"), order.alias("o"), (volume.cast("double") if volume is not None else F.lit(1.0)).alias("v"))
    return rows.groupBy("symbol", "ts").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the orders table, by priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return derive_bars(orders, F.col("o_orderpriority"), F.date_trunc("day", "o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the orders table, by the customer's nation."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return derive_bars(joined, F.col("c_nationkey"), F.date_trunc("day", "o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the events table, by event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return derive_bars(events, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), F.col("event_id"))


def shipment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items by return flag: discounted prices, quantities as volume."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = F.struct("l_orderkey", "l_linenumber")
    return derive_bars(items, F.col("l_returnflag"), F.date_trunc("day", "l_shipdate"), F.col("l_extendedprice") * (1 - F.col("l_discount")), order, F.col("l_quantity"))


def _current(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """The number of a store's last manifest and its rows (timeframe, symbol, version); 0 and None for a new store."""
    known = [int(n.split("-")[1]) for n in names(spark, path) if n.startswith("manifest-")]
    return max(known, default=0), spark.read.schema("timeframe string, symbol string, version string").parquet(f"{path}/manifest-{max(known):08d}") if known else None


def _same(a: str, b: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("timeframe", "symbol")])


def store_bars(bars: DataFrame, path: str, timeframe: str) -> None:
    """Replace the stored range [first, last] of each symbol by bars; running it twice changes nothing.

    The store is Parquet, partitioned by version, timeframe and symbol.  The new state of the symbols that bars touches is written as a version of its own; then a manifest, which says what version of each symbol counts, is
    given its name in one step.  Until then readers see the old state, whole, and a write that fails leaves it so; of two writers at once one gets an error.
    """
    spark = bars.sparkSession
    new = bars.withColumn("timeframe", F.lit(timeframe))
    number, known = _current(spark, path)
    if known is not None:
        old = load_bars(spark, path)
        ranges = new.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).withColumnRenamed("symbol", "_symbol")
        kept = old.where(F.col("timeframe") == timeframe).join(ranges, F.col("symbol").eqNullSafe(F.col("_symbol"))).where("ts < lo or ts > hi").drop("lo", "hi", "_symbol")
        new = kept.unionByName(new, allowMissingColumns=True)
    version = uuid.uuid4().hex
    folder = f"{path}/data/version={version}"
    new.write.partitionBy("timeframe", "symbol").parquet(folder)
    parts = spark.read.schema(_as_text(new.schema)).option("basePath", folder).parquet(folder).select("timeframe", "symbol").distinct().withColumn("version", F.lit(version))
    if known is not None:
        parts = parts.unionByName(known.alias("a").join(parts.alias("b"), _same("a", "b"), "left_anti"))
    staged = f"{path}/_staged-{version}"
    parts.coalesce(1).write.parquet(staged)
    publish(spark, staged, f"{path}/manifest-{number + 1:08d}")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove versions that the last manifest does not name, and older manifests; returns what was removed.  No writer or reader of an older state may be at work."""
    number, known = _current(spark, path)
    if known is None:
        return []
    used = {f"version={r.version}" for r in known.select("version").distinct().collect()}
    gone = [f"data/{n}" for n in names(spark, f"{path}/data") if n.startswith("version=") and n not in used] + [n for n in names(spark, path) if n.startswith("_staged-") or n.startswith("manifest-") and int(n.split("-")[1]) < number]
    for n in gone:
        remove(spark, f"{path}/{n}")
    return gone


def _as_text(schema: T.StructType) -> T.StructType:
    """Partition columns as text; Spark would take the folder name 1d for a number."""
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("timeframe", "symbol", "version") else f for f in schema])


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The store as its last manifest has it; that is a row for each symbol and timeframe, and prunes the scan's partitions."""
    _, known = _current(spark, path)
    if known is None:
        raise FileNotFoundError(f"no store at {path}")
    rows = spark.read.schema(_as_text(spark.read.parquet(f"{path}/data").schema)).parquet(f"{path}/data")
    met = rows.alias("a").join(F.broadcast(known).alias("b") if known.count() <= 1 << 20 else known.alias("b"), _same("a", "b") & (F.col("a.version") == F.col("b.version")), "left_semi")
    return met.drop("version")


def load_bars(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored bars; symbol and timeframe prune partitions, start and end reach the Parquet scan."""
    bars = _stored(spark, path)
    if timeframe:
        bars = bars.where(F.col("timeframe") == timeframe)
    if symbol:
        bars = bars.where(F.col("symbol") == symbol)
    if start:
        bars = bars.where(F.col("ts") >= F.to_timestamp(F.lit(start)))
    if end:
        bars = bars.where(F.col("ts") <= F.to_timestamp(F.lit(end)))
    return bars


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old and new with one row per key, the one latest in `order`; new rows come after old ones."""
    rows = new.withColumn("_gen", F.lit(1))
    if old is not None:
        rows = old.withColumn("_gen", F.lit(0)).unionByName(rows)
    whole = F.struct("_gen", order, *[c for c in new.columns if c not in keys and c != order])
    last = rows.groupBy(*keys).agg(F.max(whole).alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in new.columns])


def append_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key old does not hold: what an insert-if-absent would write."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
