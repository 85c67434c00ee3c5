"""Long histories in slices, so that one symbol is the work of many tasks.

A slice is a run of whole time buckets of a symbol.  `split` deals rows by (symbol, slice), each slice with the rows ahead of it that a trailing
window needs (its halo); the pair takes the symbol's place, so windows by symbol stay as they are.  What
reaches back without bound is carried: a slice's last value goes to the slices after it through a table of one row a slice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.state import cut
from .staged import Staged

#: Rows of the table of buckets up to which it is broadcast (some 50 MB); beyond, it is joined by shuffle
BROADCAST_ROWS = 1 << 20


class Slicing(NamedTuple):
    """rows: a new slice begins once one has so many.  bucket: the unit of time (as date_trunc knows it) that is never cut."""

    rows: int
    bucket: str = "month"

    @classmethod
    def of(cls, spark: SparkSession) -> Slicing | None:
        """What the session asks for by spark.barloom.slice.rows and spark.barloom.slice.bucket; None: a symbol is one task."""
        rows = spark.conf.get("spark.barloom.slice.rows", None)
        return cls(int(rows), spark.conf.get("spark.barloom.slice.bucket", "month")) if rows else None


def buckets(rows: DataFrame, slicing: Slicing, before: int, time: str = "ts") -> DataFrame:
    """symbol, bucket, slice (from 1), upto: the last slice that has the bucket, or a part of it, among the `before` rows ahead of it."""
    line = Window.partitionBy("symbol").orderBy("bucket")
    sizes = rows.groupBy("symbol", F.date_trunc(slicing.bucket, time).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("end", F.sum("n").over(line))
    sizes = sizes.withColumn("full", F.floor((F.col("end") - F.col("n")) / slicing.rows)).withColumn("slice", F.dense_rank().over(Window.partitionBy("symbol").orderBy("full")))
    if before < 1:
        return sizes.select("symbol", "bucket", "slice", F.col("slice").alias("upto"))
    # a slice begins where the bucket before it ends
    following = F.coalesce(F.lead("slice").over(line), F.col("slice"))
    near = Window.partitionBy("symbol").orderBy("end").rangeBetween(0, before - 1)
    return sizes.withColumn("following", following).select("symbol", "bucket", "slice", F.max("following").over(near).alias("upto"))


def split(rows: DataFrame, slicing: Slicing, before: int = 0, time: str = "ts") -> DataFrame:
    """rows dealt to slices: symbol becomes the pair (symbol, slice), and _kept tells a slice's own rows from those ahead of it.

    No slice has fewer than `before` rows ahead, where the symbol has them.  A null symbol is a symbol.
    """
    plan = cut(buckets(rows, slicing, before, time)).withColumnsRenamed({"symbol": "_symbol", "bucket": "_bucket", "slice": "_slice", "upto": "_upto"})
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    met = rows.join(plan, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.date_trunc(slicing.bucket, time) == F.col("_bucket")))
    dealt = met.withColumn("_part", F.explode(F.sequence("_slice", "_upto"))).withColumn("_kept", F.col("_part") == F.col("_slice"))
    number = F.when(F.col("_part") > 0, F.col("_part"))  # always; nullable, as Arrow hands it back
    return dealt.withColumn("symbol", F.struct("symbol", number.alias("slice"))).drop("_symbol", "_bucket", "_slice", "_upto", "_part")


def whole(rows: DataFrame) -> DataFrame:
    """The slices' own rows under their symbols again."""
    return rows.where("_kept").withColumn("symbol", F.col("symbol.symbol")).drop("_kept")


def carried(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """rows of split() with each column filled by its last known value in the symbol's rows so far."""
    rows = cut(rows)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order))
    last = rows.where("_kept").groupBy("symbol").agg(*[F.max_by(c, known(c)).alias(c) for c in columns])
    earlier = Window.partitionBy("symbol.symbol").orderBy("symbol.slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = last.select("symbol", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_ahead_{c}") for c in columns]).withColumnRenamed("symbol", "_pair")
    line = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(ahead.hint("merge"), F.col("symbol") == F.col("_pair"), "left").drop("_pair")
    return met.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(line), F.col(f"_ahead_{c}")) for c in columns}).drop(*[f"_ahead_{c}" for c in columns])


#: How two parts' values of a running aggregate become one
_MERGE = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}


def running(rows: DataFrame, wanted: dict[str, tuple[str, Column]], order: list[str]) -> DataFrame:
    """rows of split() with the sum, max or min of a column over the symbol's rows so far: name -> (aggregate, column).

    Each slice sends one row of totals; a slice starts from the merged totals of those before it.  Rows ahead of a slice's own get no value of use.
    """
    if not wanted:
        return rows
    rows = cut(rows)
    own = {name: F.when(F.col("_kept"), column) for name, (_, column) in wanted.items()}
    call = lambda name, column: getattr(F, wanted[name][0])(column)
    totals = rows.where("_kept").groupBy("symbol").agg(*[call(n, c).alias(n) for n, c in own.items()])
    earlier = Window.partitionBy("symbol.symbol").orderBy("symbol.slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(F.col("symbol").alias("_pair"), *[call(n, F.col(n)).over(earlier).alias(f"_ahead_{n}") for n in wanted])
    line = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(ahead.hint("merge"), F.col("symbol") == F.col("_pair"), "left").drop("_pair")
    return met.withColumns({n: _MERGE[wanted[n][0]](call(n, own[n]).over(line), F.col(f"_ahead_{n}")) for n in wanted}).drop(*[f"_ahead_{n}" for n in wanted])


class SlicedStaged(Staged):
    """A Staged frame over the rows of split()."""

    def carry(self, *columns: Column) -> list[Column]:
        copies = {f"{self.name(c)}c": self.keep(c) for c in columns}
        self.df = carried(self.df.withColumns(copies), list(copies), ["ts"])
        return [F.col(c) for c in copies]
