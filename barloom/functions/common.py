"""Small column helpers.  Missing is always NULL, never NaN; a boolean is never NULL."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol(order: str = "ts") -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(order)


def trailing(n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def rolled(agg, col: Column, n: int, frame: WindowSpec | None = None) -> Column:
    """agg(col) over the last n rows, NULL unless all n are there and not NULL."""
    frame = frame if frame is not None else trailing(n)
    return F.when(F.count(col).over(frame) == n, agg(col).over(frame))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or either is NULL."""
    return a / F.nullif(b, F.lit(0.0))


def correlation(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of a group or frame, NULL where either side is constant (F.corr divides by zero there)."""
    known = x.isNotNull() & y.isNotNull()
    x, y = F.when(known, x), F.when(known, y)
    cov, sx, sy = (c.over(over) if over is not None else c for c in (F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)))
    return ratio(cov, sx * sy)


def yes(cond: Column) -> Column:
    """cond with NULL as false."""
    return F.coalesce(cond, F.lit(False))


def clean_number(col: Column) -> Column:
    """A double; text that is no number, NaN and infinities become NULL."""
    value = col.try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
