"""A DataFrame that grows intermediate columns, so window functions can be built on window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_symbol


class Staged:
    """Bars plus named intermediate columns; an expression that was kept before is not computed again.

    All windows partition by symbol and order by ts, so one exchange and one sort serve every stage.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self._base = list(df.columns)
        self._kept: dict[str, str] = {}

    def keep(self, column: Column) -> Column:
        """Give an expression a column of its own and return it."""
        key = str(column)
        if key not in self._kept:
            self._kept[key] = f"_s{len(self._kept)}"
            self.df = self.df.withColumn(self._kept[key], column)
        return F.col(self._kept[key])

    def name(self, column: Column) -> str:
        """What the column of a kept expression is called."""
        self.keep(column)
        return self._kept[str(column)]

    def carry(self, *columns: Column) -> list[Column]:
        """Each expression's last known value in its symbol's rows so far."""
        return [self.keep(F.last(self.keep(c), ignorenulls=True).over(by_symbol())) for c in columns]

    def select(self, **columns: Column) -> DataFrame:
        return self.df.select(*self._base, *[c.alias(n) for n, c in columns.items()])
