"""Bars written by hand, and random walks."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np

BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def sessions(n: int, start: str = "2021-01-04") -> list[datetime]:
    day, out = datetime.fromisoformat(start), []
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += timedelta(days=1)
    return out


def micro(spark, rows: list[tuple], symbol: str = "X", volume: float = 1e6):
    """Literal (open, high, low, close) rows on weekdays."""
    return spark.createDataFrame([(symbol, ts, *map(float, r), float(volume)) for ts, r in zip(sessions(len(rows)), rows, strict=True)], BAR)


def walk(spark, n: int = 400, symbols: tuple[str, ...] = ("A", "B"), seed: int = 1):
    rng, rows = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.015, n)))
        for ts, c in zip(sessions(n), close, strict=True):
            o = float(c * (1 + rng.normal(0, 0.004)))
            rows.append((s, ts, o, float(max(o, c) * (1 + abs(rng.normal(0, 0.004)))), float(min(o, c) * (1 - abs(rng.normal(0, 0.004)))), float(c), float(rng.integers(1_000_000, 5_000_000))))
    return spark.createDataFrame(rows, BAR)


def values(df, column: str) -> list:
    return [r[column] for r in df.orderBy("symbol", "ts").collect()]
