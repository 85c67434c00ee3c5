"""A store is whole at any time: a write that fails midway leaves what was there."""

import pytest
from pyspark.sql import functions as F

from barloom.sources import bars as src

from .helpers import walk


def rows(df):
    return sorted(map(tuple, df.select("symbol", "ts", "close", "timeframe").collect()))


def test_a_write_that_fails_midway(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    bars = walk(spark, 40, ("A", "B/..", "C=1"))
    src.store_bars(bars, path, "1d")
    before = rows(src.load_bars(spark, path))
    assert len(before) == 120
    changed = bars.where("symbol < 'C'").withColumn("close", F.col("close") + 1)
    broken = changed.withColumn("close", F.when((F.col("symbol") > "A") & (F.col("ts") > "2021-02-10"), F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="lost"):
        src.store_bars(broken, path, "1d")
    assert rows(src.load_bars(spark, path)) == before
    with monkeypatch.context() as m:  # all files are there, the manifest has no name yet
        m.setattr(src, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            src.store_bars(changed, path, "1d")
    assert rows(src.load_bars(spark, path)) == before
    for _ in range(2):
        src.store_bars(changed, path, "1d")
    after = rows(src.load_bars(spark, path))
    assert after == sorted((s, t, c + 1 if s < "C" else c, f) for s, t, c, f in before)
    assert len(src.vacuum(spark, path)) >= 4 and rows(src.load_bars(spark, path)) == after and src.vacuum(spark, path) == []


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    bars = walk(spark, 5, ("A",))
    src.store_bars(bars, path, "1d")
    real = src._current
    monkeypatch.setattr(src, "_current", lambda *a: (0, None))
    with pytest.raises(FileExistsError):
        src.store_bars(bars, path, "1d")
    monkeypatch.setattr(src, "_current", real)
    assert src.load_bars(spark, path).count() == 5


def test_ranges_timeframes_and_pruning(spark, tmp_path):
    path = str(tmp_path / "store")
    bars = walk(spark, 30, ("A", "B"))
    src.store_bars(bars, path, "1d")
    src.store_bars(bars.limit(0), path, "1d")
    src.store_bars(bars.where("symbol = 'A'"), path, "1w")
    assert src.load_bars(spark, path).count() == 90 and src.load_bars(spark, path, "A", "1w").count() == 30
    plan = src.load_bars(spark, path, "A", "1d", start="2021-01-20")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "(symbol#" in plan.split("PartitionFilters: [")[1] and "GreaterThanOrEqual(ts" in plan
    with pytest.raises(FileNotFoundError):
        src.load_bars(spark, str(tmp_path / "none"))
