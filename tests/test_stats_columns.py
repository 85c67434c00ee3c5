"""Distribution functions as Columns against the scalar ones, quantiles against sorting."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.operators import quantiles as qt
from barloom.operators.quantiles import quantiles


def test_normal(spark):
    xs = [-37.0, -9.0, -5.0001, -5.0, -4.9999, -3.0, -1.0, -1e-9, 0.0, 0.3, 1.96, 4.99, 5.01, 8.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.normal_cdf_column(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc(-r.x / math.sqrt(2)) / 2, rel=1e-11, abs=1e-300)
    ps = [1e-12, 0.001, 0.2, 0.5, 0.77, 0.95, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", stats.normal_inverse_column(F.col("p")).alias("x")).collect()
    for r in got:
        assert r.x == pytest.approx(statistics.NormalDist().inv_cdf(r.p), rel=1e-8, abs=1e-9)
    assert [r.x for r in spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(stats.normal_inverse_column(F.col("p")).alias("x")).collect()] == [None] * 3


def test_student_binomial_and_gamma(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-6, 6), float(rng.choice([1, 2, 5, 30, 400, 20_000])), n := rng.choice([1, 7, 50, 3000]), rng.randrange(n + 1), rng.uniform(0.01, 0.99)) for _ in range(120)]
    df = spark.createDataFrame(rows, "t double, df double, n long, k long, p double")
    got = df.select("*", stats.student_cdf_column(F.col("t"), F.col("df")).alias("s"), stats.binomial_cdf_column(F.col("k"), F.col("n"), F.col("p")).alias("b"), stats.lgamma_column(F.col("df") / 7).alias("g")).collect()
    for r in got:
        assert r.s == pytest.approx(stats.student_cdf(r.t, r.df), rel=1e-7, abs=1e-12)
        assert r.b == pytest.approx(stats.binomial_cdf(r.k, r.n, r.p), rel=1e-7, abs=1e-12)
        assert r.g == pytest.approx(math.lgamma(r.df / 7), rel=1e-11, abs=1e-11)


AT = [0.0, 0.05, 0.25, 0.5, 0.731, 0.95, 1.0]


def by_sorting(values):
    v = sorted(values)
    out = []
    for q in AT:
        x = q * (len(v) - 1)
        lo, hi = v[math.floor(x)], v[math.ceil(x)]
        out.append(lo + (hi - lo) * (x - math.floor(x)))
    return out


@pytest.mark.parametrize("bins,few", [(256, 10_000), (4, 3), (2, 1)])
def test_quantiles(spark, monkeypatch, bins, few):
    monkeypatch.setattr(qt, "BINS", bins)
    rng = random.Random(bins)
    for values in ([rng.gauss(0, 1) for _ in range(700)], [rng.choice([0.0, 1.0, 1.0, 5.0]) for _ in range(500)], [10.0 ** rng.randrange(-200, 200) for _ in range(300)], [7.0] * 50, [3.0]):
        rows = spark.createDataFrame([(x,) for x in [*values, None, math.nan]], "x double")
        assert quantiles(rows, "x", AT, few) == pytest.approx(by_sorting(values), rel=1e-14)
    assert quantiles(spark.createDataFrame([(None,)], "x double"), "x", AT) == []


def test_counts_far_off_have_no_chance(spark):
    """30,076 trades where 2,886 are due: z is -506, where a rule of 400 steps gives 0.0306 for both tails."""
    z = -(30_076 - 2_886) / math.sqrt(2_886)
    density = lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    simpson = lambda n: 1 + 2 * z / n / 3 * sum((1 if i in (0, n) else 2 + i % 2 * 2) * density(z * i / n) for i in range(n + 1))
    got = spark.range(1).select(2 * stats.normal_cdf_column(F.lit(z))).first()[0]
    assert got == math.erfc(-z / math.sqrt(2)) == 0 and simpson(4_000) == pytest.approx(0, abs=1e-12) and round(simpson(400), 4) == 0.0306
