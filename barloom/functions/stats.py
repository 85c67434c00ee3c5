"""Distribution functions that neither Spark nor the standard library has."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_cdf(t: float, df: float) -> float:
    half = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return half if t < 0 else 1 - half


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k)."""
    return 1.0 if k >= n else beta_cdf(1 - p, n - k, k + 1)


# --- the same as Columns, for any number of rows -----------------------------------------------


def _steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def _with(value, **given: Column) -> Column:
    """value of given columns by name, each computed once, so that expressions built on expressions stay small."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in given.items()])), lambda v: value(**{k: v.getField(k) for k in given})), 0)


def normal_cdf_column(x: Column) -> Column:
    """P(X <= x) of a standard normal: near 0 by its series, far out by the continued fraction of the tail."""

    def upper(x: Column, a: Column) -> Column:
        density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
        # x + x^3 / 3 + x^5 / (3 5) + ..
        start = F.struct(a.alias("term"), a.alias("sum"))
        grown = lambda s, k: s.term * a * a / (2 * k + 1)
        series = F.aggregate(_steps(40), start, lambda s, k: F.struct(grown(s, k).alias("term"), (s.sum + grown(s, k)).alias("sum")), lambda s: s.sum)
        # 1 / (x + 1 / (x + 2 / (x + ..
        tail = density / F.aggregate(F.reverse(_steps(100)), a, lambda s, k: a + k / s)
        return _with(lambda above, x: F.when(x < 0, above).otherwise(1 - above), above=F.when(a < 2, 0.5 - density * series).otherwise(tail), x=x)

    return _with(upper, x=x, a=F.abs(x))


def normal_inverse_column(p: Column) -> Column:
    """The x with P(X <= x) = p, by Halley steps from a rational start; NULL unless 0 < p < 1."""

    def low(p: Column, q: Column, t: Column) -> Column:
        # fixed values: the start, right to 0.0005
        start = (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) - t

        def better(x: Column, _: Column) -> Column:
            off = (normal_cdf_column(x) - q) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
            return _with(lambda x, off: x - off / (1 + x * off / 2), x=x, off=off)

        return _with(lambda x, p: F.when(p <= 0.5, x).otherwise(-x), x=F.aggregate(_steps(3), start, better), p=p)

    q = F.least(p, 1 - p)
    return _with(low, p=p, q=q, t=F.sqrt(-2 * F.ln(F.when((p > 0) & (p < 1), q))))


def lgamma_column(x: Column) -> Column:
    """ln gamma(x) for x > 0, by Stirling's series eight further on."""

    def value(x: Column, z: Column, r: Column) -> Column:
        ahead = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, k: s + F.ln(x + k))
        return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) * r) * r) * r) / z - ahead

    return _with(value, x=x, z=x + 8.0, r=1 / ((x + 8.0) * (x + 8.0)))


def beta_cdf_column(x: Column, a: Column, b: Column, steps: int = 200) -> Column:
    """The regularised incomplete beta function, by its continued fraction on the side where that is fast."""
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def walked(turned: Column, y: Column, p: Column, q: Column) -> Column:
        first = 1 / safe(1 - (p + q) * y / (p + 1))

        def on(s: Column, k: Column) -> Column:
            # of k = 2, 3, 4, 5 ..: the even term of m = k / 2, then its odd one
            m = F.floor(k / 2)
            term = F.when(k % 2 == 0, m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))).otherwise(-(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)))
            moved = lambda h, c, d: state(c, d, h * c * d)
            return _with(lambda s, term: _with(moved, h=s.h, c=safe(1 + term / s.c), d=1 / safe(1 + term * s.d)), s=s, term=term)

        front = F.exp(lgamma_column(p + q) - lgamma_column(p) - lgamma_column(q) + p * F.ln(y) + q * F.log1p(-y)) / p
        value = front * F.aggregate(F.sequence(F.lit(2), F.lit(2 * steps + 1)), _with(lambda f: state(F.lit(1.0), f, f), f=first), on, lambda s: s.h)
        return _with(lambda part, turned: F.when(turned, 1 - part).otherwise(part), part=value, turned=turned)

    def sided(x: Column, a: Column, b: Column) -> Column:
        turned = x > (a + 1) / (a + b + 2)
        inside = _with(walked, turned=turned, y=F.when(turned, 1 - x).otherwise(x), p=F.when(turned, b).otherwise(a), q=F.when(turned, a).otherwise(b))
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)

    return _with(sided, x=x, a=a, b=b)


def student_cdf_column(t: Column, df: Column) -> Column:
    half = beta_cdf_column(df / (df + t * t), df / 2, F.lit(0.5)) / 2
    return F.when(t < 0, half).otherwise(1 - half)


def binomial_cdf_column(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k)."""
    return F.when(k >= n, 1.0).otherwise(beta_cdf_column(1 - p, (n - k).cast("double"), (k + 1).cast("double")))
