"""Exact quantiles in bounded memory: a histogram, then finer ones of the bins that hold the ranks asked for.

No pass gathers the values of a column: bins are cut at approximate quantiles and counted, so what holds a rank shrinks by about
BINS with each pass, until it is one value or few enough to be read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a pass, and values of a bin up to which they are read
BINS, FEW = 256, 10_000


def quantiles(rows: DataFrame, value: str, at: list[float], few: int = FEW) -> list[float]:
    """The quantiles of a column at shares between 0 and 1, between two values in proportion.  Nulls and NaN don't count; without values the list is empty.

    A pass is two aggregations over all ranks at once, however many values there are; ties take no more room than one value.
    """
    known = rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    whole = known.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not whole.n:
        return []
    places = [q * (whole.n - 1) for q in at]
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    found: dict[int, float] = {}
    open_ = [(whole.lo, whole.hi, 0, whole.n)]  # from, to, values below, values inside
    while open_:
        small = [b for b in open_ if b[3] <= few]
        for lo, hi, below, n in small:
            held = known.where(F.col("v").between(lo, hi)).groupBy("v").count().orderBy("v").collect()
            upto = below
            for r in held:
                found |= {k: r.v for k in ranks if upto <= k < upto + r["count"]}
                upto += r["count"]
        open_ = _finer(known, [b for b in open_ if b[3] > few], ranks, found)
    value_at = lambda x: found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x))
    return [value_at(x) for x in places]


def _finer(known: DataFrame, bins: list[tuple], ranks: list[int], found: dict[int, float]) -> list[tuple]:
    """The parts of bins that hold ranks; a part that is one value is found."""
    if not bins:
        return []
    cuts = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    inside = lambda b: F.col("v").between(b[0], b[1])
    edges = known.agg(*[F.percentile_approx(F.when(inside(b), F.col("v")), cuts, 10_000).alias(f"e{k}") for k, b in enumerate(bins)]).first()
    # values equal to an edge are a bin of their own: the part below it, it, the part above
    spot = lambda k: F.size(F.filter(F.lit(sorted(set(edges[f"e{k}"]))), lambda e: e < F.col("v"))) + F.size(F.filter(F.lit(sorted(set(edges[f"e{k}"]))), lambda e: e <= F.col("v")))
    bin_ = reduce(lambda c, kb: c.when(inside(kb[1]), F.lit(kb[0])), enumerate(bins[1:], 1), F.when(inside(bins[0]), F.lit(0)))
    place = reduce(lambda c, kb: c.when(inside(kb[1]), spot(kb[0])), enumerate(bins[1:], 1), F.when(inside(bins[0]), spot(0)))
    counts = known.select("v", bin_.alias("bin"), place.alias("place")).where("bin is not null").groupBy("bin", "place").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("bin", "place").collect()
    out, below = [], {k: b[2] for k, b in enumerate(bins)}
    for r in counts:
        start = below[r.bin]
        below[r.bin] += r.n
        held = [k for k in ranks if start <= k < start + r.n]
        if held and r.lo == r.hi:
            found |= dict.fromkeys(held, r.lo)
        elif held:
            out.append((r.lo, r.hi, start, r.n))
    return out
