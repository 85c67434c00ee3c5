import itertools
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm.filter_audit import audit, text_failures

from . import brute
from .conftest import odd_rows

LABELS = [(1, 1, 0), (1, 0, None), (4, 0, 1), (10, 1, 1), (11, None, 1), (None, 1, 1), (14, 1, 0)]


def failures(rows):
    """(part, letters failed, good, toxic) of odd rows, filter by filter."""
    out = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = brute.WORD.findall(t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        fails += "E" * (i is not None and any(r[0] is not None and r[0] < i and (r[1] or "") == t for r in rows))
        own = [x for x in LABELS if x[0] == i and i is not None]
        out.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    return out


def walked(found, filters, orders):
    """Every order, step by step over the documents."""
    out = []
    for part in {f[0] for f in found}:
        own, removed = [f for f in found if f[0] == part], {}
        lines = []
        for order in orders:
            left = own
            for step, c in enumerate(order, 1):
                gone, stay = [f for f in left if c in f[1]], [f for f in left if c not in f[1]]
                before = sum(c in f[1] for f in own) - len(gone)
                lines.append([part, order, step, len(stay), len(gone), before, sum(f[1] == c for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone), c])
                removed[c] = removed.get(c, 0) + len(gone)
                left = stay
        out += [(*x[:-1], removed[x[-1]]) for x in lines]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_documents(request, spark, table):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality long, toxic long")
    got = audit(text_failures(request.getfixturevalue(table), labels), "ABCDE")
    assert brute.as_rows(got, COLUMNS) == sorted(walked(failures(odd_rows()), "ABCDE", ["".join(p) for p in itertools.permutations("ABCDE")]), key=repr)


@pytest.mark.parametrize("filters", ["X", "XY", "QWRT"])
def test_other_filters(spark, filters):
    rng = random.Random(filters)
    found = [(rng.choice("pq"), "".join(c for c in filters if rng.random() < 0.4), rng.random() < 0.5, rng.random() < 0.2) for _ in range(300)]
    rows = spark.createDataFrame([(p, *[True if c in f else rng.choice([False, None]) for c in filters], g, t) for p, f, g, t in found], f"part string, {', '.join(f'{c} boolean' for c in filters)}, good boolean, toxic boolean")
    assert brute.as_rows(audit(rows, filters), COLUMNS) == sorted(walked(found, filters, ["".join(p) for p in itertools.permutations(filters)]), key=repr)


def test_shapley_values_share_what_all_filters_remove(spark, odd):
    got = audit(text_failures(odd, spark.createDataFrame(LABELS, "doc_id long, quality long, toxic long")), "ABCDE").where("filter_order = 'ABCDE'")
    for r in got.groupBy("part").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect():
        assert r.s == 120 * r.r


def test_an_empty_table(spark, none):
    assert audit(text_failures(none, spark.createDataFrame(LABELS, "doc_id long, quality long, toxic long")), "ABCDE").count() == 0
