"""Filter interaction audit by inclusion-exclusion over the filters' joint failures.

One pass counts, for every part and every set S of filters, the documents that fail all of S: a sum of
products of flags.  From these 2**n counts, all else follows without a look at the documents again: alternating sums
over subsets give survivors of any filters applied together, those over supersets (Moebius inversion) give failures of one filter alone, and the
Harsanyi dividend of S in the game "how many are removed", the signed count of S, divided among its members gives Shapley values.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import WORD
from .shared import cut


def text_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Which of five filters a document fails, and what its labels say.

    docs: doc_id, text, lang.  labels: doc_id, quality, toxic; a document is good, or toxic, if any of its labels is 1.  One row per row of docs: part (lang,
    null as the empty string), A (under 200 words), B (fewer distinct words than half of all), C (over 3 % of characters are A-Z), D (any of ``#$%&*|``),
    E (the text of a smaller doc_id), good, toxic.  A null text is empty.  A null doc_id is neither smaller nor
    larger than another, so its row fails no E; rows that repeat a doc_id do not fail E by each other.  Texts of any length are read
    whole; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n = F.size("words")
    flags = {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * n,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 3 * F.length("text").cast("long"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    # the texts stay here: all that follows moves some 60 bytes a document
    judged = cut(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), *[c.alias(k) for k, c in flags.items()]))
    # the first of each text meets its own rows only, so a text in a third of all documents is one row here and spread there
    first = judged.groupBy("same").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    told = labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    known = judged.join(first, ["same", "doc_id"], "left").join(told, "doc_id", "left")
    copied = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return known.select("part", *flags, copied.alias("E"), *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])


def joint_failures(rows: DataFrame, filters: str, part: str = "part", kinds: tuple[str, ...] = ()) -> DataFrame:
    """For each part an array of counts, `all` and one for each boolean column in kinds: at index S, rows that fail every filter of S.

    filters names a boolean column by each of its letters, the first being bit 0 of S; null flags count as false.
    """
    flag = {c: F.coalesce(F.col(c), F.lit(False)).cast("long") for c in (*filters, *kinds)}

    def counts(kind: str | None) -> Column:
        one = flag[kind] if kind else F.lit(1).cast("long")
        return F.array(*[F.sum(reduce(mul, [flag[c] for k, c in enumerate(filters) if s >> k & 1], one)) for s in range(1 << len(filters))])

    return rows.groupBy(part).agg(counts(None).alias("all"), *[counts(k).alias(k) for k in kinds])


def survivors(joint: Column, n: int) -> Column:
    """For every set of filters, how many rows pass all of it: sum over its subsets S of (-1)**|S| joint[S]."""
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    sign = lambda s: F.when(F.bit_count(s) % 2 == 0, 1).otherwise(-1)
    return F.transform(every, lambda of: F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + F.when(s.bitwiseAND(of) == s, sign(s) * F.get(joint, s)).otherwise(0)))


def _over_supersets(joint: Column, n: int, bit: int, weight) -> Column:
    """Sum of (-1)**(|S| - 1) weight(|S|) joint[S] over all S with the bit."""
    sets = [s for s in range(1 << n) if s >> bit & 1]
    return sum(F.get(joint, F.lit(s)) * ((-1) ** (s.bit_count() - 1) * weight(s.bit_count())) for s in sets)


def audit(rows: DataFrame, filters: str, part: str = "part", kinds: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """What each filter does at each step of every order in which the filters can be applied.

    rows: a boolean column for each letter of filters and each name in kinds, and the column part.  One row per part, filter_order and step: kept
    (rows after it), removed (at it), redundant (failing its filter, removed before), unique_fails (failing its filter only), for each kind
    KIND_lost (rows of the kind removed at it), shapley (rows its filter removes, summed over all orders).  Null flags are false, a null part is a part
    of its own, repeated rows count as often as they occur, and an empty table gives no rows.
    """
    n, orders = len(filters), ["".join(p) for p in itertools.permutations(filters)]
    joint = joint_failures(rows, filters, part, kinds)
    by_bit = lambda weight: F.array(*[_over_supersets(F.col("all"), n, k, weight) for k in range(n)])
    known = joint.select(
        part, "all", by_bit(lambda size: 1).alias("alone"), by_bit(lambda size: math.factorial(n) // size).alias("shapley"), *[survivors(F.col(k), n).alias(f"left_{k}") for k in ("all", *kinds)]
    )
    # a row a part until here
    steps = known.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    head = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    before = reduce(lambda a, b: a + b, [F.when(F.contains(head, F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(filters)])
    bit = F.instr(F.lit(filters), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    steps = steps.select("*", before.alias("before"), bit.alias("bit")).withColumn("own", F.get(F.array(*[F.lit(1 << k) for k in range(n)]), F.col("bit")))
    left = {k: (F.get(f"left_{k}", F.col("before")), F.get(f"left_{k}", F.col("before") + F.col("own"))) for k in ("all", *kinds)}
    removed = left["all"][0] - left["all"][1]
    lost = [(left[k][0] - left[k][1]).alias(f"{k}_lost") for k in kinds]
    return steps.select(part, "filter_order", "step", left["all"][1].alias("kept"), removed.alias("removed"), (F.get("all", F.col("own")) - removed).alias("redundant"), F.get("alone", F.col("bit")).alias("unique_fails"), *lost, F.get("shapley", F.col("bit")).alias("shapley"))
