import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("the of and a to in is it that was".split()) + str(rng.randrange(60)) for _ in range(n))
    base, shared = say(120), say(60)
    near = [base.split() for _ in range(12)]
    for k, w in enumerate(near):
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
    texts = [None, "", " \t\n", "A", "a", "one two three", "One  TWO three", "é É", "Ünï cödé " * 3, say(5), base, base.upper(), base, base + " tail", shared + " " + say(30), say(30) + "\n" + shared, "x" * 5000, say(4000), "日本語 テキスト です", "..., !!", "\x1c\x85 odd space"]
    texts += [" ".join(w) for w in near] + [base] * 8
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s0", "s1", "s2"][i % 4], None if i % 5 == 0 else i) for i, t in enumerate(texts)]
    rows += [(None, base, "en", "s0", 1), (None, None, None, None, None), rows[10], rows[10], rows[3], (7, "another text under a known id", "en", "s1", 3)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The odd rows with further columns under names that operators use inside."""
    from pyspark.sql import functions as F

    names = "grp digit rest sig part piece block copies h pos bin size key weight target taken s b upto before shard first nth n held_out base start end text_hash names odd nodes host quality_weight epochs run same first words good toxic part_ prompt pieces ids sequence_id phrase path trie rank score".split()
    return odd.withColumns({c: F.lit("clash") for c in names})
