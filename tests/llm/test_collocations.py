import random
import re
from collections import Counter, defaultdict

import pytest

from barloom.llm import collocations
from barloom.llm.collocations import Paths, frequent_phrases, mine

from . import brute
from .conftest import odd_rows

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counted(rows, longest):
    """Counts by language and tuple of words; () has the number of words."""
    out = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            if w:
                out[lang or "und"][()] += len(w)
            for i in range(len(w)):
                for m in range(1, longest + 1):
                    if i + m <= len(w):
                        out[lang or "und"][tuple(w[i : i + m])] += 1
    return out


def mined(rows, longest, least, top):
    out = []
    for lang, f in counted(rows, longest).items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        own = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, left, right = min((1000 * a * f[()] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, f[()], -s) for k, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)]
    return sorted(out, key=repr)


def sentences(seed, n):
    rng = random.Random(seed)
    words = [chr(97 + k % 26) * (1 + k // 26) + rng.choice(["", "é", "Z", "\x1f", "\x00"]) for k in range(40)]
    draw = lambda: rng.choice(words[:6]) if rng.random() < 0.5 else rng.choice(words)
    return [(rng.choice(["en", "de", None]), rng.choice([" ", "\t ", "  "]).join(draw() + rng.choice(["", "", "", ".", "!\n"]) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("longest,least,top", [(5, 4, 2000), (3, 2, 30), (2, 1, 5)])
def test_against_every_phrase(spark, longest, least, top):
    rows = sentences(longest, 300)
    table = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert brute.as_rows(mine(table, longest, least, top), COLUMNS) == mined(rows, longest, least, top)


def test_many_ranges_and_small_shards(spark, monkeypatch):
    """Nodes on the edges of ranges, and texts cut where pieces end, add up."""
    monkeypatch.setattr(collocations, "RANGE_BYTES", 1000)
    monkeypatch.setattr(collocations, "_EVERY", 3)
    rows = sentences(9, 400) + [("en", "x y z. " * 500)] * 5
    table = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    got = brute.as_rows(frequent_phrases(table, 5, 3), ["lang", "phrase", "words", "n"])
    want = [(lang, " ".join(p), len(p), a) for lang, f in counted(rows, 5).items() for p, a in f.items() if a >= 3 or not p]
    assert got == sorted(want, key=repr)


def test_texts_longer_than_a_shard(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "SHARD_BYTES", 50)
    text = "one two. three, four five\n" * 20 + "no end in it " * 20 + ". end"
    batch = pa.RecordBatch.from_pydict({"lang": ["x"], "text": [text]})
    got = [t for _, texts in collocations._stretches(iter([batch])) for t in texts]
    assert b"".join(got) == text.encode() and len(got) > 10 and all(t.decode()[-1] in ".,\n" for t in got[:-1])


def test_a_trie_comes_back(monkeypatch):
    rows = sentences(4, 200)
    langs, texts = [(x or "und").encode() for x, t in rows if t], [t.encode() for _, t in rows if t]
    whole = Paths.of(langs, texts, 4)
    cuts = [0, *sorted(whole.place(whole.path(i)) for i in (5, 100, 101, 300)), len(whole.counts)]
    assert cuts[1:-1] == [5, 100, 101, 300]
    back = Paths.merge([whole.write(a, b) for a, b in zip(cuts, cuts[1:])])
    assert [back.path(i) for i in range(len(back.counts))] == [whole.path(i) for i in range(len(whole.counts))]
    assert back.counts.tolist() == whole.counts.tolist()
    assert [whole.path(i) for i in range(len(whole.counts))] == sorted(whole.path(i) for i in range(len(whole.counts)))


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_odd_rows(request, table):
    rows = [(r[2], r[1]) for r in odd_rows()]
    assert brute.as_rows(mine(request.getfixturevalue(table), 5, 2, 50), COLUMNS) == mined(rows, 5, 2, 50)


def test_products_past_64_bits(spark):
    from pyspark.sql import functions as F

    a = l = r = 9 * 10**13
    n = 10**17
    got = spark.range(1).select(F.expr(f"(cast(1000 as decimal(4, 0)) * (cast({a} as decimal(18, 0)) * cast({n} as decimal(18, 0)))) div (cast({l} as decimal(18, 0)) * cast({r} as decimal(18, 0)))")).first()[0]
    assert got == 1000 * a * n // (l * r)


def test_an_empty_table(none):
    assert mine(none).count() == 0
