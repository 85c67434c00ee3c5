import random

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm.components import components
from barloom.llm.exact_dedup import exact_groups
from barloom.llm.jaccard_join import similar_groups
from barloom.llm.substring_dedup import remove_repeats
from barloom.llm.words import hash_words, shingle_sets, windows

from . import brute
from .conftest import SCHEMA, odd_rows

ROWS = [(r[0], r[1]) for r in odd_rows()]


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_exact(request, table):
    got = brute.as_rows(exact_groups(request.getfixturevalue(table)), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"])
    assert got == sorted(brute.exact(ROWS), key=repr)


def test_exact_splits_beyond_the_first_digit(spark):
    texts = ["x" * 63 + c + "y" * 900 + d for c in "ab" for d in "cdcd"] + ["x" * 64, "X" * 64]
    rows = list(enumerate(texts))
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), first=4, factor=2)
    assert brute.as_rows(got, ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]) == sorted(brute.exact(rows), key=repr)


@pytest.mark.parametrize("table", ["odd", "clashing"])
@pytest.mark.parametrize("width", [1, 7, 35])
def test_substrings(request, table, width):
    from pyspark.sql import functions as F

    got = remove_repeats(request.getfixturevalue(table), width).withColumn("sha", F.sha2("kept_text", 256))
    assert brute.as_rows(got, ["doc_id", "n_words", "n_removed", "sha"]) == sorted(brute.substrings(ROWS, width), key=repr)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_windows_whose_hashes_collide_are_told_apart(monkeypatch):
    """64-bit hashes cut to two bits: the 32 further bits must do, in a group and between groups."""
    from barloom.llm import substring_dedup

    real = substring_dedup.windows
    monkeypatch.setattr(substring_dedup, "windows", lambda *a: (real(*a)[0] & np.uint64(3), real(*a)[1]))
    rows = [r for r in ROWS if r[0] is not None]
    tables = [pa.table({"doc_id": [r[0] for r in part], "text": pa.array([r[1] for r in part], pa.string()), "grp": [g] * len(part)}) for g, part in enumerate((rows[::2], rows[1::2]))]
    asked = pa.concat_tables([substring_dedup._requests(7, 1)(t) for t in tables])
    answers = substring_dedup._answers(asked)
    got = []
    for g, t in enumerate(tables):
        out = substring_dedup._removals(7, 1)(t, answers.filter(pa.array([x == g for x in answers.column("grp").to_pylist()])))
        got += zip(*(out.column(c).to_pylist() for c in ("doc_id", "n_words", "n_removed")), strict=True)
    assert sorted(got) == sorted(r[:3] for r in brute.substrings(rows, 7))


@pytest.mark.parametrize("top", [1, 2**20, 2**63])
@pytest.mark.parametrize("n", [1, 2, 1000])
def test_hashes_travel_as_differences(top, n):
    from barloom.llm.words import pack, unpack

    values = np.sort(np.random.default_rng(n).integers(0, top, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert (unpack(pack(values)) == values).all()
    assert (unpack(pack(np.array([2**64 - 1], np.uint64))) == 2**64 - 1).all()


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_hot_groups_join_in_parts(spark, monkeypatch, limit):
    from pyspark.sql import functions as F

    from barloom.llm import hot

    monkeypatch.setattr(hot, "LEAST", 3)
    monkeypatch.setattr(hot, "BROADCAST_LIMIT", limit)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = sorted(map(tuple, hot.join_groups(rows, groups, ["k"], "n", 1000, F.col("id"), F.lit(8)).select("id", "k", "n", "top").collect()))
    assert got == [(i, 0, 334, 999) if i % 3 == 0 else (i, i, 1, i) for i in range(1000)]


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_similar(request, table):
    got = brute.as_rows(similar_groups(request.getfixturevalue(table)), ["doc_id", "n_shingles", "component_id", "n_links"])
    assert got == sorted(brute.similar(ROWS), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_similar_loses_no_link(spark, seed):
    """Sizes around every band edge, edits around the threshold, chains, and a block larger than one cell would be."""
    rng = random.Random(seed)
    rows, k = [], 0
    for size in (6, 20, 76, 77, 95, 96, 97, 120, 150, 191, 192, 240, 400):
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size + 4)]
            for _ in range(rng.randrange(1, 9)):
                copy = list(words)
                for _ in range(rng.randrange(0, max(2, size // 25))):
                    copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
                cut = rng.randrange(0, max(1, size // 5))
                rows.append((k, " ".join(copy[cut:] if rng.random() < 0.5 else copy)))
                k += 1
    rng.shuffle(rows)
    got = brute.as_rows(similar_groups(spark.createDataFrame(rows, "doc_id long, text string")), ["doc_id", "n_shingles", "component_id", "n_links"])
    assert got == sorted(brute.similar(rows), key=repr)


def test_split_blocks(spark, monkeypatch):
    """Parts of a block are compared with one another like rows of one part."""
    import barloom.llm.jaccard_join as jj

    monkeypatch.setattr(jj, "_CELL", 3)
    got = brute.as_rows(jj.similar_groups(spark.createDataFrame(ROWS, "doc_id long, text string")), ["doc_id", "n_shingles", "component_id", "n_links"])
    assert got == sorted(brute.similar(ROWS), key=repr)


@pytest.mark.parametrize("per_size", [0.02, 0.15])
def test_bands_whose_pieces_promise_nothing(spark, per_size):
    """With too few pieces for its differences, a band gets a piece for each shingle, and no link is lost."""
    rng = random.Random(9)
    rows = []
    for size in (90, 97, 130, 190, 200, 390, 800):
        for _ in range(4):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size + 4)]
            for k in range(4):
                copy = list(words)
                for _ in range(k * size // 60):
                    copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
                rows.append((len(rows), " ".join(copy[rng.randrange(0, size // 6) :])))
    got = brute.as_rows(similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), pieces_per_size=per_size), ["doc_id", "n_shingles", "component_id", "n_links"])
    assert got == sorted(brute.similar(rows), key=repr) and any(r[3] for r in got)


def test_lower_similarity(spark):
    """A partner may hold more other shingles than shared ones."""
    rows = [(0, " ".join(f"w{k}" for k in range(60))), (1, " ".join(f"w{k}" for k in range(30))), (2, " ".join(f"w{k}" for k in range(20, 60))), (3, " ".join(f"w{k}" for k in range(300))), (4, " ".join(f"w{k}" for k in range(130)))]
    for percent in (40, 50, 70):
        got = brute.as_rows(similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), similarity=percent / 100), ["doc_id", "n_shingles", "component_id", "n_links"])
        assert got == sorted(brute.similar(rows, percent=percent), key=repr)


def test_groups_in_detail(odd):
    rows = similar_groups(odd, detail=True).collect()
    assert all((r.group_id is None) == (r.n_shingles == 0) for r in rows)
    groups = {}
    for r in rows:
        assert r.group_id is None or groups.setdefault(r.group_id, r.component_id) == r.component_id
    wanted = [c for _, n, c, _ in brute.similar(ROWS) if n]
    assert len(groups) >= len(set(wanted))


def test_empty_tables(none):
    assert exact_groups(none).count() == remove_repeats(none).count() == similar_groups(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(a, a + 1) for a in range(0, 40)] + [(100, 100), (200, 201), (201, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[201] == 200 and 100 not in got
    for a, b in edges:
        if a != b:
            assert got[a] == got[b] <= min(a, b)


def test_words_agree_with_plain_splitting():
    texts = [None, "", "a b", " lead", "trail ", "two\n\x0blines", "ÄÖ ü", "x" * 3_000_000, "y " * 400_000, "\x1cno\x85space", "A a"]
    hashes, bounds = hash_words(pa.array(texts), lower=False)
    assert np.diff(bounds).tolist() == [len(brute.WORD.findall(t or "")) for t in texts]
    table = {}
    for i, t in enumerate(texts):
        for w, h in zip(brute.WORD.findall(t or ""), hashes[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert table.setdefault(w, h) == h
    assert len(set(table.values())) == len(table)
    folded, _ = hash_words(pa.array(["A a Ä"]), lower=True)
    assert folded[0] == folded[1] != folded[2]


def test_windows_and_shingles():
    hashes, bounds = hash_words(pa.array(["a b c d e f", "x", "b c d e f g"]), lower=False)
    found, starts = windows(hashes, bounds, 5)
    assert len(found) == 4 and starts.tolist() == [0, 1, 7, 8] and found[1] == found[2]
    assert [len(s) for s in shingle_sets(pa.array(["a b c d e f", "x y", "", None, "a a a a a a a"]))] == [2, 1, 0, 0, 1]
    assert SCHEMA
