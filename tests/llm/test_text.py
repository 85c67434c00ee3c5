import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import lm_score
from barloom.llm.decontaminate import clean, leaks
from barloom.llm.encoder import Encoder
from barloom.llm.language_id import Model, held_out, identify
from barloom.llm.lm_score import LogBilinear, Tokens, Vocabulary, _before, score
from barloom.llm.token_store import PerfectHash, TokenStore

from . import brute
from .conftest import odd_rows

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
BPE = public.path("word_bpe_49k.json")


# --- token store
@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_store_round_trip(request, table, tmp_path):
    docs = request.getfixturevalue(table)
    store = TokenStore.write(docs, str(tmp_path / "store"), BPE, shards=4)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store.fetch(docs.select("doc_id")).collect()), key=lambda r: r[1])
    plain = tokenizers.Tokenizer.from_file(BPE)
    want = []
    for r in odd_rows():
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((a, c, d) for a, _, c, d in got), key=key) == sorted(want, key=key)
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()


def test_store_misses_unknown_keys(spark, odd, tmp_path):
    store = TokenStore.write(odd, str(tmp_path / "store"), BPE, shards=3)
    assert store.fetch(spark.range(10_000, 10_200).withColumnRenamed("id", "doc_id")).count() == 0


def test_empty_store(spark, none, tmp_path):
    store = TokenStore.write(none, str(tmp_path / "store"), BPE, shards=2)
    assert store.fetch(spark.range(3).withColumnRenamed("id", "doc_id")).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 2**64, 50_000, dtype=np.uint64)
    mph = PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    again, _ = PerfectHash.unpack(mph.pack() + b"more")
    assert (again.slots(keys) == mph.slots(keys)).all()
    assert PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_encoder_agrees_with_the_library():
    e, plain = Encoder(BPE), tokenizers.Tokenizer.from_file(BPE)
    texts = ["", "Don't stop, NOW...", "naïve ÀÉÎÕ ÿŸ ß ẞ", "İstanbul ﬁ x́ á b", "1,234.5 kg", "a\x1cb\x85c d", "<|endoftext|> mid<|startoftext|>dle", "日本語。テキスト", ",,,... .", "σΣ ς", "\t tabs \n\n lines "]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, f"<u{e.width}").tolist() == plain.encode(t, add_special_tokens=False).ids


# --- decontamination
BENCH = [
    (0, "Alice Smith had 12 apples and gave 5 apples to her brother before walking 3 km home again"),
    (1, "If the quick brown fox jumps over 4 lazy dogs and then rests, how many dogs did Bobby see"),
    (2, "tiny item"),
    (3, None),
    (4, "exactly five plain words here"),
    (5, "a plain passage without any slot whatsoever that goes on for a good dozen of words"),
]


def test_leaks(spark):
    noise = "some words that lead up to it and "
    docs = [
        (0, noise + BENCH[0][1] + " and more after"),
        (1, noise + BENCH[0][1].replace("12", "90").replace("5", "7").replace("3 km", "8 miles")),  # re-parameterised
        (2, BENCH[5][1].upper().replace(" ", "  ")),
        (3, BENCH[5][1][:30]),  # too little of it
        (4, noise * 5),
        (5, "we saw exactly five, plain words here today"),
        (6, None),
        (7, ""),
        (8, "tiny item"),
        (9, BENCH[1][1].replace("Bobby", "Carol").lower()),
        (None, BENCH[5][1]),
    ]
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(0, 0), (1, 0), (2, 5), (5, 4), (9, 1), (None, 5)}


def test_slots_must_be_consistent(spark):
    item = "take 7 red balls add 7 more red balls to the box then count all 7 red balls again"
    docs = [(0, item.replace("7", "4")), (1, item.replace("7", "4", 1).replace("7", "9", 1))]
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {r.doc_id for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()} == {0}


def test_clean_keeps_columns_and_other_rows(spark, clashing, odd, none):
    items = spark.createDataFrame([(0, odd_rows()[10][1])], "item_id long, text string")
    left = clean(clashing, items)
    assert left.columns == clashing.columns
    assert left.where("text is null").count() == 2
    assert left.count() < odd.count() and leaks(none, items).count() == 0
    assert clean(odd, spark.createDataFrame([], "item_id long, text string")).count() == odd.count()


def test_leaks_on_the_tables(spark, sf):
    import re

    norm = lambda t: " ".join(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", brute.low(t)).split())
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = [(r.item_id, norm(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in whole if t in norm(r.text)}
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == want


# --- language ID
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    got = identify(docs, Model.train(docs.where(~out))).join(docs.select("doc_id", "lang"), "doc_id").where(out).where("lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_mixed_text_is_labelled_in_spans(spark):
    en = "the house and the garden were quiet that morning when they walked to the river with their dogs"
    de = "das haus und der garten waren still an jenem morgen als sie mit ihren hunden zum fluss gingen"
    ru = "дом и сад были тихими в то утро когда они шли к реке со своими собаками"
    train = spark.createDataFrame([(en, "en"), (de, "de"), (ru, "ru")] * 5, "text string, lang string")
    model = Model.train(train)
    texts = [f"{en} {de} {de}", f"{ru} {en}", None, "", "123 ...", en.upper(), ru]
    langs, scores, spans = model.predict(texts, penalty=12.0)
    assert langs == ["de", "en", "und", "und", "und", "en", "ru"] or langs == ["de", "ru", "und", "und", "und", "en", "ru"]
    assert [s[2] for s in spans[0]] == ["en", "de"] and {s[2] for s in spans[1]} == {"en", "ru"}
    assert abs(spans[0][0][1] - len(en.split())) <= 1


def test_skipping_viterbi_changes_nothing():
    rng = np.random.default_rng(3)
    model = Model(["a", "b", "c"], np.ones((3, 65536 + 60)))
    for _ in range(300):
        s = rng.normal(0, rng.choice([1, 6]), (rng.integers(1, 30), 3))
        path = model.label(s, 5.0)
        best = np.full(3, 0.0) + s[0]
        for x in s[1:]:
            best = np.maximum(best, best.max() - 5.0) + x
        got = s[np.arange(len(s)), path].sum() - 5.0 * (np.diff(path) != 0).sum()
        assert abs(got - best.max()) < 1e-9


@pytest.mark.parametrize("table", ["odd", "clashing", "none"])
def test_language_on_odd_rows(request, table):
    docs = request.getfixturevalue(table)
    got = identify(docs, Model.train(docs))
    assert got.count() == docs.count()
    assert got.where("lang_pred is null or score is null").count() == 0


def test_no_training_rows(odd, none):
    assert {r.lang_pred for r in identify(odd, Model.train(none)).collect()} == {"und"}


# --- LM scoring
@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_base_score(request, table):
    import math
    from collections import Counter

    docs = request.getfixturevalue(table).drop("held_out")
    out = held_out(F.col("doc_id"), 7, 2)
    rows = odd_rows()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in rows}
    tokens = [brute.WORD.findall(brute.low(r[1])) + [None] for r in rows]
    count = Counter(w for r, t in zip(rows, tokens, strict=True) if not held[r[0]] for w in t)
    n, v = sum(count.values()), len(count)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = sorted(((r[0], held[r[0]], len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(rows, tokens, strict=True)), key=key)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in score(docs, out).collect()), key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want])


def test_model_beats_the_unigram_on_held_out_text(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    s = score(docs, held_out(F.col("doc_id"), 7, 2)).where("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert s.b < s.m < 0


def words_and_model(texts, head, seed=0):
    """A vocabulary of `head` words counted on the texts, random parameters, and the texts' tokens."""
    tokens = Tokens(pa.array(texts))
    words, first, place = np.unique(tokens.hashes, return_index=True, return_inverse=True)
    counts, kinds = np.bincount(place), tokens.classes(first)
    end = kinds == lm_score._CLASSES
    top = np.argsort(-np.where(end, 0, counts), kind="stable")[:head]
    by_class = lambda x: np.bincount(kinds[~end], weights=x[~end], minlength=lm_score._CLASSES).astype(np.int64)
    vocabulary = Vocabulary(words[top], kinds[top], counts[top], by_class(counts), by_class(np.ones(len(words))), int(counts[end].sum()))
    fresh = LogBilinear.fresh(vocabulary)
    flat = np.random.default_rng(seed).normal(0, 0.5, len(fresh.flat))
    return tokens, vocabulary, LogBilinear(flat, vocabulary.contexts, len(vocabulary.word_noise)), counts[place]


def test_probabilities_are_normalised():
    texts = ["the cat sat on the mat. The dog, too", "", None, "one two three two one"]
    tokens, vocabulary, model, _ = words_and_model(texts, 4)
    words = len(vocabulary.word_noise)
    before = np.repeat(np.random.default_rng(1).integers(0, vocabulary.contexts, (4, 1)), words, axis=1)
    assert abs(np.exp(model.log_probs(before, np.arange(words), vocabulary.word_class, vocabulary)).sum() - 1) < 1e-5
    for noise in (vocabulary.word_noise, vocabulary.class_noise):
        assert abs(noise.sum() - 1) < 1e-12
    # shares of a class's rest: its training words, and one more for all others
    rest = [h for h in np.unique(tokens.hashes) if h not in set(vocabulary.sorted)]
    assert vocabulary.rest_total.sum() == (np.isin(tokens.hashes, rest) & (tokens.ends > 0)).sum() + len(rest) - 1 + lm_score._CLASSES + 1


def test_scores_are_a_plain_forward_pass():
    """Token by token, from the formulas alone."""
    texts = ["the cat sat on the mat. The dog, too", "", None, "one two three two one the", "x"]
    tokens, vocabulary, model, _ = words_and_model(texts, 5)
    word, kind, context = vocabulary.numbers(tokens)
    got = model.log_probs(_before(context, tokens.bounds, vocabulary.contexts - 1), word, kind, vocabulary)
    at = 0
    for row in range(len(texts)):
        seen = [vocabulary.contexts - 1] * 4
        for t in range(tokens.bounds[row], tokens.bounds[row + 1]):
            h = sum(model.context[:, c].astype(float) * model.scale[k] for k, c in enumerate(reversed(seen[-4:])))
            of_class, of_word = np.exp(h @ model.kind + model.kind_bias), np.exp(h @ model.word + model.word_bias)
            members = [w for w in range(len(of_word)) if vocabulary.word_class[w] == kind[t]]
            want = np.log(of_class[kind[t]] / of_class.sum()) + np.log(of_word[word[t]] / of_word[members].sum())
            assert abs(got[t] - want) < 1e-4
            seen.append(context[t])
            at += 1
    assert at == len(word)


def test_classes_look_at_the_word_alone():
    tokens = Tokens(pa.array(["abcing", "ing", "ING.", "ng", "x", "g"]))
    kinds = tokens.classes(np.arange(len(tokens.hashes)))
    assert kinds[0] == kinds[2] == kinds[4] and all(kinds[k] == lm_score._CLASSES for k in (1, 3, 5, 7, 9, 11))
    assert (Tokens(pa.array(["g"])).classes(np.array([0])) == kinds[10]).all()


def test_scores_of_nothing(none, odd):
    assert score(none, held_out(F.col("doc_id"), 7, 2)).count() == 0
    assert score(odd, F.lit(True)).where("score is null or score = double('-inf')").count() == 0
