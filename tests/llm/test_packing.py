import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm.byte_encoder import ByteEncoder
from barloom.llm.packing import Limits, Packer, pack, pieces

from .conftest import odd_rows

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a  b", " a", "a ", "\n", "a\nb", "\n\na", "é.à", "a.\nb", "don't stop. it's", "x<|endoftext|>y", "a\tb", "1.5, 2", "a...", "²x ½.", "日本語 テキスト です", "a\x1cb", "\x85", "İß. ", " .", "word.)", "I'll,", "\0", "a\0b c", "so­ft", "é.", "ǅ. ʰ", "a. .b", "Ａ！"]


def plain(text):
    return ByteEncoder.shared(FILE).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_the_whole_text_does():
    encoder = ByteEncoder.shared(FILE)
    assert encoder.by_pieces
    rng = random.Random(3)
    made = ["".join(rng.choice(["ab", "é", " ", " ", "\n", ".", ",", "'s", "7", "x", " ", "-"]) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    for text in ODD + made:
        assert list(array(encoder.code, encoder.encode(text))) == plain(text), repr(text)


def packed(rows, limits):
    """The sequences of (key, number of ids, free) rows; every id is its place in its example."""
    packer = Packer(limits, 4, waiting=16)
    out = []
    for key, n, free in rows:
        out += packer.add(key, np.arange(n, dtype="<u4").tobytes(), free)
    return out + list(packer.rest())


@pytest.mark.parametrize("limits", [Limits(64, 8, 64), Limits(64, 3, 64), Limits(64, 8, 20), Limits(64, 1, 1), Limits(7, 2, 3)])
def test_limits_hold_and_every_id_is_placed_once(limits):
    rng = random.Random(str(limits))
    rows = [(k, n := rng.choice([1, 1, 2, 5, 30, 63, 64, 65, 200]), rng.randrange(n + 1)) for k in range(300)]
    found = {k: np.zeros(n, int) for k, n, _ in rows}
    for sequence in packed(rows, limits):
        n = sum(len(p[2]) // 4 for p in sequence)
        bear = sum(max(0, p[1] + len(p[2]) // 4 - max(p[4], p[1])) for p in sequence)
        assert n <= limits.tokens and len(sequence) <= limits.segments and bear <= limits.loss
        assert n == limits.tokens or n & (n - 1) == 0
        for key, start, ids, whole, _ in sequence:
            own = np.frombuffer(ids, "<u4")
            assert len(own) and (own == np.arange(start, start + len(own))).all() and whole == len(found[key])
            found[key][start : start + len(own)] += 1
    assert all((x == 1).all() for x in found.values())


def test_the_heuristic_mixes_short_and_long_examples():
    """64 one-token examples and 21 long ones: a first fit of the short ones would use up the segments."""
    full = [s for s in packed([(k, 1, 0) for k in range(12)] + [(100 + k, 40, 0) for k in range(8)], Limits(64, 8, 64)) if sum(len(p[2]) for p in s) == 256]
    assert len(full) == 5


def test_no_limit_is_below_one():
    with pytest.raises(ValueError):
        Packer(Limits(8, 0, 8), 2)


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_round_trip(request, table):
    """Pieces put together again are each document's ids; sequences have no gap."""
    got = pieces(pack(request.getfixturevalue(table), FILE, 0)).collect()
    texts = sorted(([*plain(r[1]), 0] for r in odd_rows()), key=repr)
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    ids = [r[0] for r in odd_rows()]
    for key, rows in by_doc.items():
        if ids.count(key) == 1:
            own = b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.start))
            text = next(r[1] for r in odd_rows() if r[0] == key)
            assert np.frombuffer(own, "<u4").tolist() == [*plain(text), 0] and {r.doc_tokens for r in rows} == {len(own) // 4}
    assert sum(r.length for r in got) == sum(map(len, texts))
    assert sum(r.start == 0 for r in got) == len(texts)


def test_query_columns(spark, sf):
    from barloom.llm.queries import op12_pack_sequences

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    spans = {}
    for r in op12_pack_sequences(spark, sf).collect():
        own = np.array([*plain(docs[r.doc_id]), 0], "<u4")
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    assert spans.keys() == docs.keys()
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_prompts_bear_no_loss(spark):
    rows = [(k, "ask " * (k % 50), "answer " * (k % 70)) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id string, prompt string, text string").repartition(2)
    limits = Limits(128, 4, 40)
    for s in pack(table, FILE, 0, limits, prompt="prompt").collect():
        assert len(s.pieces) <= 4 and sum(p.length - p.loss_from for p in s.pieces) <= 40 and len(s.ids) == 4 * s.n_tokens
        for p in s.pieces:
            ahead = len(plain(dict((str(k), a) for k, a, _ in rows)[p.doc_id]))
            assert p.loss_from == min(p.length, max(0, ahead - p.start))


def test_an_empty_table(none):
    assert pack(none, FILE, 0).count() == 0 and pieces(pack(none, FILE, 0)).agg(F.sum("length")).first()[0] is None
