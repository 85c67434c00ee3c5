"""Benchmark decontamination by template canonicalisation.

Texts become templates: A-Z lowered, punctuation dropped, runs of numbers, units after a number and
names replaced by typed placeholders, in three views: no names, those capitalised inside a sentence, also those that
start one.  Digits are split from letters after them, and number words are numbers.  Windows of a benchmark item's
template are hash-joined with those of the documents.  The windows of an item that meet a document at
one offset form an alignment; in it each slot value of the item must always stand for the same value
of the document, so a question with other numbers or names is caught and a chance pattern is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _GRAM, _ROLL, U64, _window_hash, hash_spans, mix, slices, text_bytes, word_bounds

#: Unit words, lower case
UNITS = """
mm cm m km inch inches in ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons tonne tonnes
ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years
km/h mph c f k degree degrees percent dollar dollars euro euros cent cents usd eur w kw watt watts v volt volts j joule joules n newton newtons hz khz mhz ghz kb mb gb tb
""".split()

#: Number words, lower case
NUMBERS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split()
#: Views: which kinds of token are slots in them; the last is the plain tokens of items that have no eligible window
_VIEWS, _LITERAL = (0, 1, 2), 3
_SLOT = np.array([[0, 1, 1, 0, 0], [0, 1, 1, 1, 0], [0, 1, 1, 1, 1], [0, 0, 0, 0, 0]], bool)

_GAP = np.zeros(256, bool)
_GAP[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"()"]] = True
_NUMBER, _UNIT, _NAME = (U64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_LEXICAL = 4
#: Benchmark window hashes kept in every task to drop other windows before the join: 8 MB at most
FILTER_LIMIT = 1 << 20


def _hashes(words: list[str]) -> np.ndarray:
    raw, bounds = text_bytes(pa.array(words))
    return np.sort(hash_spans(raw, bounds[:-1], bounds[1:], lower=True))


def _tokens(column: pa.Array, units: np.ndarray, numbers: np.ndarray):
    """Per token its value's hash and its kind (0 word, 1 number, 2 unit, 3 name, 4 capitalised first in a sentence), and rows' bounds; then hashes and bounds with number runs whole."""
    raw, bounds = text_bytes(column)
    values, kinds, places = [np.zeros(0, U64)], [np.zeros(0, np.int8)], [np.zeros(0, np.int64)]
    for at, to, starts, ends in word_bounds(raw, bounds, _GAP):
        piece = raw[at:to]
        digit = np.concatenate([[0], np.cumsum((piece >= 48) & (piece <= 57))])
        stop = np.concatenate([[0], np.cumsum(_STOP[piece])])
        mixed = np.flatnonzero((digit[starts + 1] > digit[starts]) & (digit[ends] - digit[starts] < ends - starts))
        if len(mixed):  # 5km is 5 and km
            letters = np.flatnonzero(np.diff(digit) == 0)
            at_letter = letters[np.searchsorted(letters, starts[mixed])]
            starts, ends = np.insert(starts, mixed + 1, at_letter), np.insert(ends, mixed, at_letter)
        hashes = hash_spans(piece, starts, ends, lower=True)
        number = digit[ends] - digit[starts] == ends - starts
        number |= np.isin(hashes, numbers)
        before = np.concatenate([[0], ends[:-1]])
        inside = stop[starts] == stop[before]
        if len(inside):
            inside[0] = False
        first = piece[starts] if len(starts) else piece[:0]
        second = piece[np.minimum(starts + 1, max(0, to - at - 1))] if len(starts) else piece[:0]
        name = (first >= 65) & (first <= 90) & (ends - starts > 1) & ((second >= 97) | (second >= 128))
        kinds.append(np.where(number, 1, np.where(name, np.where(inside, 3, 4), 0)).astype(np.int8))
        values.append(hashes)
        places.append(starts + at)
    values, kinds, places = np.concatenate(values), np.concatenate(kinds), np.concatenate(places)
    rows = np.searchsorted(places, bounds)
    head = np.zeros(len(values) + 1, bool)
    head[rows] = True
    kinds[head[:-1] & (kinds == 3)] = 4
    whole = values, rows
    if len(values):
        after = np.concatenate([[False], kinds[:-1] == 1]) & ~head[:-1]
        unit = after & ((kinds == 0) | (kinds == 4)) & np.isin(values, units)
        kinds[unit] = 2
        rest = after & (kinds == 1)
        values, kinds = values[~rest], kinds[~rest]
        rows = rows - np.concatenate([[0], np.cumsum(rest)])[rows]
    return values, kinds, rows, *whole


def _windows(values: np.ndarray, kinds: np.ndarray, rows: np.ndarray, width: int, view: int) -> tuple[np.ndarray, np.ndarray]:
    """Template hashes of all windows of `width` tokens with enough words in them, and their first tokens."""
    counts = np.maximum(np.diff(rows) - width + 1, 0)
    starts = np.repeat(rows[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    slot = _SLOT[view][kinds]
    shape = np.where(~slot, values, np.where(kinds == 1, _NUMBER, np.where(kinds == 2, _UNIT, _NAME)))
    found = mix(_window_hash(shape * _GRAM + U64(1), starts, starts + width, _ROLL) + U64(width))
    if view == _LITERAL:
        return found, starts
    plain = np.concatenate([[0], np.cumsum(~slot)])
    enough = plain[starts + width] - plain[starts] >= min(_LEXICAL, width)
    return found[enough], starts[enough]


def _emit(found, starts, values, kinds, rows, ids, width, view, hit) -> dict[str, pa.Array]:
    found, starts = found[hit], starts[hit]
    row = np.searchsorted(rows, starts, "right") - 1
    slots = []
    for s in starts:
        k = kinds[s : s + width]
        at = np.flatnonzero(_SLOT[view][k])
        slots.append([(int(a), int(values[s + a].view(np.int64))) for a in at])
    kind = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.int64())]))
    return {"row": row, "h": pa.array(found.view(np.int64)), "pos": pa.array((starts - rows[row]).astype(np.int64)), "slots": pa.array([[{"at": a, "value": v} for a, v in x] for x in slots], kind)}


_SLOTS = "slots array<struct<at: int, value: long>>"


def _item_windows(width: int, least: int):
    """Every template window of each item, in all views; plain windows of the items that have no template window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, numbers = _hashes(UNITS), _hashes(NUMBERS)
        for batch in batches:
            for part in slices(batch, "text"):
                values, kinds, rows, plain, plain_rows = _tokens(part.column("text"), units, numbers)
                has = np.zeros(len(rows) - 1, bool)
                for view in (*_VIEWS, _LITERAL):
                    if view == _LITERAL:
                        values, kinds, rows = plain, np.zeros(len(plain), np.int8), plain_rows
                    size = np.diff(rows)
                    for w in range(least, width + 1):
                        mine = (size >= w) if w == width else (size == w)
                        if view == _LITERAL:
                            mine &= ~has
                        found, starts = _windows(values, kinds, rows, w, view)
                        hit = mine[np.searchsorted(rows, starts, "right") - 1]
                        out = _emit(found, starts, values, kinds, rows, None, w, view, hit)
                        row = out.pop("row")
                        if view != _LITERAL:
                            has[row] = True
                        yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row)), pa.array(np.full(len(row), w), pa.int32()), pa.array(np.full(len(row), view), pa.int32()), out["h"], out["pos"], out["slots"]], ["item_id", "width", "names", "h", "pos", "slots"])

    return run


def _doc_windows(wanted: list[tuple[int, int]], keep: np.ndarray | None):
    """Windows of documents in the wanted views and widths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, numbers = _hashes(UNITS), _hashes(NUMBERS)
        for batch in batches:
            for part in slices(batch, "text"):
                *template, plain, plain_rows = _tokens(part.column("text"), units, numbers)
                for view, w in wanted:
                    values, kinds, rows = template if view != _LITERAL else (plain, np.zeros(len(plain), np.int8), plain_rows)
                    found, starts = _windows(values, kinds, rows, w, view)
                    if keep is not None:
                        hit = keep[np.minimum(np.searchsorted(keep, found), len(keep) - 1)] == found
                    else:
                        hit = np.ones(len(found), bool)
                    if not hit.any():
                        continue
                    out = _emit(found, starts, values, kinds, rows, None, w, view, hit)
                    row = out.pop("row")
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), part.column("text_hash").take(pa.array(row)), pa.array(np.full(len(row), view), pa.int32()), out["h"], out["pos"], out["slots"]], ["doc_id", "text_hash", "names", "h", "doc_pos", "doc_slots"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.6, least: int = 4) -> DataFrame:
    """Documents (doc_id, text) that hold a benchmark item (item_id, text), also with other numbers, units or names.

    One row for each pair: doc_id, text_hash (xxhash64 of the text, to tell rows that repeat a doc_id), item_id,
    coverage (share of the item's template windows found in consistent alignments, `coverage` or more).
    An item of `least` to width - 1 tokens is one window; one with fewer tokens, or a null text, is never found.
    Windows with under 4 plain words are left out; an item that has no other is found by all its words and numbers as they stand.  Repeated rows give one row; other columns are ignored.
    """
    items = benchmark.select("item_id", "text").mapInArrow(_item_windows(width, least), f"item_id long, width int, names int, h long, pos long, {_SLOTS}").distinct()
    totals = items.groupBy("item_id", "names").agg(F.countDistinct("pos").alias("n_windows"))
    wanted = sorted((r.names, r.width) for r in items.select("names", "width").distinct().collect())  # at most 4 * (width - least + 1)
    keep = None
    hashes = items.select("h").distinct()
    if hashes.count() <= FILTER_LIMIT:
        keep = np.sort(np.array([r.h for r in hashes.collect()], np.int64).view(U64))
    if not wanted:
        keep = None
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    met = rows.mapInArrow(_doc_windows(wanted, keep), f"doc_id long, text_hash long, names int, h long, doc_pos long, doc_{_SLOTS}")
    met = met.distinct().join(items, ["h", "names"])
    one = ["doc_id", "text_hash", "item_id", "names", F.col("doc_pos").alias("doc_pos"), "pos"]
    runs = met.select(*one, F.col("slots").alias("s"), F.col("doc_slots").alias("d")).withColumn("offset", F.col("doc_pos") - F.col("pos"))
    # a slot value of the item that meets two values of the document makes the alignment inconsistent
    pairs = runs.select("doc_id", "text_hash", "item_id", "names", "offset", F.explode(F.arrays_zip("s", "d")).alias("z")).select("doc_id", "text_hash", "item_id", "names", "offset", F.col("z.s.value").alias("theirs"), F.col("z.d.value").alias("ours"))
    key = ["doc_id", "text_hash", "item_id", "names", "offset"]
    odd = pairs.groupBy(*key, "theirs").agg(F.min("ours").alias("lo"), F.max("ours").alias("hi")).where("lo <> hi").select(*key).distinct()
    odd = odd.toDF(*[f"odd_{c}" for c in key])
    good = runs.select(*key, "pos").join(odd, reduce(and_, (F.col(c).eqNullSafe(F.col(f"odd_{c}")) for c in key)), "left_anti")
    found = good.groupBy(*key[:-1]).agg(F.countDistinct("pos").alias("n")).join(totals, ["item_id", "names"])
    found = found.where((F.col("names") != _LITERAL) | (F.col("n") == F.col("n_windows")))
    best = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.col("n") / F.col("n_windows")).alias("coverage"))
    return best.where(F.col("coverage") >= coverage)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay."""
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad._leak_id) & (F.xxhash64(docs.text) == bad._leak_hash), "left_anti")
