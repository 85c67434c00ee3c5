"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

The model is one table of character trigram log-probabilities per language, and each language's share of
scripts, counted in Spark over all training documents.  A word's score for a language is the sum
over its trigrams.  A path of labels pays a penalty for each switch; its best is found by Viterbi, which
is left out where no run of words can gain the penalty back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U64, mix, slices

_BUCKETS = 1 << 16
#: First code points of the script ranges told apart, and the script each range belongs to
SCRIPT_RANGES = [
    (0x0000, "Common"), (0x0041, "Latin"), (0x005B, "Common"), (0x0061, "Latin"), (0x007B, "Common"), (0x00AA, "Latin"), (0x00AB, "Common"), (0x00B5, "Greek"),
    (0x00B6, "Common"), (0x00BA, "Latin"), (0x00BB, "Common"), (0x00C0, "Latin"), (0x02B0, "Common"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Common"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Common"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Common"), (0x2C60, "Latin"), (0x2C80, "Common"), (0x3040, "Kana"), (0x3100, "Common"), (0x3400, "Han"), (0xA000, "Common"), (0xAC00, "Hangul"), (0xD7B0, "Common"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Common"), (0x20000, "Han"), (0x30000, "Common"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_FROM = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES], np.int16)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter (Unicode category L*)."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def _words(texts: list[str | None]):
    """Of all texts: trigram buckets with the word of each, words' bounds among rows, words' scripts and letter counts."""
    joined = " ".join((t or "").lower() for t in texts)
    lengths = np.array([len((t or "").lower()) for t in texts], np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths + 1)
    letter = _letters()[points]
    # what is no letter ends a word, and takes no part in scores
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    rows = np.concatenate([[0], np.searchsorted(starts, ends)])
    coded = np.where(letter, points, 0).astype(U64)
    one = np.concatenate([[0], coded[:-1]]).astype(U64)
    two = np.where(one > 0, np.concatenate([[0, 0], coded[:-2]])[: len(coded)], 0).astype(U64)
    # a trigram ends at each letter, and one at the place after the word
    at = letter | np.concatenate([[False], letter[:-1]])
    grams = (mix(coded[at] | one[at] << U64(21) | two[at] << U64(42)) >> U64(48)).astype(np.int64)
    place = np.flatnonzero(at)
    word = np.searchsorted(starts, place, "right") - 1
    script = _SCRIPT[np.searchsorted(_FROM, points[starts], "right") - 1] if len(starts) else np.zeros(0, np.int16)
    return grams, word, rows, script, stops - starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task; buckets from _BUCKETS on are scripts."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            langs = part.column("lang").to_pylist()
            texts = part.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                grams, _, _, script, _ = _words([t for t, x in zip(texts, langs, strict=True) if x == lang])
                own = seen.setdefault(lang, np.zeros(_BUCKETS + len(SCRIPTS), np.int64))
                own += np.bincount(np.concatenate([grams, script.astype(np.int64) + _BUCKETS]), minlength=len(own))
    for lang, own in seen.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])


class Model:
    """Per-language trigram log-probabilities and script shares."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, :_BUCKETS].astype(np.float64), counts[:, _BUCKETS:].astype(np.float64)
        smooth = 0.05
        self.logp = np.log((grams + smooth) / (grams.sum(1, keepdims=True) + smooth * _BUCKETS)).T.astype(np.float32).copy()
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        allowed = (share >= 0.001).T  # by script, then language
        allowed[~allowed.any(axis=1)] = True  # a script that no language uses rules none out
        self.barred = ~allowed

    @classmethod
    def train(cls, docs: DataFrame) -> Model:
        """Count docs (text, lang) with a language; the table is languages x 65,536, whatever the input's size."""
        counted = docs.select("text", "lang").where("lang is not null and text is not null").mapInArrow(_count, "lang string, bucket int, n long")
        rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        langs = sorted(set(rows.column("lang").to_pylist()))
        counts = np.zeros((len(langs), _BUCKETS + len(SCRIPTS)))
        which = np.searchsorted(np.array(langs), rows.column("lang").to_numpy(zero_copy_only=False).astype(str)) if langs else np.zeros(0, int)
        counts[which, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
        return cls(langs, counts)

    @staticmethod
    def _stays(scores: np.ndarray, best: int, penalty: float) -> bool:
        """Whether no path beats staying with the best language, by a bound: all others count as one, and switch freely.

        Then a run of other words costs two switches, or one at either end, and the whole text none.
        """
        gain = np.cumsum(np.delete(scores, best, axis=1).max(axis=1) - scores[:, best])
        before = np.concatenate([[0.0], gain[:-1]])
        return gain[-1] <= 0 and gain.max() <= penalty and gain[-1] - before.min() <= penalty and (gain - np.minimum.accumulate(before)).max() <= 2 * penalty

    def label(self, scores: np.ndarray, penalty: float) -> np.ndarray:
        """The language of each word on the best path; ties go to the language first in order."""
        n, k = scores.shape
        best = int(scores.sum(0).argmax())
        if k == 1 or self._stays(scores, best, penalty):
            return np.full(n, best)
        back = np.zeros((n, k), np.int16)
        value = scores[0].astype(np.float64)
        stay = np.arange(k)
        for i in range(1, n):
            top = int(value.argmax())
            move = value[top] - penalty > value
            back[i] = np.where(move, top, stay)
            value = np.where(move, value[top] - penalty, value) + scores[i]
        path = np.zeros(n, np.int64)
        path[-1] = value.argmax()
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    def predict(self, texts: list[str | None], penalty: float) -> tuple[list[str], list[float], list[list[tuple]]]:
        grams, word, rows, script, letters = _words(texts)
        langs, scores, spans = [], [], []
        table = np.zeros((len(script), len(self.langs)))
        if len(grams) and self.langs:
            table = np.add.reduceat(self.logp[grams], np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])), axis=0).astype(np.float64)
            table[self.barred[script]] -= 50.0
        for i in range(len(texts)):
            own = table[rows[i] : rows[i + 1]]
            if not len(own) or not self.langs:
                langs.append("und")
                scores.append(0.0)
                spans.append([])
                continue
            path = self.label(own, penalty)
            weight = np.bincount(path, weights=letters[rows[i] : rows[i + 1]], minlength=len(self.langs))
            top = int(weight.argmax())
            share = weight[top] / weight.sum()
            total = own[path == top].sum(0)
            rival = np.delete(total, top).max() if len(total) > 1 else -np.inf
            langs.append(self.langs[top])
            scores.append(float(share / (1 + np.exp(min(0.0, rival - total[top])))) if rival > -np.inf else float(share))
            turn = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
            spans.append([(int(a), int(b), self.langs[path[a]]) for a, b in zip(turn[:-1], turn[1:], strict=True)])
        return langs, scores, spans


def held_out(doc_id: Column, of: int, is_: int) -> Column:
    """Whether crc32(doc_id as text) mod `of` is `is_`; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == is_


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, more: tuple[str, ...] = ()) -> DataFrame:
    """Label docs (doc_id, text): doc_id, lang_pred, score, spans (start and end word, lang).

    Words are runs of letters.  lang_pred is the language of most letters on the best path, score its share of
    letters times its odds against the runner-up on its own words.  A null text, one without a letter, or a model
    without languages gives `und`, 0 and no spans.  Rows are labelled one by one, so repeated rows agree; of other columns, those named in `more` come along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 256 KB
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                langs, scores, spans = shared.value.predict(part.column("text").to_pylist(), penalty)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs), pa.array(scores, pa.float64()), pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x] for x in spans], span), *(part.column(c) for c in more)], ["doc_id", "lang_pred", "score", "spans", *more])

    kind, *kinds = (docs.schema[c].dataType.simpleString() for c in ("doc_id", *more))
    carried = "".join(f", `{c}` {k}" for c, k in zip(more, kinds, strict=True))
    return docs.select("doc_id", "text", *more).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>{carried}")
