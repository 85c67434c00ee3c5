"""LM scoring with a log-bilinear model, trained in numpy by noise-contrastive estimation.

Tokens are lower-cased words and one end per text.  The vocabulary's head is its most frequent words, `HEAD` times the
root of all distinct ones; every word, in the head or not, has one of `_CLASSES` classes by its last letters.  A
token's probability is that of its class times that of its word within the class; words outside the head are one
member of their class together, and a rarer word has its share of it by smoothed counts.  Class and word are each a softmax
over all outcomes, so probabilities are normalised at the cost of a few dozen products a token: tokens are sorted by
class, and a class's words are one matrix product for all its tokens.

The context vector is the sum of the previous words' vectors, each scaled by a vector for its distance (diagonal
context matrices); words outside the head share as many hashed vectors as the head has words.  Training is data-parallel: every task
runs noise-contrastive steps over each token of its documents, and the tasks' parameters are averaged, by
Spark, after each round.  A model takes about 50 numbers for each head word: 20 MB of them at 10**10 distinct words.

Counts cover every training document and stay in Spark.  Documents are dealt into groups; a group asks each hash range
for the counts of its distinct words, as substring_dedup does for windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, partitions
from .words import U64, hash_spans, mix, slices, text_bytes, word_bounds

#: Head words, as a multiple of the root of all distinct words, and at least
HEAD, _LEAST_HEAD = 2, 63
_CLASSES, _CONTEXT, _WIDTH = 64, 4, 16
_END_HASH = U64(0x0123456789ABCDEF)
_NOISE = {"word": 128, "kind": 32}
#: Tokens of a training step, and of a scoring step
_STEP, _BATCH = 8192, 32768
#: Numbers of a parameter vector that travel as one row
_BLOCK = 4096
RATE = 0.02


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Tokens:
    """The tokens of a column of texts: each one's hash, the rows' bounds among them, and where their words stand in the bytes."""

    def __init__(self, column: pa.Array):
        self.raw, bounds = text_bytes(column)
        hashes, starts, ends = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, to, first, last in word_bounds(self.raw, bounds):
            hashes.append(hash_spans(self.raw[at:to], first, last, lower=True))
            starts.append(first + at)
            ends.append(last + at)
        places = np.concatenate(starts)
        rows = np.searchsorted(places, bounds)
        at = rows[1:]  # an end after every row; its word is empty
        self.hashes = np.insert(np.concatenate(hashes), at, _END_HASH)
        self.starts, self.ends = np.insert(places, at, 0), np.insert(np.concatenate(ends), at, 0)
        self.bounds = rows + np.arange(len(rows))

    def classes(self, of: np.ndarray) -> np.ndarray:
        """The classes of some tokens: by their last three bytes, folded, less a full stop or comma; an end has the last."""
        start, last = self.starts[of], self.ends[of] - 1
        if not len(self.raw):
            return np.full(len(of), _CLASSES)
        byte = self.raw[last]
        last = last - (((byte == 46) | (byte == 44)) & (last > start))
        tail = np.zeros(len(of), U64)
        for k in range(3):
            tail = tail << U64(8) | np.where(last - k >= start, _FOLD[self.raw[np.maximum(last - k, 0)]], 0).astype(U64)
        return np.where(last < 0, _CLASSES, (mix(tail) >> U64(58)).astype(np.int64))


class Vocabulary:
    """Head words, and what is left of each class: how tokens become the model's numbers.

    Class `_CLASSES` is the end's.  Words: the head in order of class, then "the rest" of each class, with the end.
    """

    def __init__(self, words: np.ndarray, classes: np.ndarray, counts: np.ndarray, n_class: np.ndarray, v_class: np.ndarray, ends: int):
        by_class = np.lexsort((words, classes))
        self.size, self.counts = len(words), counts[by_class]
        self.word_class = np.concatenate([classes[by_class], np.arange(_CLASSES + 1)])
        self.sorted, self.order = np.sort(words), np.argsort(words[by_class])
        self.tokens, self.distinct = int(n_class.sum()) + ends, int(v_class.sum()) + (ends > 0)
        n_rest = n_class - np.bincount(classes, weights=counts, minlength=_CLASSES).astype(np.int64)
        v_rest = v_class - np.bincount(classes, minlength=_CLASSES)
        self.rest_total = np.append(n_rest + v_rest + 1, 1)  # one more for all words never seen
        share = lambda x: (x + 1.0) / (x + 1.0).sum()
        self.word_noise = share(np.concatenate([self.counts, n_rest, [ends]]))
        self.class_noise = share(np.append(n_class, ends))
        self.members = [np.flatnonzero(self.word_class == c) for c in range(_CLASSES + 1)]

    @property
    def contexts(self) -> int:
        """Context vectors: the head's, as many hashed ones, and one for ends and what lies before a text."""
        return 2 * max(self.size, _LEAST_HEAD) + 1

    def numbers(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's word, class and context vector."""
        hashes = tokens.hashes
        word = np.full(len(hashes), -1)
        if self.size:
            at = np.minimum(np.searchsorted(self.sorted, hashes), self.size - 1)
            word = np.where(self.sorted[at] == hashes, self.order[at], -1)
        other = np.flatnonzero(word < 0)
        kind = tokens.classes(other)
        word[other] = self.size + kind
        context = word.copy()
        half = max(self.size, _LEAST_HEAD)
        context[other] = np.where(kind == _CLASSES, 2 * half, half + (hashes[other] % U64(half)).astype(np.int64))
        return word, self.word_class[word], context


def _before(context: np.ndarray, bounds: np.ndarray, outside: int) -> np.ndarray:
    """The context vectors of the tokens before each token, nearest first; `outside` stands for what lies before the text."""
    out = np.full((_CONTEXT, len(context)), outside)
    place = np.arange(len(context)) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in range(_CONTEXT):
        ok = np.flatnonzero(place > k)
        out[k, ok] = context[ok - 1 - k]
    return out


class LogBilinear:
    """Context and distance vectors, and vectors and biases of words and classes, as one flat float32 array; columns are items."""

    def __init__(self, flat: np.ndarray, contexts: int, words: int):
        self.flat = flat.astype(np.float32).copy()
        shapes = [("context", (_WIDTH, contexts)), ("scale", (_CONTEXT, _WIDTH)), ("word", (_WIDTH, words)), ("word_bias", (words,)), ("kind", (_WIDTH, _CLASSES + 1)), ("kind_bias", (_CLASSES + 1,))]
        at = 0
        for name, shape in shapes:
            setattr(self, name, self.flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        self.steps, self.mean, self.square = 0, np.zeros(at, np.float32), np.zeros(at, np.float32)

    @classmethod
    def fresh(cls, vocabulary: Vocabulary) -> LogBilinear:
        words, contexts = len(vocabulary.word_noise), vocabulary.contexts
        size = _WIDTH * (contexts + _CONTEXT + words + _CLASSES + 1) + words + _CLASSES + 1
        model = cls(np.random.default_rng(7).normal(0, 0.1, size), contexts, words)
        model.scale[:] = 1.0 / np.arange(1, _CONTEXT + 1)[:, None] ** 0.5
        model.word_bias[:], model.kind_bias[:] = np.log(vocabulary.word_noise), np.log(vocabulary.class_noise)
        return model

    def hidden(self, before: np.ndarray) -> np.ndarray:
        return sum(np.take(self.context, before[k], axis=1) * self.scale[k][:, None] for k in range(_CONTEXT))

    def step(self, before: np.ndarray, word: np.ndarray, kind: np.ndarray, vocabulary: Vocabulary, rng: np.random.Generator, rate: float) -> None:
        """One noise-contrastive step, for words and for classes; the batch shares its noise."""
        taken = [np.take(self.context, before[k], axis=1) for k in range(_CONTEXT)]
        h = sum(x * self.scale[k][:, None] for k, x in enumerate(taken))
        to_h, n = np.zeros_like(h), h.shape[1]
        grads = {}
        for name, target, noise in (("word", word, vocabulary.word_noise), ("kind", kind, vocabulary.class_noise)):
            vectors, bias = getattr(self, name), getattr(self, f"{name}_bias")
            drawn = np.minimum(np.searchsorted(np.cumsum(noise), rng.random(_NOISE[name])), len(noise) - 1)
            offset = bias - np.log(noise * len(drawn)).astype(np.float32)
            own, some = np.take(vectors, target, axis=1), vectors[:, drawn]
            up = _sigmoid(-np.einsum("ij,ij->j", h, own) - offset[target])  # data counted as noise
            down = some.T @ h
            down += offset[drawn][:, None]
            _sigmoid(down)  # noise counted as data
            own *= up
            to_h += own
            to_h -= some @ down
            items = len(noise)
            own_grad = np.stack([np.bincount(target, weights=x, minlength=items) for x in up * h])
            np.subtract.at(own_grad.T, drawn, down @ h.T)
            own_bias = np.bincount(target, weights=up, minlength=items)
            np.subtract.at(own_bias, drawn, down.sum(1))
            grads[name], grads[f"{name}_bias"] = own_grad, own_bias
        to_context, to_scale = np.zeros(self.context.shape), np.zeros_like(self.scale)
        for k, x in enumerate(taken):
            to_context += np.stack([np.bincount(before[k], weights=y, minlength=to_context.shape[1]) for y in to_h * self.scale[k][:, None]])
            to_scale[k] = np.einsum("ij,ij->i", to_h, x)
        parts = [to_context, to_scale, grads["word"], grads["word_bias"], grads["kind"], grads["kind_bias"]]
        grad = np.concatenate([x.ravel() for x in parts]).astype(np.float32)
        grad /= n
        # steps scaled by running means of the gradient and of its square, so that rare words learn too
        self.steps += 1
        self.mean += np.float32(0.1) * (grad - self.mean)
        grad *= grad
        self.square += np.float32(0.01) * (grad - self.square)
        size = np.sqrt(self.square / np.float32(1 - 0.99**self.steps))
        size += np.float32(1e-8)
        self.flat += np.float32(rate / (1 - 0.9**self.steps)) * self.mean / size

    def log_probs(self, before: np.ndarray, word: np.ndarray, kind: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """The natural log-probability of each target word, normalised over classes and over the words of its class."""
        out = np.zeros(len(word))
        for at in range(0, len(word), _BATCH):
            to = slice(at, at + _BATCH)
            h, c = self.hidden(before[:, to]), kind[to]
            order = np.argsort(c, kind="stable")
            h, c, w = h[:, order], c[order], word[to][order]
            logits = self.kind.T @ h
            logits += self.kind_bias[:, None]
            found = _log_softmax_at(logits, c)
            cuts = np.searchsorted(c, np.arange(_CLASSES + 2))
            for k in np.flatnonzero(np.diff(cuts)):
                own, mine = slice(cuts[k], cuts[k + 1]), vocabulary.members[k]
                if len(mine) > 1:
                    logits = self.word[:, mine].T @ h[:, own]
                    logits += self.word_bias[mine][:, None]
                    found[own] += _log_softmax_at(logits, np.searchsorted(mine, w[own]))
            out[at + order] = found
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; float32 holds exp up to 88."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_softmax_at(logits: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The log-softmax down each column, at one row of it."""
    logits -= logits.max(axis=0)
    own = logits[rows, np.arange(len(rows))].astype(np.float64)
    np.exp(logits, out=logits)
    return own - np.log(logits.sum(axis=0, dtype=np.float64))


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def _ask(parts: int):
    """The group's distinct words with their training counts and classes, packed by hash range."""

    def run(table: pa.Table) -> pa.Table:
        tokens = Tokens(table.column("text"))
        train = np.repeat(~table.column("held_out").to_numpy(), np.diff(tokens.bounds))
        words, first, place = np.unique(tokens.hashes, return_index=True, return_inverse=True)
        counts = np.bincount(place, weights=train, minlength=len(words)).astype(np.uint32)
        kinds = tokens.classes(first).astype(np.uint8)
        cuts = np.searchsorted(_ranges(words, parts), np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cuts))
        pack = lambda x: pa.array([x[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary())
        return pa.table({"part": pa.array(full, pa.int32()), "grp": pa.array(np.full(len(full), table.column("grp")[0].as_py()), pa.int64()), "words": pack(words), "counts": pack(counts), "kinds": pack(kinds)})

    return run


def _merge(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Each group's words; all distinct words of the range, their training counts and classes."""
    sent = [np.frombuffer(x.as_buffer(), U64) for x in table.column("words")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")])
    kinds = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("kinds")])
    words, first, place = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
    return sent, words, np.bincount(place, weights=counts, minlength=len(words)).astype(np.int64), kinds[first]


def _head(distinct: int) -> int:
    return max(_LEAST_HEAD, HEAD * math.isqrt(distinct))


def _statistics(parts: int):
    """A range's sums by class, and its most frequent words: (kind, word, n, v); a sum's word is null."""

    def run(table: pa.Table) -> pa.Table:
        _, words, counts, kinds = _merge(table)
        n, v = np.bincount(kinds, weights=counts, minlength=_CLASSES + 1), np.bincount(kinds[counts > 0], minlength=_CLASSES + 1)
        open_ = (kinds < _CLASSES) & (counts > 0)
        # the head's words fall into hash ranges at random: a range's share of them, and eight standard deviations more
        mine = _head(2 * parts * len(words)) // parts + 1
        top = np.flatnonzero(open_)[np.lexsort((words[open_], -counts[open_]))[: _LEAST_HEAD + mine + 8 * math.isqrt(mine)]]
        kind = np.concatenate([np.arange(_CLASSES + 1), kinds[top]])
        word = pa.array(np.concatenate([np.zeros(_CLASSES + 1, np.int64), words[top].view(np.int64)]), pa.int64(), mask=np.arange(len(kind)) <= _CLASSES)
        return pa.table({"kind": pa.array(kind, pa.int32()), "word": word, "n": pa.array(np.concatenate([n, counts[top]]).astype(np.int64)), "v": pa.array(np.concatenate([v, np.ones(len(top))]).astype(np.int64))})

    return run


def _answer(table: pa.Table) -> pa.Table:
    sent, words, counts, _ = _merge(table)
    part = table.column("part")[0].as_py()
    packed = [counts[np.searchsorted(words, own)].astype(np.uint64).tobytes() for own in sent]
    return pa.table({"part": pa.array([part] * len(sent), pa.int32()), "grp": table.column("grp"), "counts": pa.array(packed, pa.binary())})


def _train(known, turn: int):
    """One task's noise-contrastive pass over each of its tokens; gives its parameters in blocks, times how many tokens they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = known.value
        model, seen = LogBilinear(flat, vocabulary.contexts, len(vocabulary.word_noise)), 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                tokens = Tokens(part.column("text"))
                word, kind, context = vocabulary.numbers(tokens)
                before = _before(context, tokens.bounds, vocabulary.contexts - 1)
                # seeded by what the slice holds, so a task that runs again learns the same
                rng = np.random.default_rng([int(tokens.hashes.sum(dtype=U64) & U64(0xFFFFFFFF)), turn])
                order = rng.permutation(len(word))
                for pick in np.array_split(order, -(-len(order) // _STEP)):
                    model.step(before[:, pick], word[pick], kind[pick], vocabulary, rng, RATE / (1 + 0.01 * model.steps + turn))
                seen += len(word)
        if seen:
            starts = range(0, len(flat), _BLOCK)
            packed = [(model.flat[a : a + _BLOCK].astype(np.float64) * seen).tobytes() for a in starts]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array([seen] * len(packed), pa.int64()), pa.array(packed, pa.binary())], ["block", "seen", "total"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each block that came to this task, one row at a time."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, seen, total in zip(batch.column("block").to_pylist(), batch.column("seen").to_pylist(), batch.column("total"), strict=True):
            got = sums.setdefault(block, [0, 0.0])
            got[0] += seen
            got[1] = got[1] + np.frombuffer(total.as_buffer(), np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(total / seen).astype(np.float32).tobytes() for seen, total in sums.values()], pa.binary())], ["block", "mean"])


def _score(parts: int, known):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        vocabulary, flat = known.value
        model = LogBilinear(flat, vocabulary.contexts, len(vocabulary.word_noise))
        tokens = Tokens(docs.column("text"))
        words, place = np.unique(tokens.hashes, return_inverse=True)
        cuts = np.searchsorted(_ranges(words, parts), np.arange(parts + 1))
        counts = np.zeros(len(words), np.int64)
        for part, got in zip(answers.column("part").to_pylist(), answers.column("counts"), strict=True):
            counts[cuts[part] : cuts[part + 1]] = np.frombuffer(got.as_buffer(), np.uint64)
        c = counts[place]
        base = np.log10((c + 1) / (vocabulary.tokens + vocabulary.distinct + 1))
        word, kind, context = vocabulary.numbers(tokens)
        score = model.log_probs(_before(context, tokens.bounds, vocabulary.contexts - 1), word, kind, vocabulary) / np.log(10)
        rare = (word >= vocabulary.size) & (kind < _CLASSES)
        score[rare] += np.log10((c[rare] + 1) / vocabulary.rest_total[kind[rare]])
        rows = len(tokens.bounds) - 1
        add = lambda x: np.add.reduceat(x, tokens.bounds[:-1]) if rows else np.zeros(0)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(np.diff(tokens.bounds), pa.int64()), "n_known": pa.array(add((c > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(rows, vocabulary.tokens), pa.int64()), "base_score": pa.array(add(base), pa.float64()), "score": pa.array(add(score), pa.float64())})

    return run


def score(docs: DataFrame, held_out: Column, rounds: int = 1) -> DataFrame:
    """Score every text of docs (doc_id, text), learning from the rows that are not held out.

    One row per row: doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (add-one unigram) and score (log-bilinear), both log10 of the whole text's probability.
    A null or empty text is the end alone; a null doc_id is held out or not as the given column says, null counting as held out.
    Texts of any length are scored whole.  Words that tie in count enter the head in the order of their hashes.  Repeated rows get equal scores; without
    training rows the model is uniform over smoothed counts.  An empty table gives no rows.  Each round learns from all tokens of all training
    documents; how rows are dealt to tasks changes what is learnt a little, and no count.  Other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark, docs)
    ranges = max(1, n // 4)  # a group's distinct words are a fraction of its text
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2 * n))).repartition(n, "grp")
    asked = dealt.groupBy("grp").applyInArrow(_ask(ranges), "part int, grp long, words binary, counts binary, kinds binary")
    stats = asked.groupBy("part").applyInArrow(_statistics(ranges), "kind int, word long, n long, v long")
    sums = cut(stats.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("v").alias("v")))
    n_class, v_class = np.zeros(_CLASSES + 1, np.int64), np.zeros(_CLASSES + 1, np.int64)
    for r in sums.where("word is null").collect():  # one row a class
        n_class[r.kind], v_class[r.kind] = r.n, r.v
    top = sums.where("word is not null").orderBy(F.desc("n"), "word").limit(_head(int(v_class.sum()))).collect()  # the head
    vocabulary = Vocabulary(np.array([r.word for r in top], np.int64).view(U64), np.array([r.kind for r in top], np.int64), np.array([r.n for r in top], np.int64), n_class[:-1], v_class[:-1], int(n_class[-1]))
    flat = LogBilinear.fresh(vocabulary).flat
    training = rows.where("not held_out").select("text")
    for turn in range(rounds):
        known = spark.sparkContext.broadcast((vocabulary, flat))
        learned = training.mapInArrow(_train(known, turn), "block int, seen long, total binary")
        mean = learned.repartition(ranges, "block").mapInArrow(_average, "block int, mean binary").toArrow().sort_by("block")
        known.destroy()
        if mean.num_rows:
            flat = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in mean.column("mean")])
    known = spark.sparkContext.broadcast((vocabulary, flat))
    answers = asked.groupBy("part").applyInArrow(_answer, "part int, grp long, counts binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
        _score(ranges, known), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
