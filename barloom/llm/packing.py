"""Vector bin packing of training examples into sequences of bounded length.

A sequence has limits on tokens, on segments and on loss-bearing tokens at once.  It is filled by the dot-product
heuristic: of the examples that fit, the one whose demands, weighed by how scarce each is among all that wait, agree best with what the
sequence has left.  When none fits, the one of which most fits is cut.  Every task packs its own rows with a
pool of bounded size, so nothing is shuffled, and a lost task is simply run again; tasks share no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_encoder import ByteEncoder
from .words import slices

class Limits(NamedTuple):
    """What a sequence may hold: tokens, segments, and tokens that bear loss."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


class Packer:
    """Packs examples that come one by one; sequences leave as lists of (key, start, ids, tokens of the whole, bearing loss from).

    An example is packed ids, the first `free` of which bear no loss.  At most `waiting` examples are held, besides the one that comes.
    """

    def __init__(self, limits: Limits, width: int, waiting: int = 256):
        if min(limits) < 1:
            raise ValueError(f"every limit must be 1 at least: {limits}")
        self.limits, self.width, self.waiting = limits, width, waiting
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.need = np.zeros((waiting + 1, 3))  # of each example that waits: tokens, segments (1), loss-bearing tokens
        self.held: list[tuple] = []  # key, start, ids left, tokens of the whole, first index that bears loss

    def add(self, key, ids: bytes, free: int = 0) -> Iterator[list[tuple]]:
        """The sequences that are full once this example has come."""
        n = len(ids) // self.width
        at, most = 0, self.limits
        # what fills a sequence by itself is no choice of the heuristic
        while n - at >= most.tokens and min(most.tokens, most.tokens - (free - at)) <= most.loss:
            yield [(key, at, ids[at * self.width : (at + most.tokens) * self.width], n, free)]
            at += most.tokens
        if at < n:
            self._hold(key, at, ids[at * self.width :], n, free)
        while len(self.held) > self.waiting:
            yield from self._fill()

    def rest(self) -> Iterator[list[tuple]]:
        """The sequences of all that still waits."""
        while self.held:
            yield from self._fill()

    def _bears(self, start: int, length: int, free: int) -> int:
        """Loss-bearing tokens of a stretch of an example."""
        return length - min(length, max(0, free - start))

    def _hold(self, key, start: int, ids: bytes, whole: int, free: int) -> None:
        n = len(ids) // self.width
        self.need[len(self.held)] = n, 1, self._bears(start, n, free)
        self.held.append((key, start, ids, whole, free))

    def _take(self, i: int) -> tuple:
        """Out of those that wait; the last moves into its place."""
        got, last = self.held[i], self.held.pop()
        if i < len(self.held):
            self.held[i] = last
            self.need[i] = self.need[len(self.held)]
        return got

    def _fill(self) -> Iterator[list[tuple]]:
        left, out = self.caps.copy(), []
        weight = self.need[: len(self.held)].sum(axis=0) / self.caps**3  # how scarce a limit is, demand and rest as shares of it
        while self.held and left.min() > 0:
            need = self.need[: len(self.held)]
            value = need @ (weight * left)
            value[(need > left).any(axis=1)] = -1.0
            if left[1] == 1:  # the last segment is for what uses up the tokens
                value[need[:, 0] < left[0]] = -1.0
            i = int(value.argmax())
            if value[i] >= 0:
                key, start, ids, whole, free = self._take(i)
                n = len(ids) // self.width
            else:  # cut the one of which most can be placed
                part = np.minimum(np.minimum(need[:, 0], left[0]), need[:, 0] - need[:, 2] + left[2])
                i = int(part.argmax())
                n = int(part[i])
                key, start, ids, whole, free = self._take(i)
                if n * self.width < len(ids):
                    self._hold(key, start + n, ids[n * self.width :], whole, free)
                    ids = ids[: n * self.width]
            out.append((key, start, ids, whole, free))
            left -= n, 1, self._bears(start, n, free)
        yield from self._closed(out, int(self.caps[0] - left[0]))

    def _closed(self, pieces: list[tuple], used: int) -> Iterator[list[tuple]]:
        """The sequence itself if it is full, else its tokens in sequences whose lengths are powers of two, which need no padding."""
        if used == self.limits.tokens:
            yield pieces
            return
        lengths = [1 << b for b in range(used.bit_length()) if used >> b & 1]
        now, room = [], lengths.pop()
        for key, start, ids, whole, free in pieces:
            at, n = 0, len(ids) // self.width
            while at < n:
                step = min(room, n - at)
                now.append((key, start + at, ids[at * self.width : (at + step) * self.width], whole, free))
                at += step
                room -= step
                if not room:
                    yield now
                    now, room = [], lengths.pop() if lengths else 0


def _batch(first: int, sequences: list[list[tuple]], width: int, key: pa.DataType) -> pa.RecordBatch:
    flat = [p for s in sequences for p in s]
    lengths = np.array([len(p[2]) // width for p in flat], np.int64)
    edges = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int32)
    before = np.concatenate([[0], np.cumsum(lengths)])
    offset = before[:-1] - np.repeat(before[edges[:-1]], np.diff(edges))
    starts = np.array([p[1] for p in flat], np.int64)
    bearing = np.clip(np.array([p[4] for p in flat], np.int64) - starts, 0, lengths)
    names = ["doc_id", "start", "length", "doc_tokens", "offset", "loss_from"]
    pieces = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], key), pa.array(starts), pa.array(lengths), pa.array([p[3] for p in flat], pa.int64()), pa.array(offset), pa.array(bearing)], names)
    ids = pa.array([np.frombuffer(b"".join([p[2] for p in s]), f"<u{width}").astype("<u4").tobytes() for s in sequences], pa.binary())
    n = before[edges[1:]] - before[edges[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(sequences)), pa.int64()), pa.array(n, pa.int64()), ids, pa.ListArray.from_arrays(pa.array(edges), pieces)], ["sequence_id", "n_tokens", "ids", "pieces"])


def _packed(tokenizer: str, end_id: int, limits: Limits, prompt: str | None, rows: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = ByteEncoder.shared(tokenizer)
        end, packer = encoder.pack([end_id]), Packer(limits, encoder.width)
        at, full, key = TaskContext.get().partitionId() << 40, [], pa.int64()
        for batch in batches:
            key = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                asked = part.column(prompt).to_pylist() if prompt else [None] * part.num_rows
                for doc_id, text, ahead in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), asked, strict=True):
                    head = encoder.encode(ahead)
                    for sequence in packer.add(doc_id, head + encoder.encode(text) + end, len(head) // encoder.width):
                        full.append(sequence)
                        if len(full) == rows:
                            yield _batch(at, full, encoder.width, key)
                            at, full = at + rows, []
        full += packer.rest()
        if full:
            yield _batch(at, full, encoder.width, key)

    return run


def pack(examples: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), prompt: str | None = None) -> DataFrame:
    """Pack examples into sequences that keep all limits.

    examples: doc_id, text and, if prompt names it, a column of text that goes ahead of it and bears no loss.  An example is the ids of prompt and text,
    then end_id.  One row per sequence: sequence_id, n_tokens, ids (binary, little-endian unsigned 32-bit), and pieces by offset, each with doc_id, start (its example's ids before
    it), length, doc_tokens (its example's ids), offset and loss_from (tokens of the piece ahead of the first that bears loss).  Every id lies in one piece.
    A sequence holds limits.tokens ids; where a task's rows, or the other limits, do not allow that, its ids go to sequences whose lengths are powers of two.
    A null or empty text is the end id alone, a null doc_id stays null, and repeated rows are examples of their own.  A text of any length is read whole; other columns are ignored; an empty table
    gives no rows.  How rows are packed depends on how they are dealt to tasks.
    """
    kind = examples.schema["doc_id"].dataType.simpleString()
    schema = f"sequence_id long, n_tokens long, ids binary, pieces array<struct<doc_id: {kind}, start: long, length: long, doc_tokens: long, offset: long, loss_from: long>>"
    columns = ["doc_id", "text", *([prompt] if prompt else [])]
    return examples.select(*dict.fromkeys(columns)).mapInArrow(_packed(tokenizer, end_id, limits, prompt), schema)


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece: sequence_id, the piece's fields, and its own ids."""
    each = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p")).select("sequence_id", "p.*", "ids")
    return each.withColumn("ids", F.substring(F.col("ids"), (4 * F.col("offset") + 1).cast("int"), (4 * F.col("length")).cast("int")))
