"""Substring dedup: Rabin-Karp hashes of every fixed-length window, counted in Spark.

Documents are dealt into groups.  Each group sends the distinct window hashes it holds, packed by
hash range; each range counts how many groups sent a hash and answers with one bit per hash; the
group then merges its repeated windows into maximal intervals.  A hash crosses the network once,
as 10 bytes or so, since sorted hashes travel as differences; a window repeated in a third of all documents arrives at its range once per group.  At 10**13
different windows, 96 bits leave a chance of about 1 in 1,000 that any two share a hash.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions
from .words import U64, checks, hash_words, pack, sort_pairs, unpack, windows

_REQUEST, _ANSWER = "part int, grp long, hashes binary, checks binary", "part int, grp long, repeated binary"


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each hash; ascending in the hash."""
    return (((hashes >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def _group_windows(texts: pa.Array, width: int):
    """Words' bounds, windows' starts, the group's distinct hashes with their checks, each window's place among them, and their counts."""
    words, bounds = hash_words(texts, lower=False)
    found, starts = windows(words, bounds, width)
    check = checks(words, starts, width)
    order, new = sort_pairs(found, check)
    place = np.empty(len(found), np.int64)
    place[order] = np.cumsum(new) - 1
    first = order[new]
    return bounds, starts, found[first], check[first], place, np.diff(np.append(np.flatnonzero(new), len(found)))


def _requests(width: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, distinct, check, _, _ = _group_windows(table.column("text"), width)
        cuts = np.searchsorted(_ranges(distinct, parts), np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cuts))
        own = [slice(cuts[p], cuts[p + 1]) for p in full]
        sent = {"hashes": pa.array([pack(distinct[x]) for x in own], pa.binary()), "checks": pa.array([check[x].tobytes() for x in own], pa.binary())}
        return pa.table({"part": pa.array(full, pa.int32()), "grp": pa.array(np.full(len(full), table.column("grp")[0].as_py()), pa.int64()), **sent})

    return run


def _answers(table: pa.Table) -> pa.Table:
    sent = [unpack(x.as_buffer()) for x in table.column("hashes")]
    order, new = sort_pairs(np.concatenate(sent), np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("checks")]))
    times = np.diff(np.append(np.flatnonzero(new), len(order)))
    again = np.empty(len(order), bool)  # a group sends a hash once, so two are from two groups
    again[order] = np.repeat(times > 1, times)
    groups, bits, at = [], [], 0
    for grp, own in zip(table.column("grp").to_pylist(), sent, strict=True):
        hit = again[at : at + len(own)]
        at += len(own)
        if hit.any():
            groups.append(grp)
            bits.append(np.packbits(hit).tobytes())
    part = table.column("part")[0].as_py()
    return pa.table({"part": pa.array([part] * len(groups), pa.int32()), "grp": pa.array(groups, pa.int64()), "repeated": pa.array(bits, pa.binary())})


def _removals(width: int, parts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = docs.column("text")
        bounds, starts, distinct, _, place, count = _group_windows(texts, width)
        repeated = count > 1
        cuts = np.searchsorted(_ranges(distinct, parts), np.arange(parts + 1))
        for part, bits in zip(answers.column("part").to_pylist(), answers.column("repeated"), strict=True):
            lo, hi = cuts[part], cuts[part + 1]
            repeated[lo:hi] |= np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=hi - lo).astype(bool)
        first = starts[repeated[place]] if len(place) else starts
        edge = np.zeros(bounds[-1] + 1, np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept, removed, spans = [], [], []
        for i, text in enumerate(texts):
            own = gone[bounds[i] : bounds[i + 1]]
            words = text.as_py().encode().split() if text.is_valid else []
            removed.append(int(own.sum()))
            if removed[-1]:
                turn = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)])
                words = itertools.compress(words, (~own).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(words).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept_text": pa.array(kept, pa.string())})

    return run


def remove_repeats(docs: DataFrame, width: int = 35, groups: int | None = None) -> DataFrame:
    """Remove every word inside a window of `width` words whose word sequence starts anywhere else too.

    One row per row of docs (doc_id, text): doc_id, n_words, n_removed, spans (maximal removed word
    intervals, half open), kept_text (kept words joined by one space).  Windows are judged on the
    input.  A null or empty text has no words; a text shorter than the window loses none; repeated
    rows lose all their windows, as each repeats the other.  Texts of any length are read whole; an
    empty table gives no rows.  Other columns are ignored.
    """
    n = partitions(docs.sparkSession, docs)
    groups = groups or 2 * n
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("grp")).repartition(n, "grp")
    requests = dealt.groupBy("grp").applyInArrow(_requests(width, n), _REQUEST)
    answers = requests.groupBy("part").applyInArrow(_answers, _ANSWER)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
        _removals(width, n), f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string"
    )
