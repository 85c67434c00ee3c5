"""Phrase collocations from depth-limited count tries.

Each shard (some 8 MB of text) is a trie whose paths are its language, then up to five words of a piece of text, from every word on, with
a count at each path's end.  Tries are written in sorted order, level by level, and cut at the bounds of prefix ranges; each
range merges its share of all tries.  A node's count is the sum below it; only the nodes along a range's two edges
can go on in a neighbour, so those leave as partial counts and all others already pruned.  What is left are the frequent phrases: a phrase's left parts are
the nodes on the walk to it, and its right parts are reached by suffix links, both as joins by phrase.

Words are compared as bytes, never as hashes.  A phrase in a third of all documents is one path in each shard, and a first word
before many others is spread over ranges, since bounds are whole paths.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Bytes of text in a shard's trie, and in a range on average
SHARD_BYTES = RANGE_BYTES = 8 << 20
#: Words of which one starts a path that helps to choose the bounds; the bytes of a word that count there
_EVERY, _HEAD = 256, 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


# --- paths of a shard -----------------------------------------------------------------------


def _keys(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The columns as few 64-bit keys whose order, first key first, is theirs."""
    keys, used = [], 65
    for c in columns:
        bits = max(1, int(c.max()).bit_length()) if len(c) else 1
        if used + bits > 64:
            keys.append(c.astype(np.uint64))
            used = bits
        else:
            keys[-1] = (keys[-1] << np.uint64(bits)) | c.astype(np.uint64)
            used += bits
    return keys


def _merged(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns in order, and their counts summed."""
    keys = _keys(columns)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(fresh)
    held = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return [c[order[first]] for c in columns], held.astype(np.int64)


def _sorted_vocabulary(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The rank of each word among the distinct ones, in byte order from 1, and those."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order)).to_pylist()


class Paths:
    """Distinct paths in order, with counts: a language's place in `langs`, then words by their place in `words` from 1; 0 where a piece has ended."""

    def __init__(self, langs: list[bytes], words: list[bytes], columns: list[np.ndarray], counts: np.ndarray):
        self.langs, self.words, self.columns, self.counts = langs, words, columns, counts

    @classmethod
    def of(cls, langs: list[bytes], texts: list[bytes], longest: int) -> Paths:
        """The paths of texts, each in its language."""
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        solid = ~_GAP[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[solid]])])
        ids, words = _sorted_vocabulary(flat)
        piece = np.cumsum(_BREAK[raw], dtype=np.int32)[starts]
        known = sorted(set(langs))
        place = np.array([bisect_left(known, x) for x in langs], np.int32)
        columns = [place[np.searchsorted(begins, starts, "right") - 1], ids]
        for k in range(1, longest):
            c = np.zeros(len(ids), np.int32)
            c[: max(0, len(ids) - k)] = np.where(piece[k:] == piece[: len(ids) - k], ids[k:], 0) if len(ids) > k else 0
            columns.append(c)
        return cls(known, words, *_merged(columns, None))

    def path(self, i: int) -> tuple[bytes, ...]:
        return (self.langs[self.columns[0][i]], *[self.words[c[i] - 1] if c[i] else b"" for c in self.columns[1:]])

    def place(self, bound: tuple[bytes, ...]) -> int:
        """How many paths come before the bound."""
        lo, hi = 0, len(self.counts)
        for k, word in enumerate(bound):
            names = self.words if k else self.langs
            at = bisect_left(names, word)
            exact = at < len(names) and names[at] == word
            value = at + 1 if k else at
            if k and not word:
                value, exact = 0, True
            own = self.columns[k][lo:hi]
            first = lo + int(np.searchsorted(own, value, "left"))
            if not exact:
                return first
            lo, hi = first, lo + int(np.searchsorted(own, value, "right"))
        return lo

    # --- as a trie ---

    def write(self, lo: int, hi: int) -> tuple[bytes, int]:
        """The trie of paths lo to hi, and its bytes when decompressed: names, then for each depth how many children each node above has and the children's labels, then counts."""
        own = [c[lo:hi] for c in self.columns]
        arrays, above, fresh = [], np.zeros(1, np.int64), np.zeros(hi - lo, bool)
        used = np.unique(np.concatenate(own[1:]))
        used = used[used > 0]
        for k, c in enumerate(own):
            fresh[0] = True
            fresh[1:] |= c[1:] != c[:-1]
            nodes = np.flatnonzero(fresh)
            label = c[nodes] if not k else np.searchsorted(used, c[nodes], "right")
            arrays += [np.diff(np.append(np.searchsorted(nodes, above), len(nodes))), label]
            above = nodes
        arrays.append(self.counts[lo:hi])
        data = _put([*_names(self.langs), *_names([self.words[i - 1] for i in used.tolist()]), *arrays])
        return pa.compress(data, codec="zstd", asbytes=True), len(data)

    @classmethod
    def merge(cls, tries: Iterator[tuple[bytes, int]]) -> Paths:
        """All tries, given with their bytes when decompressed, as one."""
        read = [_get(pa.decompress(blob, size, codec="zstd", asbytes=True)) for blob, size in tries]
        langs = sorted({x.as_py() for r in read for x in _named(r[:1], r[1:2])})
        ranks, words = _sorted_vocabulary(_named([r[2] for r in read], [r[3] for r in read]))
        at, runs = 0, []
        for lang_sizes, lang_bytes, sizes, _, *arrays in read:
            rank = np.concatenate([[0], ranks[at : at + len(sizes)]]).astype(np.int32)
            at += len(sizes)
            place = np.array([bisect_left(langs, x.as_py()) for x in _named([lang_sizes], [lang_bytes])], np.int32)
            columns: list[np.ndarray] = []
            for k in range(0, len(arrays) - 1, 2):
                kids, label = arrays[k], arrays[k + 1]
                columns = [np.repeat(c, kids) for c in columns] if k else []
                columns.append((rank if k else place)[label])
            runs.append((columns, arrays[-1]))
        columns = [np.concatenate([r[0][k] for r in runs]) for k in range(len(runs[0][0]))]
        return cls(langs, words, *_merged(columns, np.concatenate([r[1] for r in runs]).astype(np.int64)))

    def nodes(self, least: int) -> Iterator[tuple[list[bytes], list[bytes], int, np.ndarray]]:
        """For each depth languages, phrases, number of words and counts of the nodes that reach `least`, or lie on an edge and may go on elsewhere."""
        fresh = np.zeros(len(self.counts), bool)
        for k, c in enumerate(self.columns):
            fresh[0] = True
            fresh[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(fresh)
            count = np.add.reduceat(self.counts, first)
            told = count >= least
            told[[0, -1]] = True
            if k:
                told &= c[first] > 0
            first, count = first[told], count[told]
            parts = [[self.words[i - 1] for i in x[first].tolist()] for x in self.columns[1 : k + 1]]
            yield [self.langs[i] for i in self.columns[0][first].tolist()], [b" ".join(p) for p in zip(*parts)] if parts else [b""] * len(first), k, count


def _names(names: list[bytes]) -> list[np.ndarray]:
    return [np.array([len(x) for x in names], np.int64), np.frombuffer(b"".join(names), np.uint8)]


def _named(sizes: list[np.ndarray], data: list[np.ndarray]) -> pa.Array:
    """The names in all of the pairs that _names made."""
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data))])


def _put(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers >= 0, each as its length, its width and that many bytes a number."""
    out = []
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
        out.append(np.array([len(a), width], "<u8").tobytes() + a.astype(f"<u{width}").tobytes())
    return b"".join(out)


def _get(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width = np.frombuffer(data, "<u8", 2, at).tolist()
        out.append(np.frombuffer(data, f"<u{width}", n, at + 16))
        at += 16 + n * width
    return out


# --- Spark ----------------------------------------------------------------------------------


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Languages and texts, about SHARD_BYTES at a time.  A longer text is cut where a piece ends."""
    langs, texts, held = [], [], 0
    for batch in batches:
        for lang, text in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "text")), strict=True):
            at = 0
            while at < len(text):
                to = min(len(text), at + SHARD_BYTES)
                if to < len(text):
                    broken = np.flatnonzero(_BREAK[np.frombuffer(text, np.uint8, to - at, at)])
                    if len(broken):
                        to = at + int(broken[-1]) + 1
                    else:
                        rest = np.flatnonzero(_BREAK[np.frombuffer(text, np.uint8, len(text) - to, to)])
                        to = to + int(rest[0]) + 1 if len(rest) else len(text)
                langs.append(lang)
                texts.append(text[at:to])
                held += to - at
                at = to
                if held >= SHARD_BYTES:
                    yield langs, texts
                    langs, texts, held = [], [], 0
    if texts:
        yield langs, texts


def _heads(longest: int):
    """Some of the paths, to choose bounds by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _stretches(batches):
            paths = Paths.of(langs, texts, longest)
            picked = [[w[:_HEAD] for w in paths.path(i)] for i in range(_EVERY // 2, len(paths.counts), _EVERY)]
            del paths  # before the next shard's
            yield pa.RecordBatch.from_arrays([pa.array(picked, pa.list_(pa.binary()))], ["path"])

    return run


def _tries(longest: int, bounds: list[tuple[bytes, ...]]):
    """Each shard's trie, cut at the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _stretches(batches):
            paths = Paths.of(langs, texts, longest)
            places = [0, *[paths.place(b) for b in bounds], len(paths.counts)]
            for part, (lo, hi) in enumerate(zip(places, places[1:])):
                if lo < hi:
                    blob, size = paths.write(lo, hi)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], ["part", "size", "trie"])
            del paths  # before the next shard's

    return run


def _range(least: int):
    def run(table: pa.Table) -> pa.Table:
        paths = Paths.merge(zip(table.column("trie").to_pylist(), table.column("size").to_pylist(), strict=True))
        made = []
        for langs, phrases, words, counts in paths.nodes(least):
            own = [pa.array(langs, pa.binary()).cast(pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(counts), words), pa.int32()), pa.array(counts, pa.int64())]
            made.append(pa.table(own, ["lang", "phrase", "words", "n"]))
        return pa.concat_tables(made)

    return run


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """Exact counts, by language, of every phrase of up to `longest` words that occurs `least` times: lang, phrase, words, n.

    docs: lang, text.  A-Z count as a-z; a phrase lies within a piece, between any of ``.,;:!?`` and line ends; its words are runs without spaces and tabs.  Overlapping
    occurrences all count.  The row with words = 0 has the number of all words of its language.  A null text is empty, a null language
    is `und`; repeated rows count as often as they occur; texts of any length are read whole; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # bounds only say where work goes: paths from 64 kB of text a range, one short path in 256
    share = min(1.0, ranges * 65536 / max(size, 1))
    heads = sorted({tuple(bytes(w) for w in r.path) for r in rows.sample(share, 11).mapInArrow(_heads(longest), "path array<binary>").collect()})
    bounds = sorted({heads[k * len(heads) // ranges] for k in range(1, ranges)}) if heads else []
    tries = rows.mapInArrow(_tries(longest, bounds), "part int, size long, trie binary")
    nodes = tries.groupBy("part").applyInArrow(_range(least), "lang string, phrase string, words int, n long")
    return nodes.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))


def mine(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, salts: int = 32) -> DataFrame:
    """Each language's `top` phrases of 2 to `longest` words by how much more often they occur than their parts would let one think.

    A phrase with count a, cut into parts that occur l and r times in n words, scores floor(1000 a n / (l r)); its lowest cut counts, of equal ones the
    first.  A phrase inside a longer one that occurs as often is left out.  Returns lang, rank, phrase, a, l, r, n, score, by score, then a, then the phrase's bytes.
    Tables and texts are read as frequent_phrases says.
    """
    nodes = cut(frequent_phrases(docs, longest, least))
    roots = nodes.where("words = 0").select("lang", F.col("n").alias("total"))
    if roots.count() <= 1 << 16:
        roots = F.broadcast(roots)
    known = nodes.where("words > 0").select("lang", "phrase", "n")
    split = F.split("phrase", " ")
    cuts = nodes.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = "cast({} as decimal(18, 0))".format
    cuts = cut(cuts.join(roots, "lang").withColumn("score", F.expr(f"(cast(1000 as decimal(4, 0)) * ({exact('a')} * {exact('total')})) div ({exact('l')} * {exact('r')})")))
    best = cuts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.*")
    # counts only fall as a phrase grows, so what covers a phrase shows by one word more
    covered = cuts.where("k = words - 1 and l = a").select("lang", F.col("left").alias("phrase")).union(cuts.where("k = 1 and r = a").select("lang", F.col("right").alias("phrase")))
    kept = best.join(covered.distinct(), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    few = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
