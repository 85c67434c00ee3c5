"""N-gram Jaccard join with parity sketches.

Rows with the same shingle set become one set first.  A set's shingles are dealt by hash into the
`m` pieces of a wide bit sketch; each shingle flips one bit of its piece, so the Hamming distance of
two sketches, and the number of pieces that differ, never exceed the symmetric difference D of the
sets.  A piece is kept folded, as the XOR of codes of its set bits.

Sets of n and n' <= n shingles with similarity t or more have D <= (n + n') (1-t)/(1+t).  Sizes fall
into bands that double; a set joins in its own band and, if a smaller partner may lie there, in the
one below, where both have the same `m`.  Of the q non-empty pieces of a set, at least q - D are
equal to those of any partner (pigeonhole).  The first band has a piece for each shingle, of which a
set of n shares n t or more with any partner; so has any band in which some set's q does not exceed its D.  With
`need` for what must be shared:

1. pieces that only one set has are dropped; a set with fewer than `need` others has no partner;
2. of its c others it need only join on the c - need + 1 rarest;
3. what is joined that way, directly or through others, forms a block, which holds all links of its sets;
4. in a block, sets are compared exactly (shared shingles by sparse counting).  A block of more
   than `_CELL` sets is split, and each pair of its parts is a task of its own, so no task holds a whole group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .hot import join_groups
from .shared import cut, partitions
from .words import U64, mix, shingle_sets, slices

_FIRST_BAND = 96
_CELL = 512
_PIECES_PER_SIZE = 0.36
_CODE, _PLACE = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def _signature(shingles: np.ndarray) -> int:
    """One 64-bit value for a set; the sum of scrambled shingles, scrambled with the size."""
    return int(mix(np.array([mix(shingles ^ _PLACE).sum(dtype=U64) + U64(len(shingles))], U64)).view(np.int64)[0])


def _bands(n: int, share: float) -> list[int]:
    """The set's own band, and the one below if a partner of at least share * n may lie there."""
    def band(size: float) -> int:
        return 0 if size < _FIRST_BAND else 1 + int(np.log2(size / _FIRST_BAND))

    own, low = band(n), band(np.ceil(n * share))
    return list(range(low, own + 1))


def _plain(shingles: np.ndarray, band: int, share: float) -> tuple[np.ndarray, int]:
    """A piece for each shingle of a set in a band, and how many of them a partner shares at least."""
    return mix(mix(shingles ^ _CODE) ^ U64(band)), max(1, int(np.ceil(len(shingles) * share - 1e-9)))


def _pieces(shingles: np.ndarray, band: int, share: float, per_size: float) -> tuple[np.ndarray, int]:
    """The non-empty folded pieces of a set in a band, and how many of them a partner shares at least; below 1 they promise nothing."""
    if not band:
        return _plain(shingles, band, share)
    n, top = len(shingles), _FIRST_BAND << band
    most = int((n + (n / share if n < top else top - 1)) * (1 - share) / (1 + share) + 1e-9)
    m = max(1, int(per_size * top))
    piece = ((shingles >> U64(32)) * U64(m)) >> U64(32)
    bit = mix(shingles ^ _CODE) & U64(0xFFFF)
    flips = piece * U64(0x10000) + bit
    order = np.argsort(flips)
    flips = flips[order]
    new = np.concatenate([[True], flips[1:] != flips[:-1]])
    times = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
    on = flips[new][times % 2 == 1]  # a bit flipped twice is off again
    if not len(on):
        return np.zeros(0, U64), -most
    at = on >> U64(16)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    folded = np.bitwise_xor.reduceat(mix(on * _CODE + U64(band)), starts)
    return mix(folded ^ (at[starts] << U64(8)) ^ U64(band)), len(folded) - most


def _describe(width: int, share: float, per_size: float, more: list[str]):
    """doc_id, n_shingles and sig of each row, and a bit for each band in which its folded pieces promise nothing."""
    def weak(s: np.ndarray) -> int:
        return sum(1 << band for band in _bands(len(s), share) if band and _pieces(s, band, share, per_size)[1] < 1) if len(s) else 0

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                found = [[len(s) for s in sets], [_signature(s) for s in sets], [weak(s) for s in sets]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in found), *(part.column(c) for c in more)], ["doc_id", "n_shingles", "sig", "weak", *more])

    return run


def _send(width: int, share: float, per_size: float, weak: int, parts: int):
    """Each piece of each distinct set of a slice, packed by hash range: (part, head, pieces); bands with a bit in `weak` have a piece for each shingle."""
    def run(batches):
        for batch in batches:
            for rows in slices(batch, "text"):
                sets = {_signature(s): s for s in shingle_sets(rows.column("text"), width) if len(s)}
                sigs, need, size, keys = [], [], [], []
                for sig, s in sets.items():
                    for band in _bands(len(s), share):
                        got, shared = _plain(s, band, share) if weak >> band & 1 else _pieces(s, band, share, per_size)
                        sigs.append(sig)
                        size.append(band)
                        need.append(shared)
                        keys.append(got)
                if not keys:
                    continue
                owner = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
                every = np.concatenate(keys)
                part = (((every >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p in np.flatnonzero(np.diff(cuts)):
                    mine = order[cuts[p] : cuts[p + 1]]
                    who, count = np.unique(owner[mine], return_counts=True)
                    head = np.stack([np.array(sigs, np.int64)[who], np.array(need, np.int64)[who], np.array(size, np.int64)[who], count])
                    out.append((int(p), head.tobytes(), every[mine].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["part", "head", "pieces"])

    return run


def _shared_pieces(table: pa.Table) -> pa.Table:
    """(sig, band, need, piece, n_sets) of the pieces in one hash range that two sets or more have."""
    heads = [np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for x in table.column("head")]
    piece = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in table.column("pieces")])
    head = np.concatenate(heads, axis=1)
    owner = np.repeat(np.arange(head.shape[1]), head[3])
    order = np.lexsort((head[0][owner], piece))
    piece, owner = piece[order], owner[order]
    sig = head[0][owner]
    new_piece = np.concatenate([[True], piece[1:] != piece[:-1]])
    fresh = new_piece | np.concatenate([[True], sig[1:] != sig[:-1]])  # the same set may come from several slices
    piece, owner, sig, new_piece = piece[fresh], owner[fresh], sig[fresh], new_piece[fresh]
    starts = np.flatnonzero(new_piece)
    n = np.repeat(np.diff(np.concatenate([starts, [len(piece)]])), np.diff(np.concatenate([starts, [len(piece)]])))
    keep = n > 1
    return pa.table({"sig": sig[keep], "band": pa.array(head[2][owner[keep]], pa.int32()), "need": pa.array(head[1][owner[keep]], pa.int32()), "piece": piece[keep].view(np.int64), "n_sets": pa.array(n[keep], pa.int64())})


def _compare(share: float):
    """Links inside one bundle of cells: ('link', a, b) spanning what is linked, and each set's number of linked rows."""
    tenths = round(share * 1000)

    def links(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
        k = len(sets)
        size = np.array([len(s) for s in sets], np.int64)
        who = np.repeat(np.arange(k), size)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, who = every[order], who[order]
        cuts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]]))
        many = np.diff(cuts)
        both = np.zeros((k, k), np.float32)
        wide = np.flatnonzero(many > 1)
        for at in range(0, len(wide), 4096):
            some = wide[at : at + 4096]
            column = np.repeat(np.arange(len(some)), many[some])
            rows = np.concatenate([who[cuts[c] : cuts[c + 1]] for c in some])
            has = np.zeros((k, len(some)), np.float32)
            has[rows, column] = 1
            both += has @ has.T
        both = np.rint(both).astype(np.int64)
        linked = 1000 * both >= tenths * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(linked, False)
        if side.any():  # two different parts of a block: links inside each are found elsewhere
            linked &= side[:, None] != side[None, :]
        return linked

    def run(table: pa.Table) -> pa.Table:
        cell = np.stack([table.column(c).to_numpy() for c in ("block", "i", "j")])
        order = np.lexsort(cell[::-1])
        sig, copies, part = (table.column(c).to_numpy() for c in ("sig", "copies", "part"))
        blobs = table.column("shingles").combine_chunks()
        left, right, count = [], [], []
        same = np.all(cell[:, order[1:]] == cell[:, order[:-1]], axis=0)
        for rows in np.split(order, np.flatnonzero(~same) + 1):
            rows = rows[np.unique(sig[rows], return_index=True)[1]]  # rows that repeat a doc_id bring a set twice
            if len(rows) < 2:
                continue
            side = (part[rows] == cell[2][rows]) & (cell[1][rows] != cell[2][rows])
            linked = links([np.frombuffer(blobs[int(r)].as_buffer(), U64) for r in rows], side)
            weight = linked @ copies[rows]
            for x in np.flatnonzero(weight):
                left.append(sig[rows[x]])
                right.append(sig[rows[x]])
                count.append(weight[x])
            open_ = linked.any(axis=1)
            while open_.any():
                seed = int(np.argmax(open_))
                reached, edge = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
                edge[seed] = reached[seed] = True
                while edge.any():
                    edge = linked[edge].any(axis=0) & ~reached
                    reached |= edge
                open_ &= ~reached
                for x in np.flatnonzero(reached):
                    if x != seed:
                        left.append(sig[rows[seed]])
                        right.append(sig[rows[x]])
                        count.append(0)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64()), "n_links": pa.array(count, pa.int64())})

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("sig", "copies", "block", "part", "parts")), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "copies", "block", "part", "parts", "shingles"])
                # another text under the same doc_id is not this set
                yield out.filter(pc.equal(pa.array([_signature(s) for s in sets], pa.int64()), part.column("sig")))

    return run


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, pieces_per_size: float = _PIECES_PER_SIZE, detail: bool = False) -> DataFrame:
    """Join rows whose sets of distinct `width`-word shingles have a Jaccard similarity of `similarity` or more.

    One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id that
    links reach, itself included), n_links (rows linked directly).  A-Z is lowered; a text with
    fewer words than `width` is one shingle; a null text or one without words has an empty set and
    links with nothing.  Rows with equal sets link.  Rows that repeat a doc_id are told apart; a null
    doc_id counts as larger than any other, and is the component_id only of a group that has no other.  Whole texts are
    read, of any length; an empty table gives no rows.  Other columns are ignored.

    `similarity` counts to three decimals.  With `detail`, two more columns: text_hash (xxhash64 of the text, to tell rows that repeat a
    doc_id) and group_id (the same for linked rows, another for each group; null for an empty set).
    """
    share = round(similarity * 1000) / 1000
    n = partitions(docs.sparkSession, docs)
    texts = docs.select("doc_id", "text")
    more = ["text_hash"] if detail else []
    described = texts.withColumn("text_hash", F.xxhash64("text")) if detail else texts
    kinds = "".join(f", {c} long" for c in more)
    rows = cut(described.mapInArrow(_describe(width, share, pieces_per_size, more), f"doc_id long, n_shingles long, sig long, weak long{kinds}"))
    weak = rows.agg(F.bit_or("weak")).first()[0] or 0  # one number: sizes have under 64 bands
    classes = rows.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))

    sent = texts.mapInArrow(_send(width, share, pieces_per_size, weak, n), "part int, head binary, pieces binary")
    shared = sent.groupBy("part").applyInArrow(_shared_pieces, "sig long, band int, need int, piece long, n_sets long")
    own = Window.partitionBy("sig", "band")
    ranked = shared.select("*", F.count(F.lit(1)).over(own).alias("c"), F.row_number().over(own.orderBy("n_sets", "piece")).alias("at"))
    joined = cut(ranked.where("at <= c - need + 1").select("sig", "piece"))
    least = joined.groupBy("piece").agg(F.min("sig").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = cut(components(joined.join(least, "piece").select(F.col("sig").alias("a"), "b").distinct()))

    sizes = blocks.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(_CELL)).cast("int").alias("parts"))
    members = blocks.join(sizes, "component").select(F.col("node").alias("sig"), F.col("component").alias("block"), "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    chosen = members.join(classes.select("sig", "copies", "rep"), "sig")
    # one row of each set brings its text: the class's smallest doc_id (or rows that repeat it, of which one stays)
    named = rows.select("doc_id", "sig").join(chosen, "sig").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "sig", "copies", "block", "part", "parts").distinct()
    found = texts.join(named, texts.doc_id.eqNullSafe(named.doc_id)).select(texts.text, "sig", "copies", "block", "part", "parts")
    sets = found.mapInArrow(_sets(width), "sig long, copies long, block long, part int, parts int, shingles binary")
    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("sig", "copies", "block", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "shingles")
    cells = cells.withColumn("bundle", F.pmod(F.xxhash64("block", "i", "j"), F.lit(4 * n)))
    links = cut(cells.groupBy("bundle").applyInArrow(_compare(share), "a long, b long, n_links long"))

    linked = components(links.where("a <> b").select("a", "b"))
    counts = links.where("a = b").groupBy(F.col("a").alias("sig")).agg(F.sum("n_links").alias("n_links"))
    named = classes.join(linked.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    firsts = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    verdict = named.join(firsts, "component").join(counts, "sig", "left").select("sig", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", *([F.col("component").alias("group_id")] if detail else []))
    alone = F.col("n_shingles") == 0
    columns = ["doc_id", "n_shingles", "component_id", "n_links", *more, *(["group_id"] if detail else [])]
    nothing = F.lit(None).cast("long")
    empty = rows.where(alone).withColumns({"component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"), **({"group_id": nothing} if detail else {})})
    return _by_sig(rows.where(~alone), verdict).select(*columns).unionByName(empty.select(*columns))


def _by_sig(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """Each row with its set's verdict."""
    return join_groups(rows, cut(verdict), ["sig"], "copies", rows.count(), F.col("doc_id"), F.lit(48))
