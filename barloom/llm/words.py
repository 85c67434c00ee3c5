"""Words, shingles and their 64-bit hashes for a whole Arrow column at once.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; all of those bytes are ASCII, so
UTF-8 never needs decoding.  Hashes are polynomial over a random byte table, modulo 2**64, and
then scrambled; two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=U64)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_BASE, _ROLL, _GRAM = (U64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5))
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept, and grown when a longer run comes."""
    got = _POWERS.get(base)
    if got is None or len(got) <= n:
        got = np.full(max(n + 1, _CHUNK + 4096), base, U64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _POWERS[base] = got
    return got


def _window_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: U64) -> np.ndarray:
    """Polynomial hash of values[s:e] for each pair, from one prefix sum."""
    if not len(values):
        return np.zeros(len(starts), U64)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers(int(base), len(values))[: len(values)], out=total[1:])
    inverse = pow(int(base), -1, 1 << 64)
    return (total[ends] - total[starts]) * _powers(inverse, len(values))[starts]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """The hash of raw[s:e] for each pair."""
    return mix(_window_hash((_FOLDED if lower else _BYTES)[raw], starts, ends, _BASE))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each row's bounds in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_bounds(raw: np.ndarray, bounds: np.ndarray, gap: np.ndarray = _SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, word starts, word ends) over pieces of about 1 MB that end where no word goes on; gap: the bytes between words."""
    breaks = bounds[:-1][np.diff(bounds) > 0]
    at = 0
    while at < len(raw):
        to = min(len(raw), at + _CHUNK)
        while to < len(raw) and not gap[raw[to]]:
            nxt = breaks[np.searchsorted(breaks, to)] if len(breaks) and breaks[-1] >= to else len(raw)
            spaces = np.flatnonzero(gap[raw[to : min(nxt, to + 4096)]])
            if len(spaces):
                to += int(spaces[0])
                break
            to = int(min(nxt, to + 4096))
            if to == nxt:
                break
        solid = ~gap[raw[at:to]]
        fresh = np.ones(to - at, bool)
        fresh[1:] = ~solid[:-1]
        lo, hi = np.searchsorted(breaks, [at, to])
        fresh[breaks[lo:hi] - at] = True
        starts = np.flatnonzero(solid & fresh)
        last = np.ones(to - at, bool)
        last[:-1] = ~solid[1:] | fresh[1:]
        yield at, to, starts, np.flatnonzero(solid & last) + 1
        at = to


def hash_words(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and each row's bounds among them.  lower: A-Z count as a-z."""
    raw, bounds = text_bytes(column)
    hashes, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for at, to, starts, ends in word_bounds(raw, bounds):
        hashes.append(hash_spans(raw[at:to], starts, ends, lower))
        places.append(starts + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of each run of `width` words inside one row, and the word it starts at."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    starts = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return mix(_window_hash(hashes, starts, starts + width, _ROLL)), starts


def checks(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """32 further bits of each window's hash, from another polynomial: with windows(), 96 bits tell windows apart."""
    return (mix(_window_hash(mix(hashes ^ _GRAM), starts, starts + width, _BASE)) >> U64(32)).astype(np.uint32)


def pack(ascending: np.ndarray) -> bytes:
    """64-bit values in ascending order as their differences: how many bytes one takes, then so many bytes each."""
    steps = np.diff(ascending, prepend=U64(0)).astype("<u8")
    # the first value is a step of its own, and may be as long as a hash: it goes ahead, whole
    rest = steps[1:]
    width = max(1, -(-int(rest.max()).bit_length() // 8)) if len(rest) else 1
    return bytes([width]) + steps[:1].tobytes() + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    width, first = int(raw[0]), raw[1:9].copy().view("<u8")
    rest = raw[9:].reshape(-1, width)
    steps = np.zeros((len(rest), 8), np.uint8)
    steps[:, :width] = rest
    return np.cumsum(np.concatenate([first, steps.view("<u8").ravel()]), dtype=U64)


def sort_pairs(hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal (hash, check) pairs stand together, and whether a pair differs from the one before it."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], check[order]
    same = h[1:] == h[:-1]
    if (same & (c[1:] != c[:-1])).any():  # hashes that collide: put their checks in order too
        order = np.lexsort((check, hashes))
        h, c = hashes[order], check[order]
        same = h[1:] == h[:-1]
    return order, np.concatenate([[True], ~same | (c[1:] != c[:-1])])[: len(hashes)]


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per row, A-Z lowered; a row with 1 to width-1 words has one shingle."""
    hashes, bounds = hash_words(column, lower=True)
    grams, starts = windows(hashes * _GRAM + U64(1), bounds, width)
    cuts = np.searchsorted(starts, bounds)
    out = []
    for i in range(len(bounds) - 1):
        n = bounds[i + 1] - bounds[i]
        if n >= width:
            out.append(np.unique(grams[cuts[i] : cuts[i + 1]]))
        elif n:
            own = hashes[bounds[i] : bounds[i + 1]]
            out.append(mix(_window_hash(own + U64(n), np.array([0]), np.array([n]), _ROLL) ^ U64(n)))
        else:
            out.append(np.zeros(0, U64))
    return out


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to
