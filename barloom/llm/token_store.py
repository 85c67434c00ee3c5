"""Token-ID store: raw id payloads in shards, reached by a minimal perfect hash index.

Layout under one folder, all little-endian:

* ``shard-K.ids``    token ids, uint16 if the vocabulary allows and else uint32, of consecutive documents (ascending doc_id), each closed by the end id
* ``index-P.mph``    for the keys whose hash falls in index part P: the hash's bit levels, then by slot
  a stored fingerprint (uint32), shard (uint32), first id in the shard (uint64), number of ids (uint64)

A key is a doc_id with its occurrence: 0, or 1, 2, .. for further rows that repeat the doc_id.

A key is found in constant time: its part, its bit in the first level that holds it, the rank of
that bit (its slot), the fingerprint there.  Levels are built as in BBHash: at each level keys that
collide go on to the next.  Both kinds of file are written under a name of the task attempt's own
and renamed, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoder import Encoder
from .shared import partitions
from .words import U64, mix, slices

_NULL_KEY = -(2**63)
_GAMMA = 2.0
_SLOT = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("ids", "<u8")])


def _write(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(own, f"{path}/{name}")


def _read(folder: str, name: str) -> pa.NativeFile:
    files, path = fs.FileSystem.from_uri(folder)
    return files.open_input_file(f"{path}/{name}")


# --- minimal perfect hash -------------------------------------------------------------------


def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Each key's bit at a level."""
    with np.errstate(over="ignore"):
        h = mix(keys + U64(level + 1) * U64(0x9E3779B97F4A7C15))
    return (h % U64(bits)).astype(np.int64)


class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own slot in 0..n-1; other keys to any slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(x)[:-1]]) for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], np.unique(keys)
        while len(rest):
            bits = max(64, int(_GAMMA * len(rest)))
            at = _spot(rest, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            at = _spot(keys[open_], k, len(level))
            hit = level[at]
            out[open_[hit]] = self.before[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *[len(x) for x in self.levels]], "<u8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, blob: bytes) -> tuple[PerfectHash, int]:
        """The hash, and the bytes it took."""
        n = int(np.frombuffer(blob, "<u8", 1)[0])
        sizes = np.frombuffer(blob, "<u8", n, 8).astype(int)
        at, levels = 8 * (n + 1), []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        return cls(levels), at


def _key_hash(doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.view(U64)) + occurrence.astype(np.int64).view(U64) * U64(0x2545F4914F6CDD1D))


def _mark(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32)


# --- writing --------------------------------------------------------------------------------


def _shards(folder: str, tokenizer: str, end_id: int):
    """Encode one task's documents, write its shard, and return where each lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = Encoder.shared(tokenizer)
        end = encoder.pack([end_id])
        places: list[pa.RecordBatch] = []

        def payload() -> Iterator[bytes]:
            first, last, times = 0, None, 0
            for batch in batches:
                for part in slices(batch, "text"):
                    blobs = [x + end for x in encoder.encode(part.column("text").to_pylist())]
                    n = np.array([len(x) // encoder.width for x in blobs], np.int64)
                    at = first + np.concatenate([[0], np.cumsum(n)[:-1]])
                    first += int(n.sum())
                    nth = []
                    for doc_id in part.column("doc_id").to_pylist():
                        times = times + 1 if (nth or places) and doc_id == last else 0
                        last = doc_id
                        nth.append(times)
                    places.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(n), shard), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(nth, pa.int64())], ["doc_id", "shard", "first", "n_tokens", "nth"]))
                    yield b"".join(blobs)

        _write(folder, f"shard-{shard}.ids", payload())
        encoder.forget()
        yield from places

    return run


def _index(folder: str):
    """Write the perfect hash index of one part; returns its part and number of keys."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        key, nth, shard, first, ids = (table.column(c).to_numpy() for c in ("key", "nth", "shard", "first", "n_tokens"))
        hashes = _key_hash(key, nth)
        mph = PerfectHash.build(hashes)
        at = mph.slots(hashes)
        slots = np.zeros(int(mph.before[-1]), _SLOT)
        for name, value in (("mark", _mark(hashes)), ("shard", shard), ("first", first), ("ids", ids)):
            slots[name][at] = value
        _write(folder, f"index-{part}.mph", iter([mph.pack(), slots.tobytes()]))
        return pa.table({"part": pa.array([part], pa.int32()), "keys": pa.array([len(slots)], pa.int64())})

    return run


class TokenStore:
    """A folder of shards and index parts, with its small manifest."""

    def __init__(self, spark: SparkSession, folder: str, places: DataFrame, starts: DataFrame, parts: int, width: int):
        self.spark, self.folder, self.places, self.starts, self.parts, self.width = spark, folder, places, starts, parts, width

    @classmethod
    def write(cls, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> TokenStore:
        """Encode every text of docs (doc_id, text) and write it in ascending doc_id order.

        A null or empty text is the end id alone.  A null doc_id sorts first and is kept under the
        doc_id -2**63; rows that repeat a doc_id lie one after the other, in a fixed order.
        Other columns are ignored.  An empty table makes a store without documents.
        """
        spark = docs.sparkSession
        n = shards or partitions(spark)
        # texts under a repeated doc_id may go to different shards, so one id can't fill a task
        ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
        made = ordered.mapInArrow(_shards(folder, tokenizer, end_id), "doc_id long, shard int, first long, n_tokens long, nth long")
        made.write.mode("overwrite").parquet(f"{folder}/places")
        places = spark.read.schema(made.schema).parquet(f"{folder}/places")
        key = F.coalesce("doc_id", F.lit(_NULL_KEY))
        # occurrences count on over shards; a shard adds one row for each doc_id that is repeated
        again = places.groupBy(key.alias("key"), "shard").agg(F.count(F.lit(1)).alias("k"))
        again = again.withColumn("base", F.sum("k").over(Window.partitionBy("key").orderBy("shard")) - F.col("k")).where("base > 0").select("key", "shard", "base")
        keyed = places.withColumn("key", key).join(again, ["key", "shard"], "left").select("key", (F.col("nth") + F.coalesce("base", F.lit(0))).alias("nth"), "shard", "first", "n_tokens")
        keyed = keyed.withColumn("part", F.pmod(F.xxhash64("key", "nth"), F.lit(n)).cast("int"))
        # the index files are what this makes; their numbers of keys are summed only to run it
        keyed.groupBy("part").applyInArrow(_index(folder), "part int, keys long").agg(F.sum("keys")).collect()
        # one row a shard
        sums = places.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
        at, starts = 0, []
        for row in sums:
            starts.append((row.shard, at))
            at += row.n
        return cls(spark, folder, places, spark.createDataFrame(starts, "shard int, base long"), n, Encoder.shared(tokenizer).width)

    def fetch(self, keys: DataFrame) -> DataFrame:
        """The stored documents of keys (doc_id), found by the index alone.

        keys has one row for each row wanted: a doc_id listed k times brings its first k occurrences.
        Returns doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, first.  A
        key that is not stored gives no row, unless its 32-bit fingerprint agrees by chance.
        """
        folder = self.folder
        step = 1 << 16
        wanted = keys.select(F.coalesce("doc_id", F.lit(_NULL_KEY)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("k"))
        wanted = wanted.select("key", "k", F.explode(F.sequence(F.lit(0), F.expr(f"(k - 1) div {step}"))).alias("run"))
        wanted = wanted.select("key", F.explode(F.expr(f"sequence(run * {step}, least((run + 1) * {step}, k) - 1)")).alias("nth"))
        wanted = wanted.withColumn("part", F.pmod(F.xxhash64("key", "nth"), F.lit(self.parts)).cast("int"))
        hits = wanted.groupBy("part").applyInArrow(_lookup(folder), "key long, shard int, first long, n_tokens long")
        read = hits.repartition(partitions(self.spark), "shard", (F.col("first") / F.lit(1 << 22)).cast("long")).sortWithinPartitions("shard", "first")
        sized = read.mapInArrow(_payloads(folder, self.width), "key long, shard int, first long, n_tokens long, ids_crc32 long")
        found = sized.join(F.broadcast(self.starts), "shard")
        return found.select(F.when(F.col("key") != _NULL_KEY, F.col("key")).alias("doc_id"), (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "shard", "first")


def _lookup(folder: str):
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        part = table.column("part")[0].as_py()
        files, path = fs.FileSystem.from_uri(folder)
        if files.get_file_info(f"{path}/index-{part}.mph").type == fs.FileType.NotFound:
            keys = keys[:0]
            slots = np.zeros(0, _SLOT)
        else:
            with _read(folder, f"index-{part}.mph") as file:
                blob = file.read()
            mph, used = PerfectHash.unpack(blob)
            table_ = np.frombuffer(blob, _SLOT, offset=used)
            hashes = _key_hash(keys, table.column("nth").to_numpy())
            at = mph.slots(hashes)
            good = (at >= 0) & (table_["mark"][np.maximum(at, 0)] == _mark(hashes))
            keys, slots = keys[good], table_[at[good]]
        return pa.table({"key": pa.array(keys, pa.int64()), "shard": pa.array(slots["shard"].astype(np.int32)), "first": pa.array(slots["first"].astype(np.int64)), "n_tokens": pa.array(slots["ids"].astype(np.int64))})

    return run


def _payloads(folder: str, width: int):
    """Read each hit's ids from its shard; checksums are of the ids as uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file = None, None
        for batch in batches:
            sums = []
            for k, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "n_tokens")), strict=True):
                if k != shard:
                    if file:
                        file.close()
                    shard, file = k, _read(folder, f"shard-{k}.ids")
                crc = 0
                file.seek(width * first)
                left = width * n
                while left:
                    got = file.read(min(left, 1 << 24))
                    if not got:
                        raise OSError(f"shard {k} ends early")
                    left -= len(got)
                    crc = zlib.crc32(np.frombuffer(got, f"<u{width}").astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "shard", "first", "n_tokens")), pa.array(sums, pa.int64())], ["key", "shard", "first", "n_tokens", "ids_crc32"])
        if file:
            file.close()

    return run
