"""Token-ID output with constant-time keyed access.

Format. A store is a folder of shard files and index files with two manifest tables.

* A shard holds raw little-endian ids of many documents, one after the other, then a row
  table (key, whether the key is null, start of the ids), then a trailer of fixed size. Shards
  follow each other in ascending key order, null keys first.
* An index file holds a minimal perfect hash of the keys of one bucket: bit arrays in levels,
  where a key owns the first bit that no other key of its level shares, and the rank of that
  bit is its slot. A slot holds a fingerprint of its key and a run of (shard, row, count)
  entries. Looking a key up reads one bit per level, the fingerprint and the entry; a key that
  is not in the store fails the fingerprint but for one chance in 2^32, and the key in the
  shard's row table settles that.

Files are written by the tasks under names of their own for each attempt; only those that the
manifest, written by Spark's committer, names belong to the store. A lost executor leaves
files that no manifest names.

Defined cases. Null text: no ids but the end id. Null key: stored first, found by `scan`, not
in the index. Repeated keys: all their rows are stored and found; the index holds one entry
for each shard with the key, so a key of any number of rows spreads over shards. Empty table:
a store without shards. Columns besides key and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .common import filesystem
from .tokens import encoder

MAGIC = b"WLTOKEN1"
TRAILER = struct.Struct("<8sIQQI")
#: Text bytes that a task turns into shards.
PART_BYTES = 16 << 20
#: Ids after which a shard is closed; a shard is longer only by its last document.
SHARD_IDS = 8 << 20
#: Keys of one index file.
BUCKET_KEYS = 1 << 16
#: Levels of a hash before the rest is kept as a sorted list.
LEVELS = 48
GAMMA = 2.0


# --- minimal perfect hash ------------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of each key."""
    x = keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Maps n distinct 64-bit keys to the numbers 0 to n - 1."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.ranks, total = [], 0
        for words in bits:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.in_levels = total

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, bits, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            m = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = (mix(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(sizes, bits, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for a key that was not built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(todo):
                return out
            at = (mix(keys[todo], level) % np.uint64(m)).astype(np.int64)
            word = self.bits[level][at >> 6]
            shift = (at & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            rank = self.ranks[level][at >> 6] + below
            out[todo[hit]] = rank[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.searchsorted(self.rest, keys[todo])
            at = np.minimum(at, len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.in_levels + at[hit]
        return out


def index_bytes(keys: np.ndarray, shard: np.ndarray, row: np.ndarray, count: np.ndarray) -> bytes:
    """The index file of one bucket; a key may have several entries."""
    distinct, at = np.unique(keys, return_inverse=True)
    table = PerfectHash.build(distinct)
    slot = table.slots(distinct)
    prints = np.empty(len(distinct), np.uint32)
    prints[slot] = fingerprints(distinct)
    order = np.lexsort((row, shard, slot[at]))
    runs = np.bincount(slot, minlength=len(distinct), weights=None) * 0
    np.add.at(runs, slot[at], 1)
    first = np.concatenate([[0], np.cumsum(runs)]).astype("<u4")
    head = np.array(
        [len(distinct), len(keys), len(table.sizes), len(table.rest), *table.sizes], dtype="<u8"
    )
    parts = [head, *table.bits, table.rest.astype("<i8"), prints.astype("<u4"), first]
    parts += [x[order].astype("<u4") for x in (shard, row, count)]
    return b"".join([struct.pack("<8sQ", MAGIC, len(head)), *[x.tobytes() for x in parts]])


class Index:
    """A loaded index file."""

    def __init__(self, data: bytes):
        magic, n_head = struct.unpack_from("<8sQ", data)
        if magic != MAGIC:
            raise ValueError("not an index file")
        self.data, self.at = data, 16
        n, entries, levels, rest, *sizes = self._take("<u8", n_head).tolist()
        bits = [self._take("<u8", m // 64) for m in sizes]
        self.hash = PerfectHash(sizes, bits, self._take("<i8", rest))
        self.prints, self.first = self._take("<u4", n), self._take("<u4", n + 1)
        self.shard, self.row, self.count = (self._take("<u4", entries) for _ in range(3))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(position in keys, shard, row, count) of every entry of the keys that are found."""
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprints(keys[known])
        which = np.flatnonzero(known)
        lo = self.first[slot[which]].astype(np.int64)
        runs = self.first[slot[which] + 1].astype(np.int64) - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        return np.repeat(which, runs), self.shard[at], self.row[at], self.count[at]


# --- shards --------------------------------------------------------------------------


def shard_bytes(ids: list[bytes], keys: list[int | None], dtype: np.dtype) -> tuple[bytes, int]:
    """A shard file and the number of its ids."""
    payload = b"".join(ids)
    n = np.array([len(x) // dtype.itemsize for x in ids], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(n)]).astype("<u8")
    empty = np.array([k is None for k in keys], dtype=np.uint8)
    named = np.array([0 if k is None else k for k in keys], dtype="<i8")
    tail = TRAILER.pack(MAGIC, dtype.itemsize, len(ids), int(starts[-1]), zlib.crc32(payload))
    return b"".join([payload, named.tobytes(), empty.tobytes(), starts.tobytes(), tail]), int(starts[-1])


class Shard:
    """An open shard: its row table is read at once, ids are read by row."""

    def __init__(self, system: pafs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(TRAILER.size, size - TRAILER.size)
        magic, self.width, n, self.n_ids, self.crc = TRAILER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        base = self.n_ids * self.width
        rows = self.file.read_at(size - TRAILER.size - base, base)
        self.keys = np.frombuffer(rows, "<i8", n)
        self.empty = np.frombuffer(rows, np.uint8, n, 8 * n).astype(bool)
        self.starts = np.frombuffer(rows, "<u8", n + 1, 9 * n).astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids of rows lo to hi - 1."""
        a, b = self.starts[lo] * self.width, self.starts[hi] * self.width
        return np.frombuffer(self.file.read_at(b - a, a), f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


ROW_SCHEMA = "key long, start long, n_tokens long, ids_crc32 long"


@dataclass
class TokenStore:
    """A written store: its folder and the manifests of shards and index files."""

    spark: SparkSession
    folder: str
    shards: DataFrame  # shard, name, base, rows, ids
    indexes: DataFrame  # bucket, index_name
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "TokenStore":
        shards = spark.read.parquet(f"{folder}/shards")
        indexes = spark.read.parquet(f"{folder}/indexes")
        kept = indexes.filter("bucket < 0").first()
        return cls(spark, folder, shards, indexes.filter("bucket >= 0"), int(kept["index_name"]))

    def locate(self, keys: DataFrame, key: str = "key") -> DataFrame:
        """(key, shard, row, count) of the distinct non-null keys that are in the store."""
        folder = self.folder

        def find(group: pd.DataFrame) -> pd.DataFrame:
            system, root = filesystem(folder)
            with system.open_input_file(f"{root}/index/{group['index_name'].iloc[0]}") as file:
                index = Index(file.read())
            asked = group["key"].to_numpy(np.int64)
            which, shard, row, count = index.find(asked)
            return pd.DataFrame(
                {"key": asked[which], "shard": shard.astype(np.int64),
                 "row": row.astype(np.int64), "count": count.astype(np.int64)}
            )

        asked = keys.select(F.col(key).cast("long").alias("key")).filter("key IS NOT NULL").distinct()
        asked = asked.withColumn("bucket", C.salt("key", self.buckets))
        return (
            asked.join(self.indexes, "bucket")
            .groupBy("bucket")
            .applyInPandas(find, "key long, shard long, row long, count long")
        )

    def read(self, keys: DataFrame, key: str = "key", ids: bool = False) -> DataFrame:
        """The stored rows of the given keys, by way of the index: key, start (ids of all rows
        before it in the store), n_tokens, ids_crc32 and, if asked for, the ids."""
        folder = self.folder
        columns = ["key", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

        def fetch(group: pd.DataFrame) -> pd.DataFrame:
            system, root = filesystem(folder)
            shard = Shard(system, f"{root}/data/{group['name'].iloc[0]}")
            base, rows = int(group["base"].iloc[0]), []
            asked = group[["row", "count", "key"]].sort_values("row")
            for lo, count, name in asked.itertuples(index=False):
                if shard.keys[lo] != name or shard.empty[lo]:
                    continue  # the fingerprint of a foreign key agreed
                for r in range(lo, lo + count):
                    got = shard.ids(r, r + 1).astype("<u4")
                    row = [name, base + shard.starts[r], len(got), zlib.crc32(got.tobytes())]
                    rows.append((*row, got.astype(np.int64)) if ids else tuple(row))
            shard.close()
            return pd.DataFrame(rows, columns=columns)

        found = self.locate(keys, key).join(self.shards.select("shard", "name", "base"), "shard")
        return found.groupBy("shard").applyInPandas(
            fetch, ROW_SCHEMA + (", ids array<long>" if ids else "")
        )

    def scan(self, null_keys_only: bool = False) -> DataFrame:
        """All rows, or those with a null key, straight from the shards."""
        folder = self.folder

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = filesystem(folder)
            for batch in batches:
                for name, base in zip(batch["name"].to_pylist(), batch["base"].to_pylist(), strict=True):
                    shard = Shard(system, f"{root}/data/{name}")
                    rows = np.flatnonzero(shard.empty) if null_keys_only else np.arange(len(shard.keys))
                    crc = [zlib.crc32(shard.ids(r, r + 1).astype("<u4").tobytes()) for r in rows.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.keys[rows], pa.int64(), mask=shard.empty[rows]),
                            pa.array(base + shard.starts[rows], pa.int64()),
                            pa.array(np.diff(shard.starts)[rows], pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["key", "start", "n_tokens", "ids_crc32"],
                    )
                    shard.close()

        wanted = self.shards.filter("null_keys > 0") if null_keys_only else self.shards
        return wanted.select("name", "base").mapInArrow(walk, ROW_SCHEMA)


def write_token_store(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text",
    end_id: int = 0, part_bytes: int = PART_BYTES, shard_ids: int = SHARD_IDS,
    bucket_keys: int = BUCKET_KEYS,
) -> TokenStore:
    """Encodes the texts, writes them in ascending key order and builds the index.

    `folder` must be one that all executors share and Arrow can write. One shuffle puts the
    texts in order; the ids are written by the task that makes them.
    """
    spark = docs.sparkSession
    system, root = filesystem(folder)
    for part in ("data", "index"):
        system.create_dir(f"{root}/{part}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        here = TaskContext.get()
        part, attempt = here.partitionId(), here.taskAttemptId()
        system, root = filesystem(folder)
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = made = 0

        def close() -> pa.RecordBatch:
            nonlocal keys, ids, size, made
            name = f"{part:06d}-{made:04d}-{attempt}-{uuid.uuid4().hex[:8]}.ids"
            data, total = shard_bytes(ids, keys, enc.dtype)
            with system.open_output_stream(f"{root}/data/{name}") as file:
                file.write(data)
            row = [[part], [made], [name], [len(keys)], [total], [sum(k is None for k in keys)]]
            made, keys, ids, size = made + 1, [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2]),
                 *[pa.array(x, pa.int64()) for x in row[3:]]],
                names=["part", "seq", "name", "rows", "ids", "null_keys"],
            )

        for batch in batches:
            names = batch[0].to_pylist()
            for at in range(0, len(names), 2048):
                texts = batch[1].slice(at, 2048).to_pylist()
                for k, one in zip(names[at : at + 2048], enc.encode(texts), strict=True):
                    keys.append(k)
                    ids.append(one + end)
                    size += len(one) // enc.dtype.itemsize + 1
                    if size >= shard_ids:
                        yield close()
        if keys:
            yield close()

    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = ["key", F.xxhash64("text"), F.monotonically_increasing_id()]
    n = C.pieces(C.text_bytes(ordered), part_bytes)
    ordered = ordered.select("*", order[1].alias("h"), order[2].alias("at"))
    ordered = ordered.repartitionByRange(n, "key", "h", "at").sortWithinPartitions("key", "h", "at")
    made = ordered.select("key", "text").mapInArrow(
        write, "part int, seq int, name string, rows long, ids long, null_keys long"
    )
    made.write.parquet(f"{folder}/made")
    # One row for each shard from here on, some millions for 100 TB.
    before = Window.orderBy("part", "seq")
    made = spark.read.schema(made.schema).parquet(f"{folder}/made")
    shards = made.select(
        (F.row_number().over(before) - 1).cast("long").alias("shard"),
        "name",
        (F.sum("ids").over(before) - F.col("ids")).alias("base"),
        "rows",
        "ids",
        "null_keys",
    )
    shards.write.parquet(f"{folder}/shards")
    shards = spark.read.schema(shards.schema).parquet(f"{folder}/shards")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        for batch in batches:
            for name, number in zip(batch["name"].to_pylist(), batch["shard"].to_pylist(), strict=True):
                shard = Shard(system, f"{root}/data/{name}")
                first = int(shard.empty.sum())  # null keys lead
                keys, at, count = np.unique(shard.keys[first:], return_index=True, return_counts=True)
                shard.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (keys, np.full(len(keys), number), at + first, count)],
                    names=["key", "shard", "row", "count"],
                )

    total = shards.agg(F.sum("rows")).first()[0] or 0
    buckets = C.pieces(total, bucket_keys)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        name = f"{bucket:06d}-{uuid.uuid4().hex}.mph"
        data = index_bytes(*(group[c].to_numpy(np.int64) for c in ("key", "shard", "row", "count")))
        system, root = filesystem(folder)
        with system.open_output_stream(f"{root}/index/{name}") as file:
            file.write(data)
        return pd.DataFrame({"bucket": [bucket], "index_name": [name]})

    indexes = (
        shards.select("name", "shard")
        .repartition(C.pieces(shards.count(), 4), "shard")
        .mapInArrow(entries, "key long, shard long, row long, count long")
        .withColumn("bucket", C.salt("key", buckets))
        .groupBy("bucket")
        .applyInPandas(build, "bucket long, index_name string")
    )
    kept = spark.range(1).select(F.lit(-1).cast("long").alias("bucket"), F.lit(str(buckets)).alias("index_name"))
    indexes.unionByName(kept).write.parquet(f"{folder}/indexes")
    return TokenStore.open(spark, folder)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes `documents` as a token store in the work folder and reads every document back by
    its key: doc_id, start, n_tokens, ids_crc32."""
    from .tokens import default_tokenizer

    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    store = write_token_store(docs, C.Stage(spark, "token-store").folder, default_tokenizer())
    rows = store.read(docs, "doc_id").unionByName(store.scan(null_keys_only=True))
    return rows.withColumnRenamed("key", "doc_id")
