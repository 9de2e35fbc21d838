"""Packing documents into token sequences by minimum bin slack.

Every document gives floor(n / capacity) full sequences of its own and one remainder. Only the
remainders need fitting, and for them only their lengths matter: a histogram of at most
capacity - 1 counts, whatever the corpus holds. Windows are planned on that histogram. The
longest remaining length opens a window; a bitset subset-sum dynamic program over the other
lengths, bounded by their counts, finds the sum closest to capacity, and the counts of each
length are backtracked. The multiset found is used as often as the counts allow, so the plan
stays short for any number of documents.

Documents then find their place by arithmetic: a rank among equal remainders picks window,
instance and position. Ranks come from salted groups of a bounded size, so one length that a
third of all documents share is many groups.

Windows whose best sum is below capacity are not padded. They follow each other in a stream
that is cut at the capacity, one document for each sequence at most, and the end of the stream
is cut into sequences whose lengths are powers of two, which need no padding.

Defined cases. Null text: an empty text, one end id. Repeated rows: each is packed. Null key:
packed like any other. Empty table: no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import default_tokenizer, encoder

CAPACITY = 1024
#: Rows of a salted group, and most groups before they grow with the table.
GROUP_ROWS, GROUPS = 256, 1 << 20


@dataclass(frozen=True)
class Pattern:
    """A window: (length, count) from the longest on, used `instances` times."""

    items: tuple[tuple[int, int], ...]
    instances: int

    @property
    def total(self) -> int:
        return sum(length * n for length, n in self.items)


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within `counts`, whose sum is closest to `room` from below."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        most = min(counts[length], room // length)
        if not most:
            continue
        steps.append((length, most, reach))
        part, left = 1, most
        while left:
            part = min(part, left)
            reach |= (reach << part * length) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Windows that use up all remainders."""
    left = {length: n for length, n in counts.items() if n and 0 < length <= capacity}
    plan = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = closest_multiset({x: n for x, n in rest.items() if n}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        plan.append(Pattern(tuple(sorted(used.items(), reverse=True)), times))
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return plan


class Placement:
    """Where the remainder of a length and a rank goes.

    Full windows are sequences. The others follow each other in one stream that is cut at the
    capacity, and its end at powers of two.
    """

    def __init__(self, plan: list[Pattern], capacity: int):
        self.capacity = capacity
        self.full = sum(p.instances for p in plan if p.total == capacity)
        self.stream = sum(p.instances * p.total for p in plan if p.total < capacity)
        whole, rest = divmod(self.stream, capacity)
        #: First position of each sequence of the stream's end, and the end itself.
        self.ends = [whole * capacity]
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.ends.append(self.ends[-1] + (1 << bit))
        self.sequences = self.full + whole + len(self.ends) - 1
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        table: dict[int, list[tuple[int, ...]]] = {}
        taken: dict[int, int] = {}
        at_full, at_stream = 0, self.full * capacity
        for p in plan:
            base, at = (at_full, 0) if p.total == capacity else (at_stream, 0)
            for length, n in p.items:
                first = taken.get(length, 0)
                table.setdefault(length, []).append((first, n, p.total, base + at))
                taken[length] = first + n * p.instances
                at += n * length
            if p.total == capacity:
                at_full += p.instances * p.total
            else:
                at_stream += p.instances * p.total
        for length, rows in table.items():
            self.by_length[length] = tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of each piece."""
        firsts, counts, totals, bases = self.by_length[length]
        i = int(np.searchsorted(firsts, rank, side="right")) - 1
        instance, slot = divmod(rank - int(firsts[i]), int(counts[i]))
        lo = int(bases[i]) + instance * int(totals[i]) + slot * length
        end, out, tail = lo + length, [], self.full * self.capacity
        at = lo
        while at < end:
            in_stream = at - tail
            if in_stream < self.ends[0]:
                sequence = at // self.capacity
                a, b = sequence * self.capacity, (sequence + 1) * self.capacity
            else:
                k = int(np.searchsorted(self.ends, in_stream, side="right")) - 1
                sequence = self.full + self.ends[0] // self.capacity + k
                a, b = tail + self.ends[k], tail + self.ends[k + 1]
            out.append((at - lo, min(b, end) - at, sequence, at - a))
            at = min(b, end)
        return out


def tokenise(docs: DataFrame, tokenizer: str, key: str, text: str, end_id: int) -> DataFrame:
    """key, n (ids with the end id) and ids (little-endian bytes, 2 each below 65,536 ids)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = [x + end for x in enc.encode(part[1].to_pylist())]
                n = [len(x) // enc.dtype.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part[0].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["key", "n", "ids"],
                )

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        encode, "key long, n long, ids binary"
    )


PIECE_SCHEMA = (
    "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
    capacity: int = CAPACITY, ids: bool = False, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row for each piece of each document: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, if asked for, the ids as little-endian bytes."""
    stage = C.Stage(docs.sparkSession, "packing")
    path = stage.path("ids")
    made = tokenise(docs, tokenizer, key, text, end_id)
    made.write.option("compression", "zstd").parquet(path)
    made = docs.sparkSession.read.schema(made.schema).parquet(path)
    made = made.withColumns({"rest": F.col("n") % capacity, "full": F.floor(F.col("n") / capacity)})

    histogram = made.groupBy("rest").agg(F.count("*").alias("rows"), F.sum("full").alias("full"))
    histogram = {r["rest"]: (r["rows"], r["full"]) for r in histogram.collect()}  # <= capacity rows
    total = sum(n for n, _ in histogram.values())
    placement = Placement(
        plan_windows({x: n for x, (n, _) in histogram.items() if x}, capacity), capacity
    )
    bases, at = {}, placement.sequences
    for x, (_, full) in sorted(histogram.items()):
        bases[x] = at
        at += full

    each = max(group_rows, -(-total // GROUPS))
    salts = F.array(*[F.lit(C.pieces(histogram.get(x, (1, 0))[0], each)) for x in range(capacity)])
    mark = F.struct("key", F.xxhash64("ids"))
    made = made.withColumn("salt", C.salt(mark, F.element_at(salts, F.col("rest").cast("int") + 1)))
    groups = made.groupBy("rest", "salt").agg(F.count("*").alias("rows"), F.sum("full").alias("fulls"))
    ahead = Window.partitionBy("rest").orderBy("salt")
    groups = groups.select(
        "rest", "salt",
        (F.sum("rows").over(ahead) - F.col("rows")).alias("rows_before"),
        (F.sum("fulls").over(ahead) - F.col("fulls")).alias("fulls_before"),
    )
    within = Window.partitionBy("rest", "salt").orderBy("key", F.xxhash64("ids"))
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = made.join(groups, ["rest", "salt"]).select(
        "key", "n", "ids",
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("rank"),
        (F.col("fulls_before") + F.sum("full").over(running) - F.col("full")).alias("fulls"),
    )
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                out: list[tuple] = []
                part = batch.slice(lo, 1024)
                for name, n, data, rank, fulls in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    width = len(data) // n
                    whole, rest = divmod(n, capacity)
                    spans = [(k * capacity, capacity, bases[rest] + fulls + k, 0) for k in range(whole)]
                    if rest:
                        spans += [
                            (whole * capacity + a, size, seq, off)
                            for a, size, seq, off in placement.pieces(rest, rank)
                        ]
                    for start, size, seq, off in spans:
                        own = data[start * width : (start + size) * width]
                        wide = np.frombuffer(own, f"<u{width}").astype("<u4").tobytes()
                        row = (name, start, size, zlib.crc32(wide), n, seq, off)
                        out.append((*row, own) if ids else row)
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, columns, strict=True)],
                    names=names,
                )

    return placed.mapInArrow(cut, PIECE_SCHEMA + (", ids binary" if ids else ""))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all `documents` into sequences of at most 1024 tokens; one row for each piece."""
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, default_tokenizer()).withColumnRenamed("key", "doc_id")
