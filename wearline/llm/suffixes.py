"""Exact removal of repeated strings by induced sorting of sampled suffixes.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
text or another. Sorting every suffix would say which do; it takes tens of bytes for each byte
of text. Here only those suffixes are sorted that can matter, and the order of the others is
induced from them:

1. Sample. Each window of `length` bytes has one sample position, the leftmost of its k-grams
   with the smallest hash. It depends on the window's bytes alone, so equal windows have their
   sample at the same offset. A sample serves a run of windows; their union is its context.
2. Samples whose k-gram occurs once are done: their windows are unique. Samples that agree in
   their whole context are done too: all their windows are repeated.
3. The rest is sorted by k-gram and the bytes that follow, an external sort whose runs are
   spilled and merged, and neighbours get their common-prefix values.
4. Induction. The order of the suffixes one byte further left follows from that byte and the
   order before; the common prefix of new neighbours is one more than the smallest value
   between their old places. Going left through the offsets of the samples' windows, a window
   is repeated exactly if its suffix shares `length` bytes with a neighbour in the order.
5. Recursion. A k-gram with more contexts than one task should sort is split by ranges of
   offsets; the windows of half a range share more bytes, and these bytes are the new key. At
   one offset the key is the window, and its count is the answer.

Samples of windows repeated within one text are settled where they are found. Contexts are read
for the rest only, so what is shuffled besides one pass of the texts is in proportion to the
samples, about 2 in `length - k` bytes.

Defined cases. Null text: empty. A text shorter than `length`: nothing removed. Repeated rows
and texts: all of their windows are repeated. Null key: like any other. Runs and periods: a
string that overlaps its other occurrence counts. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C

LENGTH, GRAM = 400, 64
#: Windows looked at in one go; a power of two, the bits of a place in a sliding minimum.
BLOCK = 1 << 16
PLACE = 17
#: Longest string length that a block's places leave room for.
LONGEST = 1 << 15
#: Contexts of a k-gram that one task sorts, and contexts it sorts at a time.
GROUP, BATCH = 2048, 4096

_RANDOM = np.random.default_rng(20_240_229)
BYTES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if n not in _POWERS:
        inverse = pow(BASE, -1, 2**64)
        made = []
        for base in (BASE, inverse):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _POWERS[n] = tuple(made)
    return _POWERS[n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes."""
    n = len(data)
    up, down = powers(BLOCK + LONGEST)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * up[:n], out=sums[1:])
    h = (sums[k:] - sums[: n + 1 - k]) * down[: n + 1 - k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def samples(text: bytes, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, hash) of each sample of a text."""
    if not k <= length <= LONGEST:
        raise ValueError(f"the length must be from {k} to {LONGEST}")
    n, width = len(text) - length + 1, length - k + 1
    if n < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    data = np.frombuffer(text, np.uint8)
    mask = np.uint64((1 << PLACE) - 1)
    parts = []
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        h = gram_hashes(data[at : at + size + length - 1], k)
        keyed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        place = (window_minima(keyed, width) & mask).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [size]])
        first = place[edges[:-1]]
        parts.append([first + at, edges[:-1] + at, edges[1:] - 1 + at, h[first]])
    place, lo, hi, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.concatenate([[True], np.diff(place) != 0])  # a run may go on in the next block
    last = np.concatenate([new[1:], [True]])
    return place[new], lo[new], hi[last], h[new]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SAMPLE_SCHEMA = "key long, mark long, gram long, u1 long, u2 long, n int, place int, lo int, hi int"


def sampled(docs: DataFrame, length: int, k: int) -> DataFrame:
    """The samples of all texts: document (key and a hash of its text), k-gram, context (a 128-bit
    hash), place and context span; n is 2 for a context repeated within its text. Rows without a
    k-gram are spans settled already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            names: list[int | None] = []
            marks, nulls, size = [], [], 0
            for name, mark, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = (text or "").encode()
                place, lo, hi, h = samples(raw, length, k)
                if not len(place):
                    continue
                end = hi + length
                digests = [
                    xxhash.xxh3_128_intdigest(raw[a:b], seed=p - a)
                    for p, a, b in zip(place.tolist(), lo.tolist(), end.tolist(), strict=True)
                ]
                seen: dict[int, int] = {}
                again = []
                for i, d in enumerate(digests):
                    if seen.setdefault(d, i) != i:
                        again.append(i)
                n = np.ones(len(place), np.int32)
                if again:
                    first = sorted({seen[digests[i]] for i in again})
                    n[first] = 2
                    runs = merged([(int(lo[i]), int(end[i])) for i in [*first, *again]])
                    keep = np.ones(len(place), bool)
                    keep[again] = False
                    place, lo, end, h, n = (x[keep] for x in (place, lo, end, h, n))
                    digests = [d for d, ok in zip(digests, keep.tolist(), strict=True) if ok]
                else:
                    runs = []
                extra = np.array([a for a, _ in runs], np.int64), np.array([b for _, b in runs], np.int64)
                total, more = len(place) + len(runs), np.zeros(len(runs), np.int64)
                u1 = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
                u2 = np.array([d & (2**64 - 1) for d in digests], np.uint64).view(np.int64)
                made = [h.view(np.int64), u1, u2, n, place, lo, end]
                others = [more, more, more, more + 2, more, *extra]
                for column, x, y in zip(columns, made, others, strict=True):
                    column.append(np.concatenate([x.astype(np.int64), y]))
                names += [name] * total
                marks += [mark] * total
                nulls += [np.concatenate([np.zeros(len(place), bool), np.ones(len(runs), bool)])]
                size += total
            if size:
                gram, u1, u2, n, place, lo, hi = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()), pa.array(marks, pa.int64()),
                        pa.array(gram, pa.int64(), mask=np.concatenate(nulls)), pa.array(u1), pa.array(u2),
                        *[pa.array(x.astype(np.int32)) for x in (n, place, lo, hi)],
                    ],
                    names=["key", "mark", "gram", "u1", "u2", "n", "place", "lo", "hi"],
                )

    return docs.select("key", "mark", "text").mapInArrow(run, SAMPLE_SCHEMA)


# --- induction -----------------------------------------------------------------------


def common_prefixes(right: list[bytes], groups: np.ndarray) -> np.ndarray:
    """For each string the length of the prefix it shares with the one before, in one group."""
    lengths = np.array([len(r) for r in right])
    width = int(lengths.max(initial=1))
    grid = np.zeros((len(right), width), np.uint8)
    for i, r in enumerate(right):
        grid[i, : len(r)] = np.frombuffer(r, np.uint8)
    out = np.zeros(len(right), np.int64)
    if len(right) > 1:
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[1:] = np.where(groups[1:] == groups[:-1], np.minimum(first, np.minimum(lengths[1:], lengths[:-1])), 0)
    return out


def induce(
    groups: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, length: int
) -> np.ndarray:
    """Which windows are repeated: a row for each sample, a column for each offset.

    Samples are sorted by group and right bytes. Sample i serves the offsets low[i] to high[i],
    the number of bytes its windows start ahead of it; left[i] holds its high[i] bytes before.
    """
    m, most = len(left), int(high.max(initial=0))
    before = np.full((m, most + 1), 256, np.int64)  # the byte d places ahead; 256: there is none
    for i, x in enumerate(left):
        near = np.frombuffer(x, np.uint8)[::-1][:most]
        before[i, 1 : len(near) + 1] = near
    repeated = np.zeros((m, most + 1), bool)
    order, shared = np.arange(m), common_prefixes(right, groups)
    for d in range(most + 1):
        if d:
            byte = before[order, d]
            keep = byte < 256
            if not keep.all():
                # What leaves the order leaves the smaller of its two values to the next.
                starts = np.flatnonzero(keep)
                if not len(starts):
                    break
                bounds = np.concatenate([[0], starts[:-1] + 1])
                shared = np.minimum.reduceat(shared[: starts[-1] + 1], bounds)
                order, byte = order[keep], byte[keep]
            key = groups[order] * 256 + byte
            by = np.argsort(key, kind="stable")
            same = key[by[1:]] == key[by[:-1]]
            shared_new = np.zeros(len(by), np.int64)
            if same.any():
                # Smallest value between the old places of new neighbours; pairs of one byte
                # follow each other, so the ranges in between are empty.
                a, b = by[:-1][same], by[1:][same]
                padded = np.append(shared, 0)
                bounds = np.stack([a + 1, b + 1], axis=1).ravel()
                shared_new[1:][same] = np.minimum.reduceat(padded, bounds)[::2] + 1
            order, shared = order[by], shared_new
        long = shared >= length
        hit = long | np.append(long[1:], False)
        own = order[hit]
        repeated[own, d] = (low[own] <= d) & (d <= high[own])
    return repeated


UNIT = "key long, mark long, open boolean, place int, low int, high int, `left` binary, `right` binary"
SPAN_SCHEMA = "key long, mark long, lo int, hi int"


def windows_to_spans(rows: list[tuple], repeated: np.ndarray, length: int) -> pa.RecordBatch:
    out = []
    for i, (key, mark, open_, place) in enumerate(rows):
        at = np.flatnonzero(repeated[i]) if open_ else ()
        if len(at):
            cuts = np.flatnonzero(np.diff(at) > 1)
            firsts, lasts = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])]
            out += [(key, mark, place - int(b), place - int(a) + length) for a, b in zip(firsts, lasts, strict=True)]
    columns = list(zip(*out, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "mark", "lo", "hi"]
    )


def solve(units: DataFrame, length: int) -> DataFrame:
    """The repeated spans of open samples; `units` has (group, ...) and groups fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close(rows: list[tuple]) -> pa.RecordBatch:
            _, numbers = np.unique([r[0] for r in rows], return_inverse=True)
            low, high = (np.array([r[c] for r in rows]) for c in (5, 6))
            found = induce(numbers, [r[7] for r in rows], [r[8] for r in rows], low, high, length)
            return windows_to_spans([r[1:5] for r in rows], found, length)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield close(held)
                    held = []
                held.append(row)
        if held:
            yield close(held)

    named = units.select("group", "key", "mark", "open", "place", "low", "high", "left", "right")
    ordered = named.repartition("group").sortWithinPartitions("group", "right")
    return ordered.mapInArrow(run, SPAN_SCHEMA)


UNIT_NAMES = [f.split()[0].strip("`") for f in UNIT.split(", ")]


def split(units: DataFrame, first: int, last: int, length: int) -> DataFrame:
    """The samples with windows at the offsets first to last, grouped by the bytes that all
    windows there share: two 64-bit hashes, `group` and `check`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["left"].to_pylist(), batch["right"].to_pylist(), strict=True)
            shared = [x[len(x) - first :] + y[: length - last] for x, y in pairs]
            hashes = [
                pa.array([xxhash.xxh3_64_intdigest(x, seed=seed) - 2**63 for x in shared], pa.int64())
                for seed in (first * LONGEST + last, 1)
            ]
            yield pa.RecordBatch.from_arrays(
                [*hashes, *batch.columns], names=["group", "check", *batch.schema.names]
            )

    kept = units.filter((F.col("low") <= last) & (F.col("high") >= first)).select(*UNIT_NAMES)
    # The offsets outside the range are another call's.
    kept = kept.withColumns({"low": F.greatest("low", F.lit(first)), "high": F.least("high", F.lit(last))})
    return kept.mapInArrow(run, f"group long, check long, {UNIT}")


def solve_large(units: DataFrame, length: int, offsets: int, stage: C.Stage, group: int) -> list[DataFrame]:
    """The repeated spans of samples whose group is too large for a task."""
    done: list[DataFrame] = []
    todo = [(units, 0, offsets)]
    while todo:
        rows, first, last = todo.pop()
        middle = (first + last) // 2
        for a, b in {(first, middle), (middle + 1, last)}:
            if a > b:
                continue
            part = stage.keep(split(rows, a, b, length), f"split-{a}-{b}")
            sizes = part.groupBy("group", "check").agg(F.count("*").alias("rows"), F.max("open").alias("any"))
            part = part.join(sizes.filter("rows > 1 AND any"), ["group", "check"])
            if a == b:
                # One offset: the shared bytes are the window.
                lo = F.col("place") - a
                done.append(part.filter("open").select("key", "mark", lo.alias("lo"), (lo + length).alias("hi")))
                continue
            done.append(solve(part.filter(F.col("rows") <= group), length))
            large = stage.keep(part.filter(F.col("rows") > group).select(*UNIT_NAMES), f"large-{a}-{b}")
            if not large.isEmpty():
                todo.append((large, a, b))
    return done


# --- the operator --------------------------------------------------------------------


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, removed runs, and the hash of what is kept."""
    kept, at, removed = hashlib.sha256(), 0, 0
    view = memoryview(text)
    for a, b in spans:
        kept.update(view[at:a])
        removed += b - a
        at = b
    kept.update(view[at:])
    return len(text), removed, len(spans), kept.hexdigest()


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    k: int = GRAM, group: int = GROUP, kept: bool = False,
) -> DataFrame:
    """One row for each document: key, spans (removed runs of bytes), n_bytes, n_removed, n_spans,
    kept_sha256 and, if asked for, the kept bytes."""
    stage = C.Stage(docs.sparkSession, "repeats")
    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    # A document is known by its key and a hash of its text; a null key is 0 with another mark.
    named = named.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit("")), F.col("key").isNull()))
    named = named.withColumns({"no_key": F.col("key").isNull(), "key": F.coalesce("key", F.lit(0).cast("long"))})
    all_samples = stage.keep(sampled(named, length, k), "samples")
    with_gram = all_samples.filter("gram IS NOT NULL")
    grams = with_gram.groupBy("gram").agg(F.sum("n").alias("total")).filter("total > 1").select("gram")
    again = stage.keep(with_gram.join(grams, "gram", "left_semi"), "again")
    context = ["gram", "u1", "u2"]
    one = F.struct("key", "mark", "place", "lo", "hi")
    classes = again.groupBy(*context).agg(F.sum("n").alias("total"), F.min(one).alias("one"))
    classes = stage.keep(classes, "classes")
    settled = again.join(classes.filter("total > 1").select(*context), context, "left_semi")
    # Rows that agree in key and text hold the same spans; each is kept once.
    settled = settled.select("key", "mark", "lo", "hi").unionByName(
        all_samples.filter("gram IS NULL").select("key", "mark", "lo", "hi")
    ).distinct()
    groups = classes.groupBy("gram").agg(F.count("*").alias("rows"), F.max(F.col("total") == 1).alias("any"))
    open_ = classes.join(groups.filter("rows > 1 AND any"), "gram").select(
        "one.*", (F.col("total") == 1).alias("open"), "gram", (F.col("rows") > group).alias("large")
    )
    # What is known of each document: settled spans, and places whose contexts are needed.
    none = F.lit(None)
    about = settled.select("key", "mark", F.struct("lo", "hi").alias("span"), none.alias("unit")).unionByName(
        open_.select("key", "mark", none.alias("span"), F.struct("place", "lo", "hi", "open", "gram", "large").alias("unit"))
    )
    about = about.groupBy("key", "mark").agg(F.collect_list("span").alias("spans"), F.collect_list("unit").alias("units"))

    unit = f"group long, large boolean, {UNIT}"
    fields = ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in unit.split(", "))
    out_schema = (
        f"key long, mark long, no_key boolean, spans array<struct<lo: int, hi: int>>, {DIGEST}, text binary, units array<struct<{fields}>>"
    )

    def result(raw: bytes, spans: list[tuple[int, int]]) -> dict:
        runs = merged(spans)
        values = dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), digest(raw, runs), strict=True))
        return values | {"spans": [{"lo": a, "hi": b} for a, b in runs]}

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(at, 256).to_pylist():
                    raw = (row["text"] or "").encode()
                    spans = [(s["lo"], s["hi"]) for s in row["spans"] or ()]
                    out = {"key": row["key"], "mark": row["mark"], "no_key": row["no_key"], "text": raw, "units": []}
                    for u in row["units"] or ():
                        place, lo, hi = u["place"], u["lo"], u["hi"]
                        out["units"].append(
                            {
                                "group": u["gram"], "large": u["large"], "key": row["key"], "mark": row["mark"],
                                "open": u["open"], "place": place, "low": place + length - hi, "high": place - lo,
                                "left": raw[lo:place], "right": raw[place:hi],
                            }
                        )
                    if any(u["open"] for u in out["units"]):
                        out["spans"] = [{"lo": a, "hi": b} for a, b in merged(spans)]
                    else:
                        out |= result(raw, spans) | ({} if kept else {"text": None})
                    rows.append(out)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    arrow_schema = to_arrow_schema(T._parse_datatype_string(out_schema))
    known = named.join(about, ["key", "mark"], "left").select("key", "mark", "no_key", "text", "spans", "units")
    known = stage.keep(known.mapInArrow(first_pass, out_schema), "known")
    units = known.select(F.explode("units").alias("u")).select("u.*")
    small = units.filter("NOT large")
    found = [solve(small, length)]
    large = units.filter("large")
    if not large.isEmpty():
        found += solve_large(large, length, length - k, stage, group)
    spans = found[0]
    for other in found[1:]:
        spans = spans.unionByName(other)
    spans = spans.distinct().groupBy("key", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("more"))

    final_schema = f"key long, no_key boolean, spans array<struct<lo: int, hi: int>>, {DIGEST}" + (", kept binary" if kept else "")
    final_arrow = to_arrow_schema(T._parse_datatype_string(final_schema))

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(at, 256).to_pylist():
                    spans = [(s["lo"], s["hi"]) for s in [*row["spans"], *(row["more"] or ())]]
                    out = {"key": row["key"], "no_key": row["no_key"]} | result(row["text"], spans)
                    if kept:
                        gone = np.zeros(len(row["text"]), bool)
                        for s in out["spans"]:
                            gone[s["lo"] : s["hi"]] = True
                        out["kept"] = np.frombuffer(row["text"], np.uint8)[~gone].tobytes()
                    rows.append(out)
                yield pa.RecordBatch.from_pylist(rows, schema=final_arrow)

    pending = known.filter("n_bytes IS NULL").drop("units") if not kept else known.drop("units")
    pending = pending.join(spans, ["key", "mark"], "left").select("key", "no_key", "text", "spans", "more")
    ended = pending.mapInArrow(last_pass, final_schema)
    if not kept:
        ended = ended.unionByName(known.filter("n_bytes IS NOT NULL").select(*ended.columns))
    return ended.withColumn("key", F.when(~F.col("no_key"), F.col("key"))).drop("no_key")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of all `documents`; beside these the number
    of bytes that are left and, for any byte removed, the removed runs as start:end."""
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = remove_repeats(docs)
    runs = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["lo"], s["hi"])), ",")
    return found.select(
        F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256",
        (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"), runs.alias("removed"),
    )
