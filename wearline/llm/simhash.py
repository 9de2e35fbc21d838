"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed from whole texts, then equal ones are merged: a group of exact
copies is one row from there on. Distinct fingerprints are sorted by their population counts,
taken over equal blocks of the 64 bits, and cut into tiles of equal counts. Each differing bit
changes the population count of one block by one, so two tiles can hold a link only if their
counts differ by the radius at most, summed over the blocks; all other tile pairs are skipped.
With one block this is the plain population count; more blocks skip more, and the number of
blocks follows the number of fingerprints, so that the pairs compared for each fingerprint
stay bounded. It changes the work, never the result.

The tile pairs left are compared exactly, with numpy exclusive-or and bit counts. A tile pair
with more links than rows passes on a spanning forest of them, so a large group of near copies
gives links in proportion to its rows and the components stay exact.

Defined cases. Null, empty and blank texts have fingerprint zero and are linked like others.
Repeated rows stay, each with its component. Null keys take part; a component's id is its
smallest key that is not null. Empty table: no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints of a tile, and of a task that makes tiles.
TILE, PART = 256, 100_000
#: Shingles counted, and fingerprint pairs compared, at a time.
AT_ONCE, PAIRS = 1 << 15, 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    # bytes.lower changes A-Z alone and bytes.split cuts at ASCII white space alone.
    words = (text or "").encode().lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, AT_ONCE):
        spans = zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True)
        h = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, print) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch[1].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch[0].cast(pa.int64()), pa.array(prints.view(np.int64))], names=["key", "print"]
            )

    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(run, "key long, print long")


# --- tiles ---------------------------------------------------------------------------


def blocks_for(n: int) -> int:
    """Blocks of bits by the number of fingerprints: two more for each power of ten."""
    return min(16, max(4, 2 * int(math.log10(max(1, n))) - 6))


def widths(blocks: int) -> list[int]:
    return [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]


def count_key(column: str, blocks: int) -> Column:
    """The population counts of the blocks, as one number in mixed radix."""
    out, at = F.lit(0).cast("long"), 0
    for width in widths(blocks):
        part = F.shiftrightunsigned(F.col(column), at)
        if width < BITS:
            part = part.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = out * F.lit(width + 1) + F.bit_count(part)
        at += width
    return out


def steps(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """Changes of the counts up to the radius, one of each pair of opposite ones."""
    found = {(0,) * blocks}
    for _ in range(radius):
        for step, i, d in itertools.product(list(found), range(blocks), (-1, 1)):
            found.add(tuple(x + d * (j == i) for j, x in enumerate(step)))
    zero = (0,) * blocks
    return sorted(s for s in found if s >= zero)


def tiles_of(prints: DataFrame, blocks: int, n: int, tile: int = TILE) -> DataFrame:
    """(counts, tile, prints): runs of at most `tile` fingerprints with equal counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def emit(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            edges = np.flatnonzero(np.diff(keys)) + 1
            bounds = [0, *edges.tolist(), len(keys)]
            runs = [(a, min(a + tile, hi)) for lo, hi in itertools.pairwise(bounds) for a in range(lo, hi, tile)]
            ids = np.arange(number, number + len(runs))
            number += len(runs)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[[a for a, _ in runs]]),
                    pa.array(ids),
                    pa.array([values[a:b].tobytes() for a, b in runs], pa.binary()),
                ],
                names=["counts", "tile", "prints"],
            )

        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch["counts"].to_numpy()])
            values = np.concatenate([values, batch["print"].to_numpy()])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            whole += (len(keys) - whole) // tile * tile
            if whole:
                yield emit(keys[:whole], values[:whole])
                keys, values = keys[whole:], values[whole:]
        if len(keys):
            yield emit(keys, values)

    keyed = prints.select(count_key("print", blocks).alias("counts"), "print")
    ordered = keyed.repartitionByRange(C.pieces(n, PART), "counts", "print")
    return ordered.sortWithinPartitions("counts", "print").mapInArrow(
        cut, "counts long, tile long, prints binary"
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, fewer than the values they join."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def links_of(lists: list[tuple[bytes, bytes, bool]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of some tile pairs; `same` marks a tile paired with itself."""
    left = [np.frombuffer(a, "<i8") for a, _, _ in lists]
    right = [np.frombuffer(b, "<i8") for _, b, _ in lists]
    n_left, n_right = (np.array([len(x) for x in side]) for side in (left, right))
    a_all, b_all = np.concatenate(left), np.concatenate(right)
    per = n_left * n_right
    row = np.repeat(np.arange(len(per)), per)
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    i, j = np.divmod(within, n_right[row])
    x = a_all[(np.cumsum(n_left) - n_left)[row] + i]
    y = b_all[(np.cumsum(n_right) - n_right)[row] + j]
    near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
    same = np.array([s for _, _, s in lists])[row]
    near &= ~same | (i < j)
    x, y, row = x[near], y[near], row[near]
    found = np.bincount(row, minlength=len(per))
    crowded = found > n_left + n_right
    if not crowded.any():
        return x, y
    keep = ~crowded[row]
    parts = [(x[keep], y[keep])]
    for r in np.flatnonzero(crowded):
        parts.append(forest(x[row == r], y[row == r]))
    return tuple(np.concatenate(side) for side in zip(*parts, strict=True))


def links(tiles: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(a, b) fingerprints that differ in at most `radius` bits, or a forest of them."""
    # Where each step leads in the mixed radix, and the range of each block's count.
    sizes = widths(blocks)
    scale = [math.prod(w + 1 for w in sizes[i + 1 :]) for i in range(blocks)]
    moves = steps(blocks, radius)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["counts"].to_numpy()
            digits = np.stack([own // s % (w + 1) for s, w in zip(scale, sizes, strict=True)], axis=1)
            for move in moves:
                there = digits + np.array(move)
                ok = ((there >= 0) & (there <= np.array(sizes))).all(axis=1)
                if ok.any():
                    part = batch.filter(pa.array(ok))
                    target = (there[ok] * np.array(scale)).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(target),
                            part["tile"],
                            part["prints"],
                            pa.array(np.full(len(target), not any(move))),
                        ],
                        names=["counts", "other", "others", "equal"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pairs = [], 0
            last = batch.num_rows - 1
            for at, (a, b, same) in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                rows.append((a, b, same))
                pairs += len(a) * len(b) // 64
                if pairs >= PAIRS or at == last:
                    x, y = links_of(rows, radius)
                    rows, pairs = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    probes = tiles.mapInArrow(probe, "counts long, other long, others binary, equal boolean")
    # Tiles of equal counts would meet in either order.
    pairs = probes.join(tiles, "counts").filter("NOT equal OR other <= tile")
    return pairs.select("others", "prints", (F.col("other") == F.col("tile")).alias("same")).mapInArrow(
        compare, "a long, b long"
    )


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    radius: int = RADIUS, blocks: int | None = None, tile: int = TILE,
) -> DataFrame:
    """(key, print, component) of every row: its fingerprint and the smallest key reachable over
    links of at most `radius` differing bits."""
    stage = C.Stage(docs.sparkSession, "simhash")
    prints = stage.keep(fingerprints(docs, key, text, shingle), "prints")
    distinct = stage.keep(prints.groupBy("print").agg(F.min("key").alias("low")), "distinct")
    n = distinct.count()
    blocks = blocks or blocks_for(n)
    tiles = stage.keep(tiles_of(distinct, blocks, n, tile), "tiles")
    edges = stage.keep(links(tiles, blocks, radius), "links")
    roots = components(edges, stage)
    member = distinct.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "low", F.coalesce("root", "print").alias("root")
    )
    member = stage.keep(member, "member")
    lows = member.groupBy("root").agg(F.min("low").alias("component"))
    return prints.join(member.join(lows, "root").select("print", "component"), "print").select(
        "key", "print", "component"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of all `documents`."""
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash_components(docs).select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
