"""Vector codes from per-part codebooks, assigned through value dictionaries of each dimension.

Vectors of whole numbers are cut into `PARTS` equal consecutive parts. A part's codebook starts as
that part of the first rows by id; each round assigns every part to its nearest entry and moves
each entry to the floored mean of its parts.

No distance is computed from the vectors themselves. Rows are kept in chunks that hold, for each
dimension, the sorted distinct integers of the chunk and the place of every row's value in them.
For a codebook the squared differences of these integers to all entries are tabulated, one row
per integer; the distances of a part are then rows gathered by code, added up over its dimensions.
A chunk is encoded once and serves all rounds.

Each task sends its sums by part, entry and dimension; Spark adds them, and the driver gets as many
numbers as the codebooks hold. Sums are split in limbs of 40 bits, so no count of rows overflows
them. Tables are 32-bit while no distance can exceed that, 64-bit beyond, Python integers beyond
that, so results are exact at any magnitude.

Defined cases. Null vectors, null or non-finite components: the row takes no part. Null ids: coded
like others, last in the order of the first codebook; rows of equal id are ordered by vector.
Fewer rows than entries: smaller codebooks. Vectors of different length, or a length that the
parts do not divide: filled with zeros. Ties: the lower entry. Errors beyond the range of long are
cut to it. Null labels share one sum. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a chunk and of the distance matrix at a time.
CHUNK, TILE = 4096, 512
#: A label of more rows counts as large; the sums of at most so many large labels go to all tasks.
LABEL_ROWS, LABELS = 1 << 18, 10_000
LIMB = 40
LONG = 2**63 - 1


def whole_number(x: float, scale: int) -> int:
    """floor(scale * x), exact beyond the range of doubles too."""
    return math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def encode_rows(values: np.ndarray, scale: int) -> tuple[list[list[int]] | list[np.ndarray], np.ndarray]:
    """The dictionary of each dimension and the rows' codes, (dimension, row)."""
    codes = np.empty((values.shape[1], len(values)), "<u2")
    books = []
    small = np.abs(values).max(initial=0.0) * scale < 2.0**31
    for d in range(values.shape[1]):
        if small:
            book, codes[d] = np.unique(np.floor(values[:, d] * scale).astype(np.int64), return_inverse=True)
            books.append(book)
        else:
            numbers = [whole_number(x, scale) for x in values[:, d].tolist()]
            book = sorted(set(numbers))
            at = {v: i for i, v in enumerate(book)}
            codes[d] = [at[v] for v in numbers]
            books.append(book)
    return books, codes


def _chunker(width: int, scale: int, chunk: int):
    """Rows (key, label, vec) to chunks (keys, labels, sizes, numbers, big, codes, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, chunk):
                rows = batch.slice(first, chunk)
                lists = rows["vec"]
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                lengths = np.diff(lists.offsets.to_numpy())
                matrix = np.zeros((rows.num_rows, width))
                matrix[np.arange(width)[None, :] < lengths[:, None]] = flat
                books, codes = encode_rows(matrix, scale)
                small = not books or isinstance(books[0], np.ndarray)
                values = np.concatenate(books).astype("<i8").tobytes() if small and books else b""
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays([0, rows.num_rows], rows["key"]),
                        pa.ListArray.from_arrays([0, rows.num_rows], rows["label"]),
                        pa.array([[len(b) for b in books]], pa.list_(pa.int32())),
                        pa.array([values], pa.binary()),
                        pa.array([None if small else json.dumps(list(chain(*books)))], pa.string()),
                        pa.array([codes.tobytes()], pa.binary()),
                        pa.array([rows.num_rows], pa.int32()),
                    ],
                    names=["keys", "labels", "sizes", "numbers", "big", "codes", "n"],
                )

    return run


class Chunk:
    """One chunk read back: the dictionary of each dimension and the codes."""

    def __init__(self, sizes: list[int], numbers: bytes, big: str | None):
        values = np.frombuffer(numbers, "<i8") if big is None else np.array(json.loads(big), object)
        self.books = np.split(values, np.cumsum(sizes)[:-1]) if sizes else []

    def largest(self) -> int:
        return max((int(max(abs(b[0]), abs(b[-1]))) for b in self.books if len(b)), default=0)


def nearest(chunk: Chunk, codes: np.ndarray, books: list[np.ndarray], top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part the nearest entry of every row and its squared distance.

    `books` holds (entry, position) of each part in Python integers, `top` their largest magnitude.
    """
    at = 0
    for book in books:
        width = book.shape[1]
        most = width * (chunk.largest() + top) ** 2
        kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
        entries = book.astype(kind)
        tables = []
        for d in range(width):
            gap = chunk.books[at + d].astype(kind)[:, None] - entries[None, :, d]
            tables.append(gap * gap)
        rows = codes.shape[1]
        best, error = np.empty(rows, np.int64), np.empty(rows, np.int64 if kind is not object else object)
        for first in range(0, rows, TILE):
            total = np.zeros((min(TILE, rows - first), len(entries)), kind)
            for d in range(width):
                total += tables[d][codes[at + d, first : first + TILE]]
            found = total.argmin(axis=1)
            best[first : first + TILE] = found
            error[first : first + TILE] = total[np.arange(len(found)), found]
        at += width
        yield best, error


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(batch, row, chunk, codes by dimension) of every chunk."""
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("sizes", "numbers", "big", "codes", "n")]
        for i, (sizes, numbers, big, codes, n) in enumerate(zip(*columns, strict=True)):
            yield batch, i, Chunk(sizes, numbers, big), np.frombuffer(codes, "<u2").reshape(len(sizes), n)


def limbs(value: int) -> list[tuple[int, int]]:
    """A whole number as signed limbs of `LIMB` bits, lowest first."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append((len(out), sign * (rest & ((1 << LIMB) - 1))))
        rest >>= LIMB
    return out


def _summer(sent):
    """Sums of one round: (part, entry, position, limb, total); position -1 holds the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, top = sent.value
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for _, _, chunk, codes in _chunks(batches):
            at = 0
            for part, (best, _) in enumerate(nearest(chunk, codes, books, top)):
                counts[part] += np.bincount(best, minlength=len(books[part]))
                for d in range(books[part].shape[1]):
                    values = chunk.books[at + d][codes[at + d]]
                    if values.dtype == object:
                        np.add.at(sums[part][:, d], best, values)
                    else:  # below 2^31, a few thousand rows: exact in doubles
                        sums[part][:, d] += np.bincount(best, values, len(books[part])).astype(np.int64)
                at += books[part].shape[1]
        rows = []
        for part, (count, total) in enumerate(zip(counts, sums, strict=True)):
            for e in np.flatnonzero(count).tolist():
                rows.append((part, e, -1, 0, int(count[e])))
                rows += [(part, e, d, limb, x) for d, v in enumerate(total[e].tolist()) for limb, x in limbs(int(v))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int32() if i < 4 else pa.int64()) for i in range(5)],
            names=["part", "entry", "position", "limb", "total"],
        )

    return run


def _assigner(sent):
    """The final code and error of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, top = sent.value
        for batch, i, chunk, codes in _chunks(batches):
            parts = list(nearest(chunk, codes, books, top))
            digits = np.stack([best for best, _ in parts], axis=1).astype(np.uint8)
            errors = sum(error.astype(object) for _, error in parts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["keys"].slice(i, 1).flatten(),
                    batch["labels"].slice(i, 1).flatten(),
                    pa.array([row.tobytes().hex() for row in digits], pa.string()),
                    pa.array([min(LONG, int(e)) for e in errors], pa.int64()),
                ],
                names=["key", "label", "code", "error"],
            )

    return run


def fit_codes(chunks: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after some rounds over all chunks."""
    spark = chunks.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((books, _top(books)))
        sums = chunks.select("sizes", "numbers", "big", "codes", "n").mapInArrow(
            _summer(sent), "part int, entry int, position int, limb int, total long"
        )
        found = sums.groupBy("part", "entry", "position", "limb").agg(F.sum("total").alias("total")).collect()
        count, total = {}, {}
        for r in found:
            if r["position"] < 0:
                count[r["part"], r["entry"]] = r["total"]
            else:
                place = r["part"], r["entry"], r["position"]
                total[place] = total.get(place, 0) + (r["total"] << (LIMB * r["limb"]))
        books = [b.copy() for b in books]
        for (part, e), n in count.items():
            books[part][e] = [total.get((part, e, d), 0) // n for d in range(books[part].shape[1])]
        sent.destroy()
    return books


def _top(books: list[np.ndarray]) -> int:
    return max((abs(int(v)) for b in books for v in b.flat), default=0)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.flat).encode()).hexdigest()


def compress(
    df: DataFrame, key: str, vector: str, label: str, scale: int = SCALE, parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK, label_rows: int = LABEL_ROWS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, label, code, error, label_error) of every kept row, and the codebooks.

    `code` holds two hex digits for each part, `error` the squared distance to the coded entries,
    `label_error` its sum over the rows of the same label.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    spark = df.sparkSession
    stage = C.Stage(spark, "codes")
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), vec.alias("vec")).filter(
        F.col(vector).isNotNull() & finite
    )
    first = [list(r["vec"]) for r in rows.orderBy(F.col("key").asc_nulls_last(), "vec").limit(entries).collect()]
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    width = math.ceil(longest / parts) * parts
    each = width // parts
    numbers = [[whole_number(x, scale) for x in v] + [0] * (width - len(v)) for v in first]
    books = [
        np.array([n[p * each : (p + 1) * each] for n in numbers], object).reshape(len(numbers), each) for p in range(parts)
    ]
    key_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("key", "label"))
    chunks = stage.keep(
        rows.mapInArrow(
            _chunker(width, scale, chunk),
            f"keys array<{key_type}>, labels array<{label_type}>, sizes array<int>, numbers binary, big string, codes binary, n int",
        ),
        "chunks",
    )
    books = fit_codes(chunks, books, rounds)
    sent = spark.sparkContext.broadcast((books, _top(books)))
    coded = chunks.mapInArrow(_assigner(sent), f"key {key_type}, label {label_type}, code string, error long")
    coded = stage.replace(coded, "coded", chunks)
    return _with_label_errors(coded, label_rows), books


def _with_label_errors(coded: DataFrame, label_rows: int) -> DataFrame:
    """Adds the sum of errors of each label. Labels of many rows are at most `LABELS` and go to all
    tasks, so no task gets all rows of one; the others are joined by label."""
    many = max(label_rows, coded.count() // LABELS)
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
    total = F.least(F.col("sum"), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error")
    same = F.col("label").eqNullSafe(F.col("of"))
    hot = F.broadcast(sums.filter(F.col("n") > many).select(F.col("label").alias("of"), total))
    cold = sums.filter(F.col("n") <= many).select(F.col("label").alias("of"), total)
    rest = coded.join(hot, same, "left_anti").join(cold, same)
    return coded.join(hot, same).unionByName(rest).drop("of")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector of `embeddings`."""
    table = C.read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    coded, books = compress(table, "vec_id", "embedding", "label")
    return coded.select(
        F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
