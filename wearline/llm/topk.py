"""Exact top-k by inner product with block-at-a-time pruning.

Candidates are put in ranges of similar vectors: by the nearest of a few centres, then by id.
Each range is cut into blocks that hold their vectors (the forward index) and, for each
dimension, the largest and the smallest component. For a query the sum over dimensions of the
larger product with these two bounds every score of a block. A task orders its blocks by their
bound for each query and scores block after block until the bounds fall below the query's k-th
best score. A first pass scores only the best block of each task; its k-th scores start the
second, so tasks prune by what others have found. Pruning never changes the result: blocks whose
bound equals the k-th score are scored as well, and ties go to the smaller id.

Queries go to the tasks in chunks of a fixed size, each chunk against all blocks.

Integers are exact: products are summed in doubles while all sums stay below 2^53, in Python
integers beyond. Scores beyond the range of long are cut to it.

Defined cases. Null vectors, null or non-finite components, null ids: the row takes no part.
Vectors of different length: the shorter is filled with zeros. Repeated rows: one query, and a
candidate each; a query's own id is never its candidate. Fewer candidates than k: all. Empty
table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .vectors import finite_vectors, matrix, sample

SCALE, K = 1024.0, 10
#: Vectors of a block and of a task, centres of the order and the rows they are fitted on.
BLOCK, PART, CENTRES, SAMPLE = 256, 1 << 16, 32, 4096
#: Queries sent to the tasks at a time.
CHUNK = 4096
LONG = 2**63 - 1


def fit_centres(rows: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    """Directions that order the vectors; they change the blocks, never the result."""
    if not len(rows):
        return np.zeros((1, 1))
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1.0)
    found = rows[np.linspace(0, len(rows) - 1, min(centres, len(rows))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(rows @ found.T - (found**2).sum(axis=1) / 2, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(found))[:, None]
        found = np.where(n > 0, sums / np.maximum(n, 1), found)
    return found


def blocks_of(vectors: DataFrame, n: int, block: int, part: int) -> DataFrame:
    """(block, ids, vecs, high, low): runs of at most `block` vectors in the order of a task."""
    centres = fit_centres(sample(vectors, n, SAMPLE), CENTRES)
    width = centres.shape[1]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch["vec"].to_pylist(), width)
            rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0), 1.0)
            near = np.argmax(rows @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.astype(np.int64)), *batch.columns], names=["range", "id", "vec"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[tuple[int, int, bytes]] = []

        def emit(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            nonlocal number
            vecs = matrix([v for _, _, v in rows])
            number += 1
            data = [np.array([i for _, i, _ in rows], "<i8"), vecs, vecs.max(axis=0), vecs.min(axis=0)]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), *[pa.array([x.astype(x.dtype.newbyteorder("<")).tobytes()], pa.binary()) for x in data]],
                names=["block", "ids", "vecs", "high", "low"],
            )

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (row[0] != held[0][0] or len(held) == block):
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    ranged = vectors.mapInArrow(order, "range long, id long, vec binary")
    ranged = ranged.repartitionByRange(C.pieces(n, part), "range", "id").sortWithinPartitions("range", "id")
    return ranged.mapInArrow(cut, "block long, ids binary, vecs binary, high binary, low binary")


NINES = str.maketrans("0123456789", "9876543210")


def order_key(score: int) -> str:
    """A string that sorts as whole numbers of any size do."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}{digits.translate(NINES)}"


class Best:
    """The k best (score, id) of each query so far; `floor` is what a score must reach."""

    def __init__(self, k: int, floors: list):
        self.k, self.floor = k, floors
        self.rows: list[list[tuple]] = [[] for _ in floors]

    def add(self, query: int, scores: list, ids: list) -> None:
        rows = sorted(self.rows[query] + [(-s, i) for s, i in zip(scores, ids, strict=True)])[: self.k]
        self.rows[query] = rows
        if len(rows) == self.k and (self.floor[query] is None or -rows[-1][0] > self.floor[query]):
            self.floor[query] = -rows[-1][0]


def search_blocks(
    blocks: list[tuple[bytes, bytes, bytes, bytes]], names: np.ndarray, queries: np.ndarray,
    floors: list, k: int, rounds: int | None,
) -> Best:
    """The best of some blocks for each query, block at a time by falling bound."""
    ids = [np.frombuffer(b[0], "<i8") for b in blocks]
    raw = [np.frombuffer(b[1], "<f8").reshape(len(i), -1) for b, i in zip(blocks, ids, strict=True)]
    width = max([queries.shape[1], *[r.shape[1] for r in raw]])
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    queries, vecs = wide(queries), [wide(r) for r in raw]
    high, low = (wide(matrix([b[at] for b in blocks])) for at in (2, 3))
    for side, pick in ((high, np.maximum), (low, np.minimum)):
        for i, r in enumerate(raw):
            side[i, r.shape[1] :] = 0.0
            pick(side[i], 0.0, out=side[i], where=np.arange(width) >= r.shape[1])
    largest = max(np.abs(queries).max(initial=0), 1.0) * max(np.abs(high).max(initial=0), np.abs(low).max(initial=0), 1.0)
    if largest * max(width, 1) >= 2.0**53:
        whole = np.vectorize(int, otypes=[object])
        queries, high, low, vecs = whole(queries), whole(high), whole(low), [whole(v) for v in vecs]
    zero = queries * 0
    bounds = np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = Best(k, floors)
    active = np.arange(len(queries))
    for turn in range(len(blocks) if rounds is None else min(rounds, len(blocks))):
        at = order[active, turn]
        open_ = [best.floor[q] is None or bounds[q, b] >= best.floor[q] for q, b in zip(active.tolist(), at.tolist(), strict=True)]
        active, at = active[open_], at[open_]
        if not len(active):
            break
        by = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[by])) + 1
        for group in np.split(active[by], cuts):
            b = int(order[group[0], turn])
            scores = queries[group] @ vecs[b].T
            for q, row in zip(group.tolist(), scores, strict=True):
                keep = ids[b] != names[q]
                if best.floor[q] is not None:
                    keep &= (row >= best.floor[q]).astype(bool)
                if keep.any():
                    best.add(q, [int(s) for s in row[keep]], ids[b][keep].tolist())
    return best


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables (id, vec) of integer-valued vectors."""
    spark = candidates.sparkSession
    stage = C.Stage(spark, "topk")
    n = candidates.count()
    blocks = stage.keep(blocks_of(candidates, n, block, part), "blocks")
    queries = stage.keep(queries.distinct(), "queries")
    chunks = C.pieces(queries.count(), chunk)
    best = Window.partitionBy("query_id", "query").orderBy(F.col("order").desc(), "vec_id")

    def one_pass(name: str, sent, rounds: int | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, raw, floors = sent.value
            held = [row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            if not held:
                return
            found = search_blocks(held, np.array(names), matrix(raw), list(floors), k, rounds)
            rows = [
                (names[q], q, i, max(-LONG - 1, min(LONG, -s)), str(-s), order_key(-s))
                for q, own in enumerate(found.rows) for s, i in own
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["query_id", "query", "vec_id", "score", "exact", "order"],
            )

        found = blocks.select("ids", "vecs", "high", "low").mapInArrow(
            run, "query_id long, query long, vec_id long, score long, exact string, order string"
        )
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return stage.keep(ranked, name)

    parts = []
    for number in range(chunks):
        mine: Column = C.salt(F.struct("id", "vec"), chunks) == number
        rows = sorted((r["id"], bytes(r["vec"])) for r in queries.filter(mine).collect())  # about `chunk`
        names, raw = [i for i, _ in rows], [v for _, v in rows]
        sent = spark.sparkContext.broadcast((names, raw, [None] * len(rows)))
        first = one_pass("first", sent, 1)
        floors: list = [None] * len(rows)
        for r in first.filter(F.col("rank") == k).select("query", "exact").collect():
            floors[r["query"]] = int(r["exact"])
        sent = spark.sparkContext.broadcast((names, raw, floors))
        parts.append(one_pass("best", sent, None))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every query of `embeddings`."""
    table = C.read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    vectors = C.Stage(spark, "vectors").keep(finite_vectors(table, "vec_id", "embedding", SCALE), "vectors")
    return top_k(vectors, vectors.filter(F.col("id") % 100 == 0))
