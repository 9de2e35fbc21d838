"""Approximate nearest neighbours by cosine over balanced posting lists.

Centroids come from balanced bisection of a bounded sample, so lists hold about as many vectors
each. They lie in a graph in memory: every centroid is linked to its nearest ones, and a beam
search walks it. A vector goes to the list of its nearest centroid and, if it lies near a
boundary, to those of the next ones too. A list longer than its limit, such as that of a vector
a third of the table repeats, is dealt over several chunks; none of its rows is left out.

A query searches the lists whose centroid is at most `ratio` times as far as the nearest one.
The ratio is set on the sample: the smallest with which a share `recall` of its true neighbours
within the sample is found. Neighbours among all rows are nearer than in the sample, so they
are found more often. Scores are exact cosines of the original vectors.

Defined cases. Null or zero vectors, null or non-finite components, null ids: the row takes no
part. Vectors of different length: the shorter is filled with zeros. Repeated rows: one query,
and one candidate each id. A query's own id is never its candidate. Fewer candidates than k are
all found if the ratio reaches their lists. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .vectors import finite_vectors, matrix, sample

K = 5
#: Vectors of a list and of its chunks, most lists, and rows of the sample.
LIST, CHUNK, LISTS, SAMPLE = 512, 1024, 16_384, 20_000
#: Links of a centroid, and lists a boundary vector may be in.
DEGREE, COPIES, BOUNDARY = 24, 3, 1.02
#: Lists that every query searches.
LEAST = 4
#: Sample queries that set the ratio, and the share of their neighbours it has to find.
TRIALS, RECALL = 200, 0.97


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0), 1e-300)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def balanced_centroids(rows: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a bisection into parts of equal size, each split at the median of the
    direction between two means."""
    leaf = max(1, -(-len(rows) // max(1, lists)))
    found, todo = [], [np.arange(len(rows))]
    while todo:
        part = todo.pop()
        own = rows[part]
        if len(part) <= leaf:
            found.append(own.mean(axis=0))
            continue
        ends = own[[0, int(np.argmin(own @ own[0]))]]
        for _ in range(rounds):
            along = own @ (ends[0] - ends[1])
            first = np.zeros(len(part), bool)
            first[np.argsort(-along, kind="stable")[: len(part) // 2]] = True
            ends = np.stack([own[first].mean(axis=0), own[~first].mean(axis=0)])
        todo += [part[~first], part[first]]
    return unit(np.array(found))


class Graph:
    """Centroids, each linked to its nearest ones and to the next in order of bisection."""

    def __init__(self, centroids: np.ndarray, links: np.ndarray | None = None):
        self.centroids, n = centroids, len(centroids)
        if links is None:
            degree = min(DEGREE, n - 1)
            near = []
            for at in range(0, n, 1024):
                close = centroids[at : at + 1024] @ centroids.T
                close[np.arange(len(close)), np.arange(at, at + len(close))] = -np.inf
                near.append(np.argsort(-close, axis=1, kind="stable")[:, :degree])
            ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1)
            links = np.concatenate([*[np.concatenate(near)], ring], axis=1) if n > 1 else ring[:, :1]
        self.links = links
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    def _far(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distances of unit vectors to their own nodes."""
        near = np.einsum("bd,bkd->bk", queries, self.centroids[nodes])
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * near))

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the nearest `width` found for each query, nearest first."""
        n, rows = len(self.centroids), len(queries)
        width = min(width, n)
        size = max(width, len(self.entries))
        ids = np.full((rows, size), -1)
        far = np.full((rows, size), np.inf)
        ids[:, : len(self.entries)] = self.entries
        far[:, : len(self.entries)] = self._far(queries, np.tile(self.entries, (rows, 1)))
        done = np.zeros((rows, size), bool)
        live = np.arange(rows)
        while len(live):
            open_ = np.where(done[live], np.inf, far[live])
            at = np.argmin(open_, axis=1)
            more = np.isfinite(open_[np.arange(len(live)), at])
            live, at = live[more], at[more]
            if not len(live):
                break
            done[live, at] = True
            nodes = self.links[ids[live, at]]
            dist = self._far(queries[live], nodes)
            dist[(nodes[:, :, None] == ids[live][:, None, :]).any(axis=2)] = np.inf
            for c in range(1, nodes.shape[1]):  # a link may stand twice in a row
                dist[(nodes[:, :c] == nodes[:, c : c + 1]).any(axis=1), c] = np.inf
            all_ids = np.concatenate([ids[live], nodes], axis=1)
            all_far = np.concatenate([far[live], dist], axis=1)
            all_done = np.concatenate([done[live], np.zeros(nodes.shape, bool)], axis=1)
            best = np.argpartition(all_far, size - 1, axis=1)[:, :size]
            ids[live], far[live], done[live] = (
                np.take_along_axis(x, best, axis=1) for x in (all_ids, all_far, all_done)
            )
        order = np.argsort(far, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)

    def within(self, queries: np.ndarray, ratio: float) -> list[np.ndarray]:
        """For each query the centroids found at most `ratio` times as far as the nearest, and
        the `LEAST` nearest in any case."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(queries)
        live, width = np.arange(len(queries)), 32
        while len(live):
            ids, far = self.beam(queries[live], width)
            inside = far <= np.maximum(far[:, :1], 1e-12) * ratio
            inside[:, :LEAST] = True
            full = inside.all(axis=1) & (ids.shape[1] < len(self.centroids))
            for q, i, ok in zip(live[~full].tolist(), ids[~full], inside[~full], strict=True):
                out[q] = i[ok]
            live, width = live[full], width * 4
        return out

    def lists(self, rows: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector: the nearest and, near a boundary, the next ones."""
        ids, far = self.beam(rows, 4 * COPIES)
        ok = far <= np.maximum(far[:, :1], 1e-12) * BOUNDARY
        return [i[o][:COPIES] for i, o in zip(ids, ok, strict=True)]


def fit_ratio(graph: Graph, rows: np.ndarray, k: int, recall: float) -> float:
    """The smallest ratio that finds the share `recall` of the sample's true neighbours."""
    if len(rows) < 2:
        return 1.0
    trials = np.linspace(0, len(rows) - 1, min(TRIALS, len(rows))).astype(int)
    needed = []
    for at in trials.tolist():
        near = rows @ rows[at]
        near[at] = -np.inf
        true = np.argsort(-near, kind="stable")[: min(k, len(rows) - 1)]
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (graph.centroids @ rows[at])))
        least = max(far.min(), 1e-12)
        needed += [min(far[i] for i in own) / least for own in graph.lists(rows[true])]
    return float(np.quantile(needed, recall))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, ratio: float | None = None,
    per_list: int = LIST, per_chunk: int = CHUNK, recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables (id, vec); `queries` is part of `vectors`
    or not, but a candidate with the query's id is left out."""
    spark = vectors.sparkSession
    stage = C.Stage(spark, "postings")
    n = vectors.count()
    rows = sample(vectors, n, SAMPLE)
    width = rows.shape[1]
    unit_rows = unit(rows) if len(rows) else np.zeros((1, max(1, width)))
    lists = min(LISTS, max(1, -(-n // per_list)), len(unit_rows))
    graph = Graph(balanced_centroids(unit_rows, lists))
    ratio = fit_ratio(graph, unit_rows, k, recall) if ratio is None else ratio
    # At most LISTS centroids and their links: a few megabytes at any number of rows.
    sent = spark.sparkContext.broadcast((graph.centroids, graph.links))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = graph.lists(unit(matrix(part["vec"].to_pylist(), width)))
                again = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own).astype(np.int64)), part["id"].take(again), part["vec"].take(again)],
                    names=["list", "id", "vec"],
                )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, raw = part["id"].to_pylist(), part["vec"].to_pylist()
                by: dict[int, list[int]] = {}
                for q, found in enumerate(graph.within(unit(matrix(raw, width)), ratio)):
                    for c in found.tolist():
                        by.setdefault(c, []).append(q)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(by), pa.int64()),
                        pa.array([[names[q] for q in own] for own in by.values()], pa.list_(pa.int64())),
                        pa.array([[raw[q] for q in own] for own in by.values()], pa.list_(pa.binary())),
                    ],
                    names=["list", "query_ids", "query_vecs"],
                )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for names, raw, asked, asked_raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                wide = max(len(r) for r in [*raw, *asked_raw]) // 8
                own, ids = matrix(raw, wide), np.array(names)
                length = np.sqrt((own * own).sum(axis=1))
                for q, vec in zip(asked, matrix(asked_raw, wide), strict=True):
                    # Sums along rows: equal rows get equal scores wherever they stand.
                    near = (own * vec).sum(axis=1) / (length * np.sqrt((vec * vec).sum()))
                    seen: set[int] = {q}
                    for i in np.lexsort((ids, -near)).tolist():
                        if names[i] not in seen:  # a repeated id is one candidate, its nearest
                            seen.add(names[i])
                            out.append((q, names[i], float(near[i])))
                            if len(seen) > k:
                                break
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                names=["query_id", "vec_id", "score"],
            )

    spread = C.pieces(n, 4096)
    # Equal rows are one candidate; rows of one id are dealt by their vectors too.
    own = vectors.select("id", "vec").distinct().repartition(spread, "id", "vec")
    assigned = stage.keep(own.mapInArrow(assign, "list long, id long, vec binary"), "assigned")
    lengths = assigned.groupBy("list").agg(F.count("*").alias("rows"))
    chunked = assigned.join(lengths, "list").withColumn(
        "chunk", C.salt(F.xxhash64("id", "vec"), F.ceil(F.col("rows") / per_chunk))
    )
    packed = chunked.groupBy("list", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("x"))
    packed = stage.keep(packed.select("list", "chunk", F.col("x.id").alias("ids"), F.col("x.vec").alias("vecs")), "lists")
    asked = queries.distinct().mapInArrow(probe, "list long, query_ids array<long>, query_vecs array<binary>")
    asked = stage.keep(asked, "probes")
    found = packed.join(asked, "list").select("ids", "vecs", "query_ids", "query_vecs")
    found = found.mapInArrow(score, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every query of `embeddings`."""
    table = C.read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    vectors = finite_vectors(table, "vec_id", "embedding", nonzero=True)
    vectors = C.Stage(spark, "vectors").keep(vectors, "vectors")
    return search(vectors, vectors.filter(F.col("id") % 50 == 0))
