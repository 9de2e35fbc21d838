"""Exact ranked lexical search by sparse ball trees over inner products.

A document is a sparse vector: for each term the whole number (10^9 tf) div (1000 tf + 20 m), where
m grows with its length. A query holds the whole weight w of each of its terms. The score is their
inner product, so the best documents are found by maximum inner-product search.

1. Statistics. The texts are read once; each document keeps its number of terms and the terms that
   some query holds. Documents, terms and document frequencies are summed from that table.
2. Trees. Documents are put in ranges by their three weightiest terms, so that those of one subject
   and copies stand together, ties broken by id; runs of at most `TREE` documents are split again
   and again between two distant documents down to leaves of `LEAF`. A node holds the floored mean
   of its documents as its centre, and radii: the largest distance of any of its documents to the
   centre, one for each of `GROUPS` groups of terms. (One group is the plain ball.)
3. Bounds. No document of a node scores above q.c plus the sum over groups of |q| r, with |q| over
   the node's own terms only, as all its documents are 0 elsewhere. Centres and squares are whole
   numbers; roots are rounded up and the sum gets a margin for the rounding of doubles, so a bound
   is never too low.
4. Search. For each query a task opens nodes best first and scores leaves exactly in whole numbers,
   until the best bound left is below its k-th score. A first pass scores one leaf of each tree
   only; its k-th scores over all tasks are where the second pass starts.

Queries go to the tasks in chunks, each chunk against all trees. Scores are summed in doubles
while all sums stay below 2^53, in 64-bit integers beyond.

Defined cases. Null or wordless texts: no document of the statistics; such an item has no rows.
Null document ids: last among equal scores. Null item ids: an item like any other. Repeated
documents: each is ranked. Repeated items: one, if id and text agree. Very long texts: read whole.
Terms of weight 0 and scores of 0: not ranked. Empty tables: no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .words import split_words, texts_of

K = 50
#: Documents of a tree, of a leaf and of a task; entries of a tree; groups of terms with a radius of their own.
TREE, LEAF, PART, ENTRIES, GROUPS = 1024, 16, 1 << 14, 1 << 18, 64
#: Different terms of the queries sent at a time, about, and the numbers of one dense query matrix.
CHUNK_TERMS, DENSE = 1 << 18, 1 << 22
#: Stands for a null document id in the trees.
NO_ID = 2**63 - 1
MARGIN = 1e-9


def term_vectors(docs: DataFrame, key: str, text: str, sent) -> DataFrame:
    """(id, n, dims, tfs): documents with a term, their terms of the broadcast vocabulary and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            keep, sizes, dims, tfs, offsets = [], [], [], [], [0]
            for i, raw in enumerate(texts_of(batch["text"])):
                words = split_words(raw)
                if not words:
                    continue
                own = sorted((number(w, -1), tf) for w, tf in Counter(words).items())
                own = [x for x in own if x[0] >= 0]
                keep.append(i)
                sizes.append(len(words))
                dims += [d for d, _ in own]
                tfs += [tf for _, tf in own]
                offsets.append(len(dims))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(dims, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tfs, pa.int64())),
                ],
                names=["id", "n", "dims", "tfs"],
            )

    named = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    return named.mapInArrow(run, "id long, n long, dims array<int>, tfs array<long>")


def components(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The whole-number components for term counts in documents of length value m."""
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m)


class Rows:
    """Sparse rows: row i holds `values` of `dims` from indptr[i] to indptr[i + 1]."""

    def __init__(self, indptr: np.ndarray, dims: np.ndarray, values: np.ndarray):
        self.indptr, self.dims, self.values = indptr, dims, values

    def take(self, order: np.ndarray) -> "Rows":
        sizes = np.diff(self.indptr)[order]
        indptr = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.indptr[order] - indptr[:-1], sizes) + np.arange(indptr[-1])
        return Rows(indptr, self.dims[at], self.values[at])

    def part(self, a: int, b: int) -> "Rows":
        x, y = self.indptr[a], self.indptr[b]
        return Rows(self.indptr[a : b + 1] - x, self.dims[x:y], self.values[x:y])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def ball(rows: Rows, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, centre and radii (one for each group) of some documents; radii are rounded up."""
    dims, at = np.unique(rows.dims, return_inverse=True)
    n = len(rows.indptr) - 1
    centre = np.floor(np.bincount(at, rows.values, len(dims)) / n)
    group = dims % groups
    # A document is away from the centre by the centre itself where it lacks a term.
    base = np.bincount(group, centre**2, groups)
    own = (rows.values - centre[at]) ** 2 - centre[at] ** 2
    change = np.bincount(rows.row_of() * groups + group[at], own, n * groups).reshape(n, groups)
    square = np.maximum(change + base, 0.0).max(axis=0)
    # Squares are whole numbers, exact below 2^53; the margin covers sums beyond.
    scale = base + np.bincount(group[at], rows.values.astype(np.float64) ** 2, groups)
    square += np.where(scale < 2.0**52, 0.0, scale * MARGIN)
    radii = np.where(square > 0, np.ceil(np.sqrt(square)) + 1, 0.0)
    return dims, centre, radii


def sketches(rows: Rows, width: int = 32) -> np.ndarray:
    """Short dense stand-ins of the documents; they choose the splits, never a result."""
    signs = np.random.default_rng(11).choice([-1.0, 1.0], (1024, width))
    out = np.zeros((len(rows.indptr) - 1, width))
    at = rows.row_of()
    for d in range(width):
        out[:, d] = np.bincount(at, rows.values * signs[rows.dims % 1024, d], len(out))
    return out


def build_tree(rows: Rows, ids: np.ndarray, leaf: int, groups: int) -> dict:
    """A ball tree: documents in tree order and nodes (first, last, children, ball)."""
    points = sketches(rows)
    order = np.arange(len(ids))
    spans, children = [(0, len(ids))], [(-1, -1)]
    at = 0
    while at < len(spans):
        a, b = spans[at]
        if b - a > leaf:
            own = order[a:b]
            x = points[own]
            far = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
            other = x[np.argmax(((x - far) ** 2).sum(axis=1))]
            side = x @ (far - other)
            by = np.argsort(side, kind="stable")
            # Between the two, but never below a quarter of the documents on one side.
            cut = int(np.searchsorted(side[by], (far @ far - other @ other) / 2))
            cut = min(max(cut, (b - a) // 4, 1), b - a - max(1, (b - a) // 4))
            order[a:b] = own[by]
            children[at] = (len(spans), len(spans) + 1)
            spans += [(a, a + cut), (a + cut, b)]
            children += [(-1, -1)] * 2
        at += 1
    rows = rows.take(order)
    balls = [ball(rows.part(a, b), groups) for a, b in spans]
    return {
        "ids": ids[order].astype("<i8"), "indptr": rows.indptr.astype("<i8"), "dims": rows.dims.astype("<i4"),
        "values": rows.values.astype("<i4"), "spans": np.array(spans, "<i4"), "children": np.array(children, "<i4"),
        "node_ptr": np.cumsum([0] + [len(d) for d, _, _ in balls]).astype("<i8"),
        "node_dims": np.concatenate([d for d, _, _ in balls]).astype("<i4"),
        "centres": np.concatenate([c for _, c, _ in balls]).astype("<i4"),
        "radii": np.concatenate([r for _, _, r in balls]).astype("<f8"),
    }


FIELDS = {
    "ids": "<i8", "indptr": "<i8", "dims": "<i4", "values": "<i4", "spans": "<i4", "children": "<i4",
    "node_ptr": "<i8", "node_dims": "<i4", "centres": "<i4", "radii": "<f8",
}


def forest(vectors: DataFrame, sent, tree: int, leaf: int, part: int, groups: int) -> DataFrame:
    """Trees over (id, m, dims, tfs), one row each. `sent` holds the weight of each term."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            lists, tfs = batch["dims"], batch["tfs"].flatten().to_numpy()
            dims, ptr = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            ptr = ptr - ptr[0]
            row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
            weight = weights[dims] * components(tfs, batch["m"].to_numpy()[row])
            by = np.lexsort((dims, -weight, row))
            top = np.full((3, len(ptr) - 1), -1, np.int32)
            for i in range(3):
                has = np.diff(ptr) > i
                top[i, has] = dims[by[ptr[:-1][has] + i]]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(t) for t in top], *batch.columns], names=["a", "b", "c", *batch.schema.names]
            )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            indptr = np.cumsum([0] + [len(d) for _, _, d, _ in held])
            dims = np.concatenate([d for _, _, d, _ in held]).astype(np.int64)
            tfs = np.concatenate([t for _, _, _, t in held]).astype(np.int64)
            m = np.repeat(np.array([x for _, x, _, _ in held], np.int64), np.diff(indptr))
            found = build_tree(Rows(indptr, dims, components(tfs, m)), np.array([i for i, *_ in held], np.int64), leaf, groups)
            return pa.RecordBatch.from_arrays([pa.array([found[f].tobytes()], pa.binary()) for f in FIELDS], names=list(FIELDS))

        for batch in batches:
            dims, tfs = batch["dims"], batch["tfs"]
            for i, (key, m) in enumerate(zip(batch["id"].to_pylist(), batch["m"].to_pylist(), strict=True)):
                own = dims[i].values.to_numpy(), tfs[i].values.to_numpy()
                if held and (len(held) == tree or size + len(own[0]) > ENTRIES):
                    yield emit()
                    held, size = [], 0
                held.append((key, m, *own))
                size += len(own[0])
        if held:
            yield emit()

    n = vectors.count()
    order = ["a", "b", "c", "id"]
    ranged = vectors.mapInArrow(keyed, "a int, b int, c int, id long, m long, dims array<int>, tfs array<long>")
    ranged = ranged.repartitionByRange(C.pieces(n, part), *order).sortWithinPartitions(*order).select("id", "m", "dims", "tfs")
    return ranged.mapInArrow(grow, ", ".join(f"{f} binary" for f in FIELDS))


class Best:
    """The k best (score, id) of each query, and the score that more must reach."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.floor = k, floors.copy()
        self.scores = [np.zeros(0, np.int64)] * len(floors)
        self.ids = [np.zeros(0, np.int64)] * len(floors)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        by = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[by], ids[by]
        if len(by) == self.k:
            self.floor[query] = max(self.floor[query], scores[by[-1]])


class Tree:
    """One tree against the queries of a dense weight matrix (query, term)."""

    def __init__(self, raw: dict, weights: np.ndarray, groups: int):
        self.f = {k: np.frombuffer(raw[k], t) for k, t in FIELDS.items()}
        self.spans, self.children = self.f["spans"].reshape(-1, 2), self.f["children"].reshape(-1, 2)
        self.radii = self.f["radii"].reshape(len(self.spans), groups)
        self.weights, self.groups = weights, groups
        self.known: dict[int, np.ndarray] = {}

    def bounds(self, node: int) -> np.ndarray:
        """What no document of the node exceeds, for every query."""
        if node not in self.known:
            a, b = self.f["node_ptr"][node : node + 2]
            dims, centre = self.f["node_dims"][a:b], self.f["centres"][a:b]
            by = np.argsort(dims % self.groups, kind="stable")
            own = self.weights[:, dims[by]].astype(np.float64)
            group = (dims % self.groups)[by]
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(by) else np.zeros(0, int)
            norm = np.sqrt(np.add.reduceat(own * own, cuts, axis=1)) if len(cuts) else np.zeros((len(own), 0))
            high = own @ centre[by].astype(np.float64) + norm @ self.radii[node, group[cuts]]
            self.known[node] = high * (1 + MARGIN) + 1
        return self.known[node]

    def leaf(self, node: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores (query, document) of a leaf and its documents' ids."""
        a, b = self.spans[node]
        x, y = self.f["indptr"][a], self.f["indptr"][b]
        dims, at = np.unique(self.f["dims"][x:y], return_inverse=True)
        row = np.repeat(np.arange(b - a), np.diff(self.f["indptr"][a : b + 1]))
        own = self.weights[np.ix_(queries, dims)]
        kind = np.float64 if float(own.sum(axis=1).max(initial=0)) * 1e6 < 2.0**53 else np.int64
        docs = np.zeros((b - a, len(dims)), kind)
        docs[row, at] = self.f["values"][x:y]
        return (own.astype(kind) @ docs.T).astype(np.int64), self.f["ids"][a:b]

    def search(self, best: Best, leaves: int | None) -> tuple[int, int]:
        """Adds what this tree holds to `best`, opening at most `leaves` leaves for each query;
        returns how many (query, document) pairs were scored and how many there are."""
        root = self.bounds(0)
        heaps = {int(q): [(-root[q], 0)] for q in np.flatnonzero(root >= best.floor)}
        scored = 0
        while heaps and leaves != 0:
            groups: dict[int, list[int]] = {}
            for q in list(heaps):
                heap = heaps[q]
                while heap and -heap[0][0] >= best.floor[q]:
                    bound, node = heapq.heappop(heap)
                    left, right = self.children[node]
                    if left < 0:
                        groups.setdefault(node, []).append(q)
                        break
                    for child in (int(left), int(right)):
                        high = min(-bound, self.bounds(child)[q])
                        if high >= best.floor[q]:
                            heapq.heappush(heap, (-high, child))
                else:
                    del heaps[q]
            for node, own in groups.items():
                found, ids = self.leaf(node, np.array(own))
                scored += found.size
                for q, scores in zip(own, found, strict=True):
                    keep = scores >= best.floor[q]
                    if keep.any():
                        best.add(q, scores[keep], ids[keep])
            leaves = None if leaves is None else leaves - 1
        return scored, len(self.weights) * len(self.f["ids"])


def _search(sent, k: int, leaves: int | None, groups: int):
    """Rows of trees to the best documents of each query; query -1 holds the scored and all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, dims, weights, floors, terms = sent.value
        best = Best(k, floors)
        step = max(1, DENSE // max(1, terms))
        scored = every = 0
        for batch in batches:
            for row in batch.to_pylist():
                for first in range(0, len(queries) - 1, step):
                    last = min(first + step, len(queries) - 1)
                    x, y = queries[first], queries[last]
                    dense = np.zeros((last - first, terms), np.int64)
                    dense[np.repeat(np.arange(last - first), np.diff(queries[first : last + 1])), dims[x:y]] = weights[x:y]
                    own = Best(k, best.floor[first:last])
                    own.scores, own.ids = best.scores[first:last], best.ids[first:last]
                    a, b = Tree(row, dense, groups).search(own, leaves)
                    scored, every = scored + a, every + b
                    best.floor[first:last] = own.floor
                    best.scores[first:last], best.ids[first:last] = own.scores, own.ids
        query = np.repeat(np.arange(len(best.ids)), [len(i) for i in best.ids])
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (best.ids, best.scores))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(x, y).astype(np.int64)) for x, y in ((query, -1), (ids, every), (scores, scored))],
            names=["query", "doc_id", "score"],
        )

    return run


def rank_documents(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", k: int = K, tree: int = TREE, leaf: int = LEAF, part: int = PART, groups: int = GROUPS,
    chunk_terms: int = CHUNK_TERMS, shares: list | None = None,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item. `shares` gets, for each
    chunk of queries, the scored and all (query, document) pairs of the second pass."""
    spark = docs.sparkSession
    stage = C.Stage(spark, "balltree")
    named = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).distinct()
    chunks = C.pieces(named.agg(F.sum(F.octet_length("text"))).first()[0] or 1, 4 * chunk_terms)
    kind = items.schema[item_key].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for chunk in range(chunks):
        rows = named.filter(C.salt(F.struct("item_id", "text"), chunks) == chunk)
        rows = rows.select("item_id", F.encode("text", "UTF-8").alias("text")).collect()
        asked = [(r["item_id"], set(split_words(r["text"] and bytes(r["text"])))) for r in rows]
        found = _rank_chunk(docs, key, text, asked, stage, k, tree, leaf, part, groups, shares)
        if found is not None:
            names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(asked)], f"query long, item_id {kind}")
            out = out.unionByName(found.join(F.broadcast(names), "query").select(*out.columns))
    return out


def _rank_chunk(docs, key, text, asked, stage, k, tree, leaf, part, groups, shares) -> DataFrame | None:
    """(query, rank, doc_id, score) for the queries of one chunk."""
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*[words for _, words in asked])))}
    if not vocabulary:
        return None
    vectors = stage.keep(term_vectors(docs, key, text, spark.sparkContext.broadcast(vocabulary)), "vectors")
    total, terms = vectors.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return None
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("dims").alias("dim")).groupBy("dim").count().collect():  # one row a term
        frequency[r["dim"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
    m = F.expr(f"50 + (50 * n * {total}L) div {terms}L").alias("m")
    held = vectors.filter(F.size("dims") > 0).select("id", m, "dims", "tfs")
    trees = stage.replace(forest(held, spark.sparkContext.broadcast(weights), tree, leaf, part, groups), "trees", vectors)
    # The files of small trees would be read by one task; dealt out, each task searches as many as it built.
    trees = trees.repartition(C.pieces(total, part), F.xxhash64("ids"))
    own = [sorted(d for d in map(vocabulary.get, words) if frequency[d] and weights[d]) for _, words in asked]
    queries = np.cumsum([0] + [len(d) for d in own])
    dims = np.array([d for q in own for d in q], np.int64)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")

    def one_pass(floors: np.ndarray, leaves: int | None, name: str) -> DataFrame:
        sent = spark.sparkContext.broadcast((queries, dims, weights[dims], floors, len(vocabulary)))
        best = trees.mapInArrow(_search(sent, k, leaves, groups), "query long, doc_id long, score long")
        return stage.keep(best, name)

    first = one_pass(np.ones(len(asked), np.int64), 1, "first")
    floors = np.ones(len(asked), np.int64)  # a score must be above 0
    ranked = first.filter("query >= 0").withColumn("rank", F.row_number().over(order))
    for r in ranked.filter(F.col("rank") == k).select("query", "score").collect():  # one row a query
        floors[r["query"]] = r["score"]
    best = one_pass(floors, None, "best")
    if shares is not None:
        shares.append(tuple(best.filter("query < 0").agg(F.sum("score"), F.sum("doc_id")).first()))
    ranked = best.filter("query >= 0").withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of `documents` for each item of `benchmark`."""
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    items = C.read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return rank_documents(docs, items)
