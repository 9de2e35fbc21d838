"""Gradient-boosted regression trees by histograms: L2 term, second-order gain, columns drawn per tree.

Values are put in bins once and kept in chunks of binary columns with their labels and predictions.
A tree level is one aggregate: each task counts rows and sums gradients by group, node, feature and
bin, Spark adds these up and picks the best split of each node, and the driver gets one row a node.
Trees of all groups (datasets) grow in the same passes, and a pass scores the rows of all groups.

The loss is squared error, so a row's gradient is prediction - label and its weight 1. A split is
worth GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2), and a leaf holds -rate G / (H + l2).
Equal gains (to six places) go to the lower feature and bin, so reruns agree.

A missing or infinite value is in bin 0, below all others, in fitting and in scoring. Rows without a
label or group take no part in fitting; rows of a group without trees are scored null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline import schema as S
from wearline.operators import store

BINS = 64
#: Predictions are written anew after so many trees; until then the newest trees are added in each pass.
REWRITE = 16
CHUNK = 1 << 16
PLACES = 6


@dataclass
class Settings:
    trees: int = 1000
    depth: int = 4
    rate: float = 0.02
    l2: float = 1.0
    columns: float = 0.8
    rows: float = 0.9
    least_rows: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: the children of i are 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row (feature, row) after so many levels."""
        at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(levels):
            feature = self.feature[at]
            right = bins[np.maximum(feature, 0), rows] > self.bin[at]
            at = np.where(feature >= 0, 2 * at + 1 + right, at)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, len(self.feature).bit_length() - 1)]


@dataclass
class BoostedModel:
    """Trees, bin edges and base value of each group."""

    by: str
    features: list[str]
    edges: dict[int, list[np.ndarray]]
    base: dict[int, float]
    trees: dict[int, list[Tree]]
    gains: dict[int, np.ndarray] = field(default_factory=dict)
    cap: int = S.RUL_CAP
    window: int = S.WINDOW
    #: All groups are scored in one pass, see ``scoring.score``.
    one_pass = True

    @property
    def subsets(self) -> list[int]:
        return sorted(self.trees)

    def predict(self, df: DataFrame, subset: int | None = None) -> DataFrame:
        """The rows with column ``prediction``; null for groups without trees."""
        sent = df.sparkSession.sparkContext.broadcast(self)
        kept = [c for c in df.columns if c != "prediction"]
        inputs = F.array(*[F.col(f"`{c}`").cast("double") for c in self.features])
        group = F.col(self.by).cast("long") if subset is None else F.lit(subset).cast("long")
        named = df.select(group.alias("group"), inputs.alias("x"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                groups = batch["group"].to_numpy(zero_copy_only=False)
                values = matrix(batch["x"], len(model.features))
                found = np.full(len(values), np.nan)
                for g in model.trees:
                    own = np.flatnonzero(groups == g)
                    bins = binned(values[own], model.edges[g])
                    found[own] = model.base[g] + sum((t.predict(bins) for t in model.trees[g]), np.zeros(len(own)))
                made = pa.array(found, mask=np.isnan(found))
                yield pa.RecordBatch.from_arrays([batch["row"], made], names=["row", "prediction"])

        schema = T.StructType([T.StructField("row", named.schema["row"].dataType), T.StructField("prediction", T.DoubleType())])
        return named.mapInArrow(run, schema).select("row.*", "prediction")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array column of equal lengths as rows; missing values are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(feature, row): 0 for a missing value, else 1 + the number of edges below it."""
    out = np.zeros((len(edges), len(values)), "<u2")
    for i, e in enumerate(edges):
        x = values[:, i]
        out[i] = np.where(np.isfinite(x), 1 + np.searchsorted(e, x, side="left"), 0)
    return out


def bin_edges(rows: DataFrame, by: str, features: list[str], bins: int) -> dict[int, list[np.ndarray]]:
    """Quantiles of each feature in each group, one aggregate."""
    shares = [i / bins for i in range(1, bins)]
    known = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c in features]
    found = rows.groupBy(by).agg(*[F.percentile_approx(k, shares, 10_000).alias(f"_{i}") for i, k in enumerate(known)])
    return {r[by]: [np.unique(np.array(r[f"_{i}"] or [], np.float64)) for i in range(len(features))] for r in found.collect()}


def fit_boosted(
    rows: DataFrame, features: list[str], label: str, by: str, params: dict | None = None, bins: int = BINS,
    edges: dict[int, list[np.ndarray]] | None = None, cap: int = S.RUL_CAP, window: int = S.WINDOW,
) -> BoostedModel:
    """Trees of every group in ``by`` from labelled feature rows. ``edges`` replaces the quantiles."""
    settings = Settings(**(params or {}))
    spark = rows.sparkSession
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in [by, label, *features]])
    rows = rows.filter(F.col(by).isNotNull() & F.col(label).isNotNull()).select(
        F.col(by).cast("long").alias(by), F.col(label).cast("double").alias("_y"), hashed.alias("_hash"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in features],
    )
    rows = store.materialised(rows)
    base = {r[by]: r["m"] for r in rows.groupBy(by).agg(F.avg("_y").alias("m")).collect()}
    edges = edges or bin_edges(rows, by, features, bins)
    model = BoostedModel(by, features, edges, base, {g: [] for g in base}, {g: np.zeros(len(features)) for g in base}, cap, window)
    named = rows.select(F.col(by).alias("group"), F.col("_y").alias("y"), F.col("_hash").alias("hash"), F.array(*features).alias("x"))
    chunks = store.materialised(named.mapInArrow(_chunker(spark.sparkContext.broadcast((edges, base))), CHUNKS))
    fresh = {g: 0 for g in base}  # trees up to here are in the written predictions
    for number in range(settings.trees):
        drawn = {g: columns_of(g, number, len(features), settings) for g in base}
        grown = {g: Tree.empty(settings.depth) for g in base}
        pending = {g: model.trees[g][fresh[g] :] for g in base}
        for level in range(settings.depth):
            sent = spark.sparkContext.broadcast((pending, grown, drawn, level, number, settings))
            found = chunks.mapInArrow(_histogram(sent), HISTOGRAM)
            for r in best_splits(found, settings).collect():
                tree, node = grown[r["group"]], r["node"]
                if level == 0:
                    tree.value[0] = -settings.rate * r["g"] / (r["n"] + settings.l2)
                if r["feature"] is None:
                    continue
                tree.feature[node], tree.bin[node] = r["feature"], r["bin"]
                model.gains[r["group"]][r["feature"]] += r["gain"]
                for child, g, n in ((2 * node + 1, r["gl"], r["nl"]), (2 * node + 2, r["g"] - r["gl"], r["n"] - r["nl"])):
                    tree.value[child] = -settings.rate * g / (n + settings.l2)
            sent.destroy()
        for g, tree in grown.items():
            model.trees[g].append(tree)
        if (number + 1) % REWRITE == 0 and number + 1 < settings.trees:
            sent = spark.sparkContext.broadcast({g: model.trees[g][fresh[g] :] for g in base})
            chunks = store.materialised(chunks.mapInArrow(_rewriter(sent), CHUNKS))
            fresh = {g: number + 1 for g in base}
    return model


def columns_of(group: int, number: int, n: int, settings: Settings) -> np.ndarray:
    """The features that a tree may split by."""
    take = max(1, round(settings.columns * n))
    return np.sort(np.random.default_rng([settings.seed, group, number]).choice(n, take, replace=False))


def in_sample(hashes: np.ndarray, number: int, settings: Settings) -> np.ndarray:
    """Which rows a tree sees: a number of each row's hash and the tree below the share."""
    if settings.rows >= 1:
        return np.ones(len(hashes), bool)
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64) ^ (np.uint64(number + 1) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 < settings.rows


CHUNKS = "group long, n int, bins binary, y binary, hash binary, pred binary"
HISTOGRAM = "group long, node int, feature int, bin int, g double, n double"


def _chunker(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, base = sent.value
        for batch in batches:
            groups = batch["group"].to_numpy()
            y, hashes = batch["y"].to_numpy(), batch["hash"].to_numpy()
            for g in np.unique(groups).tolist():
                own = np.flatnonzero(groups == g)
                values = matrix(batch["x"], len(edges[g]))[own]
                data = [binned(values, edges[g]), y[own], hashes[own], np.full(len(own), base[g])]
                yield _row(g, len(own), [x.tobytes() for x in data])

    return run


def _row(group: int, n: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([group], pa.int64()), pa.array([n], pa.int32()), *[pa.array([x], pa.binary()) for x in data]],
        names=["group", "n", "bins", "y", "hash", "pred"],
    )


def _chunks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for r in batch.to_pylist():
            bins = np.frombuffer(r["bins"], "<u2").reshape(-1, r["n"])
            yield r, bins, np.frombuffer(r["y"]), np.frombuffer(r["hash"], np.int64), np.frombuffer(r["pred"])


def _histogram(sent):
    """Sums of gradients and rows by group, node, feature and bin, one set of rows for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, grown, drawn, level, number, settings = sent.value
        sums: dict[int, np.ndarray] = {}
        first, nodes = 2**level - 1, 2**level
        for r, bins, y, hashes, pred in _chunks(batches):
            g = r["group"]
            own = in_sample(hashes, number, settings)
            bins, gradient = bins[:, own], (pred - y)[own]
            for tree in pending[g]:
                gradient = gradient + tree.predict(bins)
            at = grown[g].nodes(bins, level) - first
            here = (at >= 0) & (at < nodes)  # rows in a leaf above are done
            at, bins, gradient = at[here], bins[:, here], gradient[here]
            most = int(bins.max(initial=0)) + 1
            held = sums.get(g)
            if held is None or held.shape[3] < most:
                wider = np.zeros((2, nodes, len(drawn[g]), max(most, 1)))
                if held is not None:
                    wider[..., : held.shape[3]] = held
                held = sums[g] = wider
            width = held.shape[3]
            for i, f in enumerate(drawn[g].tolist()):
                place = at * width + bins[f]
                held[0, :, i] += np.bincount(place, gradient, nodes * width).reshape(nodes, width)
                held[1, :, i] += np.bincount(place, minlength=nodes * width).reshape(nodes, width)
        for g, held in sums.items():
            node, i, b = np.nonzero(held[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(node), g)), pa.array((node + first).astype(np.int32)),
                    pa.array(drawn[g][i].astype(np.int32)), pa.array(b.astype(np.int32)),
                    pa.array(held[0][node, i, b]), pa.array(held[1][node, i, b]),
                ],
                names=["group", "node", "feature", "bin", "g", "n"],
            )

    return run


def best_splits(found: DataFrame, settings: Settings) -> DataFrame:
    """For each node its sums and, where a split gains, the best one with the sums of its left side."""
    sums = found.groupBy("group", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    of = Window.partitionBy("group", "node", "feature")
    upto = of.orderBy("bin")
    sums = sums.select(
        "group", "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"),
        F.sum("g").over(of).alias("g"), F.sum("n").over(of).alias("n"),
    )

    def worth(g, n):
        return g * g / (n + F.lit(float(settings.l2)))

    g, n, gl, nl = (F.col(c) for c in ("g", "n", "gl", "nl"))
    gain = F.round(worth(gl, nl) + worth(g - gl, n - nl) - worth(g, n), PLACES)
    fits = (nl >= settings.least_rows) & (n - nl >= settings.least_rows) & (gain > 0)
    split = F.when(fits, F.struct((-gain).alias("loss"), "feature", "bin", "gl", "nl"))
    best = sums.groupBy("group", "node").agg(F.min(split).alias("s"), F.min_by("g", "feature").alias("g"), F.max("n").alias("n"))
    return best.select("group", "node", "g", "n", "s.feature", "s.bin", "s.gl", "s.nl", (-F.col("s.loss")).alias("gain"))


def _rewriter(sent):
    """Chunks with the newest trees in their predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, bins, _, _, pred in _chunks(batches):
            for tree in sent.value[r["group"]]:
                pred = pred + tree.predict(bins)
            yield _row(r["group"], r["n"], [r["bins"], r["y"], r["hash"], pred.tobytes()])

    return run


def importances(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """(group, feature, importance): the share of all gain that a feature's splits have."""
    rows = [
        (int(g), name, float(v / max(gains.sum(), 1e-300))) for g, gains in model.gains.items() for name, v in zip(model.features, gains.tolist())
    ]
    return spark.createDataFrame(rows, f"{model.by} long, feature string, importance double")


def save_boosted(spark: SparkSession, model: BoostedModel, path: str) -> None:
    """One row for each group."""
    rows = []
    for g in model.trees:
        held = {
            "by": model.by, "features": model.features, "edges": [e.tolist() for e in model.edges[g]], "base": model.base[g],
            "gains": model.gains[g].tolist(), "cap": model.cap, "window": model.window,
            "trees": [[t.feature.tolist(), t.bin.tolist(), t.value.tolist()] for t in model.trees[g]],
        }
        rows.append((int(g), json.dumps(held)))
    spark.createDataFrame(rows, "group long, model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_boosted(spark: SparkSession, path: str) -> BoostedModel:
    found = {r["group"]: json.loads(r["model"]) for r in spark.read.parquet(path).collect()}
    one = next(iter(found.values()))
    tree = lambda t: Tree(np.array(t[0], np.int32), np.array(t[1], np.int32), np.array(t[2]))
    return BoostedModel(
        one["by"], one["features"], {g: [np.array(e, np.float64) for e in m["edges"]] for g, m in found.items()},
        {g: m["base"] for g, m in found.items()}, {g: [tree(t) for t in m["trees"]] for g, m in found.items()},
        {g: np.array(m["gains"]) for g, m in found.items()}, one["cap"], one["window"],
    )
