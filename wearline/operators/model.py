"""Boosted-tree regression of remaining life, one model per dataset."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import features as feat


@dataclass
class RulModel:
    """Fitted trees per subset with the ranges that scale their inputs.

    The ranges are plain numbers (a few per feature and subset), so scaling at
    prediction time is a projection and needs no join.
    """

    trees: dict[int, GBTRegressionModel]
    ranges: dict[int, dict[str, tuple[float, float]]]
    features: dict[int, list[str]]
    sensors: dict[int, list[str]]
    cap: int = S.RUL_CAP
    window: int = S.WINDOW
    metrics: dict[int, dict[str, float]] = field(default_factory=dict)

    @property
    def subsets(self) -> list[int]:
        return sorted(self.trees)

    def predict(self, df: DataFrame, subset: int | None = None) -> DataFrame:
        """Rows with column ``prediction``; each subset is scored by its own trees.

        Rows of a subset without a model cannot be scored; ``scoring.unscored``
        gives them with the reason. Pass ``subset`` when all rows belong to it.
        """
        if subset is None:
            return reduce(
                DataFrame.unionByName, [self.predict(df.filter(F.col("subset") == k), k) for k in self.subsets]
            )
        assembled = _assemble(df, self.features[subset], self.ranges[subset])
        return self.trees[subset].transform(assembled).drop("_features")


#: What trees see for a missing value, in fitting and in scoring: a number below every scaled one.
MISSING = -1.0


def _assemble(df: DataFrame, names: list[str], ranges: dict) -> DataFrame:
    def scaled_column(c: str):
        low, high = ranges[c]
        if low is None:  # no row of the training data had a value
            return F.lit(MISSING)
        value = C.min_max_scaled(C.finite(F.col(c).cast("double")), F.lit(low), F.lit(high))
        return F.coalesce(value, F.lit(MISSING))

    scaled = [scaled_column(c).alias(f"_x{i}") for i, c in enumerate(names)]
    inputs = [f"_x{i}" for i in range(len(names))]
    wide = df.select("*", *scaled)
    return VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep").transform(wide).drop(*inputs)


def fit_rul(
    rows: dict[int, DataFrame],
    label: str = "rul",
    params: dict | None = None,
    sensors: dict[int, list[str]] = S.SENSORS,
    cap: int = S.RUL_CAP,
    window: int = S.WINDOW,
    parallelism: int = 4,
) -> RulModel:
    """Fit one model per subset on its labelled feature rows.

    ``params`` override the tree settings; the full setting of 1000 trees costs
    one pass over the data per tree level. Subsets without rows get no model.
    """
    names = {k: S.feature_columns(sensors[k]) for k in rows}
    settings = {**S.GBT_PARAMS, **(params or {})}

    def fit(subset):
        cols = names[subset]
        part = rows[subset].select(
            F.lit(subset).alias("subset"), F.col(label).cast("double").alias("_label"), *[F.col(c).cast("double") for c in cols]
        )
        found = feat.fit_minmax(part, cols, ["subset"]).first()
        if found is None:
            return None
        ranges = {c: (found[f"{c}_min"], found[f"{c}_max"]) for c in cols}
        # The trainer makes some passes of its own before it caches its input.
        data = _assemble(part, cols, ranges).select("_features", "_label").persist()
        try:
            return ranges, GBTRegressor(featuresCol="_features", labelCol="_label", **settings).fit(data)
        finally:
            data.unpersist()

    subsets = sorted(rows)
    spark = rows[subsets[0]].sparkSession
    pool = ThreadPool(max(1, min(parallelism, len(subsets))))
    try:
        fitted = dict(zip(subsets, pool.map(inheritable_thread_target(spark)(fit), subsets)))
    finally:
        pool.close()
    done = {k: v for k, v in fitted.items() if v is not None}
    return RulModel(
        {k: v[1] for k, v in done.items()},
        {k: v[0] for k, v in done.items()},
        {k: names[k] for k in done},
        {k: list(sensors[k]) for k in done},
        cap,
        window,
    )


def importances(spark: SparkSession, model: RulModel, k: int = 5) -> DataFrame:
    """The k features of each subset that the trees rely on most."""
    rows = [
        (subset, name, float(v))
        for subset, trees in model.trees.items()
        for name, v in zip(model.features[subset], trees.featureImportances.toArray())
    ]
    from wearline.operators import entities

    table = spark.createDataFrame(rows, "subset int, feature string, importance double")
    return entities.newest_rows(table, ["subset"], ["importance", "feature"], k)


def model_card(spark: SparkSession, model: RulModel) -> DataFrame:
    """Sensors, cap, window, number of features and metrics of each model."""
    rows = [
        (
            k,
            f"FD00{k}",
            model.sensors[k],
            model.cap,
            model.window,
            len(model.features[k]),
            model.metrics.get(k, {}),
        )
        for k in sorted(model.trees)
    ]
    return spark.createDataFrame(
        rows,
        "subset int, dataset string, sensors array<string>, rul_cap int, window int, n_features int, "
        "metrics map<string,double>",
    )


def save_model(spark: SparkSession, model: RulModel, path: str) -> None:
    """Trees per subset plus one metadata row each."""
    for k, trees in model.trees.items():
        trees.write().overwrite().save(f"{path}/trees/{k}")
    meta = [
        (k, json.dumps({"version": 2, "ranges": model.ranges[k], "features": model.features[k],
                        "sensors": model.sensors[k], "cap": model.cap, "window": model.window,
                        "metrics": model.metrics.get(k, {})}))
        for k in model.trees
    ]
    spark.createDataFrame(meta, "subset int, meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> RulModel:
    meta = {r["subset"]: json.loads(r["meta"]) for r in spark.read.parquet(f"{path}/meta").collect()}
    any_meta = next(iter(meta.values()))
    return RulModel(
        {k: GBTRegressionModel.load(f"{path}/trees/{k}") for k in sorted(meta)},
        {k: {c: tuple(v) for c, v in m["ranges"].items()} for k, m in meta.items()},
        {k: m["features"] for k, m in meta.items()},
        {k: m["sensors"] for k, m in meta.items()},
        any_meta["cap"],
        any_meta["window"],
        {k: m["metrics"] for k, m in meta.items() if m["metrics"]},
    )
