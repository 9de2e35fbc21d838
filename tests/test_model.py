"""The boosted-tree model: fit, score, save, load."""

import pytest
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.operators import model as mod
from wearline.operators import scoring

KEYS = S.SERIES_KEYS


@pytest.fixture(scope="module")
def log(spark):
    """Two datasets of engines that wear linearly: s2 follows the cycle."""
    cycles = F.explode(F.sequence(F.lit(1), F.lit(60))).alias("cycle")
    base = spark.range(12).select(
        (F.col("id") % 2 + 1).cast("int").alias("subset"), (F.col("id") + 1).alias("unit"), cycles
    )
    noise = F.xxhash64("unit", "cycle") % 5
    sensors = {s: (F.lit(float(i)) + noise).cast("double") for i, s in enumerate(S.ALL_SENSORS)}
    sensors["s2"] = F.col("cycle") * 2.0 + noise
    sensors["s15"] = F.when(F.col("subset") != 1, sensors["s15"])
    return base.select("*", *[c.alias(s) for s, c in sensors.items()], *[F.lit(1.0).alias(c) for c in S.SETTINGS])


@pytest.fixture(scope="module")
def model(log):
    return scoring.train(log, {"maxIter": 5, "stepSize": 0.5}, position="cycle", cap=40)


def test_features_per_dataset(model):
    assert len(model.features[1]) == 40 and len(model.features[2]) == 43
    assert "s15" not in model.features[1]


def test_model_learns_the_trend(log, model):
    rows = scoring.score_history(log, model, "2024-01-01 00:00:00", position="cycle", cap=40)
    early = rows.filter("cycle < 10").agg(F.avg("predicted_rul")).first()[0]
    late = rows.filter("cycle > 50").agg(F.avg("predicted_rul")).first()[0]
    assert early > 30 and late < 15


def test_evaluate_fills_metrics_and_card(spark, log, model):
    truth = spark.range(12).select(
        (F.col("id") % 2 + 1).cast("int").alias("subset"), F.expr("id div 2 + 1").alias("unit_rank"), F.lit(0.0).alias("true_rul")
    )
    scoring.evaluate(model, log, truth)
    assert set(model.metrics) == {1, 2} and model.metrics[1]["RMSE"] < 10
    card = mod.model_card(spark, model).filter("subset = 1").first()
    assert (card["dataset"], card["rul_cap"], card["window"], card["n_features"]) == ("FD001", 40, 30, 40)
    assert set(card["metrics"]) == {"RMSE", "MAE", "R2", "NASA_Score"}


def test_importances_are_the_top_five(spark, model):
    rows = mod.importances(spark, model).collect()
    assert len(rows) == 10
    assert all(0 <= r["importance"] <= 1 for r in rows)


def test_save_and_load_score_alike(spark, log, model, tmp_path):
    mod.save_model(spark, model, str(tmp_path / "m"))
    mod.save_model(spark, model, str(tmp_path / "m"))  # a second save replaces the first
    back = mod.load_model(spark, str(tmp_path / "m"))
    assert (back.features, back.sensors, back.cap, back.window) == (model.features, model.sensors, 40, 30)
    a, b = (scoring.score_latest(log, m).select(*KEYS, "predicted_rul") for m in (model, back))
    assert a.exceptAll(b).count() == 0 and a.count() == 12


def test_missing_values_are_scored_too(log, model):
    holed = log.withColumn("s3", F.when(F.col("unit") != 3, F.col("s3")))
    assert scoring.score_latest(holed, model).filter(F.col("predicted_rul").isNotNull()).count() == 12


def test_life_stage_scores(log, model):
    got = scoring.score_life_stages(log, model, cap=40).orderBy("subset", "unit").collect()
    assert [r["snapshot_pct"] for r in got] == [20, 32, 44, 56, 68, 80] * 2
    assert all(r["snapshot_cycle"] == max(1, round(r["snapshot_pct"] / 100 * 60)) for r in got)


def test_fit_takes_missing_and_infinite_values(spark, log):
    holed = log.withColumns(
        {
            "s3": F.when(F.col("unit") != 2, F.col("s3")),
            "s4": F.when(F.col("cycle") % 7 != 0, F.col("s4")),
            "s9": F.lit(None).cast("double"),
        }
    )
    fitted = scoring.train(holed, {"maxIter": 2}, position="cycle", cap=20, window=5)
    scored = scoring.score_latest(holed, fitted)
    assert scored.filter("predicted_rul IS NULL OR predicted_rul > 20").isEmpty() and scored.count() == 12


def test_limit_and_window_come_from_the_model(log, model):
    assert scoring.cap_of(model) == model.cap and scoring.window_of(model) == model.window
    assert scoring.cap_of(model, 7) == 7 and scoring.cap_of(object()) == S.RUL_CAP
    history = scoring.score_history(log, model, "2024-01-01 00:00:00", position="cycle")
    assert history.agg(F.max("predicted_rul")).first()[0] <= model.cap


def test_rows_without_a_model_are_rejects(log, model):
    more = log.unionByName(log.limit(3).withColumn("subset", F.lit(4)))
    rejects = scoring.unscored(more, model)
    assert [r["reason"] for r in rejects.collect()] == ["no model for this subset"] * 3
    assert scoring.unscored(log, model).isEmpty()


def test_default_settings():
    assert S.GBT_PARAMS["maxIter"] == 1000 and S.GBT_PARAMS["maxDepth"] == 4 and S.GBT_PARAMS["stepSize"] == 0.02


def test_training_writes_its_columns(spark, monkeypatch):
    """The input is evaluated once, with what training needs."""
    from wearline import schema as S
    from wearline.operators import scoring, store

    sensors = [((F.col("id") * (i + 3)) % 17).cast("double").alias(s) for i, s in enumerate(S.ALL_SENSORS)]
    df = spark.range(80).select(F.lit(2).alias("subset"), (F.col("id") % 4).alias("unit"), (F.col("id") / 4).cast("int").alias("cycle"), F.lit("x").alias("more"), *sensors)
    written, keep = [], store.written
    monkeypatch.setattr(store, "written", lambda d: written.append(set(d.columns)) or keep(d))
    model = scoring.train(df, {"maxIter": 1, "maxDepth": 1}, subsets=[2])
    assert model.subsets == [2]
    assert written == [{"subset", "unit", "cycle", *S.ALL_SENSORS}, {"rul", *S.feature_columns(S.ALL_SENSORS)}]


@pytest.mark.parametrize("name", ["tree_scores", "tree_importances", "model_cards"])
def test_queries_ask_for_the_whole_model(spark, monkeypatch, tmp_path, name):
    """The registered queries fit the product's settings, all trees included, on all rows."""
    import __spark_entry__ as contract
    from pyspark.ml.regression import GBTRegressor

    events = spark.range(48).select(
        F.col("id").alias("event_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("ts"), (F.col("id") % 8).alias("user_id"),
        (F.col("id") * 5 % 13).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 9).alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    asked = []

    class Short(GBTRegressor):
        """Notes what is asked of it and fits one tree of that."""

        def fit(self, data):
            asked.append(({p: self.getOrDefault(p) for p in S.GBT_PARAMS}, data.count()))
            return GBTRegressor(featuresCol="_features", labelCol="_label", maxIter=1, maxDepth=1).fit(data)

    monkeypatch.setattr(mod, "GBTRegressor", Short)
    contract.queries()[name](spark, str(tmp_path)).collect()
    assert asked == [(S.GBT_PARAMS, 12)] * 4
