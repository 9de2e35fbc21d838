"""The dashboard pack: every panel as a named DataFrame over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions import columns as C
from wearline.operators import accuracy as acc
from wearline.operators import fleet


def active_datasets(registry: DataFrame) -> DataFrame:
    return registry.filter("is_active").orderBy("subset").select(C.dataset_label("subset").alias("dataset"))


def engines_of(engines: DataFrame, predictions: DataFrame, dataset: str | None = None) -> DataFrame:
    """Engines that have predictions, in numeric order."""
    dim = engines if dataset is None else engines.filter(F.col("subset") == C.subset_of_label(dataset))
    used = dim.join(predictions.select("engine_id"), "engine_id", "left_semi")
    return used.select(C.dataset_label("subset").alias("dataset"), "unit_number").distinct().orderBy("dataset", "unit_number")


def training_benchmarks(registry: DataFrame) -> DataFrame:
    return registry.filter("is_active").orderBy("subset", "model_id").select(
        C.dataset_label("subset").alias("dataset"), "model_id", "model_version", "algorithm",
        "train_rmse", "train_mae", "train_r2", "train_nasa_score", "trained_at",
    )


def errors_with_subset(errors: DataFrame, predictions: DataFrame, engines: DataFrame, dataset: str | None = None) -> DataFrame:
    """Error rows with engine and subset: ids first, so that only keys are joined."""
    dim = engines if dataset is None else engines.filter(F.col("subset") == C.subset_of_label(dataset))
    owner = predictions.select("prediction_id", "engine_id").join(dim.select("engine_id", "subset"), "engine_id")
    return errors.select("prediction_id", "error", "abs_error", "nasa_penalty", "true_rul", "submitted_at").join(
        owner, "prediction_id"
    )


def fleet_panels(tables: dict[str, DataFrame], as_of) -> dict[str, DataFrame]:
    """Eleven panels; seven of them share one latest-state plan."""
    pred, engines = tables["predictions"], tables["engines"]
    state = fleet.latest_state(pred)
    return {
        "total_engines": fleet.distinct_engines(pred),
        "healthy": fleet.engines_in_status(state, "HEALTHY"),
        "warning": fleet.engines_in_status(state, "WARNING"),
        "critical": fleet.engines_in_status(state, "CRITICAL"),
        "predictions_last_hour": fleet.recent_count(pred, as_of),
        "mean_rul": fleet.mean_rul(state),
        "status_distribution": fleet.status_counts(state),
        "attention": fleet.attention_list(state, engines),
        "activity": fleet.activity(pred, "minute", as_of, 3).orderBy("time"),
        "hourly_rul": fleet.mean_over_time(pred, as_of=as_of, hours=24).orderBy("time"),
        "rul_brackets": fleet.rul_brackets(state),
    }


def engine_panels(tables: dict[str, DataFrame], dataset: str, unit: int) -> dict[str, DataFrame]:
    """Panels of one engine. The engine is looked up by plain columns, so the
    filters reach the scans."""
    engines = tables["engines"]
    pred = fleet.of_engine(tables["predictions"], engines, dataset, unit)
    readings = tables["sensor_readings"]
    rows = fleet.of_engine(readings.drop(*[c for c in ("subset", "unit_number") if c in readings.columns]), engines, dataset, unit)
    state = fleet.latest_state(pred)
    sensors = {"sensors": ["s3", "s4", "s11", "s17"], "more_sensors": ["s2", "s9", "s12", "s20", "s21"]}
    return {
        "engine_variable": engines_of(engines, tables["predictions"], dataset),
        "current_rul": state.select("predicted_rul"),
        "status": state.select("health_status"),
        "last_cycle": state.select("cycle"),
        "total": fleet.row_count(pred, out="predictions"),
        "latency": pred.agg(C.decimal_round(F.avg("latency_ms"), 2).alias("avg_latency")),
        "history_used": state.select("n_history_cycles"),
        "rul_history": fleet.entity_series(pred, "predicted_at", ["predicted_rul"], [], limits=True).orderBy("time"),
        **{k: fleet.entity_series(rows, "recorded_at", v, []).orderBy("time") for k, v in sensors.items()},
        "log": fleet.entity_log(pred).orderBy(F.col("predicted_at").desc(), F.col("prediction_id").desc()),
    }


def accuracy_panels(tables: dict[str, DataFrame], since, until, dataset: str | None = None) -> dict[str, DataFrame]:
    """Panels of model accuracy, of one dataset or all."""
    joined = errors_with_subset(tables["prediction_errors"], tables["predictions"], tables["engines"], dataset)
    errors = tables["prediction_errors"] if dataset is None else joined
    label = C.dataset_label("subset").alias("dataset")
    trend = acc.accuracy_over_time(joined, since=since, until=until).withColumn(
        "metric", C.dataset_label("subset")
    )
    tallies = acc.accuracy(joined, ["subset"])
    return {
        "dataset_variable": active_datasets(tables["model_registry"]),
        "total_predictions": fleet.row_count(tables["predictions"], out="total_predictions"),
        "evaluated": fleet.row_count(errors, out="evaluated"),
        "rmse": errors.agg(C.decimal_round(acc.rmse("abs_error"), 2).alias("rmse")),
        "mae": errors.agg(C.decimal_round(F.avg("abs_error"), 2).alias("mae")),
        "nasa_score": errors.agg(C.decimal_round(F.sum("nasa_penalty"), 1).alias("nasa_score")),
        "on_time": errors.agg(F.round(acc.on_time_percent(), 1).alias("on_time_percent")),
        "benchmarks": training_benchmarks(tables["model_registry"]),
        "live_accuracy": tallies.orderBy("subset").select(
            label, "n_evaluated", C.decimal_round("rmse", 2).alias("live_rmse"),
            C.decimal_round("mae", 2).alias("live_mae"), C.decimal_round("nasa_score", 1).alias("nasa_score"),
        ),
        "rmse_trend": trend.select("time", "metric", F.col("rmse").alias("value")).orderBy("time"),
        "nasa_trend": trend.select("time", "metric", F.col("nasa_score").alias("value")).orderBy("time"),
        "late_early": tallies.orderBy("subset").select(label, "late", "on_time", "early"),
        "errors": joined.select("error"),
    }


def named_queries(tables: dict[str, DataFrame], params: dict) -> dict[str, DataFrame]:
    """All panels: params ``as_of``, ``since``, ``until``, ``dataset``, ``unit``.

    Values are bound as literals or filters, never spliced into SQL text.
    ``accuracy_dataset`` (optional) narrows the accuracy panels.
    """
    groups = {
        "fleet": fleet_panels(tables, params["as_of"]),
        "engine": engine_panels(tables, params["dataset"], params["unit"]),
        "accuracy": accuracy_panels(tables, params["since"], params["until"], params.get("accuracy_dataset")),
    }
    out = {f"{group}.{name}": df for group, panels in groups.items() for name, df in panels.items()}
    out["engine.dataset_variable"] = active_datasets(tables["model_registry"])
    return out
