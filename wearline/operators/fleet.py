"""Fleet and single-machine questions over the prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import entities
from wearline.operators import series

LOG_ORDER = ["predicted_at", "prediction_id"]


def latest_state(pred: DataFrame) -> DataFrame:
    """Newest prediction per engine; ties go to the higher prediction_id."""
    return entities.latest_row(pred, ["engine_id"], LOG_ORDER)


def with_engines(df: DataFrame, engines: DataFrame) -> DataFrame:
    """Rows joined with the engine dimension. No hint: the dimension grows with
    the fleet, so its size at run time decides between broadcast and shuffle."""
    return df.join(engines.select("engine_id", "unit_number", "subset"), "engine_id")


def fleet_summary(pred: DataFrame, engines: DataFrame) -> DataFrame:
    """Per subset and status: engines, mean and least remaining life by latest prediction."""
    state = with_engines(latest_state(pred.select("engine_id", "predicted_rul", *LOG_ORDER)), engines)
    return state.groupBy("subset", C.health_status("predicted_rul").alias("health_status")).agg(
        F.count(F.lit(1)).alias("engine_count"),  # the state has one row per engine
        C.decimal_round(F.avg("predicted_rul"), 1).alias("avg_predicted_rul"),
        C.decimal_round(F.min("predicted_rul"), 1).alias("min_predicted_rul"),
    )


def status_counts(state: DataFrame) -> DataFrame:
    """One row with a count per status, zero when a status is absent."""
    names = {"healthy": "HEALTHY", "warning": "WARNING", "critical": "CRITICAL"}
    return state.agg(*[F.count_if(F.col("health_status") == v).alias(k) for k, v in names.items()])


def status_totals(summary: DataFrame) -> DataFrame:
    """Fleet counts over the subsets of a fleet summary, zero-filled."""
    names = {"healthy": "HEALTHY", "warning": "WARNING", "critical": "CRITICAL"}
    return summary.agg(
        *[
            F.coalesce(F.sum(F.when(F.upper("health_status") == v, F.col("engine_count"))), F.lit(0)).alias(k)
            for k, v in names.items()
        ]
    )


def engines_in_status(state: DataFrame, status: str) -> DataFrame:
    return state.agg(F.count_if(F.col("health_status") == status).alias("engines"))


def statuses_by_dataset(state: DataFrame, by: str = "subset") -> DataFrame:
    """Sorted set of statuses seen in each dataset."""
    return state.groupBy(C.dataset_label(by).alias("dataset")).agg(
        F.count(F.lit(1)).alias("engines"), F.array_sort(F.collect_set("health_status")).alias("statuses")
    )


def mean_rul(state: DataFrame) -> DataFrame:
    return state.agg(C.decimal_round(F.avg("predicted_rul"), 1).alias("avg_rul"))


def rul_brackets(state: DataFrame, edges=S.RUL_BRACKETS) -> DataFrame:
    """Engines per bracket of remaining life, lowest bracket first."""
    label = None
    for edge, name in edges:
        if edge is None:
            label = label.otherwise(name)
        else:
            cond = F.col("predicted_rul") <= edge
            label = F.when(cond, name) if label is None else label.when(cond, name)
    return (
        state.groupBy(label.alias("bracket"))
        .agg(F.count(F.lit(1)).alias("engines"), F.min("predicted_rul").alias("least_rul"))
        .orderBy("least_rul")
    )


def distinct_engines(pred: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("engine_id", 0.02) if approximate else F.countDistinct("engine_id")
    return pred.agg(count.alias("total_engines"))


def row_count(df: DataFrame, by: list[str] | None = None, out: str = "n") -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias(out))


def since_hours(df: DataFrame, as_of, hours: int, time: str = "predicted_at", strict: bool = False) -> DataFrame:
    """Rows within the last hours before ``as_of``; ``strict`` leaves the edge out."""
    edge = C.hours_before(as_of, F.lit(hours))
    return df.filter(F.col(time) > edge if strict else F.col(time) >= edge)


def recent_count(pred: DataFrame, as_of, hours: int = 1) -> DataFrame:
    return since_hours(pred, as_of, hours, strict=True).agg(F.count(F.lit(1)).alias("predictions"))


def activity(pred: DataFrame, unit: str = "minute", as_of=None, hours: int = 3) -> DataFrame:
    """Predictions per time bucket over the last hours."""
    rows = pred if as_of is None else since_hours(pred, as_of, hours)
    return rows.groupBy(C.truncate_time(unit, "predicted_at").alias("time")).agg(F.count(F.lit(1)).alias("predictions"))


def mean_over_time(pred: DataFrame, value: str = "predicted_rul", unit: str = "hour", as_of=None, hours: int = 24) -> DataFrame:
    rows = pred if as_of is None else since_hours(pred, as_of, hours)
    return rows.groupBy(C.truncate_time(unit, "predicted_at").alias("time")).agg(
        C.decimal_round(F.avg(value), 1).alias("avg_remaining_life")
    )


def attention_list(state: DataFrame, engines: DataFrame, n: int = 50) -> DataFrame:
    """The n engines in alarm with the least remaining life."""
    alarmed = state.filter(F.col("health_status").isin("CRITICAL", "WARNING"))
    return (
        with_engines(alarmed, engines)
        .select(
            "unit_number",
            C.dataset_label("subset").alias("dataset"),
            "cycle",
            "predicted_rul",
            "health_status",
            "predicted_at",
        )
        .orderBy("predicted_rul", "predicted_at", "dataset", "unit_number")
        .limit(n)
    )


def of_engine(df: DataFrame, engines: DataFrame, dataset: str | None = None, unit: int | None = None) -> DataFrame:
    """Rows of one engine (or one dataset, or all) with its dimension columns."""
    dim = engines
    if dataset is not None:
        dim = dim.filter(F.col("subset") == C.subset_of_label(dataset))
    if unit is not None:
        dim = dim.filter(F.col("unit_number") == unit)
    return with_engines(df, dim)


def entity_log(pred: DataFrame, keys: list[str] = ["engine_id"], n: int = 100) -> DataFrame:
    """The newest n predictions of each engine."""
    log = entities.newest_rows(pred, keys, LOG_ORDER, n)
    return log.select(
        *keys, "prediction_id", "predicted_at", "cycle", "predicted_rul", "health_status", "latency_ms", "endpoint"
    )


def entity_series(df: DataFrame, time: str, cols: list[str], keys: list[str] = ["engine_id"], limits: bool = False) -> DataFrame:
    """Chosen columns of each engine in time order; ``limits`` adds the alert lines."""
    lines = (
        [F.lit(float(S.CRITICAL_LIMIT)).alias("critical_threshold"), F.lit(float(S.WARNING_LIMIT)).alias("warning_threshold")]
        if limits
        else []
    )
    return df.select(*keys, F.col(time).alias("time"), *cols, *lines)


def sensor_long(df: DataFrame, sensors: list[str], ids: list[str]) -> DataFrame:
    """One row per sensor value with its readable name."""
    long = df.select(*ids, *sensors).unpivot(ids, sensors, "sensor", "value")
    return long.withColumn("label", C.sensor_label("sensor"))


def mean_latency(pred: DataFrame, by: list[str] = ["engine_id"]) -> DataFrame:
    return pred.groupBy(*by).agg(C.decimal_round(F.avg("latency_ms"), 2).alias("avg_latency"))


def fleet_statistics(pred: DataFrame, engines: DataFrame, as_of) -> DataFrame:
    """Totals and the health breakdown in one row, from one pass over the log.

    The log is reduced to a row per engine before the dimension is joined; the
    breakdown has at most one entry per subset and status.
    """
    edge = C.hours_before(as_of, F.lit(1))
    per_engine = pred.groupBy("engine_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("predicted_at") > edge).alias("_recent"),
        F.max_by("predicted_rul", F.struct(*LOG_ORDER)).alias("predicted_rul"),
    )
    groups = (
        per_engine.join(engines.select("engine_id", "subset"), "engine_id", "left")
        .groupBy("subset", C.health_status("predicted_rul").alias("health_status"))
        .agg(
            F.sum("_n").alias("_n"),
            F.sum("_recent").alias("_recent"),
            F.count(F.lit(1)).alias("engine_count"),
            C.decimal_round(F.avg("predicted_rul"), 1).alias("avg_predicted_rul"),
            C.decimal_round(F.min("predicted_rul"), 1).alias("min_predicted_rul"),
        )
    )
    entry = F.struct("subset", "health_status", "engine_count", "avg_predicted_rul", "min_predicted_rul")
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_predictions"),
        F.coalesce(F.sum("_recent"), F.lit(0)).alias("predictions_last_hour"),
        F.array_sort(F.collect_list(F.when(F.col("subset").isNotNull(), entry))).alias("health_breakdown"),
    )


def run_summary(scored: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Per series: rows, final remaining life and status."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_cycles"),
        F.max_by("predicted_rul", seq).alias("final_rul"),
    ).withColumn("health_status", C.health_status("final_rul"))


def run_totals(scored: DataFrame, group: str, entity: str, seq: str) -> DataFrame:
    """Per group: predictions made, series handled and time span."""
    per = scored.groupBy(group, entity).agg(F.count(F.lit(1)).alias("_n"), F.max(seq).alias("_last"))
    return per.groupBy(group).agg(
        F.sum("_n").alias("total_predictions"),
        F.count(F.lit(1)).alias("engines_processed"),
        F.max("_last").alias("time_span_hours"),
    )


def status_changes(
    df: DataFrame, keys: list[str], seq: str, status: str = "health_status", position: str | None = None
) -> DataFrame:
    """Rows whose status differs from the row before, with that status. ``position`` names a
    gap-free counter from 1 where the rows have one."""
    numbered = df if position else series.number_rows(df, keys, [seq], "_position")
    out = series.over_trailing_rows(
        numbered, keys, position or "_position", 1, lambda w: {"previous": F.lag(status).over(w)}
    )
    changed = out.filter(F.col("previous") != F.col(status))
    return changed if position else changed.drop("_position")


def engine_sketches(pred: DataFrame, by: list[str] = ["subset"], time: str = "predicted_at", engine: str = "engine_id",
                    precision: int = 16) -> DataFrame:
    """A mergeable sketch of the engines of each minute and group, to be stored. Its size is bounded
    by 2^precision bytes whatever the number of rows, and the error of a count by about
    1.04 / 2^(precision / 2): 0.4 % for 16; small counts are exact."""
    minute = C.truncate_time("minute", time).alias("minute")
    return pred.groupBy(minute, *by).agg(F.hll_sketch_agg(engine, F.lit(precision)).alias("engines"))


def engines_from_sketches(sketches: DataFrame, unit: str, by: list[str] = [], since=None, until=None) -> DataFrame:
    """Engines per time bucket of any unit from a minute up, and group, from stored sketches alone."""
    rows = sketches
    if since is not None:
        rows = rows.filter(F.col("minute") >= C.time_literal(since))
    if until is not None:
        rows = rows.filter(F.col("minute") < C.time_literal(until))
    merged = rows.groupBy(C.truncate_time(unit, "minute").alias("time"), *by).agg(F.hll_union_agg("engines").alias("_s"))
    return merged.select("time", *by, F.hll_sketch_estimate("_s").alias("engines"))
