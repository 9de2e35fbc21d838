"""The service's stored tables: engines, readings, predictions, errors and rejects, written together.

One commit (see ``versions``) carries a whole micro-batch, so no reader sees a prediction without
its engine, and a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import accuracy as acc
from wearline.operators import scoring, series, store
from wearline.operators import truth as tr
from wearline.operators import validate as val
from wearline.operators.versions import Commit, Spec, Tables
from wearline.sources import requests as req

ENGINE = ["unit_number", "subset"]
READING = ["subset", "engine_id", "cycle"]
#: Columns of a scored row that are no part of the reading.
OF_PREDICTION = [
    "model_id", "predicted_rul", "prediction", "health_status", "n_history_cycles", "note", "unit_number", "predicted_at"
]
BUCKETS = 64


def specs(buckets: int = BUCKETS) -> dict[str, Spec]:
    """How each table is kept. Readings and engines are looked up by key, the logs are appended."""
    return {
        "engines": Spec("first", ENGINE, buckets=buckets),
        "sensor_readings": Spec("latest", READING, buckets=buckets),
        "predictions": Spec("log"),
        "prediction_errors": Spec("first", ["prediction_id"], buckets=buckets),
        "rejects": Spec("log"),
    }


def open_tables(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Tables:
    store.checkpoint_folder(spark)
    return Tables(spark, path, specs(buckets))


def reject_rows(rows: DataFrame, batch_id: int) -> DataFrame:
    """Rejects in one shape: the key as far as it is known, the reason, and the row as JSON."""
    named = ["unit_number", "subset", "cycle"]
    known = [(F.col(c) if c in rows.columns else F.lit(None)).cast("long").alias(c) for c in named]
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("reason", "reasons")]))
    reason = F.concat_ws("; ", "reasons") if "reasons" in rows.columns else F.col("reason")
    return rows.select(*known, reason.alias("reason"), row.alias("row"), F.lit(batch_id).cast("long").alias("batch_id"))


def write_rows(
    commit: Commit, rows: DataFrame, registry: DataFrame, batch_id: int, as_of, endpoint: str = "/predict/batch",
    cap: int = S.RUL_CAP, rejects: list[DataFrame] = [], arrival: list[str] = [],
) -> DataFrame:
    """Adds scored readings to a commit: engines, readings, predictions and rejects.

    ``rows`` holds subset, unit_number, cycle, sensors, predicted_rul and n_history_cycles. Rows
    without a complete key and rows that no active model is for become rejects. Two rows of one
    cycle are two predictions; the later one (by ``position`` in the request, else by the numeric
    columns ``arrival`` and the values) is the stored reading. Returns the log rows.
    """
    rows = rows.drop(*[c for c in rows.columns if c.endswith(("_rm", "_rs"))])
    whole, broken = store.without_key(rows, [*ENGINE, "cycle"])
    whole = store.written(store.with_positions(whole, [*ENGINE, "cycle"], arrival))
    engines = commit.get_or_create("engines", whole, "engine_id", at=F.col("unit_number"))
    known = series.salted_join(whole, engines.select(*ENGINE, "engine_id"), ENGINE, ["cycle", "position"])
    stored, no_model = store.with_active_model(known, registry)
    stored = store.written(stored)
    bad = reject_rows(broken, batch_id).unionByName(reject_rows(no_model.drop("engine_id", "position"), batch_id))
    for more in rejects:
        bad = bad.unionByName(reject_rows(more, batch_id))
    commit.append("rejects", bad)
    at = F.coalesce("recorded_at", C.time_literal(as_of)) if "recorded_at" in rows.columns else C.time_literal(as_of)
    readings = stored.drop(*OF_PREDICTION, *arrival).withColumn("recorded_at", at)
    commit.upsert("sensor_readings", readings, store.tie_break(readings, F.col("position")))
    log = store.prediction_rows(stored, endpoint, f"{commit.writer}-{batch_id}", as_of, cap)
    commit.append("predictions", log)
    return log


def write_batch(
    spark: SparkSession, path: str, rows: DataFrame, registry: DataFrame, batch_id: int, as_of,
    endpoint: str = "/predict/batch", cap: int = S.RUL_CAP, arrival: list[str] = [], buckets: int = BUCKETS,
) -> None:
    """Store one micro-batch of scored readings in one commit; see ``write_rows``."""
    with open_tables(spark, path, buckets).commit("batch", batch_id) as commit:
        if not commit.skipped:
            write_rows(commit, rows, registry, batch_id, as_of, endpoint, cap, arrival=arrival)


def serving_batch(path: str, model, registry: DataFrame, as_of=None, json_col: str = "value", arrival: list[str] = [],
                  buckets: int = BUCKETS):
    """foreachBatch handler: JSON bodies with several snapshots are parsed, checked, scored and
    stored in one commit per batch. Bodies that do not parse and rows that fail a check are rejects.

    Predictions are stamped ``as_of``, by default the time at which the batch is handled.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with open_tables(spark, path, buckets).commit("serving", batch_id) as commit:
            if commit.skipped:
                return
            now = as_of if as_of is not None else spark.sql("SELECT CAST(now() AS TIMESTAMP_NTZ)").first()[0]
            # Each body is parsed once; of those without readings the text is kept.
            parsed = store.written(req.parse_requests(batch, "batch", json_col, empty=True))
            rows = parsed.filter(F.col("item").isNotNull()).drop(json_col).withColumnRenamed("engine_id", "unit")
            good, bad = val.validate(rows, val.reading_rules())
            empty = parsed.filter(F.col("item").isNull()).select(*batch.columns)
            empty = empty.withColumn("reason", F.lit("no readable instances"))
            extra = [c for c in batch.columns if c not in (json_col, *arrival)]
            scored = scoring.score_snapshots(good, model).withColumnRenamed("unit", "unit_number")
            scored = scored.select(*[c for c in rows.columns if c not in (*extra, "unit")], "unit_number", "predicted_rul", "n_history_cycles")
            write_rows(
                commit, store.written(scored), registry, batch_id, now, rejects=[bad.withColumnRenamed("unit", "unit_number"), empty],
                arrival=[*arrival, "item"],
            )

    return handle


def stream_serving(stream: DataFrame, path: str, model, registry: DataFrame, **options):
    """The serving chain over a stream of request bodies; returns the unstarted writer."""
    handler = serving_batch(path, model, registry, **options)
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", f"{path}/_checkpoint")


def submit_truths(spark: SparkSession, path: str, truth: DataFrame, batch_id: int, buckets: int = BUCKETS) -> None:
    """Store the errors of submitted truths: the first of a prediction counts, unknown ids are rejects."""
    tables = open_tables(spark, path, buckets)
    with tables.commit("truths", batch_id) as commit:
        if commit.skipped:
            return
        valid, bad = val.validate(store.written(truth), val.truth_rules())
        log = tables.read("predictions").select("prediction_id", "predicted_rul", "engine_id")
        errors, unknown = tr.score_truths(log, valid, ["engine_id"])
        store_errors(commit, errors)
        commit.append("rejects", reject_rows(unknown, batch_id).unionByName(reject_rows(bad, batch_id)))


def store_errors(commit: Commit, errors: DataFrame) -> None:
    """Error rows by the rule that the first of a prediction stays."""
    errors = store.materialised(errors.select(
        "prediction_id", "engine_id", "predicted_rul", "true_rul", "submitted_at", "error", "abs_error", "nasa_penalty", "band"
    ))
    commit.insert_first("prediction_errors", errors, [F.col("submitted_at"), F.col("true_rul")])


def store_replay(
    spark: SparkSession, path: str, test: DataFrame, truth: DataFrame, model, registry: DataFrame, batch_id: int, as_of,
    sensors: list[str] = S.ALL_SENSORS, buckets: int = BUCKETS,
) -> DataFrame:
    """Replay a test set and keep it: the last row of every engine is scored and stored like a
    request, its positional truth is attached and the errors are stored, all in one commit.

    Engines without a truth and truths without an engine are rejects. Returns the accuracy per
    dataset of the errors that the replay produced, read back from the tables.
    """
    tables = open_tables(spark, path, buckets)
    with tables.commit("replay", batch_id) as commit:
        if not commit.skipped:
            scored = scoring.score_latest(test, model, sensors)
            keep = [*S.SERIES_KEYS, "cycle", "predicted_rul", *[s for s in sensors if s in scored.columns]]
            scored = store.materialised(scored.select(*keep, F.col("cycle").alias("n_history_cycles")))
            matched, lost = tr.attach_truth_by_rank(scored.select(*S.SERIES_KEYS, "cycle", "predicted_rul"), truth, S.SERIES_KEYS)
            rows = scored.withColumnRenamed("unit", "unit_number")
            lost = lost.withColumnRenamed("unit", "unit_number")
            log = write_rows(commit, rows, registry, batch_id, as_of, "/replay", rejects=[lost])
            engines = tables.resolve("engines", commit.changed["engines"])
            named = matched.join(engines.withColumnRenamed("unit_number", "unit"), S.SERIES_KEYS)
            truths = named.select("engine_id", "cycle", "true_rul")
            joined = log.select("prediction_id", "engine_id", "cycle", "predicted_rul").join(truths, ["engine_id", "cycle"])
            errors = tr.error_columns(joined.withColumn("submitted_at", C.time_literal(as_of)))
            store_errors(commit, errors)
    stored = tables.read("prediction_errors").join(tables.read("engines"), "engine_id")
    ids = tables.read("predictions").filter(F.col("request_id") == f"replay-{batch_id}").select("prediction_id")
    return acc.accuracy(stored.join(ids, "prediction_id", "left_semi"), ["subset"])
