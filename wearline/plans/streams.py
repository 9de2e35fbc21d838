"""Registered streaming queries: the events table replayed as a stream until
its end, results written to the shared folder and read back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import database, store, versions
from wearline.operators import truth as tr
from wearline.plans.catalog import query, rounded
from wearline.plans.fixtures import Tables
from wearline.streaming import carry, windows


def run_folder(spark: SparkSession) -> str:
    """A folder of its own for one run, below the shared folder."""
    return f"{store.checkpoint_folder(spark)}/wearline/{uuid.uuid4().hex}"


#: Rows of a file of a feed, and bodies of requests, which are some kilobytes each.
FILE_ROWS, FILE_BODIES = 250_000, 10_000


def feed(t: Tables, rows: DataFrame, at: str, parts: int = 4, file_rows: int = FILE_ROWS) -> DataFrame:
    """Rows as a stream: files in the order of ``at``, equally many for each micro-batch, written by as many tasks."""
    rows = store.written(rows)
    seconds = F.col(at).cast("timestamp").cast("double")
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx(seconds, shares, 10_000).alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    cuts = found["cuts"] or []
    files = max(1, math.ceil(found["n"] / (len(cuts) + 1) / file_rows))
    path = f"{run_folder(t.spark)}/feed"
    there = versions.Files(t.spark, path)
    for i in range(len(cuts) + 1):
        part = F.lit(True) if i == 0 else seconds > cuts[i - 1]
        part = part if i == len(cuts) else part & (seconds <= cuts[i])
        part = rows.filter(F.coalesce(part, F.lit(i == 0)))
        # Files are taken in the order of their times, so each micro-batch is written by itself.
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
        # Tasks without rows write none; a micro-batch is made of empty files then.
        missing = (i + 1) * files - sum(name.startswith("part-") for name in there.names(""))
        for _ in range(missing):
            t.spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def event_rows(t: Tables) -> DataFrame:
    """Events as stored predictions: all columns follow from the row alone."""
    subset = (F.col("user_id") % 4 + 1).cast("int")
    raw = (F.col("event_id") * 7 % 150).cast("double")
    return t.source("events").select(
        F.col("event_id").alias("prediction_id"),
        (F.col("user_id") * 10 + subset).alias("engine_id"),
        subset.alias("subset"),
        C.clip_rul(raw).alias("predicted_rul"),
        C.health_status(C.clip_rul(raw)).alias("health_status"),
        F.col("value").alias("s2"),
        F.col("ts").alias("predicted_at"),
    )


def event_stream(t: Tables) -> DataFrame:
    return feed(t, event_rows(t), "predicted_at")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream to the end of its input into parquet and read that."""
    out = f"{folder}/out"
    run = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(out)
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


_EVENTS_SQL = """(SELECT event_id AS prediction_id, user_id * 10 + user_id % 4 + 1 AS engine_id, CAST(user_id % 4 + 1 AS INTEGER) AS subset,
       CAST(least(event_id * 7 % 150, 125) AS DOUBLE) AS predicted_rul, value AS s2, ts AS predicted_at,
       CASE WHEN event_id * 7 % 150 <= 10 THEN 'CRITICAL' WHEN event_id * 7 % 150 <= 30 THEN 'WARNING' ELSE 'HEALTHY' END AS health_status FROM events)"""
# Windows that the watermark has closed by the end of the stream.
_CLOSED = "+ INTERVAL 1 {unit} <= (SELECT date_trunc('millisecond', max({time})) FROM {source} w) - INTERVAL 10 MINUTE"


@query("stream_activity", "R1", f"""
SELECT CAST(date_trunc('minute', predicted_at) AS TIMESTAMP) AS time, count(*) AS predictions FROM {_EVENTS_SQL} e
WHERE date_trunc('minute', predicted_at) {_CLOSED.format(unit='MINUTE', time='ts', source='events')} GROUP BY 1""")
def _(t: Tables):
    return run_to_table(windows.stream_activity(event_stream(t)), run_folder(t.spark))


@query("stream_mean_rul", "R2", f"""
SELECT CAST(date_trunc('hour', predicted_at) AS TIMESTAMP) AS time, CAST(round(CAST(avg(predicted_rul) AS DECIMAL(38,6)), 1) AS DOUBLE) AS avg_remaining_life
FROM {_EVENTS_SQL} e WHERE date_trunc('hour', predicted_at) {_CLOSED.format(unit='HOUR', time='ts', source='events')} GROUP BY 1""")
def _(t: Tables):
    return run_to_table(windows.stream_mean_rul(event_stream(t)), run_folder(t.spark))


@query("stream_accuracy", "R2", f"""
SELECT CAST(date_trunc('hour', predicted_at) AS TIMESTAMP) AS time, subset, CAST(round(CAST(sqrt(avg(d * d)) AS DECIMAL(38,6)), 2) AS DOUBLE) AS rmse,
       CAST(round(CAST(sum(CASE WHEN d < 0 THEN exp(-d / 13) - 1 ELSE exp(d / 10) - 1 END) AS DECIMAL(38,6)), 1) AS DOUBLE) AS nasa_score
FROM (SELECT *, predicted_rul - prediction_id % 100 AS d FROM {_EVENTS_SQL} e) x
WHERE date_trunc('hour', predicted_at) {_CLOSED.format(unit='HOUR', time='ts', source='events')} GROUP BY 1, subset""")
def _(t: Tables):
    rows = event_stream(t).withColumn("true_rul", (F.col("prediction_id") % 100).cast("double"))
    errors = tr.error_columns(rows).withColumnRenamed("predicted_at", "submitted_at")
    return run_to_table(windows.stream_accuracy(errors), run_folder(t.spark))


@query("stream_rolling_features", "R3", """
SELECT engine_id, cycle, round(s2_rm, 6) AS s2_rm, round(s2_rs, 6) AS s2_rs FROM features""")
def _(t: Tables):
    folder = run_folder(t.spark)
    rows = feed(t, t.readings.select("engine_id", "cycle", "s2", "recorded_at"), "recorded_at")
    writer = carry.stream_rolling_features(rows, folder, ["engine_id"], "cycle", ["s2"], step=1)
    writer.trigger(availableNow=True).start().awaitTermination()
    out = carry.output(t.spark, folder, "features").select("engine_id", "cycle", "s2_rm", "s2_rs")
    return rounded(out, 6, "s2_rm", "s2_rs")


@query("stream_rejects", "R3 V4", """
SELECT engine_id, cycle, 'gap before' AS reason, TRUE AS kept
FROM (SELECT engine_id, cycle, lag(cycle) OVER (PARTITION BY engine_id ORDER BY cycle) AS before
      FROM readings WHERE event_id % 20 NOT IN (3, 5)) r WHERE cycle - before > 1
UNION ALL
SELECT engine_id, -1, 'no sequence number', FALSE FROM readings WHERE event_id % 20 = 3""")
def _(t: Tables):
    # Some readings have lost their cycle and some never arrive.
    folder = run_folder(t.spark)
    rows = t.readings.filter("event_id % 20 <> 5").withColumn("cycle", F.when(F.col("event_id") % 20 != 3, F.col("cycle")))
    rows = feed(t, rows.select("engine_id", "cycle", "s2", "recorded_at"), "recorded_at")
    writer = carry.stream_rolling_features(rows, folder, ["engine_id"], "cycle", ["s2"], step=1)
    writer.trigger(availableNow=True).start().awaitTermination()
    rejects = carry.output(t.spark, folder, "rejects")
    return rejects.select("engine_id", F.coalesce("cycle", F.lit(-1)).alias("cycle"), "reason", "kept")


@query("stream_latest", "R4", f"""
SELECT engine_id, max(prediction_id) AS prediction_id, arg_max(predicted_rul, prediction_id) AS predicted_rul,
       arg_max(health_status, prediction_id) AS health_status FROM {_EVENTS_SQL} e GROUP BY engine_id""")
def _(t: Tables):
    folder = run_folder(t.spark)
    rows = event_stream(t).select("engine_id", "prediction_id", "predicted_rul", "health_status")
    carry.stream_latest(rows, folder, ["engine_id"], ["prediction_id"]).trigger(availableNow=True).start().awaitTermination()
    return carry.newest_version(t.spark, folder)


WAIT_DAYS, REMEMBER_DAYS = 3, 6
#: Truths of the predictions whose id leaves each remainder by 10: hours after the prediction, what is added to the value, and
#: what is added to the id.
TRUTHS = [
    (1, 1, 0, 0), (2, 1, 0, 0), (3, 1, 0, 0), (4, 1, 0, 0), (4, 2, 5, 0), (5, -1, 0, 0), (6, -1, 0, 0), (6, 1, 2, 0),
    (7, 24 * WAIT_DAYS + 24, 0, 0), (8, 1, 0, 10**12), (9, 1, 0, 0), (9, 24 * WAIT_DAYS + 24, 1, 0),
]
_TRUTHS_SQL = f"""(SELECT prediction_id + more AS prediction_id, CAST(prediction_id % 100 + plus AS DOUBLE) AS true_rul,
       predicted_at + hours * INTERVAL 1 HOUR AS submitted_at
FROM {_EVENTS_SQL} e JOIN (VALUES {', '.join(map(str, TRUTHS))}) v(of, hours, plus, more) ON prediction_id % 10 = of)"""
_END = f"""(SELECT least((SELECT max(predicted_at) FROM {_EVENTS_SQL} a), (SELECT max(submitted_at) FROM {_TRUTHS_SQL} b)) - INTERVAL 10 MINUTE)"""


@query("stream_truth_join", "R5 J7 K5", f"""
SELECT prediction_id, true_rul, error, outcome FROM (
  SELECT t.prediction_id, t.true_rul, e.predicted_rul - t.true_rul AS error, 'in time' AS outcome,
         row_number() OVER (PARTITION BY t.prediction_id ORDER BY t.submitted_at, t.true_rul) AS rn
  FROM {_TRUTHS_SQL} t JOIN {_EVENTS_SQL} e ON e.prediction_id = t.prediction_id
  WHERE t.submitted_at BETWEEN e.predicted_at AND e.predicted_at + INTERVAL {WAIT_DAYS} DAY) q WHERE rn = 1
UNION ALL
SELECT t.prediction_id, t.true_rul, NULL, CASE WHEN t.submitted_at < e.predicted_at THEN 'before its prediction' ELSE 'too late' END
FROM {_TRUTHS_SQL} t JOIN {_EVENTS_SQL} e ON e.prediction_id = t.prediction_id
WHERE t.submitted_at NOT BETWEEN e.predicted_at AND e.predicted_at + INTERVAL {WAIT_DAYS} DAY
UNION ALL
SELECT prediction_id, true_rul, NULL, 'unknown prediction_id' FROM {_TRUTHS_SQL} t
WHERE prediction_id NOT IN (SELECT event_id FROM events) AND submitted_at + INTERVAL {WAIT_DAYS} DAY < {_END}
UNION ALL
SELECT prediction_id, NULL, NULL, 'no truth' FROM {_EVENTS_SQL} e
WHERE prediction_id NOT IN (SELECT prediction_id FROM {_TRUTHS_SQL} t) AND predicted_at + INTERVAL {REMEMBER_DAYS} DAY < {_END}""")
def _(t: Tables):
    rows = event_rows(t)
    kinds = t.spark.createDataFrame(TRUTHS, "of long, hours int, plus long, more long")
    truth = rows.join(F.broadcast(kinds), F.col("prediction_id") % 10 == F.col("of")).select(
        (F.col("prediction_id") + F.col("more")).alias("prediction_id"),
        (F.col("prediction_id") % 100 + F.col("plus")).cast("double").alias("true_rul"),
        F.timestamp_add("HOUR", F.col("hours"), F.col("predicted_at")).cast("timestamp_ntz").alias("submitted_at"),
    )
    folder = run_folder(t.spark)
    writer = windows.stream_truths(
        feed(t, rows.select("prediction_id", "predicted_rul", "predicted_at"), "predicted_at"), feed(t, truth, "submitted_at"),
        folder, longest_wait=f"{WAIT_DAYS} days", remember=f"{REMEMBER_DAYS} days",
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    stored = windows.truth_tables(t.spark, folder)
    none = F.lit(None).cast("double")
    scored = stored.read("errors").select("prediction_id", "true_rul", "error", F.lit("in time").alias("outcome"))
    lost = stored.read("rejects").select("prediction_id", "true_rul", none.alias("error"), F.col("reason").alias("outcome"))
    left = stored.read("open").select("prediction_id", none.alias("true_rul"), none.alias("error"), "outcome")
    return scored.unionByName(lost).unionByName(left)


@query("stream_alerts", "R6 F1", """
SELECT engine_id, cycle, health_status, previous
FROM (SELECT *, lag(health_status) OVER (PARTITION BY engine_id ORDER BY cycle) AS previous FROM predictions) x
WHERE previous <> health_status""")
def _(t: Tables):
    folder = run_folder(t.spark)
    rows = feed(t, t.predictions.select("engine_id", "cycle", "health_status", "predicted_at"), "predicted_at")
    writer = carry.stream_alerts(rows, folder, ["engine_id"], "cycle")
    writer.trigger(availableNow=True).start().awaitTermination()
    return carry.output(t.spark, folder, "alerts").select("engine_id", "cycle", "health_status", "previous")


@query("stream_serving", "K9 S6 V1 M6 K1 K3 K4", """
SELECT unit AS unit_number, subset, cycle, predicted_rul, CASE WHEN predicted_rul <= 10 THEN 'CRITICAL' WHEN predicted_rul <= 30 THEN 'WARNING'
       ELSE 'HEALTHY' END AS health_status, n_predictions, s2, '' AS reason
FROM (SELECT r.unit, r.subset, r.cycle, round(least(greatest(b.intercept + b.slope * (r.cycle + r.s2), 0), 125), 1) AS predicted_rul, r.s2,
             CASE WHEN (r.cycle - 1) // 20 % 5 = 0 THEN 2 ELSE 1 END AS n_predictions
      FROM readings r JOIN baseline b ON b.subset = r.subset) q
UNION ALL
SELECT 0, 0, 0, 0, '', count(*), 0, 'no readable instances' FROM (SELECT DISTINCT unit FROM readings) u""")
def _(t: Tables):
    # Three micro-batches and more: every body once, some a second time, and one for each engine that does not parse.
    bodies = t.batch_requests.withColumn("turn", F.col("chunk") % 3)
    again = bodies.filter("chunk % 5 = 0").withColumn("turn", F.lit(3).cast("long"))
    broken = t.engines.select(
        F.col("unit_number").alias("sender"), F.lit(-1).cast("long").alias("chunk"), F.lit('{"instances": [').alias("value"),
        F.lit(1).cast("long").alias("turn"),
    )
    rows = bodies.unionByName(again).unionByName(broken).withColumn("at", F.timestamp_seconds("turn"))
    folder = run_folder(t.spark)
    stream = feed(t, rows, "at", file_rows=FILE_BODIES).select("value", "sender", "chunk")
    handle = database.serving_batch(folder, t.baseline, t.registry, t.as_of, buckets=8)

    def twice(batch, batch_id):
        handle(batch, batch_id)
        handle(batch, batch_id)  # as after a failure: the batch is there and stays as it is

    run = stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/_checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    stored = database.open_tables(t.spark, folder)
    engines, readings = stored.read("engines"), stored.read("sensor_readings")
    log = stored.read("predictions").groupBy("engine_id", "cycle").agg(
        F.count_distinct("prediction_id").alias("n_predictions"), F.max("predicted_rul").alias("predicted_rul"),
        F.max("health_status").alias("health_status"),
    )
    known = log.join(engines, "engine_id").join(readings.select("engine_id", "cycle", "s2"), ["engine_id", "cycle"])
    names = ["unit_number", "subset", "cycle", "predicted_rul", "health_status", "n_predictions", "s2"]
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    lost = stored.read("rejects").groupBy("reason").agg(F.count("*").alias("n_predictions")).select(
        zero.alias("unit_number"), F.lit(0).alias("subset"), zero.alias("cycle"), none.alias("predicted_rul"),
        F.lit("").alias("health_status"), "n_predictions", none.alias("s2"), "reason",
    )
    return known.select(*names, F.lit("").alias("reason")).unionByName(lost)
