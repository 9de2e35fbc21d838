"""Event-time windows on streams, whose state the engine keeps, and the join of two streams over stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.functions import columns as C
from wearline.operators import accuracy as acc
from wearline.operators import store
from wearline.operators import truth as tr
from wearline.operators.versions import Commit, Spec, Tables


def _timed(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Event time as ``_at`` with a watermark; rows later than ``delay`` are dropped."""
    return df.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)


def _start(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("time"), *cols)


def stream_activity(pred: DataFrame, width: str = "1 minute", delay: str = "10 minutes", time: str = "predicted_at") -> DataFrame:
    """Predictions per tumbling window."""
    counts = _timed(pred, time, delay).groupBy(F.window("_at", width)).agg(F.count(F.lit(1)).alias("predictions"))
    return _start(counts, "predictions")


def stream_mean_rul(pred: DataFrame, width: str = "1 hour", delay: str = "10 minutes", time: str = "predicted_at") -> DataFrame:
    """Mean remaining life per tumbling window."""
    means = _timed(pred, time, delay).groupBy(F.window("_at", width)).agg(
        C.decimal_round(F.avg("predicted_rul"), 1).alias("avg_remaining_life")
    )
    return _start(means, "avg_remaining_life")


def stream_accuracy(errors: DataFrame, width: str = "1 hour", delay: str = "10 minutes", by: str = "subset",
                    time: str = "submitted_at") -> DataFrame:
    """RMSE and score per tumbling window and dataset."""
    figures = _timed(errors, time, delay).groupBy(F.window("_at", width), by).agg(
        C.decimal_round(acc.rmse(), 2).alias("rmse"), C.decimal_round(acc.penalty_sum(), 1).alias("nasa_score")
    )
    return _start(figures, by, "rmse", "nasa_score")


IN_TIME, EARLY, LATE = "in time", "before its prediction", "too late"
UNKNOWN, OPEN, UNTIMED = "unknown prediction_id", "no truth", "no time"
VALUES = ["true_rul", "submitted_at"]
#: Newest time of each side, and the watermarks of the last two batches.
CLOCK = ["pred", "truth", "late", "mark"]


def both_streams(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions and truths as rows of one stream: the columns of both, the time in microseconds (``_at``) and
    whether a row is a truth."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("_at")
    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    p = pred.select(*pred.columns, *[none(truth.schema[c]) for c in VALUES], micros("predicted_at"), F.lit(False).alias("_truth"))
    t = truth.select(
        *["prediction_id" if f.name == "prediction_id" else none(f) for f in pred.schema], *VALUES, micros("submitted_at"),
        F.lit(True).alias("_truth"),
    )
    return p.unionByName(t)


def micros_of(spark: SparkSession, span: str) -> int:
    return spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0L) + INTERVAL {span})")).first()[0]


def meetings(rows: DataFrame, wait: int, keep: int) -> DataFrame:
    """``_met`` also where the other side has a row near enough: a truth is from ``wait`` before to ``keep`` after its
    prediction. One order of the rows of an id by time serves both sides."""
    by = Window.partitionBy("prediction_id").orderBy("_at")
    truths = F.count_if("_truth").over(by.rangeBetween(-wait, keep))
    preds = F.count_if(~F.col("_truth")).over(by.rangeBetween(-keep, wait))
    counted = rows.withColumns({"_truths": truths, "_preds": preds})
    near = F.when(F.col("_truth"), F.col("_preds")).otherwise(F.col("_truths")) > 0
    return counted.withColumn("_met", F.col("_met") | near).drop("_truths", "_preds")


def truth_join(commit: Commit, batch: DataFrame, delay: int, wait: int, keep: int) -> DataFrame:
    """What became of the truths and predictions of a micro-batch and of those before it, in the column ``outcome``.

    A truth counts if it comes up to ``wait`` after its prediction. Each truth comes out once for
    each prediction of its id: ``in time``, ``too late`` or ``before its prediction``; and once as
    ``unknown prediction_id`` if no prediction lies between ``keep`` before it and ``wait`` after it.
    A prediction for which nothing came within ``keep`` comes out once as ``no truth``. Rows without
    a time come out at once as ``no time``; one without an id is unknown.

    The rows that may still meet others lie in the table ``waiting``, so a micro-batch is one
    ordinary join. The watermark is ``delay`` behind the newest row of the side that is less far; what
    it passes is reported and forgotten. A row at or before the watermark of the last batch but one
    is left out, as a join of the engine does. Several truths in time are several rows: which of
    them counts is decided where they are stored, as they may lie in different micro-batches.
    """
    spark, tables = batch.sparkSession, commit.tables
    held = commit.base["batches"].get(commit.writer, -1)
    if commit.batch_id != held + 1:
        raise FileNotFoundError(f"the state of batch {commit.batch_id - 1} does not exist; the last one is {held}")
    names = [c for c in batch.columns if c not in ("_at", "_truth")]
    clock = tables.read("clock").first().asDict() if held >= 0 else dict.fromkeys(CLOCK)
    found = batch.agg(F.max(F.when(~F.col("_truth"), F.col("_at"))).alias("pred"), F.max(F.when(F.col("_truth"), F.col("_at"))).alias("truth"))
    newest = {c: max((x for x in (clock[c], v) if x is not None), default=None) for c, v in found.first().asDict().items()}
    mark = None if None in newest.values() else min(newest.values()) - delay
    late = F.lit(False) if clock["late"] is None else F.col("_at") <= clock["late"]
    rows = batch.filter(F.col("_at").isNotNull() & ~late).withColumns({"_new": F.lit(True), "_met": F.lit(False)})
    if held >= 0:
        rows = rows.unionByName(tables.read("waiting").withColumn("_new", F.lit(False)))
    keyed = store.materialised(meetings(rows.filter(F.col("prediction_id").isNotNull()), wait, keep))
    every = keyed.unionByName(rows.filter(F.col("prediction_id").isNull()))
    met = keyed.filter("_met")
    p = met.filter(~F.col("_truth")).drop(*VALUES, "_truth", "_met")
    t = met.filter("_truth").select(F.col("prediction_id").alias("_id"), *VALUES, F.col("_at").alias("_t_at"), F.col("_new").alias("_t_new"))
    near = (F.col("_t_at") - F.col("_at")).between(-wait, keep) & (F.col("_new") | F.col("_t_new"))
    after = F.col("_t_at") - F.col("_at")
    outcome = F.when(after < 0, EARLY).when(after > wait, LATE).otherwise(IN_TIME)
    out = p.join(t, (F.col("prediction_id") == F.col("_id")) & near).select(*names, outcome.alias("outcome"))
    past = F.lit(False) if mark is None else F.col("_at") + F.when(F.col("_truth"), F.lit(wait)).otherwise(F.lit(keep)) < mark
    alone = every.filter(past & ~F.col("_met")).select(*names, F.when(F.col("_truth"), UNKNOWN).otherwise(OPEN).alias("outcome"))
    untimed = batch.filter(F.col("_at").isNull()).select(*names, F.lit(UNTIMED).alias("outcome"))
    commit.replace("waiting", every.filter(~past).drop("_new"), {"all"})
    now = spark.createDataFrame([(newest["pred"], newest["truth"], clock["mark"], mark)], ", ".join(f"{c} long" for c in CLOCK))
    commit.replace("clock", now.coalesce(1), {"all"})
    return out.unionByName(alone).unionByName(untimed)


def store_truths(commit: Commit, rows: DataFrame) -> None:
    rows = store.materialised(rows)
    scored = tr.error_columns(rows.filter(F.col("outcome") == IN_TIME).drop("outcome"))
    commit.insert_first("errors", scored, [F.col("submitted_at"), F.col("true_rul")])
    lost = rows.filter(F.col("true_rul").isNotNull() | F.col("submitted_at").isNotNull())
    lost = lost.filter(F.col("outcome") != IN_TIME).select("prediction_id", "true_rul", "submitted_at", "outcome")
    commit.append("rejects", lost.withColumnRenamed("outcome", "reason"))
    left = rows.filter(F.col("outcome").isin(OPEN, UNTIMED) & F.col("true_rul").isNull() & F.col("submitted_at").isNull())
    commit.append("open", left.drop("true_rul", "submitted_at"))


def truth_batch(folder: str, buckets: int = 64):
    """foreachBatch handler for rows with an outcome: truths in time to ``errors`` if their prediction
    has none yet, the first by submission of those in one batch; the rest to ``rejects`` with their
    outcome, predictions that got no truth to ``open``. All three change together, and a repeated
    batch changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        with truth_tables(batch.sparkSession, folder, buckets).commit("truths", batch_id) as commit:
            if not commit.skipped:
                store_truths(commit, batch)

    return handle


def truth_tables(spark: SparkSession, folder: str, buckets: int = 64) -> Tables:
    """The tables that ``truth_batch`` writes."""
    store.checkpoint_folder(spark)
    return Tables(spark, f"{folder}/tables", {
        "errors": Spec("first", ["prediction_id"], buckets=buckets), "rejects": Spec("log"), "open": Spec("log"),
        "waiting": Spec("state"), "clock": Spec("state"),
    })


def stream_truths(
    pred: DataFrame, truth: DataFrame, folder: str, delay: str = "10 minutes", longest_wait: str = "30 days", remember: str = "60 days",
    buckets: int = 64,
):
    """Errors, rejects and open predictions as stored tables, by ``truth_join`` and ``truth_batch``'s rules; returns the
    unstarted writer. What waits for the other stream is stored in the same commit."""
    spans = [micros_of(pred.sparkSession, span) for span in (delay, longest_wait, remember)]

    def handle(batch: DataFrame, batch_id: int) -> None:
        with truth_tables(batch.sparkSession, folder, buckets).commit("truths", batch_id) as commit:
            if not commit.skipped:
                store_truths(commit, truth_join(commit, batch, *spans))

    both = both_streams(pred, truth)
    return both.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint")
