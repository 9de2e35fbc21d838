"""Streams over several micro-batches against their batch twins."""

import os

import pytest
from pyspark.sql import functions as F

from wearline.operators import entities as ent
from wearline.operators import features as feat
from wearline.operators import fleet
from wearline.streaming import carry, windows

SCHEMA = "engine_id long, cycle long, x double, predicted_rul double, health_status string, predicted_at timestamp_ntz"


def rows(spark, n=400):
    """Engine 0 sends half of the rows."""
    engine = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5)
    rul = (F.col("id") * 13 % 60).cast("double")
    return spark.range(n).select(
        engine.cast("long").alias("engine_id"),
        F.col("id").alias("cycle"),
        (F.col("id") * 37 % 101).cast("double").alias("x"),
        rul.alias("predicted_rul"),
        F.when(rul <= 10, "CRITICAL").when(rul <= 30, "WARNING").otherwise("HEALTHY").alias("health_status"),
        F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("predicted_at"),
    )


@pytest.fixture
def feed(spark, tmp_path):
    """Four files in time order, read one per micro-batch."""
    df = rows(spark)
    for i in range(4):
        df.filter(F.col("cycle").between(i * 100, i * 100 + 99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rolling_features_across_batches(spark, feed, tmp_path):
    folder = f"{tmp_path}/run"
    run(carry.stream_rolling_features(feed, folder, ["engine_id"], "cycle", ["x"], window=30))
    got = carry.output(spark, folder, "features")
    assert got.select("batch_id").distinct().count() == 4

    def cut(df):
        return df.select("engine_id", "cycle", F.round("x_rm", 9).alias("m"), F.round("x_rs", 9).alias("d"))

    same(cut(got), cut(feat.rolling_features(rows(spark), ["engine_id"], "cycle", ["x"], 30)))
    assert carry.output(spark, folder, "rejects").count() == 0


def test_repeated_batch_changes_nothing(spark, tmp_path):
    handle = carry.rolling_batch(f"{tmp_path}/r", ["engine_id"], "cycle", ["x"], 5)
    df = rows(spark, 60)
    for batch_id in (0, 1, 1):
        handle(df.filter(F.col("cycle").between(batch_id * 30, batch_id * 30 + 29)), batch_id)
    assert carry.output(spark, f"{tmp_path}/r", "features").count() == 60


def test_late_rows_are_rejected(spark, tmp_path):
    handle = carry.rolling_batch(f"{tmp_path}/r", ["engine_id"], "cycle", ["x"], 5)
    df = rows(spark, 60)
    handle(df.filter("cycle >= 20"), 0)
    handle(df.filter("cycle < 20"), 1)
    assert carry.output(spark, f"{tmp_path}/r", "features").count() == 40
    rejects = carry.output(spark, f"{tmp_path}/r", "rejects")
    assert rejects.count() == 20 and rejects.first()["reason"] == "out of order"


def test_latest_row_across_batches(spark, feed, tmp_path):
    folder = f"{tmp_path}/run"
    run(carry.stream_latest(feed, folder, ["engine_id"], ["cycle"]))
    same(carry.newest_version(spark, folder), ent.latest_row(rows(spark), ["engine_id"], ["cycle"]))


def test_alerts_across_batches(spark, feed, tmp_path):
    folder = f"{tmp_path}/run"
    run(carry.stream_alerts(feed, folder, ["engine_id"], "cycle"))
    got = carry.output(spark, folder, "alerts").select("engine_id", "cycle", "health_status", "previous")
    want = fleet.status_changes(rows(spark), ["engine_id"], "cycle").select(got.columns)
    same(got, want)


def table_of(stream, tmp_path, name):
    folder = f"{tmp_path}/{name}"
    run(stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/o"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/o")


def test_activity_of_closed_windows(spark, feed, tmp_path):
    got = table_of(windows.stream_activity(feed, "10 minutes", "5 minutes"), tmp_path, "a")
    # The last row is at minute 399, so windows ending by minute 394 are closed.
    assert got.count() == 39 and {r["predictions"] for r in got.collect()} == {10}


def test_hourly_mean_equals_batch(spark, feed, tmp_path):
    got = table_of(windows.stream_mean_rul(feed), tmp_path, "m")
    want = fleet.mean_over_time(rows(spark)).filter("time < '2024-01-01 06:00:00'")
    same(got, want)


def test_repeated_and_late_rows_are_rejects(spark, tmp_path):
    folder = f"{tmp_path}/run"
    handle = carry.alert_batch(folder, ["engine_id"], "cycle")
    schema = "engine_id int, cycle int, health_status string"
    handle(spark.createDataFrame([(1, 1, "HEALTHY"), (1, 2, "WARNING"), (1, 2, "CRITICAL")], schema), 0)
    handle(spark.createDataFrame([(1, 2, "HEALTHY"), (1, 3, "HEALTHY")], schema), 1)
    rejects = carry.output(spark, folder, "rejects")
    got = sorted((r["batch_id"], r["cycle"], r["health_status"], r["reason"]) for r in rejects.collect())
    assert got == [(0, 2, "WARNING", "repeated"), (1, 2, "HEALTHY", "out of order")]
    alerts = carry.output(spark, folder, "alerts").orderBy("cycle").collect()
    assert [(r["cycle"], r["previous"], r["health_status"]) for r in alerts] == [
        (2, "HEALTHY", "CRITICAL"), (3, "CRITICAL", "HEALTHY"),
    ]


def test_a_missing_version_fails(spark, tmp_path):
    handle = carry.latest_batch(f"{tmp_path}/run", ["engine_id"], ["cycle"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        handle(spark.createDataFrame([(1, 1)], "engine_id int, cycle int"), 3)


def at(day, hour=0):
    return f"2024-{1 + (day - 1) // 28:02d}-{1 + (day - 1) % 28:02d} {hour:02d}:00:00"


def truth_feed(spark, folder, pred, truth):
    """Streams of one file for each list of rows: (id, value, time) with the time as text."""
    out = []
    for name, batches, value, time in (("pred", pred, "predicted_rul", "predicted_at"), ("truth", truth, "true_rul", "submitted_at")):
        for rows in batches:
            df = spark.createDataFrame(rows, f"prediction_id long, {value} double, t string")
            df = df.select("prediction_id", value, F.col("t").cast("timestamp_ntz").alias(time))
            df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        out.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}"))
    return out


def test_every_truth_and_prediction_comes_out_once(spark, tmp_path):
    pred = [
        [(1, 10.0, at(1)), (2, 20.0, at(1)), (3, 30.0, at(1)), (4, 40.0, at(1)), (8, 80.0, None)],
        [(5, 50.0, at(2)), (6, 60.0, at(3))],
        [(9, 90.0, at(28))],
    ]
    truth = [
        # 1: two in time, the earlier one in a later row; 3: early, then one in time; 5: comes before its prediction is read
        [(1, 2.0, at(1, 3)), (1, 1.0, at(1, 2)), (3, 3.0, at(0 + 1, 0)), (77, 7.0, at(1, 5)), (None, 0.0, at(1, 6)), (4, 4.0, None)],
        [(5, 5.0, at(2, 1)), (1, 9.0, at(2, 2)), (6, 6.0, at(2, 3)), (6, 6.5, at(3, 3))],
        [(2, 2.0, at(6)), (99, 1.0, at(28))],
    ]
    truth[0][2] = (3, 3.0, "2023-12-31 22:00:00")
    truth[1].append((3, 3.5, at(2, 4)))
    folder = f"{tmp_path}/run"
    run(windows.stream_truths(*truth_feed(spark, tmp_path, pred, truth), folder, delay="1 hour", longest_wait="3 days", remember="6 days"))
    stored = windows.truth_tables(spark, folder)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert rows(stored.read("errors"), "prediction_id", "true_rul", "error", "band") == [
        (1, 1.0, 9.0, "OK"), (3, 3.5, 26.5, "LATE"), (5, 5.0, 45.0, "LATE"), (6, 6.5, 53.5, "LATE"),
    ]
    assert rows(stored.read("rejects"), "prediction_id", "true_rul", "reason") == sorted([
        (2, 2.0, "too late"), (3, 3.0, "before its prediction"), (4, 4.0, "no time"), (6, 6.0, "before its prediction"),
        (77, 7.0, "unknown prediction_id"), (None, 0.0, "unknown prediction_id"),
    ], key=str)
    # The last rows are still awaited: the watermark stands an hour before them.
    assert rows(stored.read("open"), "prediction_id", "outcome") == [(4, "no truth"), (8, "no time")]


def test_a_repeated_truth_batch_changes_nothing(spark, tmp_path):
    schema = "prediction_id long, predicted_rul double, true_rul double, submitted_at timestamp, outcome string"
    df = spark.createDataFrame([(1, 5.0, 2.0, None, "in time"), (2, 5.0, 2.0, None, "too late"), (3, 5.0, None, None, "no truth")], schema)
    df = df.withColumn("submitted_at", F.when(F.col("true_rul").isNotNull(), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    handle = windows.truth_batch(f"{tmp_path}/run")
    for batch_id in (0, 0, 1):
        handle(df, batch_id)
    stored = windows.truth_tables(spark, f"{tmp_path}/run")
    assert [stored.read(n).count() for n in ("errors", "rejects", "open")] == [1, 2, 2]


def test_missing_numbers_and_keys_are_never_lost(spark, tmp_path):
    """Rows without a sequence number are rejects; a missing series key is a series like any other."""
    folder = f"{tmp_path}/run"
    handle = carry.rolling_batch(folder, ["engine_id"], "cycle", ["x"], 5, step=1)
    schema = "engine_id long, cycle long, x double"
    handle(spark.createDataFrame([(None, 7, 1.0), (None, 9, 2.0), (1, None, 3.0), (1, 4, 4.0)], schema), 0)
    handle(spark.createDataFrame([(None, 7, 5.0), (None, 10, 6.0), (1, 9, 7.0), (1, None, 8.0)], schema), 1)
    made = carry.output(spark, folder, "features")
    assert sorted((str(r["engine_id"]), r["cycle"]) for r in made.collect()) == [("1", 4), ("1", 9), ("None", 7), ("None", 9), ("None", 10)]
    rejects = carry.output(spark, folder, "rejects")
    assert sorted((str(r["engine_id"]), str(r["cycle"]), r["reason"], r["kept"], r["batch_id"]) for r in rejects.collect()) == [
        ("1", "9", "gap before", True, 1), ("1", "None", "no sequence number", False, 0), ("1", "None", "no sequence number", False, 1),
        ("None", "7", "out of order", False, 1), ("None", "9", "gap before", True, 0),
    ]


def test_a_batch_touches_the_state_of_its_series_only(spark, tmp_path):
    folder = f"{tmp_path}/run"
    handle = carry.rolling_batch(folder, ["engine_id"], "cycle", ["x"], 5)
    schema = "engine_id long, cycle long, x double"
    handle(spark.createDataFrame([(e, 1, 1.0) for e in range(200)], schema), 0)
    tables = carry.state_tables(spark, folder, ["engine_id"])
    before = tables.manifest()["tables"]["carried"]["buckets"]
    handle(spark.createDataFrame([(3, 2, 1.0), (3, 3, 1.0)], schema), 1)
    after = tables.manifest()["tables"]["carried"]["buckets"]
    assert len(before) > 50 and len({b for b in before if before[b] != after[b]}) == 1
    assert carry.output(spark, folder, "carried").count() == 202


def test_waiting_rows_are_stored_and_few(spark, tmp_path):
    """Rows that await the other stream lie in a table, those the watermark passed are gone; a missing batch is an error."""
    hours = [[(b * 100 + i, 1.0, at(b * 7 + 1, i % 20)) for i in range(100)] for b in range(3)]
    truth = [[(i, v, t) for i, v, t in rows if i % 2] for rows in hours]
    folder = f"{tmp_path}/run"
    writer = windows.stream_truths(*truth_feed(spark, tmp_path, hours, truth), folder, longest_wait="1 day", remember="2 days")
    run(writer)
    stored = windows.truth_tables(spark, folder)
    assert stored.read("errors").count() == 150 and stored.read("open").count() == 100
    # Only those of the last three days wait; the engine keeps no state beside them.
    assert {r["prediction_id"] // 100 for r in stored.read("waiting").collect()} == {2}
    assert not os.path.exists(f"{folder}/checkpoint/state")
    batch = windows.both_streams(*[spark.read.parquet(f"{tmp_path}/{n}") for n in ("pred", "truth")])
    with pytest.raises(FileNotFoundError, match="does not exist"), stored.commit("truths", 7) as commit:
        windows.truth_join(commit, batch, 0, 1, 1)


def test_rows_behind_the_watermark_meet_nothing(spark, tmp_path):
    """A time at or before the watermark of the batch before last is too late for the join, as for the engine's own."""
    pred = [[(1, 1.0, at(2))], [(2, 2.0, at(5))], [(3, 3.0, at(6))], [(4, 4.0, at(3)), (5, 5.0, at(7))]]
    truth = [[(1, 0.0, at(2))], [(2, 0.0, at(5))], [(3, 0.0, at(6))], [(4, 0.0, at(3)), (5, 0.0, at(7))]]
    folder = f"{tmp_path}/run"
    run(windows.stream_truths(*truth_feed(spark, tmp_path, pred, truth), folder, delay="1 hour", longest_wait="3 days", remember="6 days"))
    assert sorted(r["prediction_id"] for r in windows.truth_tables(spark, folder).read("errors").collect()) == [1, 2, 3, 5]


@pytest.mark.parametrize("n", [0, 3, 1000])
def test_a_feed_writes_each_batch_in_several_files(spark, n):
    """Every micro-batch has as many files as the others, also where most rows have one time, and none is split or mixed."""
    from types import SimpleNamespace

    from wearline.plans import streams

    when = F.timestamp_seconds(F.when(F.col("id") % 10 < 8, 5000).otherwise(F.col("id")))
    rows = spark.range(n).select("id", when.alias("at"))
    seen = []
    stream = streams.feed(SimpleNamespace(spark=spark), rows, "at", file_rows=20)
    folder = streams.run_folder(spark)
    handle = lambda batch, _: seen.append([r["id"] for r in batch.collect()])
    run(stream.writeStream.foreachBatch(handle).option("checkpointLocation", folder))
    assert sorted(i for b in seen for i in b) == list(range(n))
    times = {r["id"]: r["at"] for r in rows.collect()}
    spans = [(min(times[i] for i in b), max(times[i] for i in b)) for b in seen if b]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_rows_and_rejects_of_a_batch_are_made_once(spark):
    """Both are read from one written table, not from the join and the order again."""
    schema = "engine_id long, cycle long, x double"
    batch = spark.createDataFrame([(1, 3, 1.0), (1, 3, 2.0), (1, 1, 3.0), (1, None, 4.0), (None, 1, 5.0)], schema)
    new, late = carry.in_order(batch, spark.createDataFrame([(1, 2, 0.0)], schema), ["engine_id"], "cycle")
    for df in (new, late):
        assert not any(word in df._jdf.queryExecution().executedPlan().toString() for word in ("Join", "Window", "Exchange"))
    assert sorted(r["x"] for r in new.collect()) == [1.0, 5.0]
    assert sorted((r["x"], r["reason"]) for r in late.collect()) == [(2.0, "repeated"), (3.0, "out of order"), (4.0, "no sequence number")]


def test_numbered_rows_are_not_numbered_again(spark):
    from wearline.operators import series
    from wearline.operators import validate as val

    df = rows(spark)
    numbered = series.number_rows(df, ["engine_id"], ["cycle"], "_position")
    same(val.sequence_steps(numbered, ["engine_id"], "cycle", position="_position").drop("_position"), val.sequence_steps(df, ["engine_id"], "cycle"))
    changes = fleet.status_changes(numbered, ["engine_id"], "cycle", position="_position").drop("_position")
    same(changes, fleet.status_changes(df, ["engine_id"], "cycle"))
