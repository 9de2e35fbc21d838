"""Write rules: properties of upserts, registry and batch writes."""

import pytest
from pyspark.sql import functions as F

from wearline.operators import database, store, versions
from wearline.sources.tables import read_stored


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_new_keys_follow_the_highest_id(spark):
    dim = spark.createDataFrame([(7, 1, 1)], "engine_id long, unit_number long, subset int")
    rows = spark.createDataFrame([(1, 1), (1, 2), (3, 1), (3, 1)], "unit_number long, subset int")
    created, everything = store.get_or_create(dim, rows, ["unit_number", "subset"], "engine_id")
    assert rows_of(created, "engine_id") == [(8, 1, 2), (9, 3, 1)]
    again, _ = store.get_or_create(everything, rows, ["unit_number", "subset"], "engine_id")
    assert again.count() == 0


def test_upsert_is_idempotent_and_last_writer_wins(spark):
    target = spark.createDataFrame([(1, 1, "old"), (2, 5, "kept")], "k int, v int, x string")
    rows = spark.createDataFrame([(1, 2, "new"), (2, 4, "stale"), (3, 1, "added")], "k int, v int, x string")
    once = store.upsert_latest(target, rows, ["k"], ["v"])
    assert rows_of(once, "k") == [(1, 2, "new"), (2, 5, "kept"), (3, 1, "added")]
    assert rows_of(store.upsert_latest(once, rows, ["k"], ["v"]), "k") == rows_of(once, "k")


def test_incoming_row_wins_a_tie(spark):
    target = spark.createDataFrame([(1, 1, "old")], "k int, v int, x string")
    rows = spark.createDataFrame([(1, 1, "new")], "k int, v int, x string")
    assert store.upsert_latest(target, rows, ["k"], ["v"]).first()["x"] == "new"


def test_no_partitioning_decides_between_equal_versions(spark):
    rows = spark.range(40).select(F.lit(1).alias("k"), F.lit(1).alias("v"), (F.col("id") * 7 % 40).alias("x"))
    for n in (1, 3, 8):
        assert store.upsert_latest(None, rows.repartition(n), ["k"], ["v"]).first()["x"] == 39
        first = store.insert_first(None, rows.repartition(n).withColumn("at", F.lit(1)), ["k"], ["at"])
        assert first.first()["x"] == 39


def test_incomplete_keys_make_no_entity(spark):
    dim = spark.createDataFrame([], "engine_id long, unit_number long, subset int")
    rows = spark.createDataFrame([(None, 1), (3, None), (2, 1)], "unit_number long, subset int")
    created, everything = store.get_or_create(dim, rows, ["unit_number", "subset"], "engine_id")
    assert rows_of(created, "engine_id") == [(1, 2, 1)]
    assert store.get_or_create(everything, rows, ["unit_number", "subset"], "engine_id")[0].count() == 0
    _, broken = store.without_key(rows, ["unit_number", "subset"])
    assert sorted(r["reason"] for r in broken.collect()) == ["no subset", "no unit_number"]


def test_first_writer_wins(spark):
    target = spark.createDataFrame([(1,)], "k int")
    rows = spark.createDataFrame([(1, 1), (2, 9), (2, 3)], "k int, at int")
    assert rows_of(store.insert_first(target, rows, ["k"], ["at"]), "k") == [(2, 3)]
    assert store.insert_first(None, rows, ["k"], ["at"]).count() == 2


REGISTRY = "model_id int, subset int, is_active boolean, trained_at string, model_version string, algorithm string, train_rmse double, train_mae double, train_r2 double, train_nasa_score double"


def registry(spark):
    return spark.createDataFrame(
        [
            (1, 1, True, "2024-01-01", None, None, 1.0, 1.0, 1.0, 1.0),
            (2, 1, True, "2024-02-01", None, None, 2.0, 2.0, 2.0, 2.0),
            (3, 1, False, "2024-03-01", "x", "y", 3.0, 3.0, 3.0, 3.0),
            (4, 2, True, "2024-01-01", "x", "y", 4.0, 4.0, 4.0, 4.0),
        ],
        REGISTRY,
    )


def test_newest_active_model(spark):
    assert rows_of(store.active_model(registry(spark)), "subset") == [(1, 2), (2, 4)]


def test_rows_of_a_subset_without_model_are_rejected(spark):
    rows = spark.createDataFrame([(1,), (3,)], "subset int")
    good, bad = store.with_active_model(rows, registry(spark))
    assert rows_of(good, "subset") == [(1, 2)]
    assert rows_of(bad, "subset") == [(3, "no active model")]


def test_registry_update_touches_active_rows_only(spark):
    metrics = spark.createDataFrame(
        [(1, None, 9.0, 8.0, None, 7.0)],
        "subset int, algorithm string, train_rmse double, train_mae double, train_r2 double, train_nasa_score double",
    )
    got = {r["model_id"]: r for r in store.update_registry(registry(spark), metrics).collect()}
    for k in (1, 2):
        assert got[k]["model_version"] == "v1-FD001" and got[k]["algorithm"] == "XGBoost"
        assert (got[k]["train_rmse"], got[k]["train_r2"], got[k]["train_nasa_score"]) == (9.0, None, 7.0)
    assert (got[3]["model_version"], got[3]["train_rmse"]) == ("x", 3.0)
    assert (got[4]["model_version"], got[4]["train_rmse"]) == ("x", 4.0)


def test_seed_guard(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.seed_table(spark, path, lambda: spark.range(2)) == "seeded"
    assert store.seed_table(spark, path, lambda: spark.range(9)) == "skipped"
    assert spark.read.parquet(path).count() == 2
    assert store.seed_table(spark, path, lambda: spark.range(9), force=True) == "seeded"
    assert spark.read.parquet(path).count() == 9


def test_batch_write_can_be_repeated(spark, tmp_path):
    tables = str(tmp_path)
    rows = spark.createDataFrame(
        [(1, 11, 5, 1.0, 9.5, 5), (1, 12, 5, 2.0, 80.0, 5), (2, 11, 6, 3.0, 25.0, 6)],
        "subset int, unit_number long, cycle int, s2 double, predicted_rul double, n_history_cycles int",
    )
    for batch in (0, 0, 1):
        database.write_batch(spark, tables, rows, registry(spark), batch, "2024-01-01 00:00:00")
    stored = read_stored(spark, tables, ["engines", "sensor_readings", "predictions"])
    assert rows_of(stored["engines"].select("engine_id", "unit_number", "subset"), "engine_id") == [(1, 11, 1), (2, 11, 2), (3, 12, 1)]
    assert stored["sensor_readings"].count() == 3
    log = stored["predictions"]
    assert log.count() == 6
    assert rows_of(log.filter("request_id = 'batch-0'").select("engine_id", "model_id", "health_status"), "engine_id") == [
        (1, 2, "CRITICAL"), (2, 4, "WARNING"), (3, 2, "HEALTHY"),
    ]


def test_stored_log_reads_back_with_ids_and_rejects(spark, tmp_path):
    from wearline.operators import fleet

    tables = str(tmp_path)
    rows = spark.createDataFrame(
        [(1, 11, 5, 1.0, 9.5, 5, "2023-05-01 10:00:00"), (1, 11, 6, 2.0, 8.5, 6, None), (9, 12, 5, 2.0, 80.0, 5, None)],
        "subset int, unit_number long, cycle int, s2 double, predicted_rul double, n_history_cycles int, recorded_at string",
    ).withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
    for batch in (0, 0, 1):
        database.write_batch(spark, tables, rows, registry(spark), batch, f"2024-01-0{batch + 1} 00:00:00")
    stored = read_stored(spark, tables, ["sensor_readings", "predictions", "rejects"])
    log = stored["predictions"]
    assert log.select("prediction_id").distinct().count() == log.count() == 4
    assert fleet.latest_state(log).count() == 1
    times = {str(r["recorded_at"]) for r in stored["sensor_readings"].collect()}
    assert times == {"2023-05-01 10:00:00", "2024-01-02 00:00:00"}
    assert [(r["unit_number"], r["reason"]) for r in stored["rejects"].collect()] == [(12, "no active model")] * 2


def test_rows_without_key_and_second_readings_of_a_cycle(spark, tmp_path):
    """Five rows, written twice: one engine a key, one reading a cycle whose winner is defined, an id for
    each prediction, and a reject for each row without a key."""
    from wearline.operators import truth as tr

    schema = "subset int, unit_number long, cycle int, s2 double, predicted_rul double, n_history_cycles int"
    given = [(1, 11, 5, 1.0, 50.0, 5), (1, 11, 5, 2.0, 51.0, 5), (1, None, 5, 3.0, 9.0, 5), (None, 12, 5, 4.0, 9.0, 5), (1, 13, None, 5.0, 9.0, 5)]
    winners = set()
    for i, parts in enumerate((1, 4)):
        tables = f"{tmp_path}/{i}"
        for batch in (0, 1):
            rows = spark.createDataFrame(given, schema).repartition(parts)
            database.write_batch(spark, tables, rows, registry(spark), batch, "2024-01-01 00:00:00")
        stored = read_stored(spark, tables, ["engines", "sensor_readings", "predictions", "rejects"])
        assert rows_of(stored["engines"].select("engine_id", "unit_number", "subset"), "engine_id") == [(1, 11, 1)]
        winners.add(rows_of(stored["sensor_readings"].select("engine_id", "cycle", "s2"), "s2")[0])
        log = stored["predictions"]
        assert log.count() == 4 == log.select("prediction_id").distinct().count()
        assert sorted(r["reason"] for r in stored["rejects"].collect()) == ["no cycle"] * 2 + ["no subset"] * 2 + ["no unit_number"] * 2
        one = log.filter("predicted_rul = 51 AND request_id = 'batch-0'")
        truth = one.select("prediction_id", F.lit(50.0).alias("true_rul"), F.col("predicted_at").alias("submitted_at"))
        assert tr.score_truths(log, truth)[0].count() == 1
    assert len(winners) == 1
    # With an order of arrival the later row is the stored one.
    rows = spark.createDataFrame([(*given[1], 1), (*given[0], 2)], schema + ", at int")
    database.write_batch(spark, f"{tmp_path}/at", rows, registry(spark), 0, "2024-01-01 00:00:00", arrival=["at"])
    assert read_stored(spark, f"{tmp_path}/at", ["sensor_readings"])["sensor_readings"].first()["s2"] == 1.0


def test_equal_rows_are_numbered_apart(spark):
    rows = spark.createDataFrame([(1, 5.0)] * 3 + [(1, 6.0), (2, None)], "k int, x double")
    got = store.with_positions(rows, ["k"])
    assert got.count() == 5 and got.select("k", "position").distinct().count() == 5


def lines(spark, n, value, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("k"), F.lit(value).alias("x"))


def test_a_small_batch_leaves_other_buckets_alone(spark, tmp_path):
    stored = versions.one_table(spark, str(tmp_path), versions.Spec("latest", ["k"], buckets=256))
    with stored.commit() as commit:
        commit.upsert("rows", lines(spark, 5000, 1), [F.col("x")])
    before = stored.manifest()["tables"]["rows"]["buckets"]
    with stored.commit() as commit:
        commit.upsert("rows", lines(spark, 100, 2), [F.col("x")])
    after = stored.manifest()["tables"]["rows"]["buckets"]
    changed = {b for b in after if before.get(b) != after[b]}
    assert len(before) == 256 and 0 < len(changed) <= 100
    got = stored.read("rows")
    assert got.count() == 5000 and got.agg(F.sum("x")).first()[0] == 5100
    assert stored.read("rows", version=1).agg(F.sum("x")).first()[0] == 5000


def test_a_killed_write_leaves_the_version_before(spark, tmp_path):
    stored = versions.one_table(spark, str(tmp_path), versions.Spec("latest", ["k"], buckets=4))
    with stored.commit("w", 0) as commit:
        commit.upsert("rows", lines(spark, 10, 1), [F.col("x")])
    with pytest.raises(RuntimeError, match="killed"):
        with stored.commit("w", 1) as commit:
            commit.upsert("rows", lines(spark, 10, 2), [F.col("x")])
            raise RuntimeError("killed")
    assert stored.read("rows").agg(F.sum("x")).first()[0] == 10 and not stored.holds("w", 1)
    with stored.commit("w", 1) as commit:
        commit.upsert("rows", lines(spark, 10, 3), [F.col("x")])
    assert stored.read("rows").agg(F.sum("x")).first()[0] == 30
    folders = len(list((tmp_path / "rows").iterdir()))
    stored.vacuum(keep=1)
    assert len(list((tmp_path / "rows").iterdir())) == folders - 1 and stored.read("rows").count() == 10


def test_the_second_of_two_writers_fails(spark, tmp_path):
    stored = versions.one_table(spark, str(tmp_path), versions.Spec("log"))
    with pytest.raises(versions.ConcurrentWrite):
        with stored.commit() as slow:
            slow.append("rows", lines(spark, 1, 1))
            with stored.commit() as fast:
                fast.append("rows", lines(spark, 2, 2))
    assert stored.read("rows").count() == 2


def test_long_buckets_are_compacted(spark, tmp_path):
    stored = versions.one_table(spark, str(tmp_path), versions.Spec("latest", ["k"], buckets=1))
    for i in range(versions.MOST + 2):
        with stored.commit() as commit:
            commit.upsert("rows", lines(spark, 3, i, start=i % 4), [F.col("x")])
    (entries,) = stored.manifest()["tables"]["rows"]["buckets"].values()
    assert len(entries) == 2
    assert rows_of(stored.read("rows"), "k") == [(0, 8), (1, 9), (2, 9), (3, 9), (4, 7), (5, 7)]


def test_a_log_merges_its_small_parts(spark, tmp_path):
    stored = versions.one_table(spark, str(tmp_path), versions.Spec("log"))
    for i in range(versions.MOST * 2 + 1):
        with stored.commit() as commit:
            commit.append("rows", lines(spark, 2, i))
    entries = stored.manifest()["tables"]["rows"]["buckets"]["all"]
    assert sorted(size for _, size in entries) == [0, 1, 1]
    assert stored.read("rows").count() == 2 * (versions.MOST * 2 + 1)


def test_first_writers_read_only_the_buckets_of_their_keys(spark, tmp_path):
    stored = versions.one_table(spark, str(tmp_path), versions.Spec("first", ["k"], buckets=1000))
    with stored.commit() as commit:
        commit.insert_first("rows", lines(spark, 20_000, 1), [F.col("x")])
    few = spark.createDataFrame([(5, 2), (5, 3), (30_000, 2), (None, 9)], "k int, x int")
    with stored.commit() as commit:
        scan = commit.absent("rows", few)
        read = {f.rsplit("/", 2)[1] for f in scan.inputFiles() if str(tmp_path) in f}
        assert 0 < len(read) <= 3 < len(stored.manifest()["tables"]["rows"]["buckets"])
        commit.insert_first("rows", few, [F.col("x")])
    got = stored.read("rows", near=few)
    assert got.filter("k = 5").first()["x"] == 1 and got.filter("k = 30000").first()["x"] == 2
    assert stored.read("rows").count() == 20_002


def test_later_columns_are_added(spark, tmp_path):
    stored = versions.one_table(spark, str(tmp_path), versions.Spec("log"))
    for rows in (lines(spark, 1, 1), lines(spark, 1, 2).withColumn("more", F.lit("m")), lines(spark, 1, 3)):
        with stored.commit() as commit:
            commit.append("rows", rows)
    assert [tuple(r) for r in stored.read("rows").orderBy("x").collect()] == [(0, 1, None), (0, 2, "m"), (0, 3, None)]


def test_append_predictions_by_subset(spark, tmp_path):
    path = str(tmp_path / "p")
    for _ in range(2):
        store.append_predictions(spark.createDataFrame([(1, 5.0), (2, 6.0)], "subset int, predicted_rul double"), path)
    assert spark.read.parquet(path).filter(F.col("subset") == 1).count() == 2


def test_checkpoint_folder_comes_from_the_session(spark):
    assert store.checkpoint_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_checkpointed_frame_has_no_lineage(spark):
    df = store.materialised(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "Range" not in df._jdf.queryExecution().toString()
    assert df.count() == 10


def test_positions_need_one_shuffle_and_agree_with_long_keys(spark, monkeypatch):
    from wearline.operators import series, store

    rows = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5), (1, 2, 0.1), (1, 2, None), (2, 1, 0.3)] * 3, "k long, at int, v double")
    short = store.with_positions(rows, ["k"], ["at"])
    assert short._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(series, "SERIES_ROWS", 2)
    long = store.with_positions(rows, ["k"], ["at"])
    got, want = (sorted(map(str, df.collect())) for df in (short, long))
    assert got == want and len(set(got)) == 15


def test_written_rows_are_read_by_column(spark):
    from wearline.operators import store

    plan = store.written(spark.range(5).selectExpr("id", "id * 2 AS b")).select("b")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet [b" in plan
