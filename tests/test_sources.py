"""Text, CSV, JSON and table sources, and the text sink."""

import json

import pytest
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.operators import accuracy as acc
from wearline.operators import truth as tr
from wearline.sources import requests as req
from wearline.sources import tables, text


def line(unit, cycle, values=21):
    return f"{unit} {cycle} -0.0007  0.0004 100.0 " + " ".join(f"{i}.5" for i in range(1, values + 1)) + "  "


@pytest.fixture
def logs(tmp_path):
    for k in (1, 3):
        lines = [line(u, c) for u in (1, 2) for c in range(1, 4)]
        (tmp_path / f"train_FD00{k}.txt").write_text("\n".join(lines) + "\n\n")
    return str(tmp_path)


def test_logs_of_all_datasets(spark, logs):
    df = text.read_sensor_log(spark, f"{logs}/train_FD00*.txt")
    assert df.columns == ["subset", *S.LOG_COLUMNS]
    assert df.count() == 12
    assert [tuple(r) for r in df.groupBy("subset").count().orderBy("subset").collect()] == [(1, 6), (3, 6)]
    row = df.first()
    assert (row["setting_1"], row["setting_3"], row["s21"]) == (-0.0007, 100.0, 21.5)


def test_only_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "readings")
    spark.createDataFrame([(1, 1, 1, 2.0, 3.0)], "subset int, unit int, cycle int, s2 double, s3 double").write.partitionBy(
        "subset"
    ).parquet(path)
    plan = spark.read.parquet(path).filter("subset = 1 AND s2 > 1").select("unit", "s2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(subset" in plan and "GreaterThan(s2,1.0)" in plan
    assert "ReadSchema: struct<unit:int,s2:double>" in plan


def test_bad_fields_become_null(spark):
    lines = spark.createDataFrame([("1 x 0.1",), ("  ",), ("2 3 0.1 0.2 nan 9",)], "value string")
    got = text.parse_sensor_lines(lines).orderBy("unit").collect()
    assert len(got) == 2
    assert got[0]["cycle"] is None and got[0]["s1"] is None
    assert got[1]["setting_3"] is None and got[1]["s1"] == 9.0


def test_truth_keeps_line_order(spark, tmp_path):
    for k in (1, 2):
        values = [(i * 7919 * k) % 200 for i in range(500)]
        (tmp_path / f"RUL_FD00{k}.txt").write_text("".join(f"{v}  \n" for v in values))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # many blocks per file
    try:
        got = text.read_truth(spark, f"{tmp_path}/RUL_FD00*.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 1000
    assert all(r["true_rul"] == ((r["unit_rank"] - 1) * 7919 * r["subset"]) % 200 for r in got)


def test_truth_blocks_may_be_sliced(spark, tmp_path, monkeypatch):
    from wearline.operators import series

    monkeypatch.setattr(series, "SERIES_ROWS", 50)
    (tmp_path / "RUL_FD001.txt").write_text("".join(f"{i}\n" for i in range(700)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = text.read_truth(spark, f"{tmp_path}/RUL_FD001.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["unit_rank"], r["true_rul"]) for r in got) == [(i + 1, float(i)) for i in range(700)]


def test_constant_prediction_against_a_truth_file(spark, tmp_path):
    (tmp_path / "RUL_FD002.txt").write_text("112 \n98 \n145 \n")
    truth = text.read_truth(spark, f"{tmp_path}/RUL_FD002.txt").withColumn("predicted_rul", F.lit(125.0))
    r = acc.accuracy(tr.error_columns(truth), ["subset"]).first()
    assert (r["n_evaluated"], r["late"], r["early"], r["on_time"]) == (3, 2, 1, 0)
    assert r["mae"] == pytest.approx((13 + 27 + 20) / 3)


CSV_ROW = ",".join(["4", "150"] + ["1.5"] * 24)


def test_engine_csv_with_and_without_header(spark, tmp_path):
    (tmp_path / "plain.csv").write_text(CSV_ROW + "\n" + CSV_ROW.replace("4,150", "9,151") + "\n")
    (tmp_path / "named.csv").write_text(",".join(S.LOG_COLUMNS) + "\n" + CSV_ROW + "\n")
    good, rejects = text.read_engine_csv(spark, f"{tmp_path}/*.csv", 2)
    got = sorted((r["file"].split("/")[-1], r["unit"], r["cycle"], r["s21"]) for r in good.collect())
    assert got == [("named.csv", 4, 150, 1.5), ("plain.csv", 4, 150, 1.5), ("plain.csv", 4, 151, 1.5)]
    assert rejects.count() == 0


def test_engine_csv_lacking_sensors(spark, tmp_path):
    names = S.LOG_COLUMNS[:20]
    (tmp_path / "short.csv").write_text(",".join(names) + "\n" + ",".join(["1"] * 20) + "\n")
    good, rejects = text.read_engine_csv(spark, f"{tmp_path}/*.csv", 2)
    assert good.count() == 0
    assert rejects.first()["missing"] == ["s17", "s20", "s21"]
    assert text.read_engine_csv(spark, f"{tmp_path}/*.csv", 1)[1].first()["missing"] == ["s17", "s20", "s21"]


def test_dataset_path_falls_back_to_training_log(spark, logs, tmp_path):
    assert text.resolve_dataset(spark, logs, "FD001").endswith("train_FD001.txt")
    (tmp_path / "demo_FD001.txt").write_text(line(1, 1))
    assert text.resolve_dataset(spark, logs, "FD001").endswith("demo_FD001.txt")
    with pytest.raises(FileNotFoundError):
        text.resolve_dataset(spark, logs, "FD002")
    with pytest.raises(ValueError):
        text.resolve_dataset(spark, logs, "FD9")


def test_log_round_trip(spark, logs, tmp_path):
    df = text.read_sensor_log(spark, f"{logs}/train_FD001.txt")
    out = str(tmp_path / "demo_FD001.txt")
    text.write_sensor_log(df, out)
    back = text.read_sensor_log(spark, out).select(*S.LOG_COLUMNS)
    assert back.exceptAll(df.select(*S.LOG_COLUMNS).withColumn("setting_1", F.lit(-0.0007))).count() == 0
    assert back.count() == 6


def test_written_log_is_ordered_text(spark, tmp_path):
    rows = [(2, 1), (1, 2), (1, 1), (2, 2)]
    df = spark.createDataFrame([(u, c, 0.12345) for u, c in rows], "unit int, cycle int, s1 double")
    out = str(tmp_path / "log")
    text.write_sensor_log(df, out, columns=["unit", "cycle", "s1"])
    parts = sorted(p for p in (tmp_path / "log").iterdir() if p.name.startswith("part-"))
    lines = [x for p in parts for x in p.read_text().splitlines()]
    assert lines == ["1 1 0.1235", "1 2 0.1235", "2 1 0.1235", "2 2 0.1235"]


def test_batch_bodies(spark):
    snap = {"subset": 1, "engine_id": 3, "cycle": 9, **{c: 1.5 for c in S.SETTINGS + S.SENSORS[1]}}
    df = spark.createDataFrame([(json.dumps({"instances": [snap, {**snap, "cycle": 10}]}),), ("no json",)], "value string")
    got = req.parse_requests(df, "batch").orderBy("cycle").collect()
    assert [(r["item"], r["cycle"], r["s2"], r["s15"]) for r in got] == [(0, 9, 1.5, None), (1, 10, 1.5, None)]


def test_unparsable_bodies_reach_validation(spark):
    df = spark.createDataFrame([("no json",), ('{"prediction_id": 4, "true_rul": 3}',)], "value string")
    got = sorted((r["prediction_id"] or 0, r["true_rul"]) for r in req.parse_requests(df, "truth").collect())
    assert got == [(0, None), (4, 3.0)]


def test_non_finite_numbers_parse(spark):
    df = spark.createDataFrame([('{"subset": 1, "s2": NaN, "s3": Infinity}',)], "value string")
    row = req.parse_requests(df, "snapshot").first()
    assert row["s2"] != row["s2"] and row["s3"] == float("inf")


def test_selection_body(spark):
    df = spark.createDataFrame([('{"dataset": "FD001", "engine_ids": [1, 2]}',)], "value string")
    row = req.parse_requests(df, "selection").first()
    assert (row["dataset"], row["engine_ids"], row["max_engines"]) == ("FD001", [1, 2], None)


def test_stored_tables_as_views(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "engines"))
    got = tables.read_tables(spark, str(tmp_path), ["engines"], views=True)
    assert got["engines"].count() == spark.sql("SELECT count(*) AS n FROM engines").first()["n"] == 3


def test_bodies_without_readings_keep_their_text(spark):
    from wearline.sources import requests as req

    bodies = ['{"instances": [{"subset": 1, "cycle": 2}, null]}', '{"instances": []}', '{"instances": [', "{}", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "sender int, value string")
    got = req.parse_requests(df, "batch", empty=True)
    assert [tuple(r) for r in got.filter("item IS NULL").select("sender", "value").orderBy("sender").collect()] == list(enumerate(bodies))[1:]
    plain = got.filter("item IS NOT NULL")
    assert plain.filter("value IS NOT NULL").isEmpty()
    assert sorted(map(str, plain.drop("value").collect())) == sorted(map(str, req.parse_requests(df, "batch").collect()))
