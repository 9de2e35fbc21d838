"""Hand-computed cases for the rules that decide correctness."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import accuracy as acc
from wearline.operators import entities as ent
from wearline.operators import features as feat
from wearline.operators import fleet
from wearline.operators import scoring
from wearline.operators import series
from wearline.operators import truth as tr
from wearline.operators import validate as val

KEYS = ["subset", "unit"]


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def series_df(spark, values, cycles=None):
    cycles = cycles or range(1, len(values) + 1)
    return spark.createDataFrame(
        [(1, 1, c, v) for c, v in zip(cycles, values)], "subset int, unit int, cycle long, x double"
    )


def test_frame_counts_rows_not_cycles(spark):
    df = series_df(spark, [1.0, 2.0, 4.0], cycles=[1, 100, 200])
    got = rows_of(feat.rolling_features(df, KEYS, "cycle", ["x"], window=2).select("cycle", "x_rm"), "cycle")
    assert got == [(1, 1.0), (100, 1.5), (200, 3.0)]


def test_lone_row_has_zero_deviation(spark):
    got = feat.rolling_features(series_df(spark, [5.0]), KEYS, "cycle", ["x"]).first()
    assert (got["x_rm"], got["x_rs"]) == (5.0, 0.0)


def test_nan_counts_as_missing(spark):
    df = series_df(spark, [1.0, float("nan"), 3.0])
    got = rows_of(feat.rolling_features(df, KEYS, "cycle", ["x"]).select("cycle", "x_rm", "x_rs"), "cycle")
    assert got == [(1, 1.0, 0.0), (2, 1.0, 0.0), (3, 2.0, pytest.approx(math.sqrt(2)))]


def test_blocks_give_the_same_as_one_window(spark):
    df = spark.range(500).select(
        F.lit(1).alias("subset"), (F.col("id") % 2).cast("int").alias("unit"),
        F.expr("id div 2 + 1").alias("cycle"), (F.col("id") * 7919 % 101).cast("double").alias("x"),
    )
    whole = feat.rolling_features(df, KEYS, "cycle", ["x"], position="cycle")
    cut = feat.rolling_features(df, KEYS, "cycle", ["x"], position="cycle", block_rows=31)
    assert whole.count() == cut.count() == 500
    joined = whole.alias("a").join(cut.alias("b"), KEYS + ["cycle"])
    off = joined.filter(
        (F.abs(F.col("a.x_rm") - F.col("b.x_rm")) > 1e-9) | (F.abs(F.col("a.x_rs") - F.col("b.x_rs")) > 1e-9)
    )
    assert off.count() == 0


@pytest.mark.parametrize("block_rows,batch", [(None, 10_000), (31, 10_000), (40, 7), (None, 1)])
def test_batches_give_the_same_as_window_functions(spark, block_rows, batch):
    """Many columns run over Arrow batches, few as window functions."""
    x = (F.col("id") * 7919 % 101).cast("double")
    df = spark.range(600).select(
        F.lit(1).alias("subset"),
        (F.col("id") % 3).cast("int").alias("unit"),
        F.expr("id div 3 + 1").alias("cycle"),
        F.col("id").cast("string").alias("tag"),
        x.alias("a"),
        F.when(F.col("id") % 4 > 0, x * 1e6 + 5e8).alias("b"),
        F.when((F.col("id") < 200) | (F.col("id") > 400), F.when(F.col("id") % 7 == 0, float("nan")).otherwise(x)).alias("c"),
        F.lit(0.1).alias("d"),
    )
    cols = ["a", "b", "c", "d"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        many = feat.rolling_features(df, KEYS, "cycle", cols, position="cycle", block_rows=block_rows)
        got = {(r["unit"], r["cycle"]): r for r in many.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 600 and many.columns[:8] == df.columns
    for c in cols:
        for r in feat.rolling_features(df, KEYS, "cycle", [c], position="cycle").collect():
            twin = got[r["unit"], r["cycle"]]
            assert twin["tag"] == r["tag"]
            for k in (f"{c}_rm", f"{c}_rs"):
                assert (twin[k] is None) == (r[k] is None)
                assert r[k] is None or twin[k] == pytest.approx(r[k], rel=1e-9, abs=1e-12)


def test_block_must_be_longer_than_frame(spark):
    with pytest.raises(ValueError):
        feat.rolling_features(series_df(spark, [1.0]), KEYS, "cycle", ["x"], position="cycle", block_rows=29)


@pytest.mark.parametrize("limit", [3, 10, 10_000])
def test_numbering_in_slices_is_exact(spark, limit):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("k"),
        (F.col("id") * F.col("id")).alias("o"),
    )
    got = series.number_rows(df, ["k"], ["o"], total="n", limit=limit)
    assert got.count() == 300
    wrong = got.withColumn("want", F.expr("row_number() OVER (PARTITION BY k ORDER BY o)")).withColumn(
        "all", F.expr("count(*) OVER (PARTITION BY k)")
    )
    assert wrong.filter("position <> want OR n <> all").count() == 0


def test_slices_stay_even_when_the_order_column_is_not(spark, monkeypatch):
    # One far outlier; the other rows crowd at the start of the range.
    df = spark.range(4000).select(F.lit(1).alias("k"), F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).alias("o"))
    long = series.long_series(df, ["k"], F.col("o").cast("double"), 100)
    sizes = series._sliced(df.join(long, "k"), F.col("o").cast("double"), 100).groupBy("_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 200
    got = series.number_rows(df, ["k"], ["o"], limit=100)
    assert got.filter("position <> CASE WHEN o < 4000 THEN o ELSE 4000 END").count() == 0


def test_numbering_without_keys(spark):
    df = spark.range(100).select((F.col("id") * 3 % 101).alias("o"))
    got = series.number_rows(df, [], ["o"], limit=7)
    assert [r["position"] for r in got.orderBy("o").collect()] == list(range(1, 101))


def test_last_value_is_per_column(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 5.0, "a"), (1, 1, 2, float("nan"), "b"), (1, 1, 3, None, None)],
        "subset int, unit int, cycle int, x double, y string",
    )
    assert rows_of(ent.last_values(df, KEYS, "cycle", ["x", "y"]), "unit") == [(1, 1, 3, 5.0, "b")]


def test_latest_features_equal_last_rolling_row(spark):
    # The last 30 values of x are missing, so the mean of the last frame that had one remains.
    values = [float(i) for i in range(1, 11)] + [None] * 35
    df = spark.createDataFrame(
        [(1, 1, i + 1, v) for i, v in enumerate(values)], "subset int, unit int, cycle int, x double"
    )
    rolled = feat.rolling_features(df, KEYS, "cycle", ["x"])
    want = ent.last_values(rolled, KEYS, "cycle", ["x", "x_rm", "x_rs"]).first()
    got = feat.latest_features(df, KEYS, "cycle", ["x"]).first()
    assert got.asDict() == want.asDict()
    assert got["x_rm"] == 10.0


def test_constant_column_scales_to_zero_without_clipping(spark):
    train = spark.createDataFrame([(1, 7.0, 0.0), (1, 7.0, 10.0)], "subset int, a double, b double")
    test = spark.createDataFrame([(1, 7.0, 15.0), (1, 8.0, -5.0)], "subset int, a double, b double")
    ranges = feat.fit_minmax(train, ["a", "b"], ["subset"])
    assert rows_of(feat.apply_minmax(test, ranges, ["a", "b"], ["subset"]), "a") == [(1, 0.0, 1.5), (1, 1.0, -0.5)]


def test_label_is_capped_and_never_rises(spark):
    df = series_df(spark, [0.0] * 200)
    got = [r["rul"] for r in feat.remaining_life(df, KEYS, "cycle", slice_rows=16).orderBy("cycle").collect()]
    assert got[0] == 125 and got[-1] == 0
    assert all(a >= b for a, b in zip(got, got[1:])) and max(got) == S.RUL_CAP


def test_rows_without_a_key_keep_their_place(spark):
    df = spark.createDataFrame([(None, 1, 3), (1, 1, 5), (1, 1, 8)], "subset int, unit int, cycle int")
    assert feat.remaining_life(df, KEYS, "cycle").count() == 3


@pytest.mark.parametrize("rul,status", [(0, "CRITICAL"), (10, "CRITICAL"), (10.01, "WARNING"), (30, "WARNING"), (30.5, "HEALTHY")])
def test_status_edges(spark, rul, status):
    assert one(spark, C.health_status(F.lit(float(rul)))) == status


def test_status_of_missing_life(spark):
    assert one(spark, C.health_status(F.lit(None).cast("double"))) == "HEALTHY"
    assert one(spark, C.health_status(F.lit(float("nan")))) == "HEALTHY"


@pytest.mark.parametrize("error,band", [(10, "OK"), (10.01, "LATE"), (-10, "OK"), (-10.5, "EARLY"), (0, "OK")])
def test_error_band_edges(spark, error, band):
    assert one(spark, C.error_band(F.lit(float(error)))) == band


def test_band_on_rounded_error(spark):
    df = spark.createDataFrame([(10.04, 0.0)], "predicted_rul double, true_rul double")
    assert tr.error_columns(df).first()["band"] == "LATE"
    assert tr.error_columns(df, round_first=True).first()["band"] == "OK"


@pytest.mark.parametrize("error,penalty", [(-13, math.e - 1), (0, 0.0), (10, math.e - 1)])
def test_penalty(spark, error, penalty):
    assert one(spark, C.late_early_penalty(F.lit(float(error)))) == pytest.approx(penalty)


def test_late_costs_more_than_early(spark):
    late, early = (one(spark, C.late_early_penalty(F.lit(d))) for d in (7.0, -7.0))
    assert late > early > 0


def test_clip_keeps_missing_missing(spark):
    assert one(spark, C.clip_rul(F.lit(-3.0))) == 0.0
    assert one(spark, C.clip_rul(F.lit(300.0))) == 125.0
    assert one(spark, C.clip_rul(F.lit(float("nan")))) is None
    assert one(spark, C.clip_rul(F.lit(None).cast("double"))) is None


def test_decimal_rounding_is_half_away(spark):
    assert one(spark, C.decimal_round(F.lit(0.25), 1)) == 0.3
    assert one(spark, C.decimal_round(F.lit(-0.25), 1)) == -0.3


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    import datetime

    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = datetime.datetime(2024, 3, 10, 2, 30)
        assert one(spark, C.hours_before(at, F.lit(5))) == datetime.datetime(2024, 3, 9, 21, 30)
        assert one(spark, C.seconds_of(C.time_literal(at))) == 1710037800
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dataset_labels(spark):
    assert one(spark, C.dataset_label(F.lit(3))) == "FD003"
    assert one(spark, C.dataset_subset(F.lit("FD004"))) == 4
    assert one(spark, C.dataset_subset(F.lit("FD005"))) is None
    assert C.subset_of_label("FD002") == 2
    with pytest.raises(ValueError):
        C.subset_of_label("FD02")


def test_sensor_sets():
    assert len(S.feature_columns(S.SENSORS[1])) == 40
    assert all(len(S.feature_columns(S.SENSORS[k])) == 43 for k in (2, 3, 4))
    assert S.feature_columns(["s2"]) == ["s2", "s2_rm", "s2_rs", "cycle"]


def test_sensor_label(spark):
    assert one(spark, C.sensor_label(F.lit("s17"))) == "HP Turbine Cool Air Flow (lbm/s)"
    assert one(spark, C.sensor_label(F.lit("s1"))) is None


def test_accuracy_figures(spark):
    df = spark.createDataFrame([(10.0, 20.0), (30.0, 20.0), (41.0, 30.0)], "predicted_rul double, true_rul double")
    r = acc.accuracy(tr.error_columns(df)).first()
    assert r["rmse"] == pytest.approx(math.sqrt((100 + 100 + 121) / 3))
    assert r["mae"] == pytest.approx(31 / 3)
    assert r["r2"] == pytest.approx(1 - 321 / (200 / 3))
    assert (r["late"], r["early"], r["on_time"]) == (1, 0, 2)


def test_accuracy_of_nothing(spark):
    empty = spark.createDataFrame([], "error double, true_rul double")
    r = acc.accuracy(empty).first()
    assert r["n_evaluated"] == 0 and r["on_time_percent"] is None and r["rmse"] is None
    assert acc.accuracy(empty.withColumn("subset", F.lit(1)), ["subset"]).count() == 0


def test_constant_truth_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "error double, true_rul double")
    assert acc.accuracy(df).first()["r2"] is None


def test_histogram(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (4.9,), (5.0,)], "error double")
    assert rows_of(acc.error_histogram(df, 5), "bucket") == [(-5.0, 1), (0.0, 2), (5.0, 1)]
    assert acc.histogram_width(df.filter("error > 100")) == 1.0
    assert acc.histogram_width(df) > 0


def test_life_stages(spark):
    def fractions(n, given=None):
        df = spark.createDataFrame([(1, u, 100) for u in range(1, n + 1)], "subset int, unit int, cycle int")
        cuts = ent.life_stage_cuts(df, KEYS, "cycle", given)
        return [round(r["life_fraction"], 4) for r in cuts.orderBy("unit").collect()]

    assert fractions(5) == [0.2, 0.3, 0.42, 0.52, 0.8]
    assert fractions(7) == [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
    assert fractions(1) == [0.4]
    assert fractions(3) == [0.2, 0.5, 0.8]
    assert fractions(7, [0.5, 1.0]) == [0.5, 1.0]


def test_life_cut_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, 1)], "subset int, unit int, cycle int")
    cuts = ent.life_stage_cuts(df, KEYS, "cycle", [0.5, 0.5, 0.1])
    assert [r["cut_cycle"] for r in cuts.orderBy("unit").collect()] == [2, 4, 1]


def test_empty_selection_means_all(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "subset int, unit int")
    assert ent.select_entities(df, []).count() == ent.select_entities(df, None).count() == 2
    assert ent.select_entities(df, [2]).count() == 1
    assert ent.select_entities(df, list(range(2, 5000))).count() == 1


def test_sample_is_repeatable(spark):
    df = spark.range(100).withColumnRenamed("id", "unit")
    first = {r["unit"] for r in ent.sample_entities(df, ["unit"], 10, 1).collect()}
    assert first == {r["unit"] for r in ent.sample_entities(df, ["unit"], 10, 1).collect()}
    assert first != {r["unit"] for r in ent.sample_entities(df, ["unit"], 10, 2).collect()}


@pytest.mark.parametrize(
    "cycles,reason",
    [([1, 2, 3], None), ([5], None), ([1, 2, 2, 1], "duplicate cycles"), ([2, 1, 9], "not ascending"), ([1, 3], "gaps"), ([], "empty")],
)
def test_sequence_precedence(spark, cycles, reason):
    df = spark.createDataFrame([(cycles,)], "c array<int>")
    assert df.select(val.sequence_reason(F.col("c"))).first()[0] == reason


def test_table_sequences(spark):
    data = {1: [1, 2, 3], 2: [1, 1, 5], 3: [3, 1, 2], 4: [1, 2, 4], 5: [7]}
    df = spark.createDataFrame(
        [(1, u, c, i) for u, cs in data.items() for i, c in enumerate(cs)], "subset int, unit int, cycle int, at int"
    )
    got = val.validate_sequence(df, KEYS, "cycle", ["at"])
    assert {r["unit"]: r["reason"] for r in got.collect()} == {
        1: None, 2: "duplicate cycles", 3: "not ascending", 4: "gaps", 5: None,
    }


def reading(**changes):
    base = {"subset": 2, "unit": 1, "cycle": 1, **{c: 1.0 for c in S.SETTINGS + S.ALL_SENSORS}}
    return {**base, **changes}


@pytest.mark.parametrize(
    "changes,reasons",
    [
        ({}, []),
        ({"s15": None}, ["s15 missing"]),
        ({"s15": None, "subset": 1}, []),
        ({"s15": float("inf")}, ["s15 not finite"]),
        ({"s2": float("nan"), "cycle": 0}, ["cycle below 1", "s2 not finite"]),
        ({"subset": 9, "s4": None}, ["subset out of range"]),
        ({"unit": None}, ["unit below 1"]),
    ],
)
def test_reading_rules(spark, changes, reasons):
    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField(c, T.IntegerType()) for c in ("subset", "unit", "cycle")]
        + [T.StructField(c, T.DoubleType()) for c in S.SETTINGS + S.ALL_SENSORS]
    )
    row = reading(**changes)
    df = spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema)
    good, bad = val.validate(df, val.reading_rules())
    assert good.count() == (0 if reasons else 1)
    assert [r["reasons"] for r in bad.collect()] == ([reasons] if reasons else [])


def test_truth_rules(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (2, -1.0), (3, None)], S.TRUTH_SCHEMA)
    good, bad = val.validate(df, val.truth_rules())
    assert good.count() == 1 and bad.count() == 3


def test_first_truth_wins_and_unknown_ids_are_reported(spark):
    pred = spark.createDataFrame([(1, 20.0), (2, 50.0)], "prediction_id long, predicted_rul double")
    truth = spark.createDataFrame(
        [(1, 25.0, "2024-01-01"), (1, 99.0, "2024-01-02"), (7, 1.0, "2024-01-01")],
        "prediction_id long, true_rul double, submitted_at string",
    )
    errors, unknown = tr.score_truths(pred, truth)
    assert [(r["prediction_id"], r["error"]) for r in errors.collect()] == [(1, -5.0)]
    assert [r["prediction_id"] for r in unknown.collect()] == [7]


def test_positions_must_match_in_number(spark):
    pred = spark.createDataFrame([(1, 4), (1, 9), (2, 1)], "subset int, unit int")
    truth = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (3, 1, 5.0)], "subset int, unit_rank long, true_rul double")
    matched, rejects = tr.attach_truth_by_rank(pred, truth, KEYS)
    assert {(r["unit"], r["true_rul"]) for r in matched.collect()} == {(4, 10.0), (9, 20.0)}
    left = {(r["subset"], r["unit_rank"], r["unit"], r["true_rul"], r["reason"]) for r in rejects.collect()}
    assert left == {
        (2, 1, 1, None, "no truth at this position"),
        (3, 1, None, 5.0, "no entity at this position"),
    }
    assert rows_of(tr.truth_counts(pred, truth, "subset"), "subset") == [(1, 2, 2, True), (2, 1, 0, False), (3, 0, 1, False)]


def test_latest_state_breaks_ties_by_id(spark):
    df = spark.createDataFrame(
        [(1, 5, "t1"), (1, 6, "t1"), (1, 4, "t0")], "engine_id int, prediction_id int, predicted_at string"
    )
    assert [r["prediction_id"] for r in fleet.latest_state(df).collect()] == [6]


def test_hour_edges(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 11:00:00' AS predicted_at UNION ALL SELECT timestamp_ntz'2024-01-01 11:30:00'")
    assert fleet.recent_count(df, "2024-01-01 12:00:00").first()[0] == 1
    assert fleet.since_hours(df, "2024-01-01 12:00:00", 1).count() == 2


def test_status_totals_fill_with_zero(spark):
    summary = spark.createDataFrame([(1, "HEALTHY", 3), (2, "HEALTHY", 4)], "subset int, health_status string, engine_count long")
    assert tuple(fleet.status_totals(summary).first()) == (7, 0, 0)
    assert tuple(fleet.status_totals(summary.limit(0)).first()) == (0, 0, 0)


def test_statistics_of_an_empty_log(spark):
    pred = spark.createDataFrame(
        [], "engine_id long, prediction_id long, predicted_rul double, predicted_at timestamp_ntz"
    )
    engines = spark.createDataFrame([], "engine_id long, unit_number long, subset int")
    r = fleet.fleet_statistics(pred, engines, "2024-01-01 00:00:00").first()
    assert (r["total_predictions"], r["predictions_last_hour"], r["health_breakdown"]) == (0, 0, [])


def test_status_changes(spark):
    df = spark.createDataFrame(
        [(1, 1, "HEALTHY"), (1, 2, "HEALTHY"), (1, 3, "WARNING"), (1, 4, "CRITICAL"), (2, 1, "CRITICAL")],
        "engine_id int, cycle int, health_status string",
    )
    got = rows_of(fleet.status_changes(df, ["engine_id"], "cycle").select("cycle", "previous", "health_status"), "cycle")
    assert got == [(3, "HEALTHY", "WARNING"), (4, "WARNING", "CRITICAL")]


class Constant:
    """Predicts the same remaining life for every row."""

    def __init__(self, value):
        self.value = value

    def predict(self, df):
        return df.withColumn("prediction", F.lit(self.value))


def test_scores_are_clipped_and_rounded(spark):
    df = spark.createDataFrame([(1,)], "subset int")
    assert scoring.score(df, Constant(12.26)).first()["predicted_rul"] == 12.3
    assert scoring.score(df, Constant(500.0)).first()["predicted_rul"] == 125.0
    assert scoring.score(df, Constant(-1.0)).first()["health_status"] == "CRITICAL"


def sequence(subset, cycles, **changes):
    rows = [Row(**{k: v for k, v in reading(cycle=c, **changes).items() if k not in ("subset", "unit")}) for c in cycles]
    return (subset, 1, [r.asDict() for r in rows])


def test_sequences_are_checked_and_scored(spark):
    data = [
        sequence(2, [1, 2, 3]),
        sequence(2, [1, 3]),
        sequence(9, [1]),
        sequence(2, [1], s15=None),
        sequence(1, [1], s15=None),
        sequence(2, [1], s3=float("inf")),
        (2, 1, []),
    ]
    df = spark.createDataFrame(data, S.SEQUENCE_SCHEMA)
    scored, rejects = scoring.score_sequences(df, Constant(20.0))
    assert sorted(r["n_history_cycles"] for r in scored.collect()) == [1, 3]
    assert sorted(r["reason"] for r in rejects.collect()) == [
        "empty", "gaps", "s15 missing", "subset out of range", "value not finite",
    ]
    assert all("historical cycles" in r["note"] for r in scored.collect())


def test_sequence_features_match_the_table_operator(spark):
    values = [float((i * 37) % 11) for i in range(45)]
    history = [
        {**{c: 1.0 for c in S.SETTINGS + S.ALL_SENSORS}, "cycle": i + 1, "s2": v} for i, v in enumerate(values)
    ]
    request = spark.createDataFrame([(2, 1, history)], S.SEQUENCE_SCHEMA)
    got = scoring.sequence_features(request).first()
    want = feat.latest_features(
        spark.createDataFrame([(2, 1, i + 1, v) for i, v in enumerate(values)], "subset int, unit int, cycle int, s2 double"),
        KEYS, "cycle", ["s2"],
    ).first()
    assert got["s2_rm"] == pytest.approx(want["s2_rm"]) and got["s2_rs"] == pytest.approx(want["s2_rs"])
    assert (got["cycle"], got["n_history_cycles"]) == (45, 45)


def test_history_times_step_back_by_the_hour(spark):
    import datetime

    df = spark.createDataFrame([(1, 1, 1, 0.0), (1, 1, 2, 0.0), (1, 2, 5, 0.0)], "subset int, unit int, cycle int, s2 double")
    now = datetime.datetime(2024, 1, 1, 12)
    got = scoring.score_history(df, Constant(1.0), now, ["s2"])
    assert {r["cycle"]: r["predicted_at"].hour for r in got.collect()} == {1: 8, 2: 9, 5: 12}


def test_penalty_sums_have_no_largest_value(spark):
    df = spark.createDataFrame([(125.0, 1200.0), (125.0, 2000.0)], "predicted_rul double, true_rul double")
    value = tr.error_columns(df).agg(C.decimal_round(acc.penalty_sum(), 1).alias("x")).first()["x"]
    assert value == pytest.approx(math.exp(1075 / 13) + math.exp(1875 / 13))


@pytest.mark.parametrize("limit", [10_000, 20])
def test_missing_order_values_come_first_at_any_size(spark, limit):
    values = [None if i % 50 == 7 else float("nan") if i % 50 == 8 else float(i * 37 % 200) for i in range(200)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, at double")
    got = {r["i"]: r["position"] for r in series.number_rows(df, ["k"], ["at", "i"], limit=limit).collect()}
    order = sorted(
        range(200),
        key=lambda i: (0, 0, i) if values[i] is None else (2, 0, i) if math.isnan(values[i]) else (1, values[i], i),
    )
    assert got == {i: n + 1 for n, i in enumerate(order)}


def test_an_infinite_value_stays_with_its_series(spark):
    cols = ["s2", "s3", "s4", "s7"]
    rows = [(u, c, *([float("inf") if u == 1 and c > 30 else float(c + u)] * 4)) for u in (1, 2) for c in range(1, 41)]
    df = spark.createDataFrame(rows, "unit int, cycle int, " + ", ".join(f"{c} double" for c in cols))
    many = feat.rolling_features(df, ["unit"], "cycle", cols, position="cycle")
    one = feat.rolling_features(df, ["unit"], "cycle", ["s2"], position="cycle")
    pick = lambda d: sorted((r["unit"], r["cycle"], repr(r["s2_rm"]), repr(round(r["s2_rs"], 9))) for r in d.collect())
    assert pick(many) == pick(one)
    assert all("nan" not in r[2] + r[3] for r in pick(many) if r[0] == 2)
