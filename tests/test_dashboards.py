"""The dashboard pack over written tables, against DuckDB on the same files."""

import datetime

import duckdb
import pytest

from twins import SF, cells
from wearline.plans.dashboards import named_queries
from wearline.plans.fixtures import Tables
from wearline.sources.tables import TABLES, read_tables

UNIT, DATASET = 6, "FD002"
OF_ENGINE = f"JOIN engines e ON e.engine_id = p.engine_id WHERE e.unit_number = {UNIT} AND concat('FD00', e.subset) = '{DATASET}'"
LATEST = """(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY engine_id ORDER BY predicted_at DESC, prediction_id DESC) AS rn
 FROM predictions) WHERE rn = 1)"""
JOINED = "prediction_errors pe JOIN predictions p ON p.prediction_id = pe.prediction_id JOIN engines e ON e.engine_id = p.engine_id"


def num(expr, places):
    return f"CAST(round(CAST({expr} AS DECIMAL(38,6)), {places}) AS DOUBLE)"


PANELS = {
    "fleet.total_engines": "SELECT count(DISTINCT engine_id) AS total_engines FROM predictions",
    "fleet.healthy": f"SELECT count(*) AS engines FROM {LATEST} WHERE health_status = 'HEALTHY'",
    "fleet.warning": f"SELECT count(*) AS engines FROM {LATEST} WHERE health_status = 'WARNING'",
    "fleet.critical": f"SELECT count(*) AS engines FROM {LATEST} WHERE health_status = 'CRITICAL'",
    "fleet.predictions_last_hour": "SELECT count(*) AS predictions FROM predictions WHERE predicted_at > $as_of::TIMESTAMP - INTERVAL 1 HOUR",
    "fleet.mean_rul": f"SELECT {num('avg(predicted_rul)', 1)} AS avg_rul FROM {LATEST}",
    "fleet.status_distribution": f"""SELECT count(*) FILTER (health_status = 'HEALTHY') AS healthy, count(*) FILTER (health_status = 'WARNING') AS warning,
        count(*) FILTER (health_status = 'CRITICAL') AS critical FROM {LATEST}""",
    "fleet.activity": """SELECT date_trunc('minute', predicted_at)::TIMESTAMP AS time, count(*) AS predictions FROM predictions
        WHERE predicted_at >= $as_of::TIMESTAMP - INTERVAL 3 HOUR GROUP BY 1""",
    "fleet.hourly_rul": f"""SELECT date_trunc('hour', predicted_at)::TIMESTAMP AS time, {num('avg(predicted_rul)', 1)} AS avg_remaining_life FROM predictions
        WHERE predicted_at >= $as_of::TIMESTAMP - INTERVAL 24 HOUR GROUP BY 1""",
    "engine.current_rul": f"SELECT p.predicted_rul FROM predictions p {OF_ENGINE} ORDER BY p.predicted_at DESC LIMIT 1",
    "engine.status": f"SELECT p.health_status FROM predictions p {OF_ENGINE} ORDER BY p.predicted_at DESC LIMIT 1",
    "engine.last_cycle": f"SELECT p.cycle FROM predictions p {OF_ENGINE} ORDER BY p.predicted_at DESC LIMIT 1",
    "engine.history_used": f"SELECT p.n_history_cycles FROM predictions p {OF_ENGINE} ORDER BY p.predicted_at DESC LIMIT 1",
    "engine.total": f"SELECT count(*) AS predictions FROM predictions p {OF_ENGINE}",
    "engine.latency": f"SELECT {num('avg(p.latency_ms)', 2)} AS avg_latency FROM predictions p {OF_ENGINE}",
    "engine.rul_history": f"SELECT p.predicted_at AS time, p.predicted_rul, 10.0::DOUBLE AS critical_threshold, 30.0::DOUBLE AS warning_threshold FROM predictions p {OF_ENGINE}",
    "engine.sensors": f"SELECT p.recorded_at AS time, p.s3, p.s4, p.s11, p.s17 FROM sensor_readings p {OF_ENGINE}",
    "engine.more_sensors": f"SELECT p.recorded_at AS time, p.s2, p.s9, p.s12, p.s20, p.s21 FROM sensor_readings p {OF_ENGINE}",
    "engine.log": f"""SELECT p.engine_id, p.prediction_id, p.predicted_at, p.cycle, p.predicted_rul, p.health_status, p.latency_ms, p.endpoint
        FROM predictions p {OF_ENGINE} ORDER BY p.predicted_at DESC LIMIT 100""",
    "engine.dataset_variable": "SELECT 'FD00' || subset AS dataset FROM model_registry WHERE is_active",
    "engine.engine_variable": f"""SELECT DISTINCT 'FD00' || e.subset AS dataset, e.unit_number FROM engines e JOIN predictions p ON p.engine_id = e.engine_id
        WHERE concat('FD00', e.subset) = '{DATASET}'""",
    "accuracy.total_predictions": "SELECT count(*) AS total_predictions FROM predictions",
    "accuracy.evaluated": "SELECT count(*) AS evaluated FROM prediction_errors",
    "accuracy.rmse": f"SELECT {num('sqrt(avg(abs_error * abs_error))', 2)} AS rmse FROM prediction_errors",
    "accuracy.mae": f"SELECT {num('avg(abs_error)', 2)} AS mae FROM prediction_errors",
    "accuracy.nasa_score": f"SELECT {num('sum(nasa_penalty)', 1)} AS nasa_score FROM prediction_errors",
    "accuracy.on_time": "SELECT round(100.0 * sum(CASE WHEN abs(error) <= 10 THEN 1 ELSE 0 END) / nullif(count(*), 0), 1) AS on_time_percent FROM prediction_errors",
    "accuracy.live_accuracy": f"""SELECT 'FD00' || e.subset AS dataset, count(*) AS n_evaluated, {num('sqrt(avg(pe.abs_error * pe.abs_error))', 2)} AS live_rmse,
        {num('avg(pe.abs_error)', 2)} AS live_mae, {num('sum(pe.nasa_penalty)', 1)} AS nasa_score FROM {JOINED} GROUP BY e.subset""",
    "accuracy.rmse_trend": f"""SELECT date_trunc('hour', pe.submitted_at)::TIMESTAMP AS time, 'FD00' || e.subset AS metric,
        {num('sqrt(avg(pe.abs_error * pe.abs_error))', 2)} AS value FROM {JOINED} WHERE pe.submitted_at BETWEEN $since AND $until GROUP BY 1, e.subset""",
    "accuracy.nasa_trend": f"""SELECT date_trunc('hour', pe.submitted_at)::TIMESTAMP AS time, 'FD00' || e.subset AS metric,
        {num('sum(pe.nasa_penalty)', 1)} AS value FROM {JOINED} WHERE pe.submitted_at BETWEEN $since AND $until GROUP BY 1, e.subset""",
    "accuracy.late_early": f"""SELECT 'FD00' || e.subset AS dataset, count(*) FILTER (pe.error > 10) AS late, count(*) FILTER (abs(pe.error) <= 10) AS on_time,
        count(*) FILTER (pe.error < -10) AS early FROM {JOINED} GROUP BY e.subset""",
    "accuracy.errors": f"SELECT pe.error FROM {JOINED}",
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    t = Tables(spark, SF)
    frames = {
        "engines": t.engines,
        "sensor_readings": t.readings.drop("subset", "unit", "n_rows", "event_id"),
        "model_registry": t.registry,
        "predictions": t.predictions,
        "prediction_errors": t.errors,
    }
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{folder}/{name}/*.parquet'")
    params = {
        "as_of": t.as_of,
        "since": t.as_of - datetime.timedelta(days=9),
        "until": t.as_of - datetime.timedelta(days=1),
        "dataset": DATASET,
        "unit": UNIT,
    }
    tables = read_tables(spark, folder)
    return tables, params, named_queries(tables, params), con


def test_every_panel_is_there(stored):
    assert len(stored[2]) == 36


@pytest.mark.parametrize("name", sorted(PANELS))
def test_panel(stored, name):
    _tables, params, panels, con = stored
    sql = PANELS[name]
    bound = {k: str(params[k]) for k in ("as_of", "since", "until") if f"${k}" in sql}
    for k, v in bound.items():
        sql = sql.replace(f"${k}::TIMESTAMP", f"${k}").replace(f"${k}", f"TIMESTAMP '{v}'")
    want = con.sql(sql).df()
    got = panels[name].toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
    assert len(got) > 0


def test_accuracy_panels_follow_the_dataset(stored):
    tables, params, _panels, con = stored
    one = named_queries(tables, {**params, "accuracy_dataset": DATASET})
    want = con.sql(f"SELECT count(*) FROM {JOINED} WHERE e.subset = 2").fetchall()[0][0]
    assert one["accuracy.evaluated"].first()[0] == want
    assert [r["dataset"] for r in one["accuracy.late_early"].collect()] == [DATASET]


def test_unknown_dataset_is_refused(stored):
    tables, params, _panels, _con = stored
    with pytest.raises(ValueError):
        named_queries(tables, {**params, "dataset": "FD005"})


def test_engine_panels_filter_the_scan(stored):
    plan = stored[2]["engine.current_rul"]._jdf.queryExecution().toString()
    assert "EqualTo(subset,2)" in plan and f"EqualTo(unit_number,{UNIT})" in plan
