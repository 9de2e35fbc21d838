"""Every registered query against its SQL twin, on even and on skewed data."""

import duckdb
import pytest

import __spark_entry__ as contract
from twins import SF, cells, views
from wearline.operators import series

# The training-data queries have tests of their own.
QUERIES = {k: v for k, v in contract.queries().items() if k not in contract.LLM_QUERIES}
SQL = {k: v for k, v in contract.oracle_sql().items() if k in QUERIES}
# On skewed data one query per plan shape is enough; these differ from another
# only in the last projection or aggregate.
SAME_SHAPE = set(
    """accuracy_in_range active_datasets active_models backdated_times combined_datasets dataset_names engine_state
    engines_critical engines_healthy engines_warning error_histogram errors_with_engines evaluation_report
    fleet_status_totals ground_truth_scoring hourly_rul late_early_per_dataset late_early_tallies latest_with_engine
    log_file_subsets mean_latest_rul on_time_percent penalty_per_prediction penalty_score penalty_trend
    predictions_last_hour predictions_with_engines r_squared reading_upsert recent_activity recent_hourly_rul
    registry_update report_head rmse_mae rolling_deviation rul_brackets rul_history run_totals sensor_log_export
    sensor_sets status_distribution stream_accuracy stream_mean_rul total_engines total_evaluated total_predictions
    training_benchmarks truth_by_key truth_request_rows""".split()
)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_sql_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """A copy of the tables in which one user sends half of all events."""
    folder = tmp_path_factory.mktemp("skewed")
    con = views(SF)
    for (table,) in con.sql("SELECT view_name FROM duckdb_views() WHERE NOT internal").fetchall():
        body = f"FROM {table}"
        if table == "events":
            body = "SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 3 ELSE user_id END AS user_id) FROM events"
        con.sql(f"COPY ({body}) TO '{folder}/{table}.parquet'")
    return str(folder)


@pytest.fixture
def short_limits(monkeypatch):
    """Limits so low that the long series is sliced and cut into blocks."""
    monkeypatch.setattr(series, "SERIES_ROWS", 60)
    monkeypatch.setattr(series, "BLOCK_ROWS", 40)
    monkeypatch.setattr(series, "BROADCAST_ROWS", 5)


@pytest.mark.parametrize("name", sorted(set(SQL) - SAME_SHAPE))
def test_query_on_skewed_data(spark, skewed, short_limits, name):
    got = QUERIES[name](spark, skewed).toPandas()
    want = views(skewed).sql(SQL[name]).df()
    assert cells(got) == cells(want)
