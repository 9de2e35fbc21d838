"""Physical plans: what scales and what must not appear."""

import re

import pytest

import __spark_entry__ as contract
from twins import SF
from wearline import schema as S
from wearline.operators import entities as ent
from wearline.operators import features as feat
from wearline.operators import fleet
from wearline.operators import series


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def readings(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.range(1000).selectExpr(
        "cast(id % 4 + 1 as int) AS subset", "id % 20 AS unit", "id div 20 + 1 AS cycle", "rand(1) AS s2", "rand(2) AS s3"
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_all_features_share_one_window_and_one_shuffle(readings):
    plan = plan_of(feat.rolling_features(readings, S.SERIES_KEYS, "cycle", ["s2", "s3"], position="cycle"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"(?<!Group)Window \[", plan)) == 1 and plan.count("Sort [") == 1
    assert "_block" in re.search(r"Exchange hashpartitioning\((.*?)\)", plan).group(1)


def test_many_features_share_one_sort_and_one_shuffle(readings):
    wide = readings.selectExpr("*", "s2 AS a", "s3 AS b")
    plan = plan_of(feat.rolling_features(wide, S.SERIES_KEYS, "cycle", ["s2", "s3", "a", "b"], position="cycle"))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert plan.count("MapInArrow") == 1


def test_latest_row_is_ranked_before_the_shuffle(readings):
    plan = plan_of(ent.latest_row(readings, S.SERIES_KEYS, ["cycle"]))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_latest_features_prune_before_the_shuffle(readings):
    plan = plan_of(feat.latest_features(readings, S.SERIES_KEYS, "cycle", ["s2"]))
    assert "row_number(), 30, Partial" in plan
    assert "partial_max_by" in plan


def test_attention_list_is_a_top_k(readings):
    state = readings.selectExpr(
        "unit AS engine_id", "cycle AS prediction_id", "cycle", "s2 AS predicted_rul", "'CRITICAL' AS health_status", "current_timestamp() AS predicted_at"
    )
    engines = readings.selectExpr("unit AS engine_id", "unit AS unit_number", "subset")
    assert "TakeOrderedAndProject" in plan_of(fleet.attention_list(fleet.latest_state(state), engines))


def test_broadcast_needs_a_checked_size(readings, monkeypatch):
    small = readings.select("unit").distinct()
    assert "isBroadcastable" in series.checked_broadcast(small)._jdf.queryExecution().logical().toString() or (
        "broadcast" in series.checked_broadcast(small)._jdf.queryExecution().logical().toString().lower()
    )
    monkeypatch.setattr(series, "BROADCAST_ROWS", 3)
    assert "broadcast" not in series.checked_broadcast(small)._jdf.queryExecution().logical().toString().lower()


def test_long_series_join_on_slices(readings, monkeypatch):
    monkeypatch.setattr(series, "SERIES_ROWS", 10)
    plan = plan_of(series.number_rows(readings, S.SERIES_KEYS, ["cycle"]))
    windows = [m for m in re.findall(r"row_number\(\) windowspecdefinition\((.*?)specified", plan)]
    assert windows and all("_slice" in w for w in windows)


# Streams read back what they wrote; trees and many columns run over Arrow batches; training-data queries have tests of their own.
OTHER = ("stream", "tree", "model_cards", "rolling_all", "boosted", "one_split")


@pytest.mark.parametrize("name", sorted(n for n in contract.queries() if not n.startswith(OTHER) and n not in contract.LLM_QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF))
    for word in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition, REPARTITION"):
        assert word not in plan


def test_each_tree_model_reads_its_own_subset(spark, readings):
    from wearline.operators import scoring

    class PerSubset:
        subsets = [1, 2, 3, 4]

        def predict(self, df, subset):
            return df.selectExpr("*", "0.0 AS prediction")

    wide = readings.selectExpr("*", "s2 AS a", "s3 AS b")
    plan = plan_of(
        scoring.score(
            wide, PerSubset(), 125,
            lambda rows: feat.rolling_features(rows, S.SERIES_KEYS, "cycle", ["s2", "s3", "a", "b"], position="cycle"),
        )
    )
    assert plan.count("MapInArrow") == 4
    assert all(f"EqualTo(subset,{k})" in plan for k in PerSubset.subsets)
