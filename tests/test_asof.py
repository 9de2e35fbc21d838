"""As-of joins on long and short series, against a plain search."""

import bisect

import pytest
from pyspark.sql import functions as F

from wearline.operators import asof, fleet


def tables(spark):
    """Series 0 holds most rows of both sides; times repeat; some rows lack a time or a key."""
    left = [(i, 0 if i % 3 else i % 5, float(i * 37 % 400)) for i in range(600)] + [(900, 1, None), (901, None, 5.0), (902, 99, 5.0)]
    right = [(0 if i % 4 else i % 5, float(i * 53 % 410), i) for i in range(300)] + [(1, None, 1000), (None, 1.0, 1001)]
    return spark.createDataFrame(left, "id long, k long, t double"), spark.createDataFrame(right, "k long, at double, v long"), left, right


def plain(left, right, reach=None):
    out = {}
    for i, k, t in left:
        own = sorted((at, v) for x, at, v in right if x == k and k is not None and at is not None)
        n = bisect.bisect_right(own, (t, float("inf"))) if t is not None else 0
        hit = own[n - 1] if n else (None, None)
        out[i] = hit if reach is None or hit[0] is None or t - hit[0] <= reach else (None, None)
    return out


@pytest.mark.parametrize("limit", [None, 40])
@pytest.mark.parametrize("reach", [None, 3.0])
def test_last_row_before_by_a_plain_search(spark, limit, reach):
    a, b, left, right = tables(spark)
    joined = asof.asof_join(a, b, ["k"], "t", "at", ["v"], reach=reach, limit=limit)
    assert joined.columns == ["id", "k", "t", "at", "v"]
    assert {r["id"]: (r["at"], r["v"]) for r in joined.collect()} == plain(left, right, reach)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_rows_on_a_side(spark):
    a, b, left, _ = tables(spark)
    assert asof.asof_join(a, b.filter("false"), ["k"], "t", "at").filter("v IS NOT NULL").count() == 0
    assert asof.asof_join(a, b.filter("false"), ["k"], "t", "at").count() == len(left)
    assert asof.asof_join(a.filter("false"), b, ["k"], "t", "at").count() == 0


def test_counts_from_stored_sketches_keep_their_bound(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.range(200_000).select(
        (F.col("id") % 4 + 1).cast("int").alias("subset"), F.xxhash64(F.col("id") % 30_011).alias("engine_id"),
        F.timestamp_add("SECOND", (F.col("id") % 100_000).cast("int"), start).alias("predicted_at"),
    )
    sketches = fleet.engine_sketches(rows, precision=12)
    for unit in ("minute", "hour", "day"):
        got = {r["time"]: r["engines"] for r in fleet.engines_from_sketches(sketches, unit).collect()}
        exact = rows.groupBy(F.date_trunc(unit, "predicted_at").cast("timestamp_ntz").alias("t")).agg(F.count_distinct("engine_id").alias("n"))
        for r in exact.collect():
            assert abs(got[r["t"]] - r["n"]) <= max(1, 4 * 1.04 / 2**6 * r["n"])
