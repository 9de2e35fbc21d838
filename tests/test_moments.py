"""Trailing moments of many columns against window functions and plain frames."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wearline.operators import features as feat
from wearline.operators.moments import trailing_moments


def batches(rng, columns, window, rows, at_once):
    """Rows of several series as Arrow batches, with NaN, infinities and very different sizes of values."""
    ages, values = [], []
    while len(ages) < rows:
        n = int(rng.integers(1, 3 * window + 5))
        scale = 10.0 ** rng.integers(-3, 9)
        part = (rng.normal(size=(n, columns)) + rng.integers(0, 100)) * scale
        part[rng.random(part.shape) < 0.1] = np.nan
        part[rng.random(part.shape) < 0.01] = np.inf
        ages += range(1, n + 1)
        values.append(part)
    values = np.vstack(values)
    names = [f"c{i}" for i in range(columns)]
    for a in range(0, len(ages), at_once):
        part = values[a : a + at_once]
        own = [pa.array(ages[a : a + at_once], pa.int64()), pa.array([False] * len(part))]
        yield pa.RecordBatch.from_arrays([*own, *[pa.array(part[:, i]) for i in range(columns)]], names=["age", "halo", *names])


@pytest.mark.parametrize("window", [1, 2, 7, 30])
@pytest.mark.parametrize("at_once", [1, 13, 1000])
def test_moments_equal_those_of_plain_frames(window, at_once):
    rng = np.random.default_rng(window * at_once)
    given = list(batches(rng, 4, window, 400, at_once))
    names = [f"c{i}" for i in range(4)]
    made = pa.Table.from_batches(list(trailing_moments(names, window, "age", "halo")(iter(given)))).to_pydict()
    table = pa.Table.from_batches(given).to_pydict()
    for c in names:
        for i, age in enumerate(table["age"]):
            frame = [x for x in table[c][i - min(age, window) + 1 : i + 1] if not math.isnan(x)]
            mean, deviation = made[f"{c}_rm"][i], made[f"{c}_rs"][i]
            if not frame:
                assert mean is None and deviation == 0
            elif any(math.isinf(x) for x in frame):
                assert math.isinf(mean) and (math.isnan(deviation) if len(frame) > 1 else deviation == 0)
            else:
                assert math.isclose(mean, math.fsum(frame) / len(frame), rel_tol=1e-9, abs_tol=1e-12)
                want = np.std(frame, ddof=1) if len(frame) > 1 else 0.0
                assert math.isclose(deviation, want, rel_tol=1e-9, abs_tol=1e-9 * max(map(abs, frame)) * 1e-3)


@pytest.mark.parametrize("window", [30, 300])
def test_fourteen_columns_equal_window_functions(spark, window):
    names = [f"x{i}" for i in range(14)]
    df = spark.range(3000).select(
        (F.col("id") % 7 % 3).alias("k"), (F.col("id") * 3).alias("seq"),
        *[F.when(F.col("id") % 11 == i % 11, float("nan")).when(F.col("id") % 401 == i, float("inf"))
          .otherwise((F.col("id") * (i + 3) % 101).cast("double")).alias(c) for i, c in enumerate(names)],
    )
    many = feat.rolling_features(df, ["k"], "seq", names, window).collect()
    for part in (names[:3], names[11:]):
        few = {(r["k"], r["seq"]): r for r in feat.rolling_features(df, ["k"], "seq", part, window).collect()}
        for r in many:
            for c in part:
                for end in ("rm", "rs"):
                    a, b = r[f"{c}_{end}"], few[r["k"], r["seq"]][f"{c}_{end}"]
                    same = a is b or a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
                    assert same, (r["k"], r["seq"], c, end, a, b)


def test_a_row_costs_the_same_at_any_window():
    took = {}
    names = [f"c{i}" for i in range(14)]
    for window in (30, 3000):
        given = list(batches(np.random.default_rng(1), 14, 3000, 60_000, 10_000))
        start = time.process_time()
        list(trailing_moments(names, window, "age", "halo")(iter(given)))
        took[window] = time.process_time() - start
    assert took[3000] < 3 * took[30]
