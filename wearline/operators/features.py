"""Labels, trailing-window features and min-max scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import series
from wearline.operators.moments import trailing_moments


# From this many columns on, trailing moments run over Arrow batches: each
# sliding aggregate is updated for every row of every frame, and beyond a few of
# them the generated code is too large to be compiled. Measured on 3 million
# rows and 8 cores, shuffle and sort included: 1 column 5 s as window functions;
# 14 columns 39 s as window functions and 8 s over Arrow batches.
ARROW_COLUMNS = 4


def rolling_features(
    df: DataFrame,
    keys: list[str],
    seq: str,
    cols: list[str],
    window: int = S.WINDOW,
    position: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Mean ``<c>_rm`` and sample deviation ``<c>_rs`` over the trailing rows.

    The frame counts rows, not distance in ``seq``. NaN counts as missing; a
    frame with fewer than two values has deviation 0. Pass ``position`` when the
    table already holds a gap-free counter from 1 (as ``cycle`` does in valid
    logs): the plan then has a single shuffle of the rows. Without it the rows
    are numbered first. Either way the rows of a series block are shuffled and
    sorted once for all columns.
    """
    src = df if position else series.number_rows(df, keys, [seq], out="_position")
    order = position or "_position"
    if len(cols) >= ARROW_COLUMNS:
        out = _moments_in_batches(src, keys, order, cols, window, block_rows)
    else:

        def build(w):
            frame = w.rowsBetween(-(window - 1), 0)
            means = {f"{c}_rm": F.avg(C.finite(c)).over(frame) for c in cols}
            devs = {f"{c}_rs": F.coalesce(F.stddev_samp(C.finite(c)).over(frame), F.lit(0.0)) for c in cols}
            return {**means, **devs}

        out = series.over_trailing_rows(src, keys, order, window - 1, build, block_rows)
    return out if position else out.drop("_position")


def _moments_in_batches(
    df: DataFrame, keys: list[str], position: str, cols: list[str], window: int, block_rows: int | None
) -> DataFrame:
    """The same features from sorted blocks, computed per Arrow batch. The row
    number within the block brings the shuffle and the sort."""
    blocked = series.trailing_blocks(df, position, window - 1, block_rows)
    in_block = Window.partitionBy(*keys, "_block").orderBy(position)
    aged = blocked.withColumn("_age", F.row_number().over(in_block)).drop("_block")
    doubles = [T.StructField(f"{c}_{k}", T.DoubleType()) for k in ("rm", "rs") for c in cols]
    schema = T.StructType([*df.schema.fields, *doubles])
    return aged.mapInArrow(trailing_moments(cols, window, "_age", "_halo"), schema)


def remaining_life(
    df: DataFrame, keys: list[str], seq: str, cap: int = S.RUL_CAP, out: str = "rul", slice_rows: int | None = None
) -> DataFrame:
    """Label each row with min(last seq of its series - seq, cap)."""
    with_last = series.attach_series(df, keys, series.slice_of(seq, slice_rows), {"_last": (F.max, F.col(seq))})
    return with_last.withColumn(out, F.least(F.col("_last") - F.col(seq), F.lit(cap))).drop("_last")


def latest_features(df: DataFrame, keys: list[str], seq: str, cols: list[str], window: int = S.WINDOW) -> DataFrame:
    """One feature row per series, as of its last row.

    Equal to the last non-missing value per column of ``rolling_features``, but
    only the last ``window`` rows of each series cross the shuffle: the rank
    filter is pushed ahead of it, and the rest are partial aggregates. When the
    whole last frame of a column is missing, the last mean that exists is that
    of a frame holding one value, hence the fallback to the value itself.
    """
    last = df.groupBy(*keys).agg(
        F.max(seq).alias(seq),
        *[F.max_by(C.finite(c), F.when(C.finite(c).isNotNull(), F.col(seq))).alias(c) for c in cols],
    )
    newest = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    tail = (
        df.select(*keys, seq, *cols)
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= window)
        .groupBy(*keys)
        .agg(
            *[F.avg(C.finite(c)).alias(f"{c}_rm") for c in cols],
            *[F.coalesce(F.stddev_samp(C.finite(c)), F.lit(0.0)).alias(f"{c}_rs") for c in cols],
        )
    )
    joined = last.join(tail, keys)
    return joined.select(
        *keys,
        seq,
        *cols,
        *[F.coalesce(f"{c}_rm", c).alias(f"{c}_rm") for c in cols],
        *[f"{c}_rs" for c in cols],
    )


def snapshot_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Features of a lone row: the mean is the value, the deviation 0."""
    return df.select(
        "*",
        *[F.col(c).alias(f"{c}_rm") for c in cols],
        *[F.when(F.col(c).isNotNull(), 0.0).alias(f"{c}_rs") for c in cols],
    )


def fit_minmax(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Range of each column per group: ``<c>_min`` and ``<c>_max``."""
    return df.groupBy(*by).agg(
        *[F.min(C.finite(c)).alias(f"{c}_min") for c in cols],
        *[F.max(C.finite(c)).alias(f"{c}_max") for c in cols],
    )


def apply_minmax(df: DataFrame, ranges: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Scale columns by fitted ranges; rows move only if the ranges are many."""
    low_high = [f"{c}_{side}" for c in cols for side in ("min", "max")]
    joined = df.join(series.checked_broadcast(ranges.select(*by, *low_high)), by, "left")
    scaled = {c: C.min_max_scaled(C.finite(c), f"{c}_min", f"{c}_max") for c in cols}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])
