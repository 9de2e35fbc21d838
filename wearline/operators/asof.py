"""As-of joins: for each row the last row of another table at or before its time, within a series.

Both sides are put in one order per series and the last row of the other side is carried along, so
there is no range condition and no row meets more than one partner. A long series is cut into
slices of its time; a slice without an earlier row of its own takes the last one of the slices
before it. No side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.operators import series


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, order: list[str] = [],
    reach: float | None = None, limit: int | None = None,
) -> DataFrame:
    """All rows of ``left`` with the columns of the last row of ``right`` whose ``right_at`` is not
    after ``at``; null where there is none.

    ``at`` and ``right_at`` are numbers or times of one kind. Of several right rows at one time the
    one with the greatest ``order`` columns counts. With ``reach`` a right row further back (in
    units of the time, seconds for timestamps) is no partner. Rows of ``left`` without a time have
    none, and those of ``right`` are none; a missing key part matches no row. Columns of ``right``
    beside the keys must not be in ``left``.
    """
    limit = limit or series.SERIES_ROWS
    other = [c for c in right.columns if c not in keys]
    mine = left.select(
        *[F.col(k) for k in keys], F.col(at).alias("_at"), F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*other)).schema[0].dataType).alias("_right"),
    )
    known = right.filter(F.col(right_at).isNotNull())
    theirs = known.select(
        *[F.col(k) for k in keys], F.col(right_at).alias("_at"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), F.struct(*other).alias("_right"),
    )
    both = mine.unionByName(theirs)
    time = _number("_at", left.schema[at].dataType.simpleString())
    long = series.long_series(both, keys, time, limit)
    if long is None:
        sliced = both.withColumn("_slice", F.lit(0).cast("long"))
    else:
        sliced = series._sliced(both.join(long, keys, "left"), time, limit).drop("_n")
    # At one time the right rows come first, the one that counts last of them.
    tie = [F.col(f"_right.{c}").asc_nulls_first() for c in order]
    along = Window.partitionBy(*keys, "_slice").orderBy(F.col("_at").asc_nulls_first(), F.col("_left").isNotNull(), *tie)
    found = F.last("_right", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = sliced.withColumn("_found", found).filter("_left IS NOT NULL").select(*keys, "_slice", "_at", "_left", "_found")
    if long is not None:
        newest = [F.col(f"_right.{c}").alias(f"_o{i}") for i, c in enumerate(order)]
        last = F.max(F.struct("_at", *newest, "_right"))
        ends = sliced.filter("_right IS NOT NULL").groupBy(*keys, "_slice").agg(last["_right"].alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = sliced.filter("_left IS NOT NULL").select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "full")
        carried = slices.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        rows = rows.join(carried, [*keys, "_slice"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    partner = F.when(F.col("_at").isNotNull(), F.col("_found"))
    for k in keys:
        partner = F.when(F.col(k).isNotNull(), partner)
    rows = rows.withColumn("_found", partner)
    if reach is not None:
        kind = left.schema[at].dataType.simpleString()
        near = _number("_at", kind) - _number(f"_found.{right_at}", kind) <= reach
        rows = rows.withColumn("_found", F.when(near, F.col("_found")))
    return rows.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in other])


def _number(column: str, kind: str):
    """A time as a number that rises with it."""
    value = F.col(column)
    return value.cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else value.cast("double")
