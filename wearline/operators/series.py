"""Keeping long series balanced.

One machine may hold a large share of all rows, so nothing here partitions by
the series key alone once a series outgrows a task:

* ``number_rows`` numbers each series; a long one is cut into slices along its
  order, the slices are counted first and each row gets slice offset + rank.
* ``trailing_blocks`` cuts numbered series into blocks of equal length and
  repeats the last rows of a block in the next, so that a trailing frame can be
  evaluated per block with the same result.
* ``attach_series`` puts a per-series aggregate back on the rows through a join
  on (series, slice), never on the series alone.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES_ROWS = 1_000_000  # a series of more rows is numbered in slices
BLOCK_ROWS = 200_000  # length of the blocks for trailing frames
BROADCAST_ROWS = 10_000  # a table of more rows is never hinted for broadcast
SALTS = 16
QUANTILES = 32  # first cut of a long series, refined by equal widths


def slice_of(seq: str, rows: int | None = None) -> Column:
    """Slice number of an integer order column."""
    return F.floor(F.col(seq) / F.lit(rows or BLOCK_ROWS)).cast("long")


def long_series(df: DataFrame, keys: list[str], at: Column, limit: int):
    """Series of more than ``limit`` rows with their size and order range.

    A count over the key columns alone (partial counts before the shuffle)
    finds them; only when there are any are their ranges read too. Returns None
    when there are none, a broadcast of the collected rows when they are few,
    and a plain DataFrame to join by shuffle otherwise.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    rows = sizes.limit(BROADCAST_ROWS + 1).collect()
    if not rows:
        return None
    few = len(rows) <= BROADCAST_ROWS
    found = F.broadcast(df.sparkSession.createDataFrame(rows, sizes.schema)) if few else sizes
    ranges = df.join(found, keys).groupBy(*keys).agg(F.first("_n").alias("_n"), _bounds(at))
    return checked_broadcast(ranges)


def _bounds(at: Column) -> Column:
    """Quantiles of the order column, from its least to its greatest value."""
    known = F.when(~F.isnan(at), at)
    return F.percentile_approx(known, [i / QUANTILES for i in range(QUANTILES + 1)], 1000).alias("_bounds")


def _sliced(df: DataFrame, at: Column, limit: int) -> DataFrame:
    """Add ``_slice`` to rows that carry ``_n`` and ``_bounds`` of their series
    when it is long. The slice rises with ``at``: the quantile the row falls
    into, then one of equally wide parts of that quantile, enough of them to
    hold about half of ``limit`` rows each.

    A missing order value comes first and NaN last, as in the order of a window;
    each is a slice of its own. The steps are columns of their own, so that none
    is evaluated twice.
    """
    long = F.col("_n").isNotNull()
    above = [F.when(F.get("_bounds", F.lit(i)) <= F.col("_slice_at"), 1).otherwise(0) for i in range(1, QUANTILES)]
    parts = F.ceil(F.col("_n") / (QUANTILES * limit)) * 2
    low, high = F.get("_bounds", F.col("_slice_quantile")), F.get("_bounds", F.col("_slice_quantile") + 1)
    width = F.floor((F.col("_slice_at") - low) * parts / (high - low + 1))
    piece = F.col("_slice_quantile") * parts + F.greatest(F.least(width, parts - 1), F.lit(0))
    piece = (
        F.when(F.col("_slice_at").isNull() & long, F.lit(-1))
        .when(F.isnan("_slice_at"), F.lit(QUANTILES) * parts)
        .otherwise(piece)
    )
    return (
        df.withColumn("_slice_at", F.when(long, at))
        .withColumn("_slice_quantile", F.when(long, reduce(add, above)))
        .withColumn("_slice", F.coalesce(piece, F.lit(0)).cast("long"))
        .drop("_slice_at", "_slice_quantile", "_bounds")
    )


def few_rows(df: DataFrame, limit: int | None = None) -> DataFrame | None:
    """``df`` as a local table hinted for broadcast when it has at most
    ``limit`` rows, else None. At most ``limit + 1`` rows reach the driver."""
    limit = BROADCAST_ROWS if limit is None else limit
    found = df.limit(limit + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)) if len(found) <= limit else None


def checked_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` hinted for broadcast after a look at its size, or unhinted when it
    is large. Meant for aggregates and selections that are small as a rule but
    not by construction."""
    few = few_rows(df, limit)
    return df if few is None else few


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list,
    out: str = "position",
    total: str | None = None,
    at: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Exact 1-based row number of each row in its series.

    ``at`` is a number that never falls along ``order`` (default: the first
    order column); it decides the slices of long series. ``total`` names an
    optional column for the series length.
    """
    limit = limit or SERIES_ROWS
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    at = order[0] if at is None else at
    at = at.cast("double")
    series = [F.col(k) for k in keys] or [F.lit(0)]
    long = long_series(df, keys, at, limit) if keys else _whole_table(df, at, limit)
    if long is None:
        whole = Window.partitionBy(*series)
        numbered = df.withColumn(out, F.row_number().over(whole.orderBy(*order)).cast("long"))
        return numbered.withColumn(total, F.count(F.lit(1)).over(whole)) if total else numbered

    on = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    sliced = _sliced(src.join(long, on, "left"), at, limit)
    ahead = Window.partitionBy(*on).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.filter(F.col("_n").isNotNull())
        .groupBy(*on, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*on, "_slice", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"))
    )
    part = Window.partitionBy(*on, "_slice")
    ranked = sliced.withColumn("_rank", F.row_number().over(part.orderBy(*order)))
    if total:
        ranked = ranked.withColumn(total, F.coalesce("_n", F.count(F.lit(1)).over(part)))
    numbered = ranked.join(offsets, [*on, "_slice"], "left").withColumn(
        out, (F.col("_rank") + F.coalesce("_start", F.lit(0))).cast("long")
    )
    return numbered.select(*df.columns, out, *([total] if total else []))


def _whole_table(df: DataFrame, at: Column, limit: int):
    """The table as one series, for numbering without keys."""
    n = df.count()
    if n <= limit:
        return None
    ranges = df.agg(F.lit(n).cast("long").alias("_n"), _bounds(at)).withColumn("_all", F.lit(0))
    return F.broadcast(df.sparkSession.createDataFrame(ranges.collect(), "_n long, _bounds array<double>, _all int"))


def trailing_blocks(df: DataFrame, position: str, reach: int, block_rows: int | None = None) -> DataFrame:
    """Add ``_block`` and ``_halo``: the last ``reach`` rows of each block also
    appear, marked as halo, at the head of the next."""
    block_rows = block_rows or BLOCK_ROWS
    if reach >= block_rows:
        raise ValueError("a block must be longer than the frame reaches back")
    block = F.expr(f"CAST((`{position}` - 1) DIV {block_rows} AS BIGINT)")
    near_end = (F.col(position) - 1) % block_rows >= block_rows - reach
    return (
        df.withColumn("_home", block)
        .withColumn(
            "_block",
            F.explode(
                F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array(F.col("_home")))
            ),
        )
        .withColumn("_halo", F.col("_block") > F.col("_home"))
        .drop("_home")
    )


def over_trailing_rows(
    df: DataFrame,
    keys: list[str],
    position: str,
    reach: int,
    build,
    block_rows: int | None = None,
) -> DataFrame:
    """Evaluate trailing-frame columns on numbered series.

    ``build`` gets the ordered window (one block of one series) and returns a
    dict of name to column. All columns share one shuffle and one sort.
    """
    blocked = trailing_blocks(df, position, reach, block_rows)
    window = Window.partitionBy(*keys, "_block").orderBy(position)
    columns = [c.alias(name) for name, c in build(window).items()]
    return blocked.select(*df.columns, "_halo", *columns).filter(~F.col("_halo")).drop("_halo")


def attach_series(df: DataFrame, keys: list[str], slice_col: Column, aggregates: dict) -> DataFrame:
    """Left-join per-series aggregates onto the rows.

    ``aggregates`` maps a name to a function (Column -> Column, e.g. F.max) and
    its input; the function must combine with itself, as max, min and sum do.
    The join key is (series, slice), so a long series spreads over many tasks.
    """
    rows = df.withColumn("_slice", slice_col)
    whole = Window.partitionBy(*[F.col(k) for k in keys])
    partial = rows.groupBy(*keys, "_slice").agg(
        *[fn(c).alias(name) for name, (fn, c) in aggregates.items()]
    )
    totals = partial.select(
        *keys, "_slice", *[fn(F.col(name)).over(whole).alias(name) for name, (fn, _) in aggregates.items()]
    )
    return rows.join(totals, [*keys, "_slice"], "left").select(*df.columns, *aggregates)


def salted_join(
    rows: DataFrame, per_key: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Join rows with a table of one row per key so that no key stays whole:
    each row of the table is repeated per salt and a key's rows spread over the
    salts. For plans that adaptive execution does not reach. ``null_safe`` makes
    a missing key part equal to a missing one."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(SALTS)).cast("int")
    copies = per_key.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = rows.withColumn("_salt", salt)
    if not null_safe:
        return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
    named = copies.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_salt").alias("_to"),
                          *[c for c in per_key.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_salt") == F.col("_to")]
    return salted.join(named, same, how).drop("_salt", "_to", *[f"_of_{k}" for k in keys])
