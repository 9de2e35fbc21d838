"""Catalogues, latest rows, selections and as-of cuts of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import series

SMALL_LIST = 1000


def entity_catalogue(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Each series with its last sequence number and row count."""
    return df.groupBy(*keys).agg(F.max(seq).alias("max_cycle"), F.count(F.lit(1)).alias("total_cycles"))


def last_values(df: DataFrame, keys: list[str], seq: str, cols: list[str]) -> DataFrame:
    """Last non-missing value of each column per series (NaN counts as missing)."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}

    def present(c):
        return C.finite(c) if c in doubles else F.col(c)

    return df.groupBy(*keys).agg(
        F.max(seq).alias(seq),
        *[F.max_by(present(c), F.when(present(c).isNotNull(), F.col(seq))).alias(c) for c in cols],
    )


def latest_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole last row per key, by ``order`` descending.

    The rank filter also runs ahead of the shuffle, so each task sends at most
    one row per key, however many a key has.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def newest_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows per key."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def select_entities(df: DataFrame, ids, key: str = "unit") -> DataFrame:
    """Rows of the listed entities; an empty or missing list means all.

    ``ids`` is a Python list or a DataFrame with column ``key``. Short lists
    become a pushed-down IN filter, long ones a semi join.
    """
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    ids = list(ids)
    if not ids:
        return df
    if len(ids) <= SMALL_LIST:
        return df.filter(F.col(key).isin(ids))
    table = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} {df.schema[key].dataType.simpleString()}")
    return df.join(table, key, "left_semi")


def missing_entities(requested: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Requested ids that have no rows, as rejects."""
    absent = requested.select(*keys).distinct().join(df.select(*keys).distinct(), keys, "left_anti")
    return absent.withColumn("reason", F.lit("no matching entity"))


def known_entities(requested: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Requested ids that do have rows."""
    return requested.select(*keys).intersect(df.select(*keys))


def first_entities(df: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """Rows of the ``n`` lowest entities per group (all groups in one when ``by`` is empty)."""
    ids = df.select(*by, key).distinct()
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(key))
        ids = ids.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    else:
        ids = ids.orderBy(key).limit(n)
    return df.join(series.checked_broadcast(ids), [*by, key], "left_semi")


def sample_entities(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """A repeatable random choice of ``n`` entities: lowest seeded hashes win."""
    ids = df.select(*key).distinct()
    return ids.orderBy(F.md5(F.concat_ws("|", *[F.col(k) for k in key], F.lit(seed))), *key).limit(n)


def life_fraction(rank: Column, n: Column, fractions: list[float] | None = None) -> Column:
    """Share of its life at which the ``rank``-th of ``n`` series is cut.

    By default five fixed shares for five series, one fixed share for a single
    series, and even steps over the same span for any other number. A list given
    as ``fractions`` is taken as it is; NULL beyond it.
    """
    if fractions is not None:
        return F.get(F.array(*[F.lit(float(f)) for f in fractions]), rank.cast("int") - 1)
    stages = F.get(F.array(*[F.lit(f) for f in S.LIFE_STAGES]), rank.cast("int") - 1)
    step = F.lit(S.LIFE_STAGE_SPAN) / F.greatest(n - 1, F.lit(1))
    return (
        F.when(n == len(S.LIFE_STAGES), stages)
        .when(n == 1, F.lit(S.SINGLE_LIFE_STAGE))
        .otherwise(F.lit(S.LIFE_STAGES[0]) + step * (rank - 1))
    )


def life_stage_cuts(
    df: DataFrame, keys: list[str], seq: str, fractions: list[float] | None = None
) -> DataFrame:
    """Per chosen series: its fraction, last sequence number and cut.

    ``keys`` is [group, entity]; series rank by entity within the group, and all
    take part. With a list of ``fractions`` those beyond its end do not, as the
    list names a share for each. The cut rounds half to even and is at least 1.
    """
    group, entity = keys
    life = df.groupBy(*keys).agg(F.max(seq).alias("max_cycle"))
    if fractions is None:
        ranked = series.number_rows(life, [group], [entity], out="_rank", total="_n")
    else:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(entity))
        ranked = life.withColumn("_rank", rank).filter(F.col("_rank") <= len(fractions)).withColumn("_n", F.lit(0))
    pct = life_fraction(F.col("_rank"), F.col("_n"), fractions)
    cut = F.greatest(F.lit(1), F.bround(pct * F.col("max_cycle"))).cast("long")
    return ranked.select(*keys, pct.alias("life_fraction"), "max_cycle", cut.alias("cut_cycle")).filter(
        F.col("life_fraction").isNotNull()
    )


def rows_up_to_cut(df: DataFrame, cuts: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of each series up to its cut."""
    return df.join(series.checked_broadcast(cuts), keys).filter(F.col(seq) <= F.col("cut_cycle"))


def rank_entities(df: DataFrame, keys: list[str], out: str = "unit_rank") -> DataFrame:
    """Number the distinct entities of each group, for positional ground truth."""
    group, entity = keys
    return series.number_rows(df.select(*keys).distinct(), [group], [entity], out=out)
