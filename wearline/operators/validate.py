"""Row and sequence checks; bad rows go to a reject table with their reasons."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import series


def reading_rules(sensors: list[str] = S.ALL_SENSORS, settings: list[str] = S.SETTINGS) -> dict[str, Column]:
    """Checks of a sensor row: reason -> condition (never NULL) under which the row is bad."""
    rules = {
        "subset out of range": ~F.coalesce(F.col("subset").between(1, 4), F.lit(False)),
        "unit below 1": ~F.coalesce(F.col("unit") >= 1, F.lit(False)),
        "cycle below 1": ~F.coalesce(F.col("cycle") >= 1, F.lit(False)),
    }
    rules.update({f"{c} not finite": C.is_not_finite(c) for c in [*settings, *sensors]})
    rules.update({f"{c} missing": F.col(c).isNull() for c in settings})
    rules.update({f"{s} missing": F.col(s).isNull() & C.needs_sensor("subset", s) for s in sensors})
    return rules


def truth_rules() -> dict[str, Column]:
    return {
        "prediction_id below 1": ~F.coalesce(F.col("prediction_id") >= 1, F.lit(False)),
        "true_rul negative": ~F.coalesce(F.col("true_rul") >= 0, F.lit(False)),
    }


def dataset_rules(column: str = "dataset") -> dict[str, Column]:
    return {"unknown dataset": ~C.is_dataset_label(column)}


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons``: the checks a row fails, in rule order."""
    hits = [F.when(bad, F.lit(reason)) for reason, bad in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*hits)))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into (valid rows, rejects with reasons).

    The split is a plain OR of the checks, which stays in generated code; the
    reasons are spelled out for rejects only.
    """
    bad = reduce(or_, rules.values())
    return df.filter(~bad), with_reasons(df.filter(bad), rules)


def missing_columns(required: Column, present: Column) -> Column:
    """Names required but not present."""
    return F.array_sort(F.array_except(required, present))


def sequence_reason(cycles: Column) -> Column:
    """Why an array of cycles is no valid history; NULL when it is one.

    Precedence: duplicates, then order, then gaps.
    """
    ahead = F.slice(cycles, F.lit(2), F.greatest(F.size(cycles) - 1, F.lit(0)))
    behind = F.slice(cycles, F.lit(1), F.greatest(F.size(cycles) - 1, F.lit(0)))
    steps = F.zip_with(ahead, behind, lambda a, b: a - b)
    return (
        F.when(cycles.isNull() | (F.size(cycles) == 0), "empty")
        .when(F.size(F.array_distinct(cycles)) != F.size(cycles), "duplicate cycles")
        .when(F.exists(steps, lambda s: s < 0), "not ascending")
        .when(F.exists(steps, lambda s: s != 1), "gaps")
    )


def validate_sequence(
    df: DataFrame, keys: list[str], seq: str, arrival: list[str], at: Column | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Verdict per series of a table, taking rows in arrival order.

    Same precedence as ``sequence_reason``. Repeats come from a two-stage
    count; order and gaps from one-row look-back within blocks.
    """
    repeats = (
        df.groupBy(*keys, seq)
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(*keys)
        .agg(F.sum("_c").alias("n_rows"), F.max((F.col("_c") > 1).cast("int")).alias("_repeat"))
    )
    numbered = series.number_rows(df.select(*keys, seq, *[c for c in arrival if c != seq]), keys, arrival, "_position", at=at)
    stepped = series.over_trailing_rows(
        numbered, keys, "_position", 1, lambda w: {"_step": F.col(seq) - F.lag(seq).over(w)}, block_rows
    )
    steps = stepped.groupBy(*keys).agg(F.min("_step").alias("_lo"), F.max("_step").alias("_hi"))
    reason = (
        F.when(F.col("_repeat") == 1, "duplicate cycles")
        .when(F.col("_lo") < 0, "not ascending")
        .when(F.col("_hi") > 1, "gaps")
    )
    return repeats.join(steps, keys).select(*keys, "n_rows", reason.alias("reason"))


def sequence_steps(df: DataFrame, keys: list[str], seq: str, block_rows: int | None = None, position: str | None = None) -> DataFrame:
    """Each row with its distance from the row before it in sequence order. ``position`` names a
    gap-free counter from 1 where the rows have one."""
    numbered = df if position else series.number_rows(df, keys, [seq], "_position")
    out = series.over_trailing_rows(
        numbered, keys, position or "_position", 1, lambda w: {"step": F.col(seq) - F.lag(seq).over(w)}, block_rows
    )
    return out if position else out.drop("_position")
