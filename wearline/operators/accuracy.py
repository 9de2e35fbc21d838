"""Accuracy of predictions. Every figure is one partial + final aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C


def rmse(error: str = "error") -> Column:
    return F.sqrt(F.avg(F.col(error) * F.col(error)))


def mae(error: str = "error") -> Column:
    return F.avg(F.abs(F.col(error)))


def r2(error: str = "error", true: str = "true_rul") -> Column:
    """1 - SSres/SStot over one group; NULL when the truth is constant."""
    total = F.regr_syy(F.col(true), F.col(true))
    return 1 - F.sum(F.col(error) * F.col(error)) / F.nullif(total, F.lit(0.0))


def penalty_sum(error: str = "error") -> Column:
    return F.sum(C.late_early_penalty(error))


def late_count(error: str = "error", late: float = S.LATE_LIMIT) -> Column:
    return F.count_if(F.col(error) > late)


def early_count(error: str = "error", early: float = S.EARLY_LIMIT) -> Column:
    return F.count_if(F.col(error) < early)


def on_time_percent(error: str = "error", limit: float = S.LATE_LIMIT) -> Column:
    """Share of errors within the limit in percent; NULL on no rows."""
    return F.lit(100.0) * F.sum(F.when(F.abs(F.col(error)) <= limit, 1).otherwise(0)) / F.nullif(
        F.count(F.lit(1)), F.lit(0)
    )


def accuracy(df: DataFrame, by: list[str] | None = None, error: str = "error", true: str = "true_rul") -> DataFrame:
    """Evaluation report in one pass: count, RMSE, MAE, R2, score, tallies."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_evaluated"),
        rmse(error).alias("rmse"),
        mae(error).alias("mae"),
        r2(error, true).alias("r2"),
        penalty_sum(error).alias("nasa_score"),
        late_count(error).alias("late"),
        early_count(error).alias("early"),
        (F.count(F.lit(1)) - late_count(error) - early_count(error)).alias("on_time"),
        on_time_percent(error).alias("on_time_percent"),
    )


def accuracy_over_time(
    df: DataFrame, unit: str = "hour", by: str = "subset", time: str = "submitted_at", since=None, until=None
) -> DataFrame:
    """RMSE and score per time bucket and group, optionally within [since, until]."""
    if since is not None:
        df = df.filter(F.col(time) >= C.time_literal(since))
    if until is not None:
        df = df.filter(F.col(time) <= C.time_literal(until))
    return df.groupBy(C.truncate_time(unit, time).alias("time"), by).agg(
        C.decimal_round(rmse(), 2).alias("rmse"), C.decimal_round(penalty_sum(), 1).alias("nasa_score")
    )


def as_wide(df: DataFrame, time: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """Long (time, metric, value) rows to one column per metric."""
    return df.groupBy(time).pivot(metric, metrics).agg(F.first(value))


def error_histogram(df: DataFrame, width: float, error: str = "error") -> DataFrame:
    """Counts per bucket [k*width, (k+1)*width)."""
    lower = F.floor(F.col(error) / width) * F.lit(float(width))
    return df.groupBy(lower.cast("double").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_width(df: DataFrame, error: str = "error") -> float:
    """Bucket width by the Freedman-Diaconis rule, 2*IQR/n^(1/3); 1 when undefined."""
    row = df.agg(
        F.percentile_approx(error, [0.25, 0.75], 10_000).alias("q"), F.count(F.lit(1)).alias("n")
    ).first()
    if not row["n"] or row["q"][0] == row["q"][1]:
        return 1.0
    return float(2 * (row["q"][1] - row["q"][0]) / row["n"] ** (1 / 3))
