"""Joining predictions with ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import series, store


def attach_truth(pred: DataFrame, truth: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions with their truth, truths whose key no prediction has)."""
    return pred.join(truth, on), truth.join(pred.select(*on), on, "left_anti")


def attach_truth_by_rank(pred: DataFrame, truth: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Positional truth: the i-th value of a group belongs to its i-th entity.

    ``pred`` has one row per entity, ``truth`` the group column, ``unit_rank``
    and ``true_rul``. Returns (predictions with their truth, rejects): entities
    without a truth and truths without an entity. Numbering looks at its input
    before the query runs, so the predictions are written once where the session
    names a folder.
    """
    group, entity = keys
    on = [group, "unit_rank"]
    ranked = series.number_rows(store.materialised(pred), [group], [entity], out="unit_rank")
    lone = ranked.join(truth, on, "left_anti").select(
        *on, entity, F.lit(None).cast("double").alias("true_rul"), F.lit("no truth at this position").alias("reason")
    )
    surplus = truth.join(ranked, on, "left_anti").select(
        *on,
        F.lit(None).cast(pred.schema[entity].dataType).alias(entity),
        F.col("true_rul").cast("double").alias("true_rul"),
        F.lit("no entity at this position").alias("reason"),
    )
    return ranked.join(truth, on), lone.unionByName(surplus)


def truth_counts(pred: DataFrame, truth: DataFrame, group: str) -> DataFrame:
    """Entities and truths per group, to check that positions can match at all."""
    entity_n = pred.select(group, "unit").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n_entities"))
    truth_n = truth.groupBy(group).agg(F.count(F.lit(1)).alias("n_truths"))
    joined = entity_n.join(truth_n, group, "full").select(
        group,
        F.coalesce("n_entities", F.lit(0)).alias("n_entities"),
        F.coalesce("n_truths", F.lit(0)).alias("n_truths"),
    )
    return joined.withColumn("matches", F.col("n_entities") == F.col("n_truths"))


def error_columns(
    df: DataFrame,
    pred: str = "predicted_rul",
    true: str = "true_rul",
    late: float = S.LATE_LIMIT,
    early: float = S.EARLY_LIMIT,
    round_first: bool = False,
) -> DataFrame:
    """Add error, abs_error, nasa_penalty and band.

    ``round_first`` takes the band on the error rounded to one decimal, as the
    command-line report does; the default takes it on the raw error.
    """
    error = F.col(pred) - F.col(true)
    banded = F.round(error, 1) if round_first else error
    return df.select(
        "*",
        error.alias("error"),
        F.abs(error).alias("abs_error"),
        C.late_early_penalty(error).alias("nasa_penalty"),
        C.error_band(banded, late, early).alias("band"),
    )


def first_truths(truth: DataFrame, key: str = "prediction_id", order: list[str] = ["submitted_at", "true_rul"]) -> DataFrame:
    """The first submission per prediction; later ones are ignored."""
    first = Window.partitionBy(key).orderBy(*order)
    return truth.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")


def score_truths(pred: DataFrame, truth: DataFrame, carry: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(error rows, rejected truths): first submission per prediction wins and
    ids without a prediction are reported. ``carry`` names prediction columns to
    keep on the error rows, which spares later readers the join back."""
    matched, unknown = attach_truth(
        pred.select("prediction_id", "predicted_rul", *carry), first_truths(truth), ["prediction_id"]
    )
    return error_columns(matched), unknown.withColumn("reason", F.lit("unknown prediction_id"))


def rounded_errors(errors: DataFrame) -> DataFrame:
    """Error figures as shown to a submitter: two decimals, penalty four."""
    return errors.select(
        "prediction_id",
        "predicted_rul",
        "true_rul",
        F.round("error", 2).alias("error"),
        F.round("abs_error", 2).alias("abs_error"),
        F.round("nasa_penalty", 4).alias("nasa_penalty"),
        F.col("band").alias("status"),
    )
