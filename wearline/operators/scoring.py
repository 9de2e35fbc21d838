"""Scoring of snapshots, sequences, whole histories, as-of cuts and test sets.

``model`` is anything with ``predict(df) -> df with column prediction``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import accuracy as acc
from wearline.operators import entities
from wearline.operators import features as feat
from wearline.operators import series
from wearline.operators import store
from wearline.operators import truth as tr
from wearline.operators import validate as val


def cap_of(model, cap: float | None = None) -> float:
    """The given limit, else the one the model was trained with, else the usual one."""
    return cap if cap is not None else getattr(model, "cap", S.RUL_CAP)


def window_of(model, window: int | None = None) -> int:
    """The given window, else the one the model was trained with, else the usual one."""
    return window if window is not None else getattr(model, "window", S.WINDOW)


def unscored(df: DataFrame, model, by: str = "subset") -> DataFrame:
    """The rows that ``score`` leaves out, as rejects: no part of the model is for them."""
    subsets = getattr(model, "subsets", None)
    known = F.coalesce(F.col(by).isin(list(subsets)), F.lit(False)) if subsets else F.lit(True)
    return df.filter(~known).withColumn("reason", F.lit("no model for this subset"))


def score(df: DataFrame, model, cap: float | None = None, features=None) -> DataFrame:
    """Predicted remaining life, clipped and rounded to one decimal, with status.

    The limit is the model's own unless one is given. A missing prediction has
    no status; rows no model is for are those of ``unscored``.

    ``features`` builds the feature rows from ``df``. A model with a part per
    subset gets them built per subset, from rows filtered at the source: the
    filter would not pass the Arrow step of the trailing features by itself. A
    model that is ``one_pass`` scores the rows of all subsets together.
    """
    build = features or (lambda rows: rows)
    subsets = getattr(model, "subsets", None)
    if subsets and not getattr(model, "one_pass", False):
        parts = [model.predict(build(df.filter(F.col("subset") == k)), k) for k in subsets]
        predicted = reduce(DataFrame.unionByName, parts)
    else:
        predicted = model.predict(build(df))
    limit = cap_of(model, cap)
    predicted = predicted.withColumn("predicted_rul", F.round(C.clip_rul("prediction", limit), 1))
    status = F.when(F.col("predicted_rul").isNotNull(), C.health_status("predicted_rul"))
    return predicted.withColumn("health_status", status)


def score_snapshots(df: DataFrame, model, sensors: list[str] = S.ALL_SENSORS, cap: float | None = None, window: int | None = None) -> DataFrame:
    """Score lone rows, with the note that trailing features are approximate."""
    scored = score(feat.snapshot_features(df, sensors), model, cap)
    return scored.withColumn("n_history_cycles", F.lit(1)).withColumn("note", C.short_history_note("cycle", window_of(model, window)))


def sequence_features(df: DataFrame, sensors: list[str] = S.ALL_SENSORS, window: int = S.WINDOW) -> DataFrame:
    """Feature row of each request with a ``history`` array, without a shuffle:
    only the last rows of the array matter, and they are already together.

    Values, means and deviations are built in separate projections, so that
    each array is cut out once and each mean is taken once.
    """
    size = F.size("history")
    tail = F.slice("history", F.greatest(size - window + 1, F.lit(1)), F.lit(window))
    keep = [c for c in df.columns if c != "history"]
    ends = df.select(*keep, tail.alias("_tail"), F.element_at("history", -1).alias("_last"), size.alias("n_history_cycles"))
    known = [*keep, "n_history_cycles", *[F.col(f"_last.{c}").alias(c) for c in ["cycle", *S.SETTINGS, *sensors]]]

    def values(s):
        return F.array_compact(F.transform("_tail", lambda r: C.finite(r[s])))

    arrays = ends.select(*known, *[values(s).alias(f"_v_{s}") for s in sensors])

    def mean(s):
        total = F.aggregate(f"_v_{s}", F.lit(0.0), lambda a, x: a + x)
        return total / F.nullif(F.size(f"_v_{s}"), F.lit(0))

    def deviation(s):
        m = F.col(f"{s}_rm")
        squares = F.aggregate(f"_v_{s}", F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
        return F.when(F.size(f"_v_{s}") > 1, F.sqrt(squares / (F.size(f"_v_{s}") - 1))).otherwise(0.0)

    means = arrays.select("*", *[mean(s).alias(f"{s}_rm") for s in sensors])
    full = means.select("*", *[deviation(s).alias(f"{s}_rs") for s in sensors])
    return full.drop(*[f"_v_{s}" for s in sensors])


def check_sequences(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejects): cycle order first, then sensors required."""
    missing = None
    for s in S.ALL_SENSORS:
        lacks = C.needs_sensor("subset", s) & F.exists("history", lambda r: r[s].isNull())
        missing = F.when(lacks, F.lit(f"{s} missing")) if missing is None else missing.when(lacks, F.lit(f"{s} missing"))
    bad_subset = F.when(~F.coalesce(F.col("subset").between(1, 4), F.lit(False)), "subset out of range")
    bad_value = F.when(
        F.exists("history", lambda r: reduce(or_, [C.is_not_finite(r[c]) for c in [*S.SETTINGS, *S.ALL_SENSORS]])),
        "value not finite",
    )
    order = val.sequence_reason(F.transform("history", lambda r: r["cycle"]))
    checked = df.withColumn("reason", F.coalesce(bad_subset, order, bad_value, missing))
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def score_sequences(df: DataFrame, model, cap: float | None = None, window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored requests, rejected requests with their reason)."""
    valid, rejects = check_sequences(df)
    scored = score(sequence_features(valid, window=window_of(model, window)), model, cap)
    note = F.concat(F.lit("Computed from "), F.col("n_history_cycles").cast("string"), F.lit(" historical cycles."))
    return scored.withColumn("note", note), rejects


def score_history(
    df: DataFrame, model, as_of, sensors: list[str] = S.ALL_SENSORS, keys: list[str] = S.SERIES_KEYS,
    seq: str = "cycle", position: str | None = None, cap: float | None = None, window: int | None = None,
) -> DataFrame:
    """Score every row; the last sequence number of a dataset maps to ``as_of``
    and each step before it lies one hour back."""
    scored = score(df, model, cap, lambda rows: feat.rolling_features(rows, keys, seq, sensors, window_of(model, window), position))
    last = series.checked_broadcast(df.groupBy(keys[0]).agg(F.max(seq).alias("_last")))
    return (
        scored.join(last, keys[0])
        .withColumn("predicted_at", C.hours_before(as_of, F.col("_last") - F.col(seq)))
        .withColumn("n_history_cycles", F.col(seq))
        .drop("_last")
    )


def score_life_stages(
    df: DataFrame, model, fractions: list[float] | None = None, sensors: list[str] = S.ALL_SENSORS,
    keys: list[str] = S.SERIES_KEYS, seq: str = "cycle", cap: float | None = None, window: int | None = None,
) -> DataFrame:
    """Score chosen series as of a share of their life."""
    cuts = entities.life_stage_cuts(df, keys, seq, fractions)
    upto = entities.rows_up_to_cut(df.select(*keys, seq, *sensors), cuts, keys, seq)
    scored = score(feat.latest_features(upto, keys, seq, sensors, window_of(model, window)), model, cap)
    return scored.join(series.checked_broadcast(cuts), keys).select(
        *keys,
        F.round(F.col("life_fraction") * 100).cast("long").alias("snapshot_pct"),
        F.col("cut_cycle").alias("snapshot_cycle"),
        "max_cycle",
        "predicted_rul",
        "health_status",
    )


def score_latest(
    df: DataFrame, model, sensors: list[str] = S.ALL_SENSORS, keys: list[str] = S.SERIES_KEYS,
    seq: str = "cycle", cap: float | None = None, window: int | None = None,
) -> DataFrame:
    """Score each series as of its last row."""
    return score(feat.latest_features(df, keys, seq, sensors, window_of(model, window)), model, cap)


def replay(
    df: DataFrame, truth: DataFrame, model, sensors: list[str] = S.ALL_SENSORS, keys: list[str] = S.SERIES_KEYS,
    seq: str = "cycle", cap: float | None = None, window: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(error rows, report per dataset, rejects): score a test set, attach its
    positional truth and evaluate. Engines without a truth and truths without an
    engine are rejects, so that figures on a part are never taken for the whole."""
    scored = score_latest(df, model, sensors, keys, seq, cap, window).select(*keys, seq, "predicted_rul", "health_status")
    matched, rejects = tr.attach_truth_by_rank(scored, truth, keys)
    errors = tr.error_columns(matched)
    return errors, acc.accuracy(errors, [keys[0]]), rejects


def report_head(errors: DataFrame, keys: list[str] = S.SERIES_KEYS, n: int = 20) -> DataFrame:
    """The first n rows of an evaluation report."""
    return errors.orderBy(*keys).limit(n)


def train(
    df: DataFrame, params: dict | None = None, keys: list[str] = S.SERIES_KEYS, seq: str = "cycle",
    position: str | None = None, cap: int = S.RUL_CAP, window: int = S.WINDOW, subsets=S.SUBSETS,
):
    """Label, build features and fit: the whole training path of the datasets.

    Ranges and trees read the feature rows several times over, and each dataset
    reads the input, so both are written out once to the shared folder, with the
    columns that training needs.
    """
    from wearline.operators.model import fit_rul

    names = dict.fromkeys(["subset", *keys, seq, "cycle", *([position] if position else []), *S.ALL_SENSORS])
    df = store.written(df.select(*names))

    def rows(subset):
        labelled = feat.remaining_life(df.filter(F.col("subset") == subset), keys, seq, cap)
        built = feat.rolling_features(labelled, keys, seq, S.ALL_SENSORS, window, position)
        return store.written(built.select("rul", *S.feature_columns(S.ALL_SENSORS)))

    return fit_rul({k: rows(k) for k in subsets}, "rul", params, cap=cap, window=window)


def evaluate(model, test: DataFrame, truth: DataFrame, keys: list[str] = S.SERIES_KEYS, seq: str = "cycle"):
    """The model with its hold-out metrics filled in (one row per dataset)."""
    _, report, _ = replay(test, truth, model, keys=keys, seq=seq, cap=model.cap, window=model.window)
    model.metrics = {
        r[keys[0]]: {"RMSE": r["rmse"], "MAE": r["mae"], "R2": r["r2"], "NASA_Score": r["nasa_score"]}
        for r in report.filter(F.col(keys[0]).isin(list(S.SUBSETS))).collect()
    }
    return model
