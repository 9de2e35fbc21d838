"""Column functions. All of them are JVM expressions; none needs a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearline import schema as S

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def health_status(rul: ColumnOrName, critical: float = S.CRITICAL_LIMIT, warning: float = S.WARNING_LIMIT) -> Column:
    """CRITICAL / WARNING / HEALTHY. NULL and NaN fall through to HEALTHY."""
    rul = _col(rul)
    return F.when(rul <= critical, "CRITICAL").when(rul <= warning, "WARNING").otherwise("HEALTHY")


def error_band(error: ColumnOrName, late: float = S.LATE_LIMIT, early: float = S.EARLY_LIMIT) -> Column:
    """LATE above the upper limit, EARLY below the lower one, else OK."""
    error = _col(error)
    return F.when(error > late, "LATE").when(error < early, "EARLY").otherwise("OK")


def clip_rul(rul: ColumnOrName, cap: float = S.RUL_CAP) -> Column:
    """Clip to [0, cap]; NULL and NaN give NULL (least/greatest would hide them)."""
    rul = _col(rul)
    bounded = F.least(F.greatest(rul, F.lit(0.0)), F.lit(float(cap)))
    return F.when(rul.isNotNull() & ~F.isnan(rul), bounded)


def late_early_penalty(error: ColumnOrName) -> Column:
    """Asymmetric penalty of one error: exp(-d/13)-1 when early, exp(d/10)-1 otherwise."""
    d = _col(error)
    return F.when(d < 0, F.exp(-d / 13) - 1).otherwise(F.exp(d / 10) - 1)


def dataset_label(subset: ColumnOrName) -> Column:
    return F.concat(F.lit("FD00"), _col(subset).cast("string"))


def dataset_subset(label: ColumnOrName) -> Column:
    """Subset number of a dataset label; NULL for anything but FD001 to FD004."""
    label = _col(label)
    return F.when(is_dataset_label(label), F.substring(label, 5, 1).cast("int"))


def is_dataset_label(label: ColumnOrName) -> Column:
    return F.coalesce(_col(label).rlike("^FD00[1-4]$"), F.lit(False))


def subset_of_label(label: str) -> int:
    """Driver-side twin of dataset_subset, so that filters reach the scan as ``subset = k``."""
    if label not in {f"FD00{k}" for k in S.SUBSETS}:
        raise ValueError("dataset must be one of FD001 to FD004")
    return int(label[-1])


def decimal_round(value: ColumnOrName, places: int) -> Column:
    """Round half away from zero on a decimal, as SQL NUMERIC does, and return a double.

    A value that no decimal holds is returned as it is: it has no such digits to round.
    """
    value = _col(value)
    return F.coalesce(F.round(value.try_cast("decimal(38,6)"), places).cast("double"), value.cast("double"))


def truncate_time(unit: str, ts: ColumnOrName) -> Column:
    """date_trunc that gives back a zone-less timestamp."""
    return F.date_trunc(unit, _col(ts)).cast("timestamp_ntz")


def time_literal(ts) -> Column:
    """A zone-less timestamp from a Column, a naive datetime or text, whatever
    the zones of Python and of the session are."""
    return ts if isinstance(ts, Column) else F.lit(str(ts)).cast("timestamp_ntz")


def hours_before(as_of, hours: ColumnOrName) -> Column:
    return F.timestamp_add("HOUR", -_col(hours).cast("int"), time_literal(as_of)).cast("timestamp_ntz")


def finite(value: ColumnOrName) -> Column:
    """The value, or NULL when it is NaN."""
    return F.nanvl(_col(value), F.lit(None).cast("double"))


def is_not_finite(value: ColumnOrName) -> Column:
    value = _col(value)
    return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))


def min_max_scaled(value: ColumnOrName, low: ColumnOrName, high: ColumnOrName) -> Column:
    """(x - min) / (max - min); a constant column scales to 0. No clipping."""
    value, low, high = _col(value), _col(low), _col(high)
    return (value - low) / F.when(high == low, 1.0).otherwise(high - low)


def short_history_note(cycle: ColumnOrName, window: int = S.WINDOW) -> Column:
    return F.when(_col(cycle) < window, "Single snapshot: trailing features are approximate").otherwise("")


def sensor_label(sensor: ColumnOrName) -> Column:
    """Readable name of a sensor id; NULL when unknown."""
    names = F.create_map(*[F.lit(x) for pair in S.SENSOR_LABELS.items() for x in pair])
    return F.try_element_at(names, _col(sensor))


def required_sensors(subset: ColumnOrName) -> Column:
    """Array of the sensors a dataset must carry."""
    subset = _col(subset)
    out = None
    for k in S.SUBSETS:
        names = F.array(*[F.lit(s) for s in S.SENSORS[k]])
        out = F.when(subset == k, names) if out is None else out.when(subset == k, names)
    return out


def needs_sensor(subset: ColumnOrName, sensor: str) -> Column:
    """Whether a dataset must carry the sensor; false for unknown datasets."""
    return F.coalesce(_col(subset).isin([k for k in S.SUBSETS if sensor in S.SENSORS[k]]), F.lit(False))


def seconds_of(ts: ColumnOrName) -> Column:
    """Whole seconds of a zone-less timestamp, independent of the session zone."""
    ts = _col(ts)
    return (
        F.unix_date(ts.cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )
