"""Reading vectors: rows with an id and finite components, as raw doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def finite_vectors(df: DataFrame, key: str, vector: str, scale: float | None = None, nonzero: bool = False) -> DataFrame:
    """(id, vec): the components as little-endian doubles, for rows whose id and vector are not
    null and whose components are all finite. With `scale`, components are floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["vec"]
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            full = np.concatenate([[0], np.cumsum(values != 0)])
            keep = bad[offsets[1:]] == bad[offsets[:-1]]
            keep &= ~lists.is_null().to_numpy(zero_copy_only=False)
            if nonzero:
                keep &= full[offsets[1:]] > full[offsets[:-1]]
            if scale is not None:
                with np.errstate(invalid="ignore", over="ignore"):
                    values = np.floor(values * scale)
            rows = np.flatnonzero(keep).tolist()
            raw = [values[offsets[i] : offsets[i + 1]].tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(rows, pa.int64())), pa.array(raw, pa.binary())], names=["id", "vec"]
            )

    C.ship(df.sparkSession)
    named = df.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")
    ).filter("id IS NOT NULL AND vec IS NOT NULL")
    return named.mapInArrow(run, "id long, vec binary")


def matrix(raw: list[bytes], width: int | None = None) -> np.ndarray:
    """Raw vectors as rows; shorter ones are filled up with zeros."""
    width = max((len(r) // 8 for r in raw), default=0) if width is None else width
    out = np.zeros((len(raw), width))
    if all(len(r) == 8 * width for r in raw):
        return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), width) if width else out
    for i, r in enumerate(raw):
        out[i, : len(r) // 8] = np.frombuffer(r, "<f8")[:width]
    return out


def sample(vectors: DataFrame, n: int, rows: int) -> np.ndarray:
    """At most about `rows` of `n` vectors, distinct, chosen by a hash of their ids."""
    share = min(1.0, rows / max(1, n))
    picked = vectors.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    raw = sorted({bytes(r["vec"]) for r in picked.select("vec").limit(2 * rows).collect()})
    return matrix(raw)
