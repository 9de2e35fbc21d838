"""Nested request records: snapshots, batches, sequences, truths, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline import schema as S


def parse_requests(df: DataFrame, kind: str, json_col: str = "value", empty: bool = False) -> DataFrame:
    """Typed columns of JSON request bodies.

    Batches come out one row per instance, tagged with their position. A body
    that does not parse gives NULL columns, which validation then rejects.
    Works on batch and streaming DataFrames alike. With ``empty`` a batch without instances
    is one row of its own, without an ``item`` but with the body, which is null elsewhere.
    """
    keep = [c for c in df.columns if c != json_col]
    parsed = df.withColumn("_body", F.from_json(F.col(json_col), S.REQUEST_SCHEMAS[kind], {"allowNonNumericNumbers": "true"}))
    if kind == "batch" and empty:
        some = F.coalesce(F.size("_body.instances") > 0, F.lit(False))
        body = F.when(~some, F.col(json_col)).alias(json_col)
        entries = F.posexplode_outer("_body.instances").alias("item", "_row")
        return parsed.select(*keep, body, entries).select(*keep, json_col, "item", "_row.*")
    if kind == "batch":
        return parsed.select(*keep, F.posexplode("_body.instances").alias("item", "_row")).select(*keep, "item", "_row.*")
    # As a generator the body is parsed once; plain projections would be copied
    # into every filter that is pushed below them.
    return parsed.select(*keep, F.inline(F.array("_body")))


def explode_history(df: DataFrame) -> DataFrame:
    """One row per history entry of a sequence request."""
    keep = [c for c in df.columns if c != "history"]
    return df.select(*keep, F.explode("history").alias("_row")).select(*keep, "_row.*")
