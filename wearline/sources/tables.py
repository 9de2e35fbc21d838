"""Stored tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["engines", "sensor_readings", "model_registry", "predictions", "prediction_errors"]


def read_tables(spark: SparkSession, folder: str, names: list[str] = TABLES, views: bool = False) -> dict[str, DataFrame]:
    """Parquet tables under a folder, optionally registered as temp views."""
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def read_stored(spark: SparkSession, folder: str, names: list[str], views: bool = False) -> dict[str, DataFrame]:
    """Tables that were committed together (see ``operators.database``), all of one version."""
    from wearline.operators import database

    stored = database.open_tables(spark, folder)
    version = stored.versions()[-1]
    tables = {name: stored.read(name, version) for name in names}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower, upper, partitions: int, properties: dict | None = None
) -> DataFrame:
    """A relational table read in parallel ranges of a numeric or date column."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties or {}
    )
