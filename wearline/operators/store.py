"""Write rules of the stored tables: get-or-create, upserts, registry, appends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import entities as ent
from wearline.operators import series


def get_or_create(
    dim: DataFrame, rows: DataFrame, keys: list[str], id_col: str, at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(new dimension rows, all dimension rows) for the keys in ``rows``.

    New keys get ids after the highest one, in key order, so a rerun on the
    same input gives the same ids. ``at`` is a number rising with the key order
    (default: the first key) and lets the numbering spread over tasks. A key with
    a missing part names no entity and gets no row; see ``without_key``.
    """
    absent = rows.select(*keys).dropna().distinct().join(dim.select(*keys), keys, "left_anti")
    start = dim.agg(F.max(id_col)).first()[0] or 0
    numbered = series.number_rows(absent, [], keys, out="_rank", at=at)
    created = numbered.select((F.col("_rank") + start).cast("long").alias(id_col), *keys)
    return created, dim.select(id_col, *keys).unionByName(created)


def without_key(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all parts of their key, rejects that name the first missing part)."""
    missing = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(f"no {k}")) for k in keys])
    marked = rows.withColumn("reason", missing)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def tie_break(df: DataFrame, last: Column | None = None) -> list[Column]:
    """An order among rows of equal version, winners first: the later position in a request if
    there is one, then all values, so that no partitioning decides which row wins."""
    sortable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return ([last.desc()] if last is not None else []) + [F.col(f"`{c}`").desc_nulls_last() for c in sortable]


def with_positions(rows: DataFrame, keys: list[str], arrival: list[str] = [], out: str = "position") -> DataFrame:
    """Numbers the rows of each key where no request gives them a position, in the order of the
    numeric columns ``arrival`` and of a hash of the values.

    Equal rows are counted first and the different rows of a key are numbered along a hash of their
    values, so neither a key nor a row that is most of the table meets in one task.
    """
    if out in rows.columns:
        return rows
    names = rows.columns
    if series.long_series(rows, keys, F.lit(0.0), series.SERIES_ROWS) is None:
        # No key is too long for one order: in it equal rows share a dense rank and differ in their number.
        order = [*arrival, "_hash", *[n for n in names if n not in arrival]]
        by = Window.partitionBy(*keys).orderBy(*[F.col(f"`{c}`") for c in order])
        copy = (F.row_number().over(by) - F.rank().over(by)).cast("long")
        hashed = rows.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in names]))
        return hashed.withColumn(out, copy * F.lit(2**32) + F.dense_rank().over(by)).select(*names, out)
    counted = rows.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_copies"))
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    order = [*arrival, "_hash", *[n for n in names if n not in arrival]]
    ranked = series.number_rows(counted.withColumn("_hash", digest), keys, order, out="_rank")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    return ranked.select(*names, "_rank", copy.alias("_copy")).select(
        *names, (F.col("_copy") * F.lit(2**32) + F.col("_rank")).alias(out)
    )


def upsert_latest(target: DataFrame | None, rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Target after an upsert: per key the row with the highest version.

    On equal versions an incoming row beats a stored one, and of several incoming
    ones the one with the greatest values in the order of the columns.
    """
    incoming = rows.withColumn("_new", F.lit(1))
    both = incoming if target is None else incoming.unionByName(target.withColumn("_new", F.lit(0)))
    order = [F.col(v).desc() for v in version] + [F.col("_new").desc()] + tie_break(rows)
    newest = Window.partitionBy(*keys).orderBy(*order)
    return both.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank", "_new")


def insert_first(target: DataFrame | None, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the earliest per key among those the target lacks."""
    fresh = rows if target is None else rows.join(target.select(*keys), keys, "left_anti")
    earliest = Window.partitionBy(*keys).orderBy(*order, *tie_break(rows))
    return fresh.withColumn("_rank", F.row_number().over(earliest)).filter(F.col("_rank") == 1).drop("_rank")


def active_model(registry: DataFrame) -> DataFrame:
    """Newest active model per subset."""
    newest = F.struct("trained_at", "model_id")
    return registry.filter("is_active").groupBy("subset").agg(F.max_by("model_id", newest).alias("model_id"))


def with_active_model(rows: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the model id of their subset, rows whose subset has no active model)."""
    models = series.checked_broadcast(active_model(registry))
    return (
        rows.join(models, "subset"),
        rows.join(models, "subset", "left_anti").withColumn("reason", F.lit("no active model")),
    )


def update_registry(registry: DataFrame, metrics: DataFrame) -> DataFrame:
    """Registry after setting version, algorithm and metrics of the active rows.

    ``metrics`` has one row per subset. The given values replace the stored
    ones, missing metrics included; the algorithm alone has a default.
    """
    fields = ["train_rmse", "train_mae", "train_r2", "train_nasa_score"]
    given = metrics.select(
        "subset",
        F.concat(F.lit("v1-"), C.dataset_label("subset")).alias("_version"),
        F.coalesce("algorithm", F.lit("XGBoost")).alias("_algorithm"),
        *[F.col(f).alias(f"_{f}") for f in fields],
    )
    joined = registry.join(series.checked_broadcast(given), "subset", "left")
    hit = F.col("is_active") & F.col("_version").isNotNull()
    new = {"model_version": "_version", "algorithm": "_algorithm", **{f: f"_{f}" for f in fields}}
    return joined.select(
        *[F.when(hit, F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in registry.columns]
    )


def prediction_rows(
    scored: DataFrame, endpoint: str, request_id: str, as_of, cap: int, latency_ms: float = 0.0
) -> DataFrame:
    """Scored rows in the shape of the prediction log.

    A ``predicted_at`` already present (back-dated history) is kept; the rest
    is stamped ``as_of``. The id follows from request, engine, cycle and the
    ``position`` of the row in the request (0 where there is none), so a repeated
    write gives the same ids and two readings of one cycle have two.
    """
    has_time = "predicted_at" in scored.columns
    position = "position" if "position" in scored.columns else F.lit(0)
    return scored.select(
        prediction_id(F.lit(request_id), "engine_id", "cycle", position).alias("prediction_id"),
        F.lit(request_id).alias("request_id"),
        "subset",
        "engine_id",
        "model_id",
        "cycle",
        "n_history_cycles",
        "predicted_rul",
        C.health_status("predicted_rul").alias("health_status"),
        F.lit(cap).alias("rul_cap"),
        F.lit(endpoint).alias("endpoint"),
        F.lit(float(latency_ms)).alias("latency_ms"),
        (F.col("predicted_at") if has_time else C.time_literal(as_of)).alias("predicted_at"),
    )


def prediction_id(*parts) -> Column:
    """A repeatable id below 2^60 of the parts that make a prediction unique."""
    digest = F.md5(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def append_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("subset").parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediates: ``spark.checkpoint.dir``, or
    a folder below the warehouse where the session names none. On a cluster that
    must not be a local folder, which other machines do not see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if not spark.sparkContext.master.startswith("local[") and folder.startswith("file:"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder. Other than from a checkpoint, later reads fetch only the columns they use."""
    path = f"{checkpoint_folder(df.sparkSession)}/wearline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seed_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> str:
    """Fill a table unless it already holds rows; ``force`` fills it anyway."""
    if not force and table_exists(spark, path) and not spark.read.parquet(path).isEmpty():
        return "skipped"
    build().write.mode("overwrite").parquet(path)
    return "seeded"
