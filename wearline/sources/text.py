"""Whitespace-delimited sensor logs, ground-truth lists and engine CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline import schema as S
from wearline.functions import columns as C
from wearline.operators import series
from wearline.operators.store import table_exists

# In the name of a file, or of the folder that holds its parts.
SUBSET_PATTERN = "FD00([1-4])[^/]*(?:/part-[^/]*)?$"


def subset_of_file(name) -> Column:
    """Subset number from a name or path such as train_FD003.txt, also when that
    is a folder of part files; NULL without one."""
    return F.regexp_extract(name, SUBSET_PATTERN, 1).try_cast("int")


def parse_sensor_lines(lines: DataFrame, schema: T.StructType = S.LOG_SCHEMA, column: str = "value") -> DataFrame:
    """Columns of whitespace-separated lines, by position. Blank lines vanish;
    a field that is absent or no number becomes NULL, and so does NaN."""
    parts = F.split(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")), " ")
    rows = lines.filter(~F.col(column).rlike(r"^\s*$")).withColumn("_parts", parts)
    fields = []
    for i, f in enumerate(schema.fields):
        c = F.get("_parts", F.lit(i)).try_cast(f.dataType)
        fields.append((C.finite(c) if isinstance(f.dataType, T.DoubleType) else c).alias(f.name))
    return rows.select(*[F.col(c) for c in lines.columns if c != column], *fields)


def read_sensor_log(spark: SparkSession, paths, schema: T.StructType = S.LOG_SCHEMA) -> DataFrame:
    """Sensor logs of one or all datasets, tagged with ``subset`` by file name."""
    lines = spark.read.text(paths).select(
        "value",
        subset_of_file(F.col("_metadata.file_path")).alias("subset"),
    )
    return parse_sensor_lines(lines, schema)


def read_truth(spark: SparkSession, paths) -> DataFrame:
    """Ground truth (subset, unit_rank, true_rul): line i belongs to engine i.

    A block of a file is read in order by one task, so the line order is block
    offset, then row order within the block; the lines of a block are counted
    and ranked like any long series.
    """
    lines = (
        spark.read.text(paths)
        .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                subset_of_file(F.col("_metadata.file_path")).alias("subset"))
        .filter(~F.col("value").rlike(r"^\s*$"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    numbered = series.number_rows(lines, ["_file"], ["_at", "_row"], out="unit_rank")
    value = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).try_cast("double")
    return numbered.select("subset", "unit_rank", value.alias("true_rul"))


def read_engine_csv(spark: SparkSession, paths, subset: int, schema: T.StructType = S.LOG_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected files) of comma-separated engine files, header optional.

    Each file is one engine: every row takes the unit of the first data row. A
    header counts as such when it names the leading columns in order; it also
    tells which columns the file has, and a file lacking a required sensor is
    rejected with the missing names.
    """
    names = [f.name for f in schema.fields]
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    lines = (
        spark.read.text(paths)
        .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
        .filter(~F.col("value").rlike(r"^\s*$"))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_cells", cells)
    )
    header = F.array(*[F.lit(n) for n in names])
    is_header = F.col("_cells") == F.slice(header, F.lit(1), F.least(F.size("_cells"), F.lit(len(names))))
    data = lines.withColumn("_header", is_header)
    first = F.struct("_at", "_row")
    facts = {
        "_first": (F.min, F.when(~F.col("_header"), F.struct("_at", "_row", F.get("_cells", F.lit(0)).alias("unit")))),
        "_width": (F.min, F.struct(first.alias("k"), F.size("_cells").alias("n"), F.col("_header").alias("h"))),
    }
    rows = series.attach_series(data, ["_file"], F.col("_at"), facts).filter(~F.col("_header"))
    # Without a header missing columns read as NULL but exist, as names are given by position.
    width = F.when(F.col("_width.h"), F.least(F.col("_width.n"), F.lit(len(names)))).otherwise(F.lit(len(names)))
    required = F.array(F.lit("unit"), F.lit("cycle"), *[F.lit(s) for s in S.SENSORS[subset]])
    lacking = F.array_sort(F.array_except(required, F.slice(header, F.lit(1), width)))
    rows = rows.withColumn("missing", lacking)
    fields = [
        (C.finite(c) if isinstance(f.dataType, T.DoubleType) else c).alias(f.name)
        for f in schema.fields[1:]
        for c in [F.get("_cells", F.lit(names.index(f.name))).try_cast(f.dataType)]
    ]
    good = rows.filter(F.size("missing") == 0).select(
        F.col("_file").alias("file"),
        F.lit(subset).alias("subset"),
        F.col("_first.unit").try_cast("int").alias("unit"),
        *fields,
    )
    rejects = rows.filter(F.size("missing") > 0).groupBy(F.col("_file").alias("file")).agg(
        F.first("missing").alias("missing"), F.count(F.lit(1)).alias("n_rows")
    )
    return good, rejects


def resolve_dataset(spark: SparkSession, folder: str, dataset: str) -> str:
    """Path of the demo log of a dataset, or of its training log when there is no demo."""
    C.subset_of_label(dataset)
    for kind in ("demo", "train"):
        path = f"{folder}/{kind}_{dataset}.txt"
        if table_exists(spark, path):
            return path
    raise FileNotFoundError(f"no demo or training log for {dataset} in {folder}")


def sensor_lines(df: DataFrame, columns: list[str] = S.LOG_COLUMNS, fmt: str = "%.4f", out: str = "value") -> DataFrame:
    """Rows as space-separated text; doubles by ``fmt``, NULL as an empty field."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [
        F.coalesce(
            F.format_string(fmt, F.col(c)) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(c).cast("string"),
            F.lit(""),
        )
        if c in kinds
        else F.lit("")
        for c in columns
    ]
    # format_string spells a NULL argument "null", so the NULL test comes first.
    fields = [F.when(F.col(c).isNotNull(), f).otherwise("") if c in kinds else f for c, f in zip(columns, fields)]
    return df.select(*[c for c in df.columns if c not in columns], F.concat_ws(" ", *fields).alias(out))


def write_sensor_log(df: DataFrame, path: str, order: list[str] = ["unit", "cycle"], columns: list[str] = S.LOG_COLUMNS, fmt: str = "%.4f") -> None:
    """Write a log as text, globally ordered across its part files."""
    ordered = df.select(*[c for c in columns if c in df.columns]).orderBy(*order)
    sensor_lines(ordered, columns, fmt).write.mode("overwrite").text(path)
