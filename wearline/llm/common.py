"""Shared pieces: the work folder, staged tables, table reading and small numeric helpers."""

from __future__ import annotations

import hashlib
import io
import math
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the word-based queries define it.
WORD = r"[^\x20\x09-\x0D]+"


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir`, as the cluster sets it.

    Where it is unset, as in tests, a folder below the warehouse is set in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        found = f"{warehouse}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path in it; any that Arrow can write."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    if "://" in folder:
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, wherever they run: once for each context, a zip in
    the work folder that Spark sends along."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if getattr(context, "_shipped_package", None) or not package.is_dir():
        return  # it is there, or this is the zip itself
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            entry = zipfile.ZipInfo(str(package.name / file.relative_to(package)))
            archive.writestr(entry, file.read_bytes())
    name = f"{package.name}-{hashlib.sha1(held.getvalue()).hexdigest()[:12]}.zip"
    system, root = filesystem(work_folder(spark))
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as file:
        file.write(held.getvalue())
    context.addPyFile(f"{work_folder(spark)}/{name}")
    context._shipped_package = name


class Stage:
    """Tables written to a folder of their own below the work folder.

    A written table cuts the lineage: a lost executor costs only the tasks it ran. `drop`
    removes one table again once nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.folder = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.folder}/{self._count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes `df` and reads it back."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame, name: str, old: DataFrame | None) -> DataFrame:
        """Writes `df`, reads it back and removes the table `old` that it came from."""
        new = self.keep(df, name)
        if old is not None:
            self.drop(old)
        return new

    def drop(self, df: DataFrame) -> None:
        """Removes the files of a table made by `keep`."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if self.folder.rpartition("/")[2] in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; columns beside them are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def pieces(total: int, each: int, most: int = 1 << 20) -> int:
    """How many parts of `each` hold `total`."""
    return max(1, min(most, math.ceil(total / each)))


def salt(column: Column | str, n: Column | int) -> Column:
    """A repeatable number from 0 to n - 1 for each value."""
    return F.pmod(F.xxhash64(column, F.lit(7)), n if isinstance(n, Column) else F.lit(n))
