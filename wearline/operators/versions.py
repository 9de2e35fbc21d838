"""Stored tables as versions: rows in hash buckets of their keys, one manifest for all tables.

A commit writes new files first and then one small manifest that names, for each bucket of each
table, the folders that hold its rows. The manifest appears by a rename that fails where another
writer was faster, so a reader sees all tables of a commit or none of them, a killed write leaves
the version before readable, and files that no manifest names are removed by ``vacuum``.

Three kinds of tables:

* ``latest`` (upsert): a commit appends the batch's rows to the buckets that it touches and reads
  nothing. Readers merge a bucket's folders, the highest version of a key first. A bucket of more
  than ``MOST`` folders is rewritten as one, with the commit that made it so long.
* ``first`` (first writer wins): only the keys of the touched buckets are read; rows whose key is
  there are left out, so keys stay unique.
* ``log``: rows are appended. Folders of one size class are merged once there are ``MOST`` of them,
  so a row is rewritten a few times only, and the manifest stays short.
* ``state``: the touched buckets get new content (see ``replace``).

Buckets hash the whole key, so the readings of a busy machine spread over all of them. A commit may
carry a batch number; a batch that the tables already hold is skipped, which makes a repeated
micro-batch harmless.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.operators import series, store

BUCKETS = 64
#: Folders of a bucket, or of a size class of a log, that are merged into one.
MOST = 8
#: Up to so many keys are also sent to the scan of a table, where they select files by their statistics.
FEW_KEYS = 1000


class ConcurrentWrite(RuntimeError):
    """Another writer committed first; nothing of this commit is visible."""


@dataclass
class Spec:
    """How a table is kept: its kind, its keys and, for ``latest``, the columns of the version."""

    kind: str
    keys: list[str] = field(default_factory=list)
    version: list[str] = field(default_factory=list)
    buckets: int = BUCKETS


class Files:
    """The few file operations that a manifest needs, on any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file in one step; False if it is there already."""
        target = self._path(f"{self.root}/{name}")
        draft = self._path(f"{self.root}/{name}.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            done = not self._fs.exists(target) and self._fs.rename(draft, target)
        except self.spark._jvm.java.io.IOException:  # some file systems raise instead
            done = False
        if not done:
            self._fs.delete(draft, False)
        return done

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Tables:
    """Several tables below one folder that change together."""

    def __init__(self, spark: SparkSession, root: str, specs: dict[str, Spec]):
        self.spark, self.specs = spark, specs
        self.files = Files(spark, root)
        self.root = self.files.root

    # --- versions ---------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.files.names("_versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest."""
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "batches": {}, "tables": {}}
        version = found[-1] if version is None else version
        return json.loads(self.files.read(f"_versions/v{version:012d}.json"))

    def holds(self, writer: str, batch_id: int) -> bool:
        """Whether a batch of a writer is already committed."""
        return self.manifest()["batches"].get(writer, -1) >= batch_id

    def commit(self, writer: str | None = None, batch_id: int | None = None) -> "Commit":
        return Commit(self, writer, batch_id)

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the newest manifests and the files that none of those names."""
        found = self.versions()
        for version in found[:-keep]:
            self.files.delete(f"_versions/v{version:012d}.json")
        named = {
            folder.split("/")[1]
            for v in found[-keep:]
            for table in self.manifest(v)["tables"].values()
            for entries in table["buckets"].values()
            for folder, _ in entries
        }
        for table in self.files.names(""):
            for written in self.files.names(table) if table in self.specs else []:
                if written not in named:
                    self.files.delete(f"{table}/{written}")

    # --- reading ----------------------------------------------------------

    def schema(self, name: str, version: int | None = None) -> T.StructType | None:
        table = self.manifest(version)["tables"].get(name)
        return schema_of(table) if table else None

    def read(self, name: str, version: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """The rows of a table; with ``near`` only those of the buckets that its keys fall into."""
        table = self.manifest(version)["tables"].get(name)
        if table is None:
            raise FileNotFoundError(f"no rows were ever committed to {name} below {self.root}")
        return self.resolve(name, table, None if near is None else self.touched(name, near, schema_of(table)))

    def touched(self, name: str, rows: DataFrame, schema: T.StructType | None = None) -> set[str]:
        """The buckets that some rows fall into; at most as many rows as buckets reach the driver."""
        spec = self.specs[name]
        table = self.manifest()["tables"].get(name)
        schema = schema or (schema_of(table) if table else rows.schema)
        typed = rows.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in spec.keys])
        bucket = bucket_of(spec, table["of"] if table else None)
        return {str(r[0]) for r in typed.select(bucket).distinct().collect()}

    def resolve(self, name: str, table: dict, only: Iterable[str] | None = None) -> DataFrame:
        spec = self.specs[name]
        schema = schema_of(table)
        buckets = {b: e for b, e in table["buckets"].items() if only is None or b in only}
        several = spec.kind == "latest"
        plain = [f for e in buckets.values() for f, _ in e if not several or len(e) == 1]
        merged = [f for e in buckets.values() for f, _ in e if several and len(e) > 1]
        kept = T.StructType([*schema.fields, T.StructField("_commit", T.LongType())])
        parts = []
        if plain:
            parts.append(self._scan(plain, kept).drop("_commit"))
        if merged:
            parts.append(newest_of(self._scan(merged, kept), spec).drop("_commit"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _scan(self, folders: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])


def schema_of(table: dict) -> T.StructType:
    return T.StructType.fromJson(json.loads(table["schema"]))


def bucket_of(spec: Spec, buckets: int | None = None) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in spec.keys]), F.lit(buckets or spec.buckets)).cast("int")


def newest_of(rows: DataFrame, spec: Spec) -> DataFrame:
    """One row of each key: the highest version, of equal ones the later commit."""
    order = [F.col(v).desc_nulls_last() for v in spec.version] + [F.col("_commit").desc()]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*spec.keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


class Commit:
    """Writes to several tables that become visible together, when the block ends without error.

    ``skipped`` is set where the batch is already there; writes then do nothing.
    """

    def __init__(self, tables: Tables, writer: str | None, batch_id: int | None):
        self.tables, self.spark = tables, tables.spark
        self.writer, self.batch_id = writer, batch_id
        self.base = tables.manifest()
        self.skipped = writer is not None and self.base["batches"].get(writer, -1) >= batch_id
        self.number = self.base["version"] + 1
        self.changed: dict[str, dict] = {}

    def __enter__(self) -> "Commit":
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None or self.skipped:
            return
        batches = self.base["batches"] | ({self.writer: self.batch_id} if self.writer else {})
        manifest = {"version": self.number, "batches": batches, "tables": self.base["tables"] | self.changed}
        if not self.tables.files.create(f"_versions/v{self.number:012d}.json", json.dumps(manifest)):
            raise ConcurrentWrite(f"version {self.number} of {self.tables.root} is taken")

    def _table(self, name: str, rows: DataFrame) -> dict:
        found = self.changed.get(name) or self.base["tables"].get(name)
        if found is None:
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
            return {"schema": schema.json(), "buckets": {}, "ids": 0, "of": self.tables.specs[name].buckets}
        if found["of"] != self.tables.specs[name].buckets:
            raise ValueError(f"{name} is kept in {found['of']} buckets, not in {self.tables.specs[name].buckets}")
        # Columns that no commit before had are added; older rows hold null there.
        schema = schema_of(found)
        more = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in schema.names]
        schema = T.StructType([*schema.fields, *more])
        return found | {"schema": schema.json(), "buckets": {b: list(e) for b, e in found["buckets"].items()}}

    def get_or_create(self, name: str, rows: DataFrame, id_col: str, at: Column) -> DataFrame:
        """The rows of a ``first`` table for the keys in ``rows``; new keys get the next ids in key order.

        ``at`` is a number that rises with the key order and lets the numbering spread over tasks.
        The manifest keeps the highest id, so no old row is read for it. Keys must be complete.
        """
        spec = self.tables.specs[name]
        asked = rows.select(*spec.keys).distinct()
        with_id = asked.select(F.lit(0).cast("long").alias(id_col), *spec.keys)
        table = self._table(name, with_id)
        numbered = series.number_rows(self.absent(name, with_id), [], spec.keys, out="_rank", at=at)
        created = store.materialised(numbered.select((F.col("_rank") + table["ids"]).alias(id_col), *spec.keys))
        self.insert_first(name, created, [F.col(id_col)])
        self.changed[name]["ids"] = table["ids"] + created.count()
        return self.tables.resolve(name, self.changed[name], self.tables.touched(name, with_id, schema_of(table)))

    def _write(self, name: str, rows: DataFrame, table: dict) -> dict[str, str]:
        """New folders by bucket. Large buckets are written by several tasks, small ones by few."""
        spec = self.tables.specs[name]
        value = lambda f: F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)
        rows = rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in schema_of(table)])
        rows = rows.withColumn("_commit", F.lit(self.number).cast("long"))
        rows = rows.withColumn("_bucket", bucket_of(spec)) if spec.keys else rows
        folder = f"{name}/{self.number:012d}-{uuid.uuid4().hex[:8]}"
        if not spec.keys:
            rows.write.parquet(f"{self.tables.root}/{folder}")
            return {"all": folder}
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.tables.root}/{folder}")
        written = [n for n in self.tables.files.names(folder) if n.startswith("_bucket=")]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in written}

    def upsert(self, name: str, rows: DataFrame, within: list[Column]) -> None:
        """Last writer wins by the version columns; ``within`` orders rows of one batch, winners first."""
        if self.skipped:
            return
        spec, table = self.tables.specs[name], self._table(name, rows)
        order = [F.col(v).desc_nulls_last() for v in spec.version] + within
        first = Window.partitionBy(*spec.keys).orderBy(*order)
        rows = rows.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")
        for bucket, folder in self._write(name, rows, table).items():
            table["buckets"].setdefault(bucket, []).append([folder, 0])
        self.changed[name] = table
        full = {b for b, e in table["buckets"].items() if len(e) > MOST}
        if full:
            self._swap(name, table, self.tables.resolve(name, table, full), full)

    def insert_first(self, name: str, rows: DataFrame, order: list[Column]) -> None:
        """Rows whose key is new, the first of each key by ``order``."""
        if self.skipped:
            return
        spec, table = self.tables.specs[name], self._table(name, rows)
        fresh = self.absent(name, rows)
        first = Window.partitionBy(*spec.keys).orderBy(*order)
        fresh = fresh.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")
        for bucket, folder in self._write(name, fresh, table).items():
            table["buckets"].setdefault(bucket, []).append([folder, 0])
        self.changed[name] = table
        full = {b for b, e in table["buckets"].items() if len(e) > MOST}
        if full:
            self._swap(name, table, self.tables.resolve(name, table, full), full)

    def absent(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows whose key the table lacks. Reads the key columns of the touched buckets only."""
        spec, table = self.tables.specs[name], self._table(name, rows)
        held = self.tables.resolve(name, table, self.tables.touched(name, rows, schema_of(table))).select(*spec.keys)
        if len(spec.keys) == 1:
            (key,) = spec.keys
            asked = [r[0] for r in rows.select(key).distinct().limit(FEW_KEYS + 1).collect()]
            if len(asked) <= FEW_KEYS:
                held = held.filter(F.col(key).isin([a for a in asked if a is not None]) | F.col(key).isNull())
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in spec.keys]
        return rows.alias("n").join(held.alias("h"), same, "left_anti")

    def append(self, name: str, rows: DataFrame) -> None:
        """All rows."""
        if self.skipped:
            return
        table = self._table(name, rows)
        entries = table["buckets"].setdefault("all", [])
        entries.append([self._write(name, rows, table)["all"], 0])
        size = 0
        while sum(1 for _, s in entries if s == size) >= MOST:
            class_ = [f for f, s in entries if s == size]
            part = {"schema": table["schema"], "buckets": {"all": [[f, size] for f in class_]}}
            merged = self._write(name, self.tables.resolve(name, part), table)["all"]
            entries[:] = [e for e in entries if e[1] != size] + [[merged, size + 1]]
            size += 1
        self.changed[name] = table

    def replace(self, name: str, rows: DataFrame, touched: set[str]) -> None:
        """New content of the touched buckets; all others keep their files."""
        if self.skipped:
            return
        self._swap(name, self._table(name, rows), rows, touched)

    def _swap(self, name: str, table: dict, rows: DataFrame, touched: set[str]) -> None:
        written = self._write(name, rows, table)
        for bucket in touched:
            table["buckets"].pop(bucket, None)
        for bucket, folder in written.items():
            table["buckets"][bucket] = [[folder, 0]]
        self.changed[name] = table


def one_table(spark: SparkSession, path: str, spec: Spec) -> Tables:
    """A table by itself below a folder of its own."""
    store.checkpoint_folder(spark)
    return Tables(spark, path, {"rows": spec})
