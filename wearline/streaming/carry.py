"""Streams over ordered series, one micro-batch at a time.

Each batch joins the last rows that its series carried over from earlier
batches, runs the batch operator on both and writes the new rows. A batch is
thus an ordinary Spark job: a machine that sends a third of the rows is cut into
blocks like in batch work, where per-key state would pin it to one task.

What is carried lies in hash buckets of the series: a batch reads and replaces
only the buckets that its series fall into. State, output and rejects change in
one commit per batch (see ``operators.versions``), so a batch that is repeated
after a failure is skipped as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline import schema as S
from wearline.operators import entities as ent
from wearline.operators import features as feat
from wearline.operators import fleet
from wearline.operators import series, store
from wearline.operators import validate as val
from wearline.operators.versions import Commit, Spec, Tables

WRITER = "stream"


def state_tables(spark: SparkSession, folder: str, keys: list[str] = [], buckets: int = 64) -> Tables:
    """The carried rows of a stream and its outputs."""
    store.checkpoint_folder(spark)
    logs = {name: Spec("log") for name in ("features", "alerts", "rejects")}
    return Tables(spark, f"{folder}/tables", {"carried": Spec("state", keys, buckets=buckets), **logs})


def output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that a stream wrote: ``features``, ``alerts``, ``rejects`` or ``carried``."""
    return state_tables(spark, folder).read(name)


def _carried(commit: Commit, batch: DataFrame, batch_id: int) -> tuple[DataFrame, set[str]]:
    """(what the series of a batch carried, the buckets of the batch). Fails if the batch before is not there,
    as going on from nothing would restart every series."""
    held = commit.base["batches"].get(WRITER, -1)
    if batch_id != held + 1:
        raise FileNotFoundError(f"the state of batch {batch_id - 1} does not exist; the last one is {held}")
    table = commit.base["tables"].get("carried")
    touched = commit.tables.touched("carried", batch)
    empty = batch.sparkSession.createDataFrame([], batch.schema)
    return (commit.tables.resolve("carried", table, touched) if table else empty), touched


def in_order(batch: DataFrame, carried: DataFrame, keys: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """(new rows, rejects): a row must have a sequence number beyond what its series already has,
    and one row per sequence number is taken, always the same one of several. A missing key part
    is a value like any other."""
    seen = carried.groupBy(*keys).agg(F.max(seq).alias("_seen"))
    joined = series.salted_join(batch, seen, keys, [seq], "left", null_safe=True)
    fresh = F.coalesce(F.col("_seen").isNull() | (F.col(seq) > F.col("_seen")), F.lit(False)) & F.col(seq).isNotNull()
    same = Window.partitionBy(*keys, seq).orderBy(*[F.col(c) for c in batch.columns if c not in (*keys, seq)])
    # Rows and rejects are parts of one written table, so that the join and the order are made once.
    late = joined.filter(~fresh).drop("_seen").withColumn("_rank", F.lit(0))
    marked = joined.filter(fresh).drop("_seen").withColumn("_rank", F.row_number().over(same)).unionByName(late)
    marked = store.written(marked)
    why = F.when(F.col("_rank") > 1, "repeated").when(F.col(seq).isNull(), "no sequence number").otherwise("out of order")
    rejects = marked.filter(F.col("_rank") != 1).withColumn("reason", why).drop("_rank")
    return marked.filter(F.col("_rank") == 1).drop("_rank"), rejects


def after_gaps(both: DataFrame, keys: list[str], seq: str, step: int, position: str | None = None) -> DataFrame:
    """New rows that are more than ``step`` beyond the row before them, carried or new."""
    steps = val.sequence_steps(both, keys, seq, position=position).filter(F.col("_new") & (F.col("step") > step))
    return steps.drop("_new", "step", *([position] if position else [])).withColumn("reason", F.lit("gap before"))


def _handler(folder: str, keys: list[str], seq: str, columns: list[str], carry: int, name: str, build, step: int | None, buckets: int):
    """A foreachBatch handler: ``build`` makes the output from new and carried rows.

    Rows out of order, repeated or without a sequence number are rejects and not kept. With
    ``step`` rows after a gap are noted there too, but kept.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tables = state_tables(spark, folder, keys, buckets)
        if tables.holds(WRITER, batch_id):
            return
        with tables.commit(WRITER, batch_id) as commit:
            need = store.materialised(batch.select(*keys, seq, *columns))
            carried, touched = _carried(commit, need, batch_id)
            fresh, late = in_order(need, carried, keys, seq)
            marked = [fresh.withColumn("_new", F.lit(True)), carried.withColumn("_new", F.lit(False))]
            # Numbered once for all that follows.
            both = reduce(DataFrame.unionByName, marked)
            both = store.materialised(series.number_rows(both, keys, [seq], "_position"))
            number = F.lit(batch_id).cast("long").alias("batch_id")
            made = build(both)
            if made is not None:
                commit.append(name, made.filter("_new").drop("_new", "_position").select("*", number))
            rejects = late.withColumn("kept", F.lit(False))
            if step is not None:
                rejects = rejects.unionByName(after_gaps(both, keys, seq, step, "_position").withColumn("kept", F.lit(True)))
            commit.append("rejects", rejects.select("*", number))
            commit.replace("carried", ent.newest_rows(both.drop("_new", "_position"), keys, [seq], carry), touched)

    return handle


def rolling_batch(folder: str, keys: list[str], seq: str, cols: list[str], window: int = S.WINDOW, step: int | None = None,
                  buckets: int = 64):
    """foreachBatch handler: trailing features across batches."""

    def build(both):
        return feat.rolling_features(both, keys, seq, cols, window, "_position")

    return _handler(folder, keys, seq, cols, window - 1, "features", build, step, buckets)


def alert_batch(folder: str, keys: list[str], seq: str, status: str = "health_status", step: int | None = None, buckets: int = 64):
    """foreachBatch handler: status changes, also across batches."""

    def build(both):
        return fleet.status_changes(both, keys, seq, status, "_position")

    return _handler(folder, keys, seq, [status], 1, "alerts", build, step, buckets)


def latest_batch(folder: str, keys: list[str], order: list[str], buckets: int = 64):
    """foreachBatch handler: the newest row of each key over all batches."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        tables = state_tables(batch.sparkSession, folder, keys, buckets)
        if tables.holds(WRITER, batch_id):
            return
        with tables.commit(WRITER, batch_id) as commit:
            rows = store.materialised(batch)
            carried, touched = _carried(commit, rows, batch_id)
            commit.replace("carried", ent.latest_row(rows.unionByName(carried), keys, order), touched)

    return handle


def newest_version(spark: SparkSession, folder: str) -> DataFrame:
    """What the last batch carried."""
    return output(spark, folder, "carried")


def stream_rolling_features(stream: DataFrame, folder: str, keys: list[str], seq: str, cols: list[str], window: int = S.WINDOW,
                            step: int | None = None):
    """Streaming twin of rolling_features; returns the unstarted writer."""
    return _writer(stream, folder, rolling_batch(folder, keys, seq, cols, window, step))


def stream_latest(stream: DataFrame, folder: str, keys: list[str], order: list[str]):
    return _writer(stream, folder, latest_batch(folder, keys, order))


def stream_alerts(stream: DataFrame, folder: str, keys: list[str], seq: str, step: int | None = None):
    return _writer(stream, folder, alert_batch(folder, keys, seq, step=step))


def _writer(stream: DataFrame, folder: str, handler):
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", f"{folder}/checkpoint")
