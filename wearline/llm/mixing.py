"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has an exponential key, Exp(1) divided by its quality weight (a column, such as a
classifier's score, or a simple measure of the text); taking documents
in ascending key order is weighted sampling without replacement. A source whose target is
above its size is taken whole first, as often as it fits; what is left of the target is the
longest prefix of the key order that fits into it, and the one document that fits best into
the rest, if it brings the sum nearer.

The prefix is found without sorting a source. Keys are numbers in [0, 2^54); sums of sizes are
aggregated for 64 digits of the key at a time, and only the rows of the digit that holds the
boundary go on to the next. The last few rows are ordered in a window. So a source with any
share of the rows costs sums, and its rows are compared with one cut. The uniform numbers are
hashes of key, text and seed: reruns agree.

Defined cases. Null text: size 0, weight of an empty text. Null source: a source of its own,
last in order. Null key: hashed and ordered like a key before all others. Repeated rows: each
is a document; rows that agree in everything are told apart by their place in the input. A
source of size 0: target 0. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SEED = 11
KEY_BITS, DIGIT_BITS = 54, 6
#: Rows of a source that one window may order.
LAST_ROWS = 256
#: A table of that many sources, some 100 bytes each, is broadcast.
FEW_SOURCES = 50_000


#: The smallest sampling weight; a given weight that is null, not finite or below it counts as this.
LEAST_WEIGHT = 1e-3


def quality_weight(distinct: int, size: int) -> float:
    """The sampling weight of a text that none is given for: a quarter, plus its share of distinct words."""
    return 0.25 + distinct / size if size else 0.25


def measure(docs: DataFrame, key: str, text: str, source: str, seed: int, carry: list[str], weight: str | None = None) -> DataFrame:
    """One row for each document: key, source, size in words, its exponential key, the same as
    a whole number, and the carried columns as a struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights = [], []
            texts = batch["row"].field(carry.index(text_name)) if carried else batch["text"]
            for text in texts.to_pylist():
                words = (text or "").encode().split()  # ASCII white space alone
                sizes.append(len(words))
                if weight is None:
                    weights.append(quality_weight(len(set(words)), len(words)))
            if weight is not None:
                given = batch["weight"].to_numpy(zero_copy_only=False).astype(np.float64)
                weights = np.where(np.isfinite(given), np.maximum(given, LEAST_WEIGHT), LEAST_WEIGHT)
            hashed = batch["hash"].to_numpy().view(np.uint64) >> np.uint64(11)
            uniform = (hashed.astype(np.float64) + 0.5) / 2.0**53
            at = -np.log(uniform) / np.array(weights)
            whole = np.minimum(-np.expm1(-at) * 2.0**KEY_BITS, 2.0**KEY_BITS - 1).astype(np.int64)
            columns = [batch["key"], batch["source"], pa.array(sizes, pa.int64()), pa.array(at), pa.array(whole)]
            names = ["key", "source", "size", "at", "digits"]
            if carry:
                columns.append(batch["row"])
                names.append("row")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # The text goes to Python once: in the row that is carried, or by itself.
    text_name, carried = text, text in carry
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    named = docs.select(
        F.col(key).cast("long").alias("key"),
        *([] if carried else [F.col(text).alias("text")]),
        F.col(source).cast("string").alias("source"),
        F.xxhash64(F.col(key), F.col(text), F.lit(seed)).alias("hash"),
        *([] if weight is None else [F.col(weight).cast("double").alias("weight")]),
        *row,
    )
    kinds = {"key": T.LongType(), "source": T.StringType(), "size": T.LongType()}
    kinds |= {"at": T.DoubleType(), "digits": T.LongType()}
    if carry:
        kinds["row"] = named.schema["row"].dataType
    return named.mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sharing the excess of stopped sources by weight until none is above its stop is filling all
    to one level, in units of weight: sources stop in the order of stop / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"),
    )
    stop = F.col("source_size") * F.lit(float(most))
    sized = sizes.select("source", "source_size", weight.alias("weight"), stop.alias("stop"))
    by_level = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    sized = sized.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("stop") / F.col("weight"), F.struct(F.col("stop") / F.col("weight"), "level"))
    final = F.min(fits).over(Window.partitionBy())["level"]
    return sized.select(
        "source", "source_size",
        F.least("stop", F.coalesce(final * F.col("weight"), F.col("stop"))).alias("target"),
    )


def with_source(rows: DataFrame, table: DataFrame, name: str, few: bool) -> DataFrame:
    """Rows with the row of `table` for their source. One source may hold most rows: a table of
    few sources, counted before, is broadcast; a longer one is a join that can be split."""
    return rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col(name)))


def cuts(rows: DataFrame, plan: DataFrame, stage: C.Stage, few: bool, last_rows: int = LAST_ROWS) -> DataFrame:
    """Where each source's fraction ends: (cut_source, floor, cut, left). Documents below the
    floor are in, above it those up to `cut`, a struct (at, key, id) or null; `left` is what
    remains of the budget. `plan` has source and the `budget` of the fraction."""
    open_ = plan.filter("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("prefix"))
    open_ = stage.keep(open_, "open")
    bits = 0
    while True:
        shift = KEY_BITS - bits
        inside = with_source(rows, open_.withColumnRenamed("source", "s"), "s", few)
        inside = inside.filter(F.shiftright("digits", shift) == F.col("prefix"))
        if bits + DIGIT_BITS > KEY_BITS:
            break
        bits += DIGIT_BITS
        digit = F.shiftright("digits", KEY_BITS - bits)
        sums = inside.groupBy("source", "budget", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows")
        )
        upto = Window.partitionBy("source").orderBy("digit")
        sums = sums.withColumn("upto", F.sum("words").over(upto))
        # The boundary lies in the first digit whose sum passes the budget; budgets are below
        # the size of their source, so there is one.
        found = sums.filter("upto > budget").groupBy("source", "budget").agg(
            F.min(F.struct("digit", "upto", "words", "rows")).alias("x")
        )
        found = found.select(
            "source", (F.col("budget") - F.col("x.upto") + F.col("x.words")).alias("budget"),
            F.col("x.digit").alias("prefix"), F.col("x.rows").alias("rows"),
        )
        found = stage.keep(found, "boundary")
        most = found.agg(F.max("rows")).first()[0]
        open_ = found.drop("rows")
        if most is None or most <= last_rows:
            shift = KEY_BITS - bits
            inside = with_source(rows, open_.withColumnRenamed("source", "s"), "s", few)
            inside = inside.filter(F.shiftright("digits", shift) == F.col("prefix"))
            break
    place = F.struct("at", "key", "id")
    upto = Window.partitionBy("source").orderBy("at", "key", "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ordered = inside.select("source", "budget", "prefix", "size", place.alias("place"), "at", "key", "id")
    ordered = ordered.withColumn("upto", F.sum("size").over(upto)).filter("upto <= budget")
    last = ordered.groupBy("source").agg(F.max("place").alias("cut"), F.max("upto").alias("used"))
    first = open_.select(F.col("source").alias("s"), "prefix", "budget")
    # If no document of the boundary's digit is taken, all those below it are.
    floor = F.shiftleft("prefix", KEY_BITS - bits)
    return first.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("s").alias("cut_source"),
        floor.alias("floor"),
        "cut",
        (F.col("budget") - F.coalesce("used", F.lit(0))).alias("left"),
    )


def in_prefix() -> Column:
    """Whether a row lies in its source's prefix; false for a source without a fraction."""
    upto = F.coalesce(F.struct("at", "key", "id") <= F.col("cut"), F.lit(False))
    return F.col("floor").isNotNull() & ((F.col("digits") < F.col("floor")) | upto)


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
    seed: int = SEED, carry: list[str] | None = None, last_rows: int = LAST_ROWS, weight: str | None = None,
) -> DataFrame:
    """One row for each document: key, source, size, source_size, target (of its source),
    copies (how often the mix takes it), taken (words), and `row`, the carried columns.
    `weight` names a column of quality weights; without it a weight follows from the text."""
    stage = C.Stage(docs.sparkSession, "mixing")
    measured = measure(docs, key, text, source, seed, carry or [], weight)
    rows = stage.keep(measured.withColumn("id", F.monotonically_increasing_id()), "measured")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(
        F.when(F.lit(most) >= 1, F.lit(1)).otherwise(F.lit(0))
    )
    plan = plan.withColumn("epochs", epochs.cast("long"))
    plan = stage.keep(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
    few = plan.count() <= FEW_SOURCES
    limits = cuts(rows.drop("row"), plan, stage, few, last_rows)
    limits = plan.withColumnRenamed("source", "plan_source").join(
        limits, F.col("plan_source").eqNullSafe(F.col("cut_source")), "left"
    )
    limits = stage.keep(limits, "limits")
    place = F.struct("at", "key", "id")
    # One more document fills what the prefix leaves of the budget, the one that fits best.
    off = F.abs(F.col("size") - F.col("left"))
    loose = with_source(rows.drop("row"), limits, "plan_source", few)
    loose = loose.filter(~in_prefix() & F.col("floor").isNotNull() & (off < F.col("left")))
    best = loose.groupBy("source").agg(F.min(F.struct(off.alias("off"), place.alias("place")))["place"].alias("extra"))
    best = best.withColumnRenamed("source", "extra_source")
    limits = limits.join(best, F.col("plan_source").eqNullSafe(F.col("extra_source")), "left")
    extra = F.coalesce(place == F.col("extra"), F.lit(False))
    copies = F.col("epochs") + (in_prefix() | extra).cast("long")
    out = with_source(rows, limits, "plan_source", few)
    return out.select(
        "key", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *(["row"] if carry else []),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all `documents`: doc_id, size, source_size, target, taken."""
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")
