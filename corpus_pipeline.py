"""The training-data pipeline over `documents`: each stage works on what the one before kept.

Every stage is one operator of `wearline.llm` and a function (spark, docs, sf_dir). Its result is
written as Parquet in the work folder and read again, so a lost executor never costs more than
the stage it is in. All stages but the last return the columns they were given, the columns of
documents among them, and the first adds its score; null values, repeated rows and empty tables have the results that the
operators define, and columns beside those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import common as C
from wearline.llm import cotraining, mixing, packing, personal, simhash
from wearline.llm.tokens import default_tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The column that the first stage adds to those it was given.
SCORE = "quality_score"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps, with its combined score as `quality_score`,
    which the mix draws by. Without usable labels: all, with score 1."""
    model = cotraining.train(spark, docs, sf_dir)
    columns = [F.col(f"row.`{c}`") for c in docs.columns if c != SCORE]
    return cotraining.classify(docs, model).filter("keep").select(*columns, F.col("score").alias(SCORE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id that is not null, of
    repeated rows the first."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = C.Stage(spark, "rows").keep(docs.select(F.monotonically_increasing_id().alias("id"), row), "rows")
    named = rows.select("id", F.col("row.text").alias("text"))
    groups = simhash.simhash_components(named, key="id").select(F.col("key").alias("id"), "component")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "id")
    first = groups.join(rows.select("id", F.col("row.doc_id").alias("doc_id")), "id").groupBy("component").agg(
        F.min(order)["id"].alias("id")
    )
    return rows.join(first.select("id"), "id", "left_semi").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data and disclosing terms replaced; n_chars follows the text.
    Documents without any stay as they are."""
    found = personal.find_personal(docs, carry=docs.columns)
    spans = personal.all_spans(F.col("spans"), F.col("added"))
    found = found.select("row", spans.alias("all")).withColumn("text", personal.sanitised(F.col("row.text"), F.col("all")))
    changed = {
        "text": F.col("text"),
        "n_chars": F.when(F.size("all") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, drawn by the classifier's score if there is one."""
    mixed = mixing.mix(docs, carry=docs.columns, weight=SCORE if SCORE in docs.columns else None)
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return mixed.select("row", again).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, default_tokenizer(), ids=True).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from `documents` to packed sequences."""
    stage = C.Stage(spark, "pipeline")
    docs = C.read_table(spark, sf_dir, "documents", *COLUMNS)
    for name, function in STAGES:
        docs = stage.keep(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
