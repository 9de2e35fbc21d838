"""Rows and tables that the tests of this folder share."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Columns beside those of documents, named like columns the operators make.
CLASH = ["key", "row", "id", "size", "spans", "text_hash", "score", "rank", "ids", "start", "mark", "keep", "target"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents with clashing columns beside theirs."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


LONG = " ".join(f"word{i % 977} number {i * 7919 % 10007}" for i in range(20_000))

ODD_ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "b", 4),
    (4, "one", None, "b", 3),
    (5, "One two", "en", None, 7),
    (None, "a text without key, but words", "de", "a", 29),
    (6, "The same text twice in a row.", "en", "c", 29),
    (6, "The same text twice in a row.", "en", "c", 29),
    (7, "The same text twice in a row.", "en", "c", 29),
    (8, "Ünïcode 日本語 \U0001f600 – “quoted” text's end", "fr", "c", 35),
    (9, LONG, "en", "a", len(LONG)),
    (10, "<|endoftext|> in a text\x1cwith  odd spaces \n\n and\ttabs ", "en", "a", 60),
]


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")
