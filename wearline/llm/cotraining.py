"""Quality classification by co-training two views of a document.

The text view sees words that tell good from bad documents and the style of a text: shares of
characters, repetition, lengths. The metadata view sees source, language and length alone. Each
view has a logistic regression of its own. In each round both score every document without a
label, and what one view is confident of, wherever it stands in the corpus, becomes training data
of the other. A fold of the labelled rows that neither is trained on calibrates both, combines them
and sets the threshold, within bounds, so that the share `KEEP` of its good documents is kept. The
combined score covers all documents.

Training rows are bounded: at most about `LABELLED` labelled ones, and `DRAWN` pseudo-labels for
each view and round, drawn by hash from all texts that passed the threshold; words come from the
labelled ones. Scoring is one pass over the table, without a shuffle of texts: the model is a few
thousand numbers.

A document is good if its quality label is 1 and its toxic label is not.

Defined cases. Null text: an empty text. Null source, language or length: a value of its own.
Null key: scored, never labelled. Several labels of a key: bad if one is. No labels, or of one
kind only: nothing to learn, every score is 1 and every document kept. Repeated rows: each is
scored, alike. Empty table: no rows.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bounds of the training rows: labelled ones, and pseudo-labels that a view learns from in a round.
LABELLED, DRAWN = 20_000, 2_000
#: Words of the text view and documents that must hold one.
WORDS, SUPPORT = 1500, 5
ROUNDS = 2
#: A view is confident of calibrated scores this near to 0 or 1.
CONFIDENT = 0.02
#: Share of the good documents of the calibration fold that the threshold keeps, and the range of
#: calibrated scores it may lie in; a small fold alone cannot move it further.
KEEP, LOWEST, HIGHEST = 0.997, 0.1, 0.5
#: Hashed values of source and language.
SOURCES, LANGS = 256, 64
SIZES = 16

PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
STYLE = len(PUNCTUATION) + 9


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def style(text: str | None, words: list[str]) -> list[float]:
    """Shares of characters by kind, repetition and lengths."""
    if not words:
        return [0.0] * STYLE
    raw = np.frombuffer((text or "").encode(), np.uint8)
    share = np.bincount(raw, minlength=256) / len(raw)
    kinds = [share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[:33].sum(), share[128:].sum()]
    n = len(words)
    again = sum(map(operator.eq, words, words[1:])) / n
    lengths = [len(set(words)) / n, again, math.log1p(n) / 10, min(len(raw) / n, 100.0) / 10]
    return [*np.sqrt(share[PUNCTUATION]).tolist(), *np.sqrt(kinds).tolist(), *lengths]


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """The set positions of the metadata view: one for source, language and size each."""
    where = lambda name, n: 0 if name is None else 1 + zlib.crc32(name.encode()) % (n - 1)
    size = 0 if n_chars is None else min(SIZES - 1, 1 + max(0, n_chars).bit_length() * 2 // 3)
    return [where(source, SOURCES), SOURCES + where(lang, LANGS), SOURCES + LANGS + size]


META = SOURCES + LANGS + SIZES


@dataclass
class Model:
    """Weights of both views, their calibration and combination, and the threshold."""

    words: dict[str, int] = field(default_factory=dict)
    word_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    style_weights: np.ndarray = field(default_factory=lambda: np.zeros(STYLE))
    meta_weights: np.ndarray = field(default_factory=lambda: np.zeros(META))
    bias: tuple[float, float] = (0.0, 0.0)
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    combination: tuple[float, float, float] = (0.0, 0.0, math.inf)
    threshold: float = 0.0
    pseudo_labels: int = 0

    def margins(self, text: str | None, source: str | None, lang: str | None, n_chars: int | None) -> tuple[float, float]:
        """The uncalibrated log odds of both views."""
        words = words_of(text)
        known = [self.words[w] for w in self.words.keys() & set(words)]
        by_text = self.bias[0] + self.word_weights[known].sum() + np.dot(self.style_weights, style(text, words))
        return float(by_text), float(self.bias[1] + self.meta_weights[metadata(source, lang, n_chars)].sum())

    def scores(self, *document) -> tuple[float, float, float]:
        """Calibrated scores of both views, and the combined one."""
        views = [a * m + b for m, (a, b) in zip(self.margins(*document), self.calibration, strict=True)]
        both = self.combination[0] * views[0] + self.combination[1] * views[1] + self.combination[2]
        return tuple(sigmoid(x) for x in (*views, both))


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0


# --- samples -------------------------------------------------------------------------


def marked(docs: DataFrame) -> DataFrame:
    """`docs` with `mark`, a hash of all that the views see; copies share it."""
    return docs.withColumn("mark", F.xxhash64("text", "source", "lang", "n_chars"))


def spread(seed: int, *columns: str):
    """A repeatable number below 2^30."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def described(rows: DataFrame) -> DataFrame:
    """(key, good, tag, words, style, meta) of rows (key, good, tag, text, source, lang, n_chars)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch["text"].to_pylist()
            words = [words_of(t) for t in texts]
            seen = zip(*[batch[c].to_pylist() for c in ("source", "lang", "n_chars")], strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["key"],
                    batch["good"],
                    batch["tag"],
                    pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())),
                    pa.array([style(t, w) for t, w in zip(texts, words, strict=True)], pa.list_(pa.float64())),
                    pa.array([[f"m{i}" for i in metadata(*x)] for x in seen], pa.list_(pa.string())),
                ],
                names=["key", "good", "tag", "words", "style", "meta"],
            )

    return rows.select("key", "good", "tag", "text", "source", "lang", "n_chars").mapInArrow(
        features, "key long, good double, tag string, words array<string>, style array<double>, meta array<string>"
    )


def one_of_each(rows: DataFrame, *by: str) -> DataFrame:
    """One row of those that agree in `by`; copies are merged before anything is shuffled."""
    return rows.groupBy(*by).agg(F.first(F.struct(*rows.columns)).alias("row")).select("row.*")


def sampled(docs: DataFrame, labels: DataFrame, labelled: int, stage: C.Stage) -> DataFrame:
    """(key, good, tag, words, style, meta) of at most about `labelled` labelled rows; the tag is
    the fold, `fit` or `calibrate`. Equal rows of a key count once, so a repeated one is no flood."""
    known = labels.filter("key IS NOT NULL").groupBy("key").agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    share = min(1.0, labelled / max(1, known.count()))
    known = known.filter(spread(5, "key") < int(share * (1 << 30)) + 1).select(
        "key", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double").alias("good")
    )
    # By the share about `labelled`; the bound holds for any keys.
    known = known.orderBy(spread(5, "key"), "key").limit(2 * labelled)
    picked = one_of_each(marked(docs).join(F.broadcast(known), "key"), "key", "mark")
    picked = stage.keep(picked, "labelled")
    share = min(1.0, 2 * labelled / max(1, picked.count()))
    picked = picked.filter(spread(6, "key", "mark") < int(share * (1 << 30)) + 1)
    fold = F.when(F.pmod(F.xxhash64("key", F.lit(9)), F.lit(4)) == 0, "calibrate").otherwise("fit")
    return stage.keep(described(picked.withColumn("tag", fold)), "sample")


def telling_words(rows: DataFrame, words: int, support: int) -> list[str]:
    """The words whose presence says most about the label, by their likelihood ratio."""
    totals = rows.groupBy("good").count().collect()
    n = {r["good"]: float(r["count"]) for r in totals}
    counts = rows.select("good", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("b"),
    )
    counts = counts.filter(F.col("a") + F.col("b") >= support)
    share = (F.col("a") + F.col("b")) / (n[1.0] + n[0.0])

    def part(seen, total):
        rate = seen / total
        return F.when(seen > 0, seen * F.log(rate / share)).otherwise(0.0) + F.when(
            seen < total, (total - seen) * F.log((1 - rate) / (1 - share))
        ).otherwise(0.0)

    gain = F.when(share < 1, part(F.col("a"), F.lit(n[1.0])) + part(F.col("b"), F.lit(n[0.0]))).otherwise(0.0)
    best = counts.select("word", gain.alias("gain")).orderBy(F.col("gain").desc(), "word").limit(words)
    return [r["word"] for r in best.collect()]


# --- fitting -------------------------------------------------------------------------


def regression(rows: DataFrame, features: str, strength: float = 0.02):
    return LogisticRegression(
        featuresCol=features, labelCol="good", regParam=strength, maxIter=25, tol=1e-4
    ).fit(rows)


def newton(x: np.ndarray, good: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights and, last, bias of a logistic regression on a few columns of a bounded fold."""
    wide = np.column_stack([x, np.ones(len(x))])
    at = np.zeros(wide.shape[1])
    ridge = 1e-3 * np.eye(len(at))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(wide @ at, -30, 30)))
        slope = wide.T @ (good - p) - ridge @ at
        step = np.linalg.solve((wide * (p * (1 - p))[:, None]).T @ wide + ridge, slope)
        at += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return at


def odds_of(view, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, log odds, labels) of a bounded fold, by key."""
    found = view.transform(rows).select("key", vector_to_array("rawPrediction")[1].alias("odds"), "good").collect()
    found = np.array(sorted((r["key"], r["odds"], r["good"]) for r in found))
    return tuple(found.T)


def score_unlabelled(docs: DataFrame, labels: DataFrame, model: Model, stage: C.Stage, name: str) -> DataFrame:
    """(mark, text_score, meta_score) of every document without a label, by one pass over the texts."""
    C.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in sliced(batches):
            views = [batch[c].to_pylist() for c in ("text", "source", "lang", "n_chars")]
            found = [own.scores(*x) for x in zip(*views, strict=True)]
            scores = [pa.array([f[i] for f in found], pa.float64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["mark"], *scores], names=["key", "mark", "text_score", "meta_score"])

    seen = marked(docs).select("key", "mark", "text", "source", "lang", "n_chars")
    found = seen.mapInArrow(run, "key long, mark long, text_score double, meta_score double")
    return stage.keep(found.join(labels.select("key").distinct(), "key", "left_anti").drop("key"), name)


def pseudo_labels(scored: DataFrame, view: str, most: int, prior: float, turn: int) -> DataFrame:
    """(mark, good): of the texts that a view is confident of, wherever they stand in the corpus, a
    draw of at most about `most` by hash, in the proportion of the labels."""
    p = F.col(view)
    sure = scored.select("mark", F.when(p >= 1 - CONFIDENT, 1.0).when(p <= CONFIDENT, 0.0).alias("good"))
    sure = sure.filter("good IS NOT NULL").distinct()
    n = {r["good"]: r["count"] for r in sure.groupBy("good").count().collect()}
    wanted = {1.0: most * prior, 0.0: most * (1 - prior)}
    cut = {g: int(min(1.0, wanted[g] / max(1, n.get(g, 0))) * (1 << 30)) + 1 for g in wanted}
    return sure.filter(spread(20 + turn, "mark") < F.when(F.col("good") == 1, cut[1.0]).otherwise(cut[0.0]))


def shape(words: list[str], views: dict, calibration: dict) -> Model:
    """The model of two fitted and calibrated views, not yet combined."""
    weights = {x: (v.coefficients.toArray(), float(v.intercept)) for x, v in views.items()}
    return Model(
        words={w: i for i, w in enumerate(words)},
        word_weights=weights["text_x"][0][: len(words)],
        style_weights=weights["text_x"][0][len(words) :],
        meta_weights=weights["meta_x"][0],
        bias=(weights["text_x"][1], weights["meta_x"][1]),
        calibration=tuple(tuple(map(float, calibration[x])) for x in ("text_x", "meta_x")),
    )


def fit(
    docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, drawn: int = DRAWN,
    rounds: int = ROUNDS, keep: float = KEEP,
) -> Model:
    """Trains on `docs` (key, text, source, lang, n_chars) and `labels` (key, quality, toxic)."""
    stage = C.Stage(docs.sparkSession, "cotraining")
    known = sampled(docs, labels, labelled, stage)
    if known.groupBy("tag", "good").count().count() < 4:  # a fold lacks one kind
        return Model()
    words = telling_words(known.filter("tag = 'fit'"), WORDS, SUPPORT) or ["-"]
    names = [f"m{i}" for i in range(META)]
    vector = CountVectorizerModel.from_vocabulary(words, inputCol="words", outputCol="word_x", binary=True)
    meta = CountVectorizerModel.from_vocabulary(names, inputCol="meta", outputCol="meta_x", binary=True)
    both = VectorAssembler(inputCols=["word_x", "style_x"], outputCol="text_x")

    def shaped(rows: DataFrame, name: str) -> DataFrame:
        made = meta.transform(vector.transform(rows.withColumn("style_x", array_to_vector("style"))))
        made = both.transform(made).select("key", "good", "tag", "text_x", "meta_x")
        return stage.keep(made.coalesce(4), name)  # a bounded sample

    folds = shaped(known, "shaped")
    first, fold = folds.filter("tag = 'fit'").drop("tag"), folds.filter("tag = 'calibrate'").drop("tag")
    prior = first.agg(F.avg("good")).first()[0]
    train = {"text_x": first, "meta_x": first}
    passed = 0
    for turn in range(rounds + 1):
        views = {x: regression(train[x], x) for x in train}
        odds = {x: odds_of(view, fold) for x, view in views.items()}
        calibration = {x: newton(o, good) for x, (_, o, good) in odds.items()}
        if turn == rounds:
            break
        # Both views score every document without a label; what one is confident of the other learns from.
        scored = score_unlabelled(docs, labels, shape(words, views, calibration), stage, f"scored-{turn}")
        told = pseudo_labels(scored, "text_score", drawn, prior, turn).withColumn("tag", F.lit("meta_x")).unionByName(
            pseudo_labels(scored, "meta_score", drawn, prior, turn).withColumn("tag", F.lit("text_x"))
        )
        told = stage.keep(told, f"told-{turn}")  # at most about twice `drawn` rows
        picked = one_of_each(marked(docs).join(F.broadcast(told), "mark"), "mark", "tag")
        more = shaped(described(picked), f"pseudo-{turn}")
        passed += more.count()
        for x in train:
            train[x] = train[x].unionByName(more.filter(F.col("tag") == x).drop("tag"))

    model = shape(words, views, calibration)
    model.pseudo_labels = passed
    # Both views on the fold that neither was trained on: calibrated, then combined.
    good = odds["text_x"][2]
    x = np.column_stack([odds[v][1] * calibration[v][0] + calibration[v][1] for v in ("text_x", "meta_x")])
    combination = newton(x, good)
    model.combination = tuple(map(float, combination))
    margins = np.sort((x @ combination[:2] + combination[2])[good == 1])
    score = sigmoid(float(margins[int((1 - keep) * len(margins))]))
    model.threshold = min(HIGHEST, max(LOWEST, score))
    return model


# --- scoring -------------------------------------------------------------------------


def classify(docs: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """(row, text_score, meta_score, score, keep) of every row; `row` holds its columns."""
    C.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in sliced(batches):
            views = [c.to_pylist() for c in batch.columns[1:]]
            texts = batch.column(0).field(at_text).to_pylist()
            found = [own.scores(*x) for x in zip(texts, *views, strict=True)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            keep = [s >= own.threshold for s in columns[2]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.float64()) for c in columns], pa.array(keep, pa.bool_())],
                names=["row", "text_score", "meta_score", "score", "keep"],
            )

    at_text = docs.columns.index(text)
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"),
        F.col(n_chars).cast("long").alias("n_chars"),
    )
    schema = T.StructType(
        [
            T.StructField("row", named.schema["row"].dataType),
            *[T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score")],
            T.StructField("keep", T.BooleanType()),
        ]
    )
    return named.mapInArrow(run, schema)


def train(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of a folder's `labels`, fitted on `docs`, which has the columns of documents."""
    labels = C.read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    named = docs.select(
        F.col("doc_id").cast("long").alias("key"), "text", F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
    )
    return fit(named, labels.withColumnRenamed("doc_id", "key"))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the scores of both views, the combined score and whether the document is kept."""
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "n_chars")
    found = classify(docs, train(spark, docs, sf_dir))
    return found.select("row.doc_id", "text_score", "meta_score", "score", "keep")
