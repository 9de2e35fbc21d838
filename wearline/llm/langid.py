"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word falls back to its
character n-grams, the longest first: the first length with a known n-gram decides, by the mean
log frequency of its known n-grams of that length. A text's language is the one with the
largest sum over its words.

Counts cover all learning texts. Words are counted in the tasks and then by key; n-gram counts
come from the word counts, not from the texts. All counts are kept, as tables: one row for each
word or n-gram with its count in every language. The most frequent words also go to the tasks,
each with its counts in all languages, and are summed up there; their number is bounded, and a
word beyond it costs a join and changes no result. Each other word is scored once: by the whole
word table, and if it is not there by the whole n-gram tables, from the longest on. Then the
scores are summed for each text. Scores are whole numbers of 1 / SCALE, so sums do not depend on
their order.

Defined cases. Null text or no letter: `und`, score 0. Null language: not learned from.
Null key: its checksum is null, so it is neither learned from nor held out. Nothing to learn
from: `und` for all. Repeated rows: each counts. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Character n-grams of unseen words; `<` and `>` mark the ends of a word.
LONGEST = 5
#: Words whose scores are sent to the tasks, and how many numbers they may take.
FAST_WORDS, FAST_CELLS = 200_000, 4_000_000
#: Steps of a score, per 1.
SCALE = 1 << 24
#: Documents a worker scores at a time.
AT_ONCE = 512
#: A word that is in more than this share of the rows of words and texts is joined by broadcast.
HOT = 1000
#: Distinct words a counting task holds before it passes them on.
HELD = 200_000
#: Added to every count.
SMOOTHING = 0.5
#: Histogram steps of a frequency cut, per factor e.
STEPS = 50
#: Unseen words whose scores a worker keeps.
KEPT = 300_000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            langs, names, counts = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                names=["lang", "word", "n"],
            )

        for batch in batches:
            for text, lang in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > HELD:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(text), F.col(lang)).mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, n: int) -> DataFrame:
    """(lang, word, n) of the character n-grams of counted words; `word` holds the n-gram."""
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    places = F.sequence(F.lit(1), F.length(marked) - (n - 1))
    grams = F.explode(F.transform(places, lambda i: F.substring(marked, i, F.lit(n))))
    long_enough = words.filter(F.length(marked) >= n)
    return long_enough.select("lang", grams.alias("word"), "n").groupBy("lang", "word").agg(
        F.sum("n").alias("n")
    )


def most_frequent(counts: DataFrame, entries: int) -> DataFrame:
    """At most `entries` rows: those above a frequency that a histogram gives."""
    step = F.floor(F.log("n") * STEPS)
    seen = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()
    cut, total = None, 0
    for row in sorted(seen, key=lambda r: -r["step"]):
        total += row["rows"]
        if total > entries:
            break
        cut = row["step"]
    return counts.filter(F.lit(False) if cut is None else step >= cut)


class Table:
    """Log frequencies of names: a row of numbers, one for each language, for each name."""

    def __init__(self, entries: list[tuple[str, int, float]], floor: list[float]):
        self.at: dict[str, int] = {}
        for name, _, _ in entries:
            self.at.setdefault(name, len(self.at))
        self.rows = np.tile(np.array(floor, np.float32), (len(self.at), 1))
        if entries:
            self.rows[[self.at[x] for x, _, _ in entries], [i for _, i, _ in entries]] = [v for _, _, v in entries]


class Model:
    """The method on one text, over tables that fit into memory: one of words, then one of n-grams
    for each length from 1 on. Tests hold `identify` against it."""

    def __init__(self, langs: list[str], tables: list[Table]):
        self.langs, self.tables = langs, tables
        self.kept: dict[str, np.ndarray] = {}

    def unseen(self, word: str) -> np.ndarray:
        """The mean over the known n-grams of the longest length that has any."""
        found = self.kept.get(word)
        if found is None:
            marked = f"<{word}>"
            for n in range(LONGEST, 0, -1):
                at = self.tables[n].at
                own = [r for i in range(len(marked) - n + 1) if (r := at.get(marked[i : i + n])) is not None]
                if own:
                    found = self.tables[n].rows[own].sum(axis=0) / len(own)
                    break
            else:
                found = np.zeros(len(self.langs), np.float32)
            if len(self.kept) < KEPT:
                self.kept[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text))
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        counts = np.fromiter(words.values(), np.float64, len(words))
        at = np.array([self.tables[0].at.get(w, -1) for w in words])
        seen = at >= 0
        total = counts[seen] @ self.tables[0].rows[at[seen]].astype(np.float64)
        if not seen.all():
            for word, ok in zip(words, seen.tolist(), strict=True):
                if not ok:
                    total += self.unseen(word) * words[word]
        best = int(np.argmax(total))
        # The posterior under equal priors, softened by the square root of the length.
        odds = np.exp((total - total[best]) / math.sqrt(counts.sum()))
        return self.langs[best], float(1 / odds.sum())


class Learned:
    """Tables (name, n, counts) of all words and, by length, of all n-grams; `bases` holds for each
    table what a count is divided by in each language, `fast` the scores of frequent words."""

    def __init__(self, langs: list[str], tables: list[DataFrame], bases: list[list[float]], fast: dict[str, list[int]]):
        self.langs, self.tables, self.bases, self.fast = langs, tables, bases, fast

    def scores(self, n: int) -> DataFrame:
        """(name, score) of a table: the log frequency in each language, in steps."""
        return with_scores(self.tables[n], self.langs, self.bases[n]).select("name", "score")


def with_scores(table: DataFrame, langs: list[str], bases: list[float]) -> DataFrame:
    held = F.map_from_entries("counts")

    def one(lang: str, base: float) -> Column:
        count = F.coalesce(F.try_element_at("held", F.lit(lang)), F.lit(0))
        return F.round(F.log((count + SMOOTHING) / base) * SCALE).cast("long")

    return table.withColumn("held", held).withColumn("score", F.array(*map(one, langs, bases)))


def by_name(counts: DataFrame) -> DataFrame:
    """(name, n, counts) of (lang, word, n): one row with the counts in all languages."""
    pair = F.struct("lang", "n")
    return counts.groupBy(F.col("word").alias("name")).agg(F.sum("n").alias("n"), F.collect_list(pair).alias("counts"))


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang",
    fast_words: int = FAST_WORDS,
) -> Learned:
    """Learns from all rows with a language."""
    stage = C.Stage(docs.sparkSession, "langid")
    counted = word_counts(docs.filter(F.col(lang).isNotNull()), text, lang)
    tables = [stage.keep(by_name(counted), "words")]
    words = tables[0].select("name", F.explode("counts").alias("x")).select("x.lang", F.col("name").alias("word"), "x.n")
    tables += [stage.keep(by_name(gram_counts(words, n)), f"grams-{n}") for n in range(1, LONGEST + 1)]
    sums = [
        {r["lang"]: r for r in table.select(F.explode("counts").alias("x")).groupBy("x.lang").agg(
            F.sum("x.n").alias("n"), F.count("*").alias("kinds")).collect()}
        for table in tables
    ]
    langs = sorted(sums[0])
    bases = [[own[x]["n"] + SMOOTHING * (own[x]["kinds"] + 1) if x in own else 1.0 for x in langs] for own in sums]
    if not langs:
        return Learned([], tables, bases, {})
    top = most_frequent(tables[0], min(fast_words, FAST_CELLS // len(langs)))  # a bounded number
    top = with_scores(top, langs, bases[0]).select("name", "score").collect()
    return Learned(langs, tables, bases, {r["name"]: r["score"] for r in top})


def partly_scored(named: DataFrame, model: Learned) -> DataFrame:
    """(row, id, total, words, rest): the summed scores of the frequent words of a text, the number
    of its words, 0 where none has a letter, and its other words with their counts."""
    spark = named.sparkSession
    names = list(model.fast)
    table = np.array([model.fast[x] for x in names], np.int64).reshape(len(names), len(model.langs))
    sent = spark.sparkContext.broadcast(({x: i for i, x in enumerate(names)}, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, table = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                totals, sizes, others, counts, ends = [], [], [], [], [0]
                for text in part[0].to_pylist():
                    words = Counter(words_of(text))
                    if not any(c.isalpha() for w in words for c in w):
                        words = Counter()
                    at = np.array([place.get(w, -1) for w in words], np.int64)
                    n = np.fromiter(words.values(), np.int64, len(words))
                    seen = at >= 0
                    totals.append(n[seen] @ table[at[seen]])
                    sizes.append(int(n.sum()))
                    if not seen.all():
                        rest = [w for w, ok in zip(words, seen.tolist(), strict=True) if not ok]
                        others += rest
                        counts += n[~seen].tolist()
                    ends.append(len(others))
                width = table.shape[1]
                total = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(totals) + 1) * width, pa.int32()), pa.array(np.concatenate(totals), pa.int64())
                )
                rest = pa.StructArray.from_arrays([pa.array(others, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [part[1], total, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)],
                    names=["row", "total", "words", "rest"],
                )

    kind = named.schema["row"].dataType.simpleString()
    schema = f"row {kind}, total array<long>, words long, rest array<struct<word:string,n:long>>"
    return named.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id())


def grams_of_words(words: DataFrame, n: int) -> DataFrame:
    """(at, name) of each n-gram of (at, word), as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                grams = [grams_of(word, n) for word in part[1].to_pylist()]
                at = np.repeat(part[0].to_numpy(zero_copy_only=False), [len(x) for x in grams])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int64()), pa.array([g for x in grams for g in x], pa.string())], names=["at", "name"]
                )

    return words.select("at", "word").mapInArrow(run, "at long, name string")


def word_scores(rest: DataFrame, model: Learned, stage: C.Stage) -> DataFrame:
    """(word, rows, score) of each distinct word of (id, word, n) that the tables can score."""
    words = rest.groupBy("word").agg(F.count("*").alias("rows"))
    known = model.scores(0).withColumnRenamed("name", "word")
    words = words.join(known, "word", "left").withColumn("at", F.monotonically_increasing_id())
    words = stage.keep(words, "words")
    scored, left = [words.filter(F.col("score").isNotNull())], words.filter(F.col("score").isNull()).drop("score")
    for n in range(LONGEST, 0, -1):
        table = model.scores(n)
        if n == 1:
            table = F.broadcast(table)  # no more rows than there are letters, and each word has the marks
        size = len(model.langs)
        sums = [F.sum(F.col("score")[i]).alias(f"s{i}") for i in range(size)]
        found = grams_of_words(left, n).join(table, "name").groupBy("at").agg(F.count("*").alias("grams"), *sums)
        means = F.array(*[F.round(F.col(f"s{i}") / F.col("grams")).cast("long") for i in range(size)])
        found = stage.keep(found.select("at", means.alias("score")), f"found-{n}")
        scored.append(left.join(found, "at"))
        left = left.join(found, "at", "left_anti")
    whole = scored[0].select("word", "rows", "score")
    for more in scored[1:]:
        whole = whole.unionByName(more.select("word", "rows", "score"))
    return stage.keep(whole, "scores")


def identify(docs: DataFrame, model: Learned, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """(key, lang_pred, score) and further columns of `docs`, for every row."""
    C.ship(docs.sparkSession)
    named = docs.select(F.col(text).cast("string").alias("text"), F.struct(F.col(key), *more).alias("row"))
    size = len(model.langs)
    if not size:
        return named.select("row.*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    stage = C.Stage(docs.sparkSession, "langid-found")
    texts = stage.keep(partly_scored(named, model), "texts")
    rest = texts.select("id", F.explode("rest").alias("x")).select("id", "x.word", "x.n")
    scores = word_scores(rest, model, stage)
    limit = max(10_000, rest.count() // HOT)  # at most HOT words are above it
    hot = F.broadcast(scores.filter(F.col("rows") > limit).drop("rows"))
    cold = scores.filter(F.col("rows") <= limit).drop("rows")
    parts = rest.join(hot, "word").unionByName(rest.join(hot.select("word"), "word", "left_anti").join(cold, "word"))
    sums = F.array(*[F.sum(F.col("score")[i] * F.col("n")) for i in range(size)])
    sums = parts.groupBy("id").agg(sums.alias("others"))
    none = F.array_repeat(F.lit(0).cast("long"), size)
    total = F.zip_with("total", F.coalesce("others", none), lambda a, b: a + b)
    whole = texts.select("row", "id", "total", "words").join(sums, "id", "left").select("row", "words", total.alias("total"))
    best = F.array_max("total")
    # The posterior under equal priors, softened by the square root of the length.
    odds = F.transform("total", lambda t: F.exp((t - best) / SCALE / F.sqrt("words")))
    score = 1 / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    names = F.array(*map(F.lit, model.langs))
    pred = F.element_at(names, F.array_position("total", best).cast("int"))
    ok = F.col("words") > 0
    return whole.select(
        "row.*", F.when(ok, pred).otherwise(UNKNOWN).alias("lang_pred"), F.when(ok, score).otherwise(0.0).alias("score")
    )


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all `documents`."""
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    quarter = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = docs.select("doc_id", "text", "lang", quarter.alias("quarter"))
    model = fit(docs.filter("quarter <> 2").select("text", "lang"))
    docs = docs.select("doc_id", "text", F.coalesce(F.col("quarter") == 2, F.lit(False)).alias("held_out"))
    return identify(docs, model, "doc_id", "text", "held_out").select("doc_id", "held_out", "lang_pred", "score")
