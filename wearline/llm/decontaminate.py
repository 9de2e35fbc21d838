"""Benchmark decontamination by suffix arrays over the training texts.

The words of the training documents that a task reads form a shard. Its suffix array holds the
start of every run of words, in the order of the words that follow; test items are then searched
in it, and no text is ever shuffled.

1. Test items are read once: their distinct words are numbered from 1, and every start of an item
   from which a window fits is a test suffix. A word that no item holds is 0 and ends a suffix, as
   does the end of a document; nothing matches across either.
2. A shard's suffixes are sorted by the packed numbers of their first words, ties by doubling:
   the rank of the words that follow decides, until the longest test item is covered.
3. Each test suffix is found by binary search, all of them at once, a packed group of words after
   the other. The places between both bounds are the occurrences of its window; searching on
   beyond the window gives the longest verbatim match.
4. Words inside an occurrence are hit. Occurrences are marked as differences and summed, so a
   passage that stands in a third of all documents costs what its words cost.

A window is `window` consecutive words of an item; an item of fewer, but not none, is one window.
`find_hits` gives a row for each document, `longest_matches` one for each test suffix,
`decontaminate` the documents without a hit.

Test items are sent to the tasks in parts of at most `PART_WORDS` words; with several parts the
documents pass through one search after the other, and are written after every fourth.

Defined cases. Null or wordless text: no words, not contaminated; such an item has no window.
Repeated rows: each has its own result. Items that share an id are one item; a null id marks words
but is not listed. Empty tables: no rows, or documents without a hit. Very long texts: a shard of
their own, whole. Columns beside key and text pass through `carry` as a struct and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .words import split_words, texts_of

WINDOW = 10
#: Words of a shard (a longer text is a shard by itself) and of the items sent at a time.
SHARD_WORDS, PART_WORDS = 1 << 20, 1 << 21


class Items:
    """Numbered words, test suffixes and the windows they begin with.

    `ids` holds the words of all items, a 0 after each. Suffix s starts at `starts[s]`, has
    `lengths[s]` words up to its item's end and begins with window `windows[s]`; window w takes
    `needs[w]` words from `window_at[w]` on and belongs to the items `owners[w]`.
    """

    def __init__(self, rows: list[tuple[str | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        ids: list[int] = []
        known: dict[tuple[int, ...], int] = {}
        self.owners: list[set[str]] = []
        self.names: list[tuple[str | None, int]] = []
        starts, lengths, windows, needs, window_at = [], [], [], [], []
        for name, text in rows:
            words = [number(w, len(self.vocabulary) + 1) for w in split_words(text)]
            need = min(window, len(words))
            for at in range(len(words) - need + 1 if words else 0):
                key = tuple(words[at : at + need])
                if key not in known:
                    known[key] = len(needs)
                    needs.append(need)
                    window_at.append(len(ids) + at)
                    self.owners.append(set())
                if name is not None:
                    self.owners[known[key]].add(name)
                self.names.append((name, at))
                starts.append(len(ids) + at)
                lengths.append(len(words) - at)
                windows.append(known[key])
            ids += [*words, 0]
        whole = lambda x: np.array(x, np.int64)
        self.starts, self.lengths, self.windows = whole(starts), whole(lengths), whole(windows)
        self.needs, self.window_at = whole(needs), whole(window_at)
        self.ids = whole(ids)
        self.depth = int(self.lengths.max(initial=0))
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.pack = max(1, min(8, 63 // self.bits))


def packed(ids: np.ndarray, bits: int, pack: int) -> np.ndarray:
    """For every place the next `pack` numbers in one integer; a 0 ends them."""
    keys = np.zeros(len(ids), np.int64)
    going = np.ones(len(ids), bool)
    for i in range(pack):
        here = np.zeros(len(ids), np.int64)
        here[: max(0, len(ids) - i)] = ids[i:]
        going &= here > 0
        keys = (keys << bits) | np.where(going, here, 0)
    return keys


class SuffixArray:
    """Places of `ids` in the order of the words that follow, compared to `depth` words.

    Places from which fewer than `least` words follow before a 0 are left out.
    """

    def __init__(self, ids: np.ndarray, bits: int, pack: int, depth: int, least: int):
        self.bits, self.pack, n = bits, pack, len(ids)
        ends = np.flatnonzero(np.concatenate([ids == 0, [True]]))
        self.follow = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
        self.keys = packed(ids, bits, pack)
        _, rank = np.unique(self.keys, return_inverse=True)
        # A rank counts the places before, so ranks of refined groups stay apart.
        rank = (np.cumsum(np.bincount(rank)) - 1)[rank] if n else rank
        reach = pack
        while reach < depth and n:
            # Only places that agree with another in all `reach` words need more of them.
            shared = np.bincount(rank, minlength=n)[rank] > 1
            tied = np.flatnonzero(shared & (self.follow >= reach))
            if not len(tied):
                break
            after = np.where(tied + reach < n, rank[np.minimum(tied + reach, n - 1)], -1)
            order = np.lexsort((after, rank[tied]))
            old, new = rank[tied][order], after[order]
            first = np.concatenate([[True], (old[1:] != old[:-1]) | (new[1:] != new[:-1])])
            last_of = np.concatenate([np.flatnonzero(first)[1:], [len(order)]]) - 1
            group = np.concatenate([[True], old[1:] != old[:-1]])
            # The last place of a group keeps the group's rank; those before count down from it.
            group_end = np.concatenate([np.flatnonzero(group)[1:], [len(order)]])[np.cumsum(group) - 1]
            place = old - (group_end - 1 - last_of[np.cumsum(first) - 1])
            rank[tied[order]] = place
            reach *= 2
        kept = np.flatnonzero(self.follow >= least)
        self.places = kept[np.argsort(rank[kept], kind="stable")]

    def _bound(self, lo: np.ndarray, hi: np.ndarray, skip: np.ndarray, key: np.ndarray, after: bool) -> np.ndarray:
        """The first index in lo..hi whose words from `skip` on are at least `key` (or beyond it)."""
        lo, hi = lo.copy(), hi.copy()
        n = len(self.keys)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            at = self.places[mid] + skip[open_]
            found = np.where(at < n, self.keys[np.minimum(at, n - 1)], 0)
            right = found <= key[open_] if after else found < key[open_]
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)

    def search(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds lo, hi of the places that go on with `lengths` words of each start."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.places), np.int64)
        for skip in range(0, int(lengths.max(initial=0)), self.pack):
            now = np.flatnonzero((lengths > skip) & (lo < hi))
            if not len(now):
                break
            self._narrow(lo, hi, now, keys[starts[now] + skip], np.minimum(lengths[now] - skip, self.pack), skip)
        return lo, hi

    def _narrow(self, lo, hi, now, keys, words, skip) -> None:
        """Keeps, of the bounds at `now`, the places whose next `words` words are those of `keys`."""
        free = (self.pack - words) * self.bits
        low = (keys >> free) << free
        at = np.full(len(now), skip, np.int64)
        first = self._bound(lo[now], hi[now], at, low, after=False)
        hi[now] = self._bound(first, hi[now], at, low | ((np.int64(1) << free) - 1), after=True)
        lo[now] = first

    def longest(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the words of its longest match, at most `lengths`, and one place of it (-1: none)."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.places), np.int64)
        matched, place = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
        going = np.flatnonzero(hi > 0)
        for skip in range(0, int(lengths.max(initial=0)), self.pack):
            going = going[lengths[going] > skip]
            if not len(going):
                break
            whole = np.minimum(lengths[going] - skip, self.pack)
            left = going
            for short in range(self.pack):
                words = np.minimum(self.pack, lengths[left] - skip) - short
                left = left[words > 0]
                if not len(left):
                    break
                words = words[words > 0]
                a, b = lo.copy(), hi.copy()
                self._narrow(a, b, left, keys[starts[left] + skip], words, skip)
                hit = a[left] < b[left]
                done = left[hit]
                matched[done], place[done] = skip + words[hit], self.places[a[done]]
                lo[done], hi[done] = a[done], b[done]
                left = left[~hit]
            going = going[matched[going] == skip + whole]
        return matched, place


def shards(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int], most: int):
    """(batch, first row, word counts, word numbers) of runs of documents; a 0 follows each document."""
    number = vocabulary.get
    for batch in batches:
        held: list[np.ndarray] = []
        counts: list[int] = []
        first = size = 0
        for i, text in enumerate(texts_of(batch["text"])):
            words = split_words(text)
            if held and size + len(words) > most:
                yield batch, first, np.array(counts, np.int64), np.concatenate(held)
                held, counts, first, size = [], [], i, 0
            numbers = np.zeros(len(words) + 1, np.int64)
            numbers[:-1] = np.fromiter(map(number, words, repeat(0)), np.int64, len(words))
            held.append(numbers)
            counts.append(len(words))
            size += len(words)
        if held:
            yield batch, first, np.array(counts, np.int64), np.concatenate(held)


def _parts(items: DataFrame, key: str, text: str, window: int, most: int) -> list[Items]:
    """The test items by parts of at most about `most` words; one item is never split."""
    named = items.select(F.col(key).cast("string").alias("name"), F.col(text).alias("text")).distinct()
    words = F.coalesce(F.octet_length("text"), F.lit(0)) / 2
    parts = C.pieces(named.agg(F.sum(words)).first()[0] or 1, most)
    out = []
    for part in range(parts):
        rows = named.filter(C.salt(F.struct("name", "text"), parts) == part)
        rows = rows.select("name", F.encode("text", "UTF-8").alias("text")).collect()
        rows = [(r["name"], None if r["text"] is None else bytes(r["text"])) for r in rows]
        found = Items(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] or b"")), window)
        if len(found.starts):
            out.append(found)
    return out


def _hits(found: Items, counts: np.ndarray, ids: np.ndarray):
    """Per document: spans of hit words, longest occurring window run and windows, of one shard."""
    least = int(found.needs.min())
    array = SuffixArray(ids, found.bits, found.pack, int(found.needs.max()), least)
    keys = packed(found.ids, found.bits, found.pack)
    lo, hi = array.search(keys, found.window_at, found.needs)
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = array.places[np.repeat(lo, n) + within]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + found.needs[window], -1)
    hit = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    edges = np.diff(hit)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    starts = np.cumsum(counts + 1) - counts - 1
    doc = lambda at: np.searchsorted(starts, at, side="right") - 1
    pairs = np.unique(doc(place) * max(1, len(n)) + window)
    return starts, doc(begin), begin, end, pairs // max(1, len(n)), pairs % max(1, len(n))


def find_hits(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = WINDOW, carry: list[str] | None = None, part: int = PART_WORDS,
    shard: int = SHARD_WORDS,
) -> DataFrame:
    """(key, row, n_words, spans, items): for each document its number of words, the runs of hit
    words (start, end exclusive, by word) and the sorted ids of items with an occurring window.
    `row` is a struct of the columns named by `carry`."""
    spark = docs.sparkSession
    C.ship(spark)
    stage = C.Stage(spark, "hits")
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(True).alias("there"))
    out = docs.select(
        F.col(key).alias("key"), row.alias("row"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    parts = _parts(items, item_key, item_text, window, part)
    for at, found in enumerate(parts or [Items([], window)]):
        out = out.mapInArrow(_searcher(spark.sparkContext.broadcast(found), shard, last=at == len(parts) - 1), schema)
        if at % 4 == 3 and at < len(parts) - 1:
            out = stage.keep(out, "part")
    return out.drop("text")


def _searcher(sent, shard: int, last: bool):
    """One part of the items searched in all shards; results are merged with those of parts before."""

    def merge(spans: list[dict], more: list[tuple[int, int]]) -> list[dict]:
        """Overlapping or touching runs become one, as they do within a part."""
        every = sorted([(s["start"], s["end"]) for s in spans] + more)
        out: list[list[int]] = []
        for a, b in every:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [{"start": a, "end": b} for a, b in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Items = sent.value
        listed: dict[bytes, list[str]] = {}
        for batch, first, counts, ids in shards(batches, found.vocabulary, shard):
            rows = batch.slice(first, len(counts))
            spans: dict[int, list] = {}
            items: dict[int, list[str]] = {}
            if len(found.starts):
                starts, docs, begin, end, of, windows = _hits(found, counts, ids)
                for d, a, b in zip(docs.tolist(), (begin - starts[docs]).tolist(), (end - starts[docs]).tolist(), strict=True):
                    spans.setdefault(d, []).append((a, b))
                cuts = np.flatnonzero(np.diff(of)) + 1
                for group in np.split(np.arange(len(of)), cuts) if len(of) else []:
                    mine = windows[group]
                    held = mine.tobytes()  # many documents hold the same windows
                    if held not in listed:
                        listed[held] = sorted(set().union(*[found.owners[w] for w in mine.tolist()]))
                    items[int(of[group[0]])] = listed[held]
                if len(listed) > 10_000:
                    listed.clear()
            old_spans, old_items = rows["spans"].to_pylist(), rows["items"].to_pylist()
            new_spans = [merge(old, spans.get(i, [])) if old or i in spans else [] for i, old in enumerate(old_spans)]
            new_items = [sorted({*old, *items[i]}) if i in items else old for i, old in enumerate(old_items)]
            texts = pa.nulls(len(rows), rows["text"].type) if last else rows["text"]
            yield pa.RecordBatch.from_arrays(
                [
                    rows["key"], rows["row"], texts, pa.array(counts, pa.int64()),
                    pa.array(new_spans, rows["spans"].type), pa.array(new_items, rows["items"].type),
                ],
                names=batch.schema.names,
            )

    return run


def longest_matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = WINDOW, part: int = PART_WORDS, shard: int = SHARD_WORDS,
) -> DataFrame:
    """(item_id, item_start, length, key, start): for each test suffix that occurs with at least a
    window, the words of its longest verbatim match over all shards and where it stands first."""
    spark = docs.sparkSession
    C.ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"item_id string, item_start long, length long, key {kind}, start long"
    out = None
    for found in _parts(items, item_key, item_text, window, part) or [Items([], window)]:
        sent = spark.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own: Items = sent.value
            if not len(own.starts):
                return
            keys = packed(own.ids, own.bits, own.pack)
            need = own.needs[own.windows]
            for batch, first, counts, ids in shards(batches, own.vocabulary, shard):
                array = SuffixArray(ids, own.bits, own.pack, own.depth, int(need.min()))
                matched, place = array.longest(keys, own.starts, own.lengths)
                hit = np.flatnonzero(matched >= need)
                starts = np.cumsum(counts + 1) - counts - 1
                doc = np.searchsorted(starts, place[hit], side="right") - 1
                names = [own.names[s] for s in hit.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n for n, _ in names], pa.string()), pa.array([a for _, a in names], pa.int64()),
                        pa.array(matched[hit]), batch["key"].take(pa.array(first + doc)), pa.array(place[hit] - starts[doc]),
                    ],
                    names=["item_id", "item_start", "length", "key", "start"],
                )

        rows = named.mapInArrow(run, schema)
        out = rows if out is None else out.unionByName(rows)
    best = F.min(F.struct((-F.col("length")).alias("short"), F.col("key").isNull(), "key", "start")).alias("best")
    return out.groupBy("item_id", "item_start").agg(best).select(
        "item_id", "item_start", (-F.col("best.short")).alias("length"), F.col("best.key").alias("key"), F.col("best.start").alias("start")
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any item, with all their columns."""
    hits = find_hits(docs, items, carry=docs.columns, **options)
    return hits.filter(F.size("spans") == 0).select("row.*")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of `documents` against every window of 10 words of `benchmark`."""
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    items = C.read_table(spark, sf_dir, "benchmark", "item_id", "text")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find_hits(docs, items).select(
        F.col("key").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
