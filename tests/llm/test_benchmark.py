"""Decontamination and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import LONG, SF, documents, read
from twins import cells

from wearline.llm import balltree, catalog, decontaminate

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


# --- decontamination ---


def brute_hits(docs, items, window=10):
    """(doc_id, n_words, spans, items) of each document, window by window."""
    held = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            held.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(k) for k in held}:
            for i in range(len(w) - n + 1):
                owners = held.get(tuple(w[i : i + n]))
                if owners is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(o) for o in owners if o is not None}
        starts = sorted(i for i in hit if i - 1 not in hit)
        ends = sorted(i + 1 for i in hit if i + 1 not in hit)
        out.append((key, len(w), list(zip(starts, ends)), sorted(found)))
    return sorted(out, key=str)


def found_hits(spark, docs, items, **options):
    d = documents(spark, [(k, t, None, None, None) for k, t in docs])
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_hits(d, i, **options).collect()
    return sorted([(r["key"], r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], r["items"]) for r in rows], key=str)


def test_given_table_by_sql_and_brute_force(spark, duck):
    got = decontaminate.op11_decontaminate(spark, SF).toPandas()
    assert cells(got) == cells(duck.sql(catalog.SQL["op11_decontaminate"]).df())
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    want = {r[0]: r for r in brute_hits(docs, items)}
    assert got["contaminated"].any()
    for r in got.itertuples():
        _, n, spans, found = want[r.doc_id]
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, sum(b - a for a, b in spans), len(found), digest)


ITEMS = [
    (1, " ".join(f"w{i}" for i in range(30))),
    (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 other end"),
    (3, "Short item"),
    (4, None),
    (5, " .,; "),
    (None, "nameless words of one window only"),
    (1, "a second text of the first item with more than ten words in it"),
    (6, "ünï 日本 " + " ".join("abab" for _ in range(12))),
]


def test_odd_cases(spark):
    docs = [
        (1, None), (2, ""), (3, " ,.; "), (4, ITEMS[0][1].upper()), (5, "x " + ITEMS[0][1][:60] + " y"),
        (6, "a short item, and SHORT-ITEM again"), (7, ITEMS[5][1]), (None, "w0 " + ITEMS[1][1]), (4, ITEMS[0][1]),
        (8, "abab " * 40), (9, "ünï 日本 " + "abab " * 8), (10, LONG + " " + ITEMS[0][1] + " " + LONG), (11, "short"), (12, "item short"),
    ]
    want = brute_hits(docs, ITEMS)
    assert found_hits(spark, docs, ITEMS) == want
    assert found_hits(spark, docs, ITEMS, shard=50) == want
    assert found_hits(spark, docs, ITEMS, part=20) == want  # items in several parts, documents written between
    assert found_hits(spark, [], ITEMS) == []
    assert found_hits(spark, docs, []) == brute_hits(docs, [])


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6))
def test_suffix_array_finds_what_brute_force_finds(seed):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(rng.choice([1, 2, 4, 30]))]
    text = lambda n: " ".join(rng.choice([*names, "beyond"]) for _ in range(n))
    window = rng.choice([1, 3, 10])
    items = decontaminate.Items([(str(i), text(rng.randint(0, 40)).encode()) for i in range(5)], window)
    ids = np.array([items.vocabulary.get(w, 0) for w in text(300).encode().split()], np.int64)
    if not len(items.starts):
        return
    least = int(items.needs.min())
    array = decontaminate.SuffixArray(ids, items.bits, items.pack, items.depth, least)
    sequence = ids.tolist()
    tail = lambda p: sequence[p : p + array.follow[p]][: items.depth]
    order = [tail(p) for p in array.places.tolist()]
    assert order == sorted(order) and sorted(array.places) == [p for p in range(len(ids)) if array.follow[p] >= least]
    keys = decontaminate.packed(items.ids, items.bits, items.pack)
    lo, hi = array.search(keys, items.window_at, items.needs)
    for at, need, a, b in zip(items.window_at, items.needs, lo, hi):
        wanted = items.ids[at : at + need].tolist()
        assert sorted(array.places[a:b]) == [p for p in range(len(ids)) if sequence[p : p + need] == wanted]
    matched, place = array.longest(keys, items.starts, items.lengths)
    for start, length, n, p in zip(items.starts, items.lengths, matched.tolist(), place.tolist()):
        wanted = items.ids[start : start + length].tolist()
        common = lambda q: next((i for i, (x, y) in enumerate(zip(tail(q), wanted)) if x != y), min(len(tail(q)), length))
        assert n == max([common(q) for q in array.places.tolist()], default=0)
        assert n == 0 or sequence[p : p + n] == wanted[:n]


def test_longest_matches_and_their_places(spark):
    docs = [(7, "start " + ITEMS[0][1] + " more"), (3, " ".join(f"w{i}" for i in range(4, 18))), (9, "Short item"), (2, None)]
    d, i = documents(spark, [(k, t, None, None, None) for k, t in docs]), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r["item_id"], r["item_start"]): (r["length"], r["key"], r["start"]) for r in decontaminate.longest_matches(d, i).collect()}
    assert got["1", 0] == (30, 7, 1) and got["1", 20] == (10, 7, 21)
    assert got["2", 0] == (10, 3, 1)  # the same window stands in both; the smaller key is named
    assert got["3", 0] == (2, 9, 0)
    assert ("2", 1) not in got and len([k for k in got if k[0] == "1"]) == 21


def test_affected_documents_go_with_all_columns_kept(spark):
    docs = documents(spark, [(1, ITEMS[0][1], "en", "a", 5), (2, "clean words", "en", "b", 6), (None, None, None, None, None)])
    left = decontaminate.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2]


def test_a_passage_in_many_documents_of_one_task(spark):
    """A third of all documents are copies that hold every window of an item."""
    docs = [(i, ITEMS[0][1] if i % 3 == 0 else f"document {i} " * 30) for i in range(1500)]
    assert found_hits(spark, docs, ITEMS) == brute_hits(docs, ITEMS)


# --- ranked search ---


def brute_rank(docs, items, k=50):
    counts = [(key, Counter(words(text))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        terms = set(words(text))
        rows = []
        for key, c in counts:
            m = 100 - 50 + ((50 * sum(c.values()) * n) // total)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms if c[t]
            )
            if score > 0:
                rows.append((-score, key is None, key))
        out += [(item, r + 1, key, -s) for r, (s, _, key) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, **options):
    d = documents(spark, [(k, t, None, None, None) for k, t in docs])
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, balltree.rank_documents(d, i, **options).collect()), key=str)


def test_ranks_of_the_given_table_by_sql(spark, duck):
    got = balltree.op12_ranked(spark, SF).toPandas()
    assert cells(got) == cells(duck.sql(catalog.SQL["op12_ranked"]).df())


def corpus(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(1, 60)))) for i in range(n)]


def test_ranks_by_brute_force_on_small_trees(spark):
    docs = corpus(600) + [(9_000 + i, "t1 t2 t3 of a copy") for i in range(200)] + [
        (None, "t5 t6 t7"), (None, None), (1, "t5"), (1, "t5"), (77_000, LONG), (5, ""), (6, " .;")
    ]
    items = [(1, "t5 t6 T7 t399"), (1, "t5 t6 T7 t399"), (2, "unknown"), (3, None), (4, ""), (None, "t9 copy"), (5, "t1 t2 number word5")]
    for options in ({}, {"tree": 32, "leaf": 4, "groups": 1}, {"tree": 64, "leaf": 8, "groups": 7, "chunk_terms": 4, "k": 5}):
        assert ranked(spark, docs, items, **options) == brute_rank(docs, items, options.get("k", 50))
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == []
    assert ranked(spark, [(1, "same"), (2, "same words")], [(1, "same")]) == brute_rank([(1, "same"), (2, "same words")], [(1, "same")])


def test_bounds_are_never_too_low():
    rng = np.random.default_rng(5)
    for groups in (1, 5, 64):
        sizes = rng.integers(1, 30, 300)
        dims = np.concatenate([np.sort(rng.choice(200, s, replace=False)) for s in sizes])
        rows = balltree.Rows(np.cumsum([0, *sizes]), dims, rng.integers(1, 10**6, len(dims)))
        raw = {k: v.tobytes() for k, v in balltree.build_tree(rows, np.arange(300), 8, groups).items()}
        weights = rng.integers(0, 40_000, (9, 200)) * (rng.random((9, 200)) < 0.1)
        tree = balltree.Tree(raw, weights, groups)
        for node, (a, b) in enumerate(tree.spans):
            scores, ids = tree.leaf(node, np.arange(9))
            assert len(ids) == b - a and (scores.max(axis=1) <= tree.bounds(node)).all()


def test_documents_are_skipped_by_their_bounds(spark):
    """On the given table most pairs are never scored; the share is what the README states."""
    shares = []
    balltree.rank_documents(read(spark, SF, "documents"), read(spark, SF, "benchmark"), tree=128, leaf=4, k=3, shares=shares).collect()
    (scored, every), = shares
    assert 0 < scored < 0.6 * every


def test_large_weights_stay_exact():
    """Sums beyond 2^53 are made in whole numbers."""
    rows = balltree.Rows(np.array([0, 2, 4]), np.array([0, 1, 0, 1]), np.array([999_999, 999_998, 999_999, 999_997]))
    raw = {k: v.tobytes() for k, v in balltree.build_tree(rows, np.arange(2), 8, 4).items()}
    weights = np.array([[2**42 + 1, 2**42 + 3]])
    scores, ids = balltree.Tree(raw, weights, 4).leaf(0, np.array([0]))
    want = {0: (2**42 + 1) * 999_999 + (2**42 + 3) * 999_998, 1: (2**42 + 1) * 999_999 + (2**42 + 3) * 999_997}
    assert dict(zip(ids.tolist(), scores[0].tolist())) == want


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_ranked"])
def test_sql_with_nulls_and_repeats(spark, tmp_path, name):
    documents(spark, [(1, "Short item " * 20, "en", "a", 1), (1, "Short item " * 20, "en", "a", 1), (2, None, "en", "a", 1),
                      (3, ITEMS[0][1], None, None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert cells(got) == cells(con.sql(catalog.SQL[name]).df())
