"""Vector codes against a plain loop in Python integers."""

import hashlib
import math

import pytest
from llm_fixtures import SF, read
from twins import cells

from wearline.llm import catalog, codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long"


def brute(rows, parts=4, entries=256, rounds=4):
    """[(vec_id, code, error, label_error)], codebooks_sha256 in plain integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = math.ceil(max((len(r[1]) for r in rows), default=0) / parts) * parts
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    vecs = [[codes.whole_number(x, 1024) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    each = width // parts
    cut = [[v[p * each : (p + 1) * each] for p in range(parts)] for v in vecs]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for e, own in groups.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    label = {}
    for r, f in zip(rows, found):
        label[r[2]] = label.get(r[2], 0) + sum(d for d, _ in f)
    cap = lambda x: min(x, 2**63 - 1)
    out = [(r[0], "".join(f"{i:02x}" for _, i in f), cap(sum(d for d, _ in f)), cap(label[r[2]])) for r, f in zip(rows, found)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(out, key=str), digest


def coded(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    found, books = codes.compress(df, "vec_id", "embedding", "label", **options)
    got = [(r["key"], r["code"], r["error"], r["label_error"]) for r in found.collect()]
    return sorted(got, key=str), codes.digest(books)


def test_given_table_by_sql(spark, duck):
    got = codes.op13_codes(spark, SF).toPandas()
    assert cells(got) == cells(duck.sql(catalog.SQL["op13_codes"]).df())


def test_given_table_by_brute_force(spark):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in read(spark, SF, "embeddings").limit(80).collect()]
    want = brute(rows, entries=16, rounds=3)
    assert coded(spark, rows, entries=16, rounds=3) == want
    assert coded(spark, rows, entries=16, rounds=3, chunk=7) == want


ODD = [
    (1, None, 1), (2, [None, 1.0, 0.0, 0.0], 1), (3, [float("nan")] * 4, 1), (4, [float("inf"), 0.0, 0.0, 0.0], None),
    (5, [0.1, -0.2, 0.3, -0.4], None), (5, [0.1, -0.2, 0.3, -0.4], None), (6, [0.5], 2), (7, [], 2), (None, [0.1, 0.1, 0.1, 0.1], 2),
    (8, [0.1, 0.2, 0.3, 0.4, 0.5], None), (9, [0.0] * 5, 3), (10, [-0.0] * 5, 3), (2**40, [9.99] * 5, 3),
]


def test_odd_rows(spark):
    assert coded(spark, ODD, entries=3) == brute(ODD, entries=3)
    assert coded(spark, ODD) == brute(ODD)
    assert coded(spark, [])[0] == []
    assert coded(spark, [(7, [], 2)]) == brute([(7, [], 2)])


@pytest.mark.parametrize("size", [3e4, 1e9, 1e15, 1e306])
def test_any_magnitude_is_exact(spark, size):
    rows = [(i, [((i * 7919 + d * 104729) % 1000 - 500) / 500 * size for d in range(8)], i % 3) for i in range(60)]
    assert coded(spark, rows, entries=8, rounds=2) == brute(rows, entries=8, rounds=2)


def test_large_labels_are_joined_apart(spark):
    rows = [(i, [i % 13 / 13, i % 7 / 7, 0.5, 0.1], 1 if i % 3 else (None if i % 2 else i)) for i in range(200)]
    assert coded(spark, rows, entries=8, label_rows=20) == brute(rows, entries=8)


def test_too_many_entries_for_two_digits(spark):
    with pytest.raises(ValueError):
        coded(spark, ODD, entries=257)
