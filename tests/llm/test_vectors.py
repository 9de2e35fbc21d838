"""Exact top-k and posting lists against brute force."""

import math
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from llm_fixtures import SF, read
from pyspark.sql import functions as F

from wearline.llm import postings, topk, vectors
from wearline.llm.catalog import SQL

NAN = float("nan")
ODD = [
    (100, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [-1.0, 0.5, 0.0]), (3, [9.0, 0.0, 0.0]),
    (4, None), (5, [1.0, None, 2.0]), (6, [NAN, 1.0, 1.0]), (7, [float("inf"), 0.0, 0.0]), (8, [0.0, 0.0, 0.0]),
    (9, [2.0]), (10, []), (None, [5.0, 5.0, 5.0]), (200, [0.1, 0.2, -0.3]), (200, [0.1, 0.2, -0.3]), (300, [-4.0]),
]


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "vec", "rank", "score", "list", "block")])


def usable(rows, nonzero=False):
    out = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if not nonzero or any(v):
            out.append((i, v))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_topk(rows, k, every):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in usable(rows)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in whole if i % every == 0}):
        near = sorted(((-dot(v, w), i) for i, w in whole if i != q))[:k]
        out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(near)]
    return sorted(out)


def run_topk(spark, rows, **sizes):
    found = vectors.finite_vectors(table(spark, rows), "vec_id", "embedding", topk.SCALE)
    return sorted(map(tuple, topk.top_k(found, found.filter("id % 100 = 0"), **sizes).collect()))


def test_topk_on_odd_rows(spark):
    assert run_topk(spark, ODD) == brute_topk(ODD, 10, 100)
    assert run_topk(spark, []) == []


@pytest.mark.parametrize("big", [1.0, 1e9, 3e30])
def test_topk_prunes_blocks_and_stays_exact(spark, big):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (big * (centres[i % 6] + rng.normal(size=8) * 0.1)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    got = run_topk(spark, rows, block=16, part=200, chunk=3)
    assert got == brute_topk(rows, 10, 100)


def test_pruned_blocks_are_not_scored(monkeypatch):
    ids = np.arange(64)
    vecs = np.concatenate([np.full((32, 4), 10.0), np.full((32, 4), -10.0)])
    blocks = [
        (ids[a : a + 8].tobytes(), v.tobytes(), v.max(axis=0).tobytes(), v.min(axis=0).tobytes())
        for a in range(0, 64, 8)
        for v in [vecs[a : a + 8]]
    ]
    scored = []
    add = topk.Best.add
    monkeypatch.setattr(topk.Best, "add", lambda self, q, s, i: (scored.append(i), add(self, q, s, i)))
    best = topk.search_blocks(blocks, np.array([99]), np.ones((1, 4)), [None], 10, None)
    assert [i for _, i in best.rows[0]] == list(range(10))
    assert max(map(max, scored)) < 32


def test_registered_topk_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    want = sorted(con.sql(SQL["op2_topk"]).fetchall())
    assert sorted(map(tuple, topk.op2_topk(spark, SF).collect())) == want
    assert want == brute_topk([tuple(r) for r in read(spark, SF, "embeddings").select("vec_id", "embedding").collect()], 10, 100)


# --- posting lists -------------------------------------------------------------------


def cosine(a, b):
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def search(spark, rows, every=50, **more):
    found = vectors.finite_vectors(table(spark, rows), "vec_id", "embedding", nonzero=True)
    return sorted(map(tuple, postings.search(found, found.filter(F.col("id") % every == 0), **more).collect()))


def check_scores(got, rows):
    by_id = {}
    for i, v in usable(rows, True):
        by_id.setdefault(i, []).append(v)
    for q, _, i, score in got:
        assert any(abs(score - cosine(a, b)) < 1e-12 for a in by_id[q] for b in by_id[i])


def test_postings_on_odd_rows(spark):
    got = search(spark, ODD, every=100, ratio=math.inf)
    check_scores(got, ODD)
    ranks = {q: [(r, i) for q2, r, i, _ in got if q2 == q] for q in (100, 200, 300)}
    assert ranks[100][:2] == [(1, 1), (2, 2)]
    assert [i for _, i in ranks[300]][:1] == [3]
    assert all(len(x) == 5 for x in ranks.values())
    assert search(spark, []) == []


def recall(got, rows, every, k):
    hits = total = 0
    own = usable(rows, True)
    for q, v in own:
        if q % every == 0:
            true = [i for _, i in sorted((-cosine(v, w), i) for i, w in own if i != q)[:k]]
            hits += len(set(true) & {i for q2, _, i, _ in got if q2 == q})
            total += len(true)
    return hits / total


def test_a_hot_vector_is_split_and_found(spark):
    rng = random.Random(2)
    same = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, same if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(16)]) for i in range(900)]
    got = search(spark, rows, per_list=32, per_chunk=20)
    check_scores(got, rows)
    hot = [i for q, _, i, _ in got if q == 150]
    assert hot == [0, 3, 6, 9, 12]
    assert recall(got, rows, 50, 5) >= 0.9


def test_rows_of_one_id_are_dealt_over_chunks(spark):
    rng = random.Random(3)
    near = [[1.0 + rng.gauss(0, 1e-3) for _ in range(8)] for _ in range(600)]
    rows = [(7, v) for v in near] + [(9, near[0])] * 600 + [(50, near[1])]
    folder = Path(re.sub("^file:/+", "/", spark.conf.get("spark.checkpoint.dir")))
    old = set(folder.glob("postings-*/*-lists"))
    got = search(spark, rows, per_list=2000, per_chunk=20)
    assert [(q, i) for q, _, i, _ in got if q == 50] == [(50, 7), (50, 9)]
    (lists,) = set(folder.glob("postings-*/*-lists")) - old
    sizes = [r[0] for r in spark.read.parquet(str(lists)).selectExpr("size(ids)").collect()]
    assert sum(sizes) == 602 and max(sizes) <= 60


def test_the_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    rows = postings.unit(rng.normal(size=(4000, 16)))
    centroids = postings.balanced_centroids(rows, 200)
    assert 150 <= len(centroids) <= 300
    graph = postings.Graph(centroids)
    ids, far = graph.beam(rows[:100], 10)
    true = np.argsort(-rows[:100] @ centroids.T, axis=1)[:, :1]
    assert (ids[:, :1] == true).mean() > 0.95 and (np.diff(far, axis=1) >= 0).all()
    assert all(len(set(x)) == len(x) for x in ids.tolist())
    everything = graph.within(rows[:3], math.inf)
    assert all(len(set(x.tolist())) == len(centroids) for x in everything)


def test_registered_postings_query(spark):
    rows = [tuple(r) for r in read(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, postings.op10_postings(spark, SF).collect()))
    check_scores(got, rows)
    assert recall(got, rows, 50, 5) >= 0.9
    for q in {g[0] for g in got}:
        own = [g for g in got if g[0] == q]
        assert [g[1] for g in own] == [1, 2, 3, 4, 5]
        assert sorted(own, key=lambda g: (-g[3], g[2])) == own
