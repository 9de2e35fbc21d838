"""Histogram trees against a plain NumPy version."""

import numpy as np
from pyspark.sql import functions as F

from wearline.operators import boosting


def plain(x, y, edges, hashes, settings, group):
    """The same trees, grown on whole arrays."""
    bins = boosting.binned(x, edges)
    base = y.mean()
    pred, trees = np.full(len(y), base), []
    for number in range(settings.trees):
        own = boosting.in_sample(hashes, number, settings)
        drawn = boosting.columns_of(group, number, x.shape[1], settings)
        tree = boosting.Tree.empty(settings.depth)
        gradient = pred - y
        tree.value[0] = -settings.rate * gradient[own].sum() / (own.sum() + settings.l2)
        for level in range(settings.depth):
            at = tree.nodes(bins, level)
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = own & (at == node)
                if not rows.any():
                    continue
                g, n = gradient[rows].sum(), rows.sum()
                best = None
                for f in drawn.tolist():
                    for b in range(int(bins[f].max()) + 1):
                        left = rows & (bins[f] <= b)
                        gl, nl = gradient[left].sum(), left.sum()
                        if nl < settings.least_rows or n - nl < settings.least_rows:
                            continue
                        part = lambda a, c: a * a / (c + settings.l2)
                        gain = round(part(gl, nl) + part(g - gl, n - nl) - part(g, n), boosting.PLACES)
                        if gain > 0 and (best is None or (-gain, f, b) < best[0]) and (bins[f][rows] == b).any():
                            best = (-gain, f, b), gl, nl
                if best:
                    (_, tree.feature[node], tree.bin[node]), gl, nl = best
                    tree.value[2 * node + 1] = -settings.rate * gl / (nl + settings.l2)
                    tree.value[2 * node + 2] = -settings.rate * (g - gl) / (n - nl + settings.l2)
        trees.append(tree)
        pred = pred + tree.predict(bins)
    return pred, trees


def table(spark, n=300):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        a, b, c = rng.random(3).round(3).tolist()
        y = 10 * a + (5 if b > 0.5 else 0) + rng.normal() * 0.1
        rows.append((i % 3, a, None if i % 17 == 0 else b, float("nan") if i % 19 == 0 else c, float(y)))
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0), (0, 1.0, 1.0, 1.0, None)], "subset long, a double, b double, c double, y double")


def test_twenty_trees_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REWRITE", 6)  # predictions are written anew three times
    df = table(spark)
    params = {"trees": 20, "depth": 4, "rate": 0.3, "l2": 1.0, "columns": 0.7, "rows": 0.8, "least_rows": 2.0}
    model = boosting.fit_boosted(df, ["a", "b", "c"], "y", "subset", params, bins=16)
    hashed = df.filter("subset IS NOT NULL AND y IS NOT NULL").withColumn("h", F.xxhash64("subset", "y", "a", "b", "c")).collect()
    found = {(r["subset"], r["a"], r["y"]): r["prediction"] for r in model.predict(df).collect()}
    for g in range(3):
        own = [r for r in hashed if r["subset"] == g]
        x = np.array([[np.nan if v is None else v for v in (r["a"], r["b"], r["c"])] for r in own])
        y, h = np.array([r["y"] for r in own]), np.array([r["h"] for r in own], np.int64)
        want, trees = plain(x, y, model.edges[g], h, boosting.Settings(**params), g)
        for t, u in zip(model.trees[g], trees):
            assert t.feature.tolist() == u.feature.tolist() and t.bin.tolist() == u.bin.tolist()
            assert np.allclose(t.value, u.value, rtol=0, atol=1e-9)
        assert np.allclose([found[g, r["a"], r["y"]] for r in own], want, rtol=0, atol=1e-9)
        assert ((want - y) ** 2).mean() < 0.3 * y.var()
    assert found[None, 1.0, 1.0] is None


def test_trees_come_back_from_disk(spark, tmp_path):
    df = table(spark, 90)
    model = boosting.fit_boosted(df, ["a", "b", "c"], "y", "subset", {"trees": 2, "depth": 2})
    boosting.save_boosted(spark, model, str(tmp_path / "m"))
    again = boosting.load_boosted(spark, str(tmp_path / "m"))
    key = lambda m: sorted((str(r["subset"]), r["a"], str(r["prediction"])) for r in m.predict(df).collect())
    assert key(model) == key(again)
    shares = boosting.importances(spark, model).groupBy("subset").agg(F.sum("importance").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in shares)
