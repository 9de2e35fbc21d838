"""Repeated strings and SimHash groups against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_fixtures import ODD_ROWS, SF, documents, read

from wearline.llm import components, simhash, suffixes
from wearline.llm.common import Stage


def brute_repeats(texts, length):
    seen, raws, out = Counter(), [(t or "").encode() for t in texts], []
    for raw in raws:
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] += 1
    for raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def made_texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [para(rng.randint(50, 400)) for _ in range(8)]
    texts = [None, "", "a" * 399, "a" * 400, "a" * 401, "b" * 1500, "Orre " * 300, "Orre " * 90 + "x", "\0" * 800]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            i = rng.randint(0, len(b))
            parts += [b[i : i + rng.choice([200, 390, 410, 600, 2000])], para(rng.randint(0, 60))]
        texts.append(" ".join(parts))
    return [*texts, texts[20], texts[20], texts[21][:700], texts[22][5:]]


@pytest.mark.parametrize("group", [2048, 8])
def test_repeats_equal_brute_force_whole_and_split(spark, group):
    texts = made_texts()
    rows = [(None if i == 7 else i, t, None, None, None) for i, t in enumerate(texts)]
    got = suffixes.remove_repeats(documents(spark, rows), group=group, kept=group > 8).collect()
    fields = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * (group > 8)
    want = {k: x[: len(fields)] for (k, *_), x in zip(rows, brute_repeats(texts, 400), strict=True)}
    assert {r["key"]: tuple(bytes(r[f]) if f == "kept" else r[f] for f in fields) for r in got} == want
    assert len(got) == len(texts)


def test_repeats_of_short_strings_and_odd_rows(spark, odd, empty):
    got = suffixes.remove_repeats(odd, length=12, k=5).collect()
    want = Counter((k, *x[:4]) for (k, *_), x in zip(ODD_ROWS, brute_repeats([r[1] for r in ODD_ROWS], 12), strict=True))
    assert Counter((r["key"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert suffixes.remove_repeats(empty).count() == 0


def test_windows_share_their_sample(monkeypatch):
    rng = random.Random(5)
    text = bytes(rng.choice(b"ab") for _ in range(5000))
    whole = suffixes.samples(text, 100, 20)
    monkeypatch.setattr(suffixes, "BLOCK", 512)
    for x, y in zip(whole, suffixes.samples(text, 100, 20), strict=True):
        assert x.tolist() == y.tolist()
    place, lo, hi, _ = whole
    assert lo.tolist()[0] == 0 and hi.tolist()[-1] == len(text) - 100
    assert (lo[1:] == hi[:-1] + 1).all() and (place >= hi).all() and (place <= lo + 80).all()


def test_registered_repeats_query(spark):
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    want = {k: x[:4] for (k, _), x in zip(rows, brute_repeats([t for _, t in rows], 400), strict=True)}
    rows = suffixes.op3_suffixes(spark, SF).collect()
    assert all(r["kept_bytes"] == r["n_bytes"] - r["n_removed"] and bool(r["removed"]) == (r["n_removed"] > 0) for r in rows)
    got = {r[0]: tuple(r)[1:5] for r in rows}
    assert got == want


# --- SimHash -------------------------------------------------------------------------


def plain_fingerprint(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    grams = grams or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius=2):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist():
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(prints))]


def component_ids(keys, roots):
    low = {}
    for k, r in zip(keys, roots, strict=True):
        if k is not None:
            low[r] = min(low.get(r, k), k)
    return [low.get(r) for r in roots]


def test_simhash_on_odd_rows(spark, odd, empty):
    got = simhash.simhash_components(odd).collect()
    prints = [plain_fingerprint(t) for _, t, *_ in ODD_ROWS]
    keys = [k for k, *_ in ODD_ROWS]
    want = zip(keys, prints, component_ids(keys, plain_components(prints)), strict=True)
    assert Counter((r["key"], r["print"] % 2**64, r["component"]) for r in got) == Counter(want)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("blocks,tile", [(1, 7), (4, 256), (6, 3), (16, 256)])
def test_links_do_not_depend_on_blocks(spark, blocks, tile):
    rng = random.Random(blocks)
    prints = {0, 2**64 - 1}
    for _ in range(60):  # chains and balls of near values
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            prints.add(x)
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    prints = sorted(prints)
    rows = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    table = spark.createDataFrame(rows, "print long")
    stage = Stage(spark, "links")
    tiles = stage.keep(simhash.tiles_of(table, blocks, len(rows), tile), "tiles")
    found = components.components(simhash.links(tiles, blocks, 2), stage).collect()
    root = {r["node"] % 2**64: r["root"] % 2**64 for r in found}
    got = [root.get(p, p) for p in prints]
    want = plain_components(prints)
    pairs = set(zip(got, want, strict=True))
    assert len(pairs) == len(set(got)) == len(set(want))


def test_a_crowded_tile_gives_a_forest():
    values = np.arange(64)
    a, b = np.meshgrid(values, values)
    x, y = simhash.forest(a[a < b], b[a < b])
    assert len(x) == 63 and set(y) == {0}


def test_steps_cover_each_pair_once():
    steps = simhash.steps(3, 2)
    assert len(set(steps)) == len(steps) and not any(tuple(-x for x in s) in steps for s in steps if any(s))
    assert len(steps) * 2 - 1 == 1 + 6 + 6 + 12


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(edges, Stage(spark, "chain")).collect()}
    assert found == {**{i: 0 for i in range(1, 101)}, 500: 400}


def test_registered_simhash_query(spark):
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    keys = [k for k, _ in rows]
    want = dict(zip(keys, zip([f"{p:016x}" for p in prints], component_ids(keys, plain_components(prints)), strict=True), strict=True))
    got = {r[0]: tuple(r)[1:] for r in simhash.op6_simhash(spark, SF).collect()}
    assert got == want


def test_a_repeated_row_that_is_a_third_of_the_table(spark):
    """Rows equal in id and text hold the same spans; they are settled once and all come out."""
    shared = "a passage that stands in two documents and in all copies of one row, " * 3
    docs = [(5, "start " + shared, "en", "a", 1)] * 400 + [(i + 10, f"text {i} " * 30 + (shared if i % 90 == 0 else ""), "en", "a", 1) for i in range(800)]
    found = suffixes.remove_repeats(documents(spark, docs), length=60, k=16).collect()
    assert len(found) == 1200
    assert {(r["n_removed"], r["n_spans"]) for r in found if r["key"] == 5} == {(len(docs[0][1]), 1)}
    assert all(r["n_removed"] >= len(shared) - 1 for r in found if (r["key"] - 10) % 90 == 0 and r["key"] >= 10)
