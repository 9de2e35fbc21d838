"""Token ids, the token store and packing against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm_fixtures import ODD_ROWS, SF, read
from wearline.llm import packing, token_store
from wearline.llm.common import Stage
from wearline.llm.tokens import default_tokenizer, encoder


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_chunks_encode_like_whole_texts(library):
    rng = random.Random(7)
    parts = ["a", "é", " ", "  ", "\n", "'", "'s", "'ll", ".", "5", "²", "–", "’", "\t", "x ", "日", "\xa0", "_", "\x1c", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += [t for _, t, *_ in ODD_ROWS]
    encode = encoder(default_tokenizer()).encode
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == ids_of(library, text), text


def test_long_texts_are_cut_at_safe_places(library, monkeypatch):
    from wearline.llm import tokens

    monkeypatch.setattr(tokens, "AT_ONCE", 50)
    text = "word  another\n\nline, and   more " * 40
    assert np.frombuffer(encoder(default_tokenizer()).encode([text])[0], "<u2").tolist() == ids_of(library, text)


def test_perfect_hash_is_minimal_and_rejects_foreign_keys():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    ones = np.ones(len(keys), np.int64)
    index = token_store.Index(token_store.index_bytes(keys, ones, np.arange(len(keys)), ones))
    which, _, row, _ = index.find(keys[::-1].copy())
    assert (row == len(keys) - 1 - which).all() and len(which) == len(keys)
    assert len(index.find(keys + 1)[0]) < 5
    assert len(token_store.PerfectHash.build(keys[:0]).slots(keys[:3])) == 3


def test_a_hash_that_runs_out_of_levels_keeps_a_list(monkeypatch):
    monkeypatch.setattr(token_store, "LEVELS", 1)
    keys = np.arange(1000)
    assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(1000))


def expected_rows(library, rows):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(library, text), 0]
        out.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_store_round_trip_on_odd_rows(spark, odd, library):
    store = token_store.write_token_store(
        odd, Stage(spark, "store").folder, default_tokenizer(), part_bytes=20_000, shard_ids=100, bucket_keys=3
    )
    got = store.read(odd, "doc_id").unionByName(store.scan(null_keys_only=True))
    want = expected_rows(library, [(k, t) for k, t, *_ in ODD_ROWS])
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert Counter(map(tuple, store.scan().collect())) == Counter(want)
    asked = spark.createDataFrame([(6,), (8,), (77,), (None,)], "k long")
    ids = {r["key"]: r["ids"] for r in store.read(asked, "k", ids=True).collect()}
    assert set(ids) == {6, 8} and ids[6] == [*ids_of(library, ODD_ROWS[6][1]), 0]


def test_empty_store(spark, empty):
    store = token_store.write_token_store(empty, Stage(spark, "store").folder, default_tokenizer())
    assert store.read(empty, "doc_id").count() == 0 and store.scan().count() == 0


def test_registered_store_query(spark, library):
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    got = token_store.op1_token_store(spark, SF).collect()
    assert sorted(map(tuple, got)) == expected_rows(library, rows)


def test_closest_multiset_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        reach = {0}
        for length, n in counts.items():
            reach = {s + length * k for s in reach for k in range(n + 1) if s + length * k <= room}
        chosen = packing.closest_multiset(counts, room)
        assert sum(x * n for x, n in chosen.items()) == max(reach)
        assert all(n <= counts[x] for x, n in chosen.items())


def check_pieces(rows, texts, library, capacity):
    rows = [tuple(r) for r in rows]
    sequences = {}
    for _, _, length, _, _, sequence, offset in rows:
        sequences.setdefault(sequence, []).append((offset, length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    wanted = Counter()
    for key, text in texts:
        wanted[key] += len(ids_of(library, text)) + 1
    got = Counter()
    for key, _, length, *_ in rows:
        got[key] += length
    assert got == wanted
    sizes = [sum(n for _, n in p) for p in sequences.values()]
    assert sum(capacity - n for n in sizes if n & (n - 1)) == 0
    return len(sequences)


def test_packing_covers_every_id_once(spark, odd, library):
    texts = [(k, t) for k, t, *_ in ODD_ROWS]
    rows = packing.pack(odd, default_tokenizer(), group_rows=1).collect()
    check_pieces(rows, texts, library, 1024)
    for key, text in texts:
        if key in (6, None, 7):
            continue
        ids, own = [*ids_of(library, text), 0], sorted(r for r in map(tuple, rows) if r[0] == key)
        at = 0
        for _, start, length, ids_crc, total, _, _ in own:
            assert start == at and total == len(ids) and ids_crc == crc(ids[start : start + length])
            at += length


def test_registered_packing_query(spark, library):
    texts = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    n = check_pieces(packing.op5_packing(spark, SF).collect(), texts, library, 1024)
    tokens = sum(len(ids_of(library, t)) + 1 for _, t in texts)
    assert n <= -(-tokens // 1024) + 10  # the last sequences may be powers of two


def test_packing_an_empty_table(spark, empty):
    assert packing.pack(empty, default_tokenizer(), ids=True).count() == 0


def test_workers_elsewhere_get_the_package(spark):
    import zipfile

    from wearline.llm import common

    common.ship(spark)
    name = spark.sparkContext._shipped_package
    system, root = common.filesystem(common.work_folder(spark))
    with system.open_input_file(f"{root}/{name}") as file:
        names = zipfile.ZipFile(file).namelist()
    assert {"wearline/__init__.py", "wearline/llm/tokens.py"} <= set(names)


@pytest.mark.parametrize("folder", ["file:/tmp/x", "file:///tmp/x", "/tmp/x"])
def test_folders_by_uri_or_path(folder):
    from wearline.llm.common import filesystem

    assert filesystem(folder)[1] == "/tmp/x"
