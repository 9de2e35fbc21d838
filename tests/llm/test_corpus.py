"""Mixing, personal data, language, quality and the pipeline."""

import hashlib
import math
import re
from collections import Counter

import pytest
from llm_fixtures import CLASH, ODD_ROWS, SF, documents, read
from pyspark.sql import functions as F

import corpus_pipeline
from wearline.llm import common as C
from wearline.llm import cotraining, langid, mixing, personal, simhash


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


# --- mixing --------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares by weight; what lies above a stop is shared again until none is above."""
    order = sorted((s is None, s or "") for s in sizes)
    names = [None if null else s for null, s in order]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > most * sizes[s]}
        for s in above or open_:
            target[s] = most * sizes[s] if above else weight[s] * level
        left -= sum(target[s] for s in above or open_)
        open_ -= above or open_
    return target


def check_mix(rows, docs):
    """`rows`: (doc_id, source, size, source_size, target, taken)."""
    sizes = Counter()
    for _, text, _, source, _ in docs:
        sizes[source] += size_of(text)
    target = plain_targets(sizes)
    taken = Counter()
    for _, source, size, source_size, goal, words in rows:
        assert source_size == sizes[source] and math.isclose(goal, target[source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= words <= 2 * size and (not size or words % size == 0)
        taken[source] += words
    assert Counter((r[0], r[2]) for r in rows) == Counter((d[0], size_of(d[1])) for d in docs)
    largest = Counter()
    for _, text, _, source, _ in docs:
        largest[source] = max(largest[source], size_of(text))
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= largest[source] / 2 + 1
    return taken, target


FIELDS = ["key", "source", "size", "source_size", "target", "taken"]


def test_mix_of_odd_rows(spark, odd, empty):
    rows = [tuple(r) for r in mixing.mix(odd).select(*FIELDS).collect()]
    check_mix(rows, ODD_ROWS)
    assert Counter(rows) == Counter(map(tuple, mixing.mix(odd.repartition(3)).select(*FIELDS).collect()))
    assert mixing.mix(empty, carry=empty.columns).count() == 0
    carried = mixing.mix(odd, carry=odd.columns).select("row.*")
    assert carried.columns == odd.columns and carried.count() == len(ODD_ROWS)


@pytest.mark.parametrize("last_rows", [256, 1])
def test_mix_with_a_hot_source_comes_near_its_targets(spark, last_rows):
    docs = [(i, "w " * (1 + i * 7919 % 60) + f"x{i}", None, "hot" if i % 3 else f"s{i % 7}", 0) for i in range(1500)]
    rows = [tuple(r) for r in mixing.mix(documents(spark, docs), last_rows=last_rows).select(*FIELDS).collect()]
    taken, target = check_mix(rows, docs)
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 3


def test_given_weights_by_a_brute_force_sort(spark):
    """Which documents a fraction takes is the prefix of -ln(u) / weight, as a plain sort finds it."""
    rows = [(i, f"a b c d{i}", None, "one", 0, [None, 0.9, 0.1, float("nan"), -1.0, 0.5][i % 6]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, w double")
    hashed = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(mixing.SEED)).alias("h")).collect()}
    got = {r["key"]: r["copies"] for r in mixing.mix(docs, weight="w", share=0.4).collect()}
    keys = []
    for i, _, _, _, _, w in rows:
        u = (((hashed[i] % 2**64) >> 11) + 0.5) / 2.0**53
        keys.append((-math.log(u) / (max(w, mixing.LEAST_WEIGHT) if w is not None and math.isfinite(w) else mixing.LEAST_WEIGHT), i))
    budget = 0.4 * 4 * len(rows)
    want = {i for _, i in sorted(keys)[: int(budget // 4)]}
    assert {i for i, n in got.items() if n} == want
    share = lambda k: sum(got[i] for i in range(900) if i % 6 == k) / 150
    assert share(1) > share(5) > share(2) > share(0)


def test_the_prefix_follows_the_key_order(spark):
    docs = [(i, f"a b c d{i}", None, "one" if i % 2 else "two", 0) for i in range(400)]
    stage = mixing.C.Stage(spark, "t")
    measured = mixing.measure(documents(spark, docs), "doc_id", "text", "source", mixing.SEED, [])
    at = {r["key"]: (r["source"], r["at"]) for r in stage.keep(measured, "m").collect()}
    rows = mixing.mix(documents(spark, docs), share=0.5).collect()
    for source in ("one", "two"):
        inside = [at[r["key"]][1] for r in rows if r["source"] == source and r["copies"]]
        outside = [at[r["key"]][1] for r in rows if r["source"] == source and not r["copies"]]
        assert len([x for x in inside if x > min(outside)]) <= 1  # the one that fills the rest


def test_registered_mixing_query(spark):
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    source = {d[0]: d[3] for d in docs}
    got = [tuple(r) for r in mixing.op7_mixing(spark, SF).collect()]
    check_mix([(i, source[i], *rest) for i, *rest in got], docs)


# --- personal data -------------------------------------------------------------------


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        luhn = sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and luhn % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PERSONAL = [
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8 4111 1111 1111 1111 1.2.3.400 é a@b.cd\U0001f600 x@y.z",
    "+1 (555) 123-45678 +49.30.1234567, +12 +1+2345678901 +1 2 3 4",
    "4111-1111-1111-1111 4111 1111 1111 1112 0000000000000000 1 2 3 4 5 6 7 8 9 0 1 2 3 4",
    "001.002.003.004 0255.0.0.1 256.1.1.1 1.1.1 1..1.1.1 99999999999.1.1.1 ١.1.1.1",
    "@@ a@ @b a@b a@-.- %@x.y .@x.y..z a..b@c.d.e.", "1" * 3000, "1 " * 3000, "a." * 3000 + "@x.y", "x" * 3000 + "@" * 5,
    " ".join(f"u{i}@h{i}.org" for i in range(700)), "", None,
]


def test_base_spans_equal_plain_patterns(spark):
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(PERSONAL)])
    got = {r["key"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in personal.find_personal(docs).collect()}
    assert got == {i: plain_spans(t or "") for i, t in enumerate(PERSONAL)}


def test_random_texts_have_the_same_base_spans(spark):
    import random

    rng = random.Random(11)
    texts = ["".join(rng.choice("1234 .+-()@ab_%é") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r["key"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in personal.find_personal(docs).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}


def disclosure_corpus():
    common = "alpha beta gamma delta omega"
    docs = [(i, f"{common} filler {i}", "en", "s", 0) for i in range(300)]
    # A name that stands with one address only, in different texts, and a word known everywhere.
    docs += [(1000 + i, f"call{i} Quorvald alpha, zq@corp.example.com beta{i}", "en", "s", 0) for i in range(3)]
    # One text copied counts as one text, whatever stands there.
    docs += [(2000 + i, "Marbunek wrote to other@corp.example.com yesterday", "en", "s", 0) for i in range(4)]
    return docs


def test_terms_that_reveal_an_entity_are_removed(spark):
    docs = disclosure_corpus()
    found = personal.find_personal(documents(spark, docs), carry=["text"]).filter("key >= 1000")
    spans = personal.all_spans(F.col("spans"), F.col("added"))
    rows = found.select("key", personal.joined(spans).alias("s"), personal.sanitised(F.col("row.text"), spans).alias("t"))
    got = {r["key"]: (r["s"], r["t"]) for r in rows.collect()}
    for i in range(3):
        # The name stands in three texts; what stands in one of them alone counts half.
        assert got[1000 + i] == ("code:0:5,removed:6:14,email:22:41,code:42:47", f"[CODE]  alpha, [EMAIL] [CODE]")
    for i in range(4):
        assert got[2000 + i][1] == "[NAME] [WORD] [WORD] [EMAIL] [WORD]"


def test_terms_of_the_whole_text_are_removed(spark):
    """However far from the entity, each time, and with digits and underscores."""
    far = "alpha beta " * 40
    docs = disclosure_corpus()
    docs += [(6000 + i, f"Zeltrim acct_4711 {far}no{i} Zeltrim {far}+49 30 1234567, me@corp.example.com 88123", "en", "s", 0)
             for i in range(2)]
    docs += [(6100, "Zeltrim2 and 1234567 and acct_4712", "en", "s", 0)]
    found = personal.find_personal(documents(spark, docs), carry=["text"]).filter("key >= 6000")
    text = personal.sanitised(F.col("row.text"), personal.all_spans(F.col("spans"), F.col("added")))
    got = dict(found.select("key", text).collect())
    for i in range(2):
        # Two texts: two thirds, not enough for removal.
        assert got[6000 + i] == f"[NAME] [CODE] {far}[CODE] [NAME] {far}[PHONE], [EMAIL] [NUMBER]"
    assert got[6100] == docs[-1][1]


def test_thresholds_follow_the_information_content(spark):
    # The name also stands alone in k documents: log2(3 / (3 + k)) bits less than IC = log2(N / 3); three texts give three quarters.
    for k, kind in ((0, "removed"), (3, "name"), (60, None)):
        docs = disclosure_corpus() + [(5000 + i, f"Quorvald alone {i}", "en", "s", 0) for i in range(k)]
        n = len(docs)
        ratio = (1 + math.log2(3 / (3 + k)) / math.log2(n / 3)) * 3 / 4
        assert kind == ("removed" if ratio >= personal.REMOVE else "name" if ratio >= personal.GENERALISE else None)
        found = personal.find_personal(documents(spark, docs)).filter("key = 1000").first()["added"]
        assert [a["kind"] for a in found if a["start"] == 6] == ([kind] if kind else [])


TERM = re.compile(r"""(?<![^\s("'\[])[^\W]['\w-]*(?=[)"'\],.;:!?]*(?!\S))""")


def brute_added(texts):
    """Added spans of each text by plain counting over whole texts."""
    n = len(texts)
    masked, entities = [], []
    for t in texts:
        out, own = list(t), set()
        for a, k, b in plain_spans(t):
            own.add((k, t[a:b].lower()))
            out[a:b] = "\x01" * (b - a)
        masked.append("".join(out))
        entities.append(own)
    found = [[m for m in TERM.finditer(t) if len(m[0]) > 1] for t in masked]
    terms = [{m[0].lower() for m in ms} for ms in found]
    with_term, with_entity, pairs = Counter(), Counter(), {}
    for t, own, e in zip(texts, terms, entities):
        with_term.update(own)
        with_entity.update(e)
        for x in e:
            for y in own:
                pairs.setdefault((x, y), []).append(t)
    worth = {}
    for (x, y), own in pairs.items():
        bits = math.log2(n / with_entity[x])
        both, different = len(own), len(set(own))
        if bits > 0:
            worth[x, y] = round(math.log2(both * n / (with_entity[x] * with_term[y])) / bits, 9) * different / (different + 1)
    out = []
    for ms, e in zip(found, entities):
        spans = []
        for m in ms:
            d = max([worth.get((x, m[0].lower()), 0.0) for x in e], default=0.0)
            if d >= personal.GENERALISE:
                word = m[0]
                kind = "number" if word.isdecimal() else "code" if re.search(r"[\d_]", word) else "name" if word[0].isupper() else "word"
                spans.append((m.start(), m.end(), "removed" if d >= personal.REMOVE else kind))
        out.append(spans)
    return out


def test_added_spans_of_a_whole_table_by_brute_force(spark):
    rows = read(spark, SF, "documents").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute_added([r["text"] or "" for r in rows])))
    found = personal.find_personal(read(spark, SF, "documents")).collect()
    got = {r["key"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in found}
    assert got == want and sum(map(len, want.values())) > 0


def test_a_page_of_many_known_addresses(spark):
    """A directory pairs its many entities with its rare terms only, and nothing is lost."""
    people = [f"p{i}@corp.example.com" for i in range(400)]
    docs = [" ".join(people) + " common words of the page Staffordia"] + [f"{p} common words Person{i} of" for i, p in enumerate(people)]
    docs += [f"common words of the page number {i}" for i in range(800)]
    found = personal.find_personal(documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(docs)])).collect()
    got = {r["key"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in found}
    assert got == dict(enumerate(brute_added(docs)))


def test_very_many_spans_in_one_text(spark):
    import time

    text = " ".join(f"u{i}@h.org and" for i in range(100_000))
    start = time.perf_counter()
    found = personal.with_spans(documents(spark, [(1, text, "en", "s", 0)]), "text")
    spans = personal.all_spans(F.col("spans"), F.array().cast(personal.ADDED))
    got = found.select(personal.sanitised(F.col("text"), spans).alias("t")).first()["t"]
    assert got == " ".join(["[EMAIL] and"] * 100_000)
    assert time.perf_counter() - start < 60


def test_sanitised_merges_overlapping_spans(spark):
    text = "+1 4111 1111 1111 1111 end"  # a phone number has at most 15 digits; the card is in it
    spans = [(0, 0, "email", 6), (3, 2, "card", 22), (23, 4, "word", 26)]
    df = spark.createDataFrame([(text, spans), (text, []), (None, [])], "t string, s array<struct<start:int,order:int,kind:string,end:int>>")
    got = [r[0] for r in df.select(personal.sanitised(F.col("t"), F.col("s"))).collect()]
    assert got == ["[EMAIL] [WORD]", text, None]


def test_personal_on_odd_rows(spark, odd, empty):
    assert personal.find_personal(odd, carry=odd.columns).count() == len(ODD_ROWS)
    assert personal.find_personal(empty, carry=empty.columns).count() == 0


def test_registered_personal_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    rows = personal.op8_personal(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        line = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(k == s[1] for s in base) for k in range(4)]
        own = [s for s in r["spans"].split(",") if s.split(":")[0] in personal.KINDS]
        assert ",".join(own) == line


# --- language ------------------------------------------------------------------------


def test_words_come_first_and_n_grams_after():
    known = {0: [("haus", 0, -1.0)], 3: [("mai", 1, -2.0)], 1: [("h", 0, -2.0)]}
    tables = [langid.Table(known.get(n, []), [-14.0, -14.0]) for n in range(langid.LONGEST + 1)]
    model = langid.Model(["de", "fr"], tables)
    assert model.predict("Haus")[0] == "de" and model.predict("maison")[0] == "fr"
    assert model.predict("h")[0] == "de"
    for text in (None, "", "12 34 !", "²"):
        assert model.predict(text) == ("und", 0.0)
    assert langid.Model([], []).predict("haus") == ("und", 0.0)


def test_language_of_odd_rows(spark, odd, empty):
    model = langid.fit(odd)
    assert model.langs == ["de", "en", "fr"]
    got = langid.identify(odd, model, "doc_id", "text", "size").collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    nothing = langid.fit(empty)
    assert nothing.langs == [] and langid.identify(empty, nothing).count() == 0


def test_the_frequency_cut_bounds_the_model(spark):
    counts = spark.createDataFrame([("en", f"w{i}", i + 1) for i in range(1000)], "lang string, word string, n long")
    for most in (0, 1, 10, 500, 5000):
        kept = [r["n"] for r in langid.most_frequent(counts, most).collect()]
        assert len(kept) <= most and sorted(kept) == list(range(1001 - len(kept), 1001))
        assert len(kept) >= min(1000, most) * 0.9 - 1


def test_all_learned_counts_are_used(spark):
    """Nothing is cut: with no word sent to the tasks the results are those of whole tables."""
    text = [("en", "the house stands near the river zq"), ("en", "the house"), ("de", "das haus steht am fluss zq"),
            ("de", "das haus"), ("es", "la casa rara")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(text)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame(
        [(1, "rara"), (2, "housing rara"), (3, "fluesse zq zq"), (None, "das"), (None, "das"), (6, None), (7, "1 2"),
         (8, "ж ж"), (9, "casas rivers hausen")], "doc_id long, text string")
    counts = Counter()
    for lang, t in text:
        for word in langid.words_of(t):
            counts[0, lang, word] += 1
            for n in range(1, langid.LONGEST + 1):
                counts.update((n, lang, g) for g in langid.grams_of(word, n))
    langs, tables = ["de", "en", "es"], []
    for n in range(langid.LONGEST + 1):
        own = [(lang, w, k) for (m, lang, w), k in counts.items() if m == n]
        base = [sum(k + 0.5 for x, _, k in own if x == lang) + 0.5 for lang in langs]
        entries = [(w, langs.index(x), math.log((k + 0.5) / base[langs.index(x)])) for x, w, k in own]
        tables.append(langid.Table(entries, [math.log(0.5 / b) for b in base]))
    plain = langid.Model(langs, tables)
    want = [(r["doc_id"], *plain.predict(r["text"])) for r in asked.collect()]
    for fast in (0, 3, 1000):
        model = langid.fit(docs, fast_words=fast)
        got = [tuple(r) for r in langid.identify(asked, model).collect()]
        assert sorted(map(str, ((k, x) for k, x, _ in got))) == sorted(map(str, ((k, x) for k, x, _ in want)))
        assert sorted(s for *_, s in got) == pytest.approx(sorted(s for *_, s in want), abs=1e-5)
        assert len(model.fast) <= fast


def test_n_gram_counts(spark):
    words = spark.createDataFrame([("en", "aba", 2), ("en", "ab", 1), ("de", "a", 5)], "lang string, word string, n long")
    for n in (1, 2, 5, 6):
        want = Counter()
        for lang, word, k in (("en", "aba", 2), ("en", "ab", 1), ("de", "a", 5)):
            for g in langid.grams_of(word, n):
                want[lang, g] += k
        got = {(r["lang"], r["word"]): r["n"] for r in langid.gram_counts(words, n).collect()}
        assert got == want


def test_registered_language_query(spark):
    import zlib

    lang = {r["doc_id"]: r["lang"] for r in read(spark, SF, "documents").select("doc_id", "lang").collect()}
    rows = langid.op9_langid(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.97


# --- quality -------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs = read(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    folder = SF.replace("sf0.001", "sf0.01")
    labels = read(spark, folder, "labels")
    model = cotraining.train(spark, docs.join(labels.filter("doc_id % 3 > 0").select("doc_id"), "doc_id", "left_semi").unionByName(
        docs.join(labels.select("doc_id"), "doc_id", "left_anti")), folder)
    assert model.pseudo_labels > 0
    found = {r["doc_id"]: r["keep"] for r in cotraining.classify(docs, model).select("row.doc_id", "keep").collect()}
    held = [r for r in labels.filter("doc_id % 3 = 0").collect()]
    good = [found[r["doc_id"]] for r in held if r["quality"] == 1 and r["toxic"] == 0]
    junk = [found[r["doc_id"]] for r in held if r["quality"] == 0]
    assert sum(good) / len(good) >= 0.97
    assert sum(junk) / len(junk) <= 0.2


def quality_table(spark, copies=0):
    """Clean and junk documents by word lists, a third of them labelled; `copies` rows repeat one labelled key."""
    clean, junk = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    text = lambda i: " ".join((clean if i % 2 else junk)[(i * 7 + j * 3) % 40] for j in range(20))
    rows = [(i, text(i), "en", f"s{i % 5}", 100) for i in range(600)] + [(3, text(3), "en", "s3", 100)] * copies
    docs = spark.createDataFrame(rows, "key long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 600, 3)], "key long, quality int, toxic int")
    return docs, labels, rows


def test_a_repeated_key_that_is_a_third_of_the_rows(spark):
    """Copies of a labelled document are one training row, and copies of an unlabelled one are one pseudo-label."""
    docs, labels, rows = quality_table(spark, 300)
    flood = spark.createDataFrame([(1, rows[1][1], "en", "s1", 100)] * 300, docs.schema)
    model = cotraining.fit(docs.unionByName(flood), labels, drawn=50)
    stage = C.Stage(spark, "test")
    assert cotraining.sampled(docs.unionByName(flood), labels, 20_000, stage).count() == 200
    # Two views, two rounds, at most about 50 rows each.
    assert 0 < model.pseudo_labels <= 2 * 2 * 80
    found = {r["key"]: r["score"] for r in cotraining.classify(docs, model).select("row.key", "score").collect()}
    right = sum((found[i] >= model.threshold) == bool(i % 2) for i in range(600))
    assert right >= 590


def test_every_unlabelled_document_is_scored_in_a_round(spark):
    docs, labels, _ = quality_table(spark)
    scored = cotraining.score_unlabelled(docs, labels, cotraining.Model(), C.Stage(spark, "test"), "scored")
    assert scored.count() == 400
    sure = scored.withColumn("text_score", F.lit(0.999))
    few = cotraining.pseudo_labels(sure, "text_score", 40, 0.5, 0)
    texts = sure.select("mark").distinct().count()
    assert 0 < few.count() < texts and cotraining.pseudo_labels(sure, "text_score", 10**6, 0.5, 0).count() == texts


def test_quality_without_labels_keeps_all(spark, odd, empty):
    model = cotraining.Model()
    rows = cotraining.classify(odd, model).select("row.doc_id", "score", "keep").collect()
    assert len(rows) == len(ODD_ROWS) and all(r["keep"] and r["score"] == 1.0 for r in rows)
    assert cotraining.classify(empty, model).count() == 0
    named = odd.drop("key").withColumnRenamed("doc_id", "key")
    none = spark.createDataFrame([], "key long, quality int, toxic int")
    assert cotraining.fit(named, none).threshold == 0.0
    one_kind = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 1), (4, 1, None)], none.schema)
    assert cotraining.fit(named, one_kind).threshold == 0.0


# --- pipeline ------------------------------------------------------------------------


def test_stages_return_what_they_were_given(spark, odd, empty, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            score = [corpus_pipeline.SCORE] if name == "quality classifier" else []
            assert stage(spark, docs, folder).columns == docs.columns + score
    scored = odd.withColumn(corpus_pipeline.SCORE, F.lit(0.5))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, scored, folder).columns) == sorted(scored.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    assert corpus_pipeline.quality(spark, odd, folder).count() == len(ODD_ROWS)


def test_one_document_of_each_group_stays(spark, odd):
    kept = corpus_pipeline.near_duplicates(spark, odd, "").collect()
    groups = simhash.simhash_components(odd.filter("doc_id IS NOT NULL")).select("key", "component").distinct().collect()
    want = {r["component"] for r in groups}
    assert Counter(r["doc_id"] for r in kept) == Counter([*want, None])
    assert {c for r in kept for c in CLASH if r[c] != CLASH.index(c)} == set()


def test_personal_stage_leaves_clean_documents_alone(spark):
    docs = documents(spark, [(1, "clean text é", "en", "a", 99), (2, "mail to x@y.org now", "en", "a", 19), (3, None, None, None, None),
                             (4, "mail to all now", "en", "a", 15)])
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["lang"]) for r in corpus_pipeline.personal_data(spark, docs, "").collect()}
    assert got == {1: ("clean text é", 99, "en"), 2: ("mail to [EMAIL] now", 19, "en"), 3: (None, None, None), 4: ("mail to all now", 15, "en")}


def test_mixing_stage_draws_by_the_score(spark):
    rows = [(i, f"a b c d{i}", "en", ["a", "b", "c"][i % 3], 8, 0.9 if i % 2 else 0.05) for i in range(900)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {corpus_pipeline.SCORE} double")
    got = Counter(r["doc_id"] % 2 for r in corpus_pipeline.mix_sources(spark, docs, "").filter("source = 'b'").collect())
    assert got[1] > 1.3 * got[0]


def test_mixing_stage_repeats_documents(spark, odd):
    copies = {r["key"]: r["copies"] for r in mixing.mix(odd.filter("doc_id <> 6")).collect()}
    got = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, odd.filter("doc_id <> 6"), "").collect())
    assert got == Counter({k: n for k, n in copies.items() if n})


def test_pipeline_over_the_table(spark):
    docs = read(spark, SF, "documents")
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    filled = Counter()
    for r in out:
        filled[r["sequence_id"]] += r["length"]
        assert len(r["ids"]) == 2 * r["length"]
    assert max(filled.values()) <= 1024
