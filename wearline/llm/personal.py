"""Personal data: patterns with checks, and information-theoretic sanitisation of what is left.

Base spans are the matches of four patterns that pass their check (email, ip, card, phone). The
patterns below match what the plain ones do, leftmost first, and differ in two ways that keep
them linear on long runs: quantifiers are possessive where giving back could not help, and a
match may only start where a run of its characters starts, or where the last match ended.

A base value is a protected entity. What else its documents say can reveal it even when it is
masked: a name, an account, an employer. For a term t and an entity e the corpus tells how much:
PMI(e; t) = log2 p(e, t) / (p(e) p(t)), against the information IC(e) = -log2 p(e) that the
entity holds. PMI / IC is 1 if the term occurs with the entity alone and near 0 if it tells
nothing. p(e), p(t) and p(e, t) count documents over the whole corpus, by their whole texts
without the base spans. How far a pair can be trusted depends on the n different texts that show
it: its disclosure is PMI / IC shrunk by n / (n + 1), so what one text shows, however often it was
copied, counts half. Terms are removed from `REMOVE` on, generalised from `GENERALISE` on, wherever
they stand in the documents of the entity. To generalise is to put the term's class in its place:
a name, a number, a code of letters and digits, a word. From one text alone a term is generalised
if it stands nowhere else, and never removed. Entities that stand in the same documents have the
same figures and are counted as one.

As no pair counts more often than its entity, a term of more than N (n_e / N)^(g (n + 1) / n)
documents cannot reach the threshold g with an entity of n_e documents and n texts. So the common
terms of a document are never paired, and a page of many entities pairs them with its rare terms.

All steps are DataFrame functions. Pair counts are distinct rows aggregated by key, so a line
that a third of the documents share is one pre-aggregated count.

Defined cases. Null text: no spans, stays null. Repeated rows: each gets its spans; they count
as documents, not as further texts. Empty table: no rows. Overlapping spans: all are reported;
the sanitised text replaces their union once, by the mark of the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
REMOVED = "removed"

EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: What a text with a passing match holds in any case; cheaper to look for.
HINTS = {
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9][\x20().0-9-]*[0-9]",
}
PART_255 = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_OK = rf"^{PART_255}(?:\.{PART_255}){{3}}$"

#: Terms are words of letters, digits and underscores between white space, without the punctuation
#: around them. They are looked for where base spans are masked, so they are never part of one.
TERM = r"""(?<![^\s("'\[])[\p{L}\p{N}_][\p{L}\p{M}\p{N}_'-]*+(?=[)"'\],.;:!?]*+(?!\S))"""
#: Neither white space nor part of a term or of the punctuation around it.
MASK = "\x01"
#: A key with more than one in so many rows, and more than MANY, is joined by broadcast.
HOT, MANY = 1000, 10_000
#: The disclosure thresholds.
GENERALISE, REMOVE = 0.5, 0.7

#: Elements whose positions are summed in one step.
STEP = 256


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(text: Column, found: Column, pattern: str) -> Column:
    """The start, in code points, of each of the matches `found`, at least one, of a pattern in
    a text.

    Cutting at the matches gives the lengths between them. Sums are made in steps, so the work
    stays near the number of matches for any number of them.
    """
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    spans = F.zip_with(
        gaps, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"))
    )
    return let(spans, _running)


def _running(spans: Column) -> Column:
    numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / STEP).cast("int"))
    parts = F.transform(numbers, lambda b: F.slice(spans, b * STEP + 1, F.lit(STEP)))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x["gap"] + x["size"])

    def add(acc: Column, part: Column) -> Column:
        return F.struct(
            (acc["at"] + total(part)).alias("at"),
            F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("at"), part.alias("part")))).alias("parts"),
        )

    kind = "array<struct<at:int,part:array<struct<gap:int,size:int>>>>"
    offsets = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("parts")), add, lambda acc: acc["parts"]
    )

    def starts(one: Column) -> Column:
        return F.aggregate(
            one["part"],
            F.struct(one["at"].alias("at"), F.array().cast("array<int>").alias("xs")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(acc["xs"], F.array(acc["at"] + x["gap"])).alias("xs"),
            ),
            lambda acc: acc["xs"],
        )

    return F.flatten(F.transform(offsets, starts))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    number = digits(value)

    def add(acc: Column, i: Column) -> Column:
        one = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(one > 4, one * 2 - 9).otherwise(one * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(one)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(IP_OK)
    if kind == "card":
        return n.between(14, 19) & luhn(value)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
ADDED = "array<struct<start:int,end:int,kind:string>>"


def base_spans(text: Column) -> Column:
    """(start, kind, end, value) of all passing matches, by start and kind; `text` is not null."""
    none = F.array().cast(SPAN)

    def of_kind(number: int, kind: str, pattern: str) -> Column:
        def span(start: Column, value: Column) -> Column:
            return F.struct(
                start.alias("start"), F.lit(number).alias("kind"),
                (start + F.length(value)).alias("end"), value.alias("value"),
            )

        def good(found: Column) -> Column:
            spans = F.zip_with(positions(text, found, pattern), found, span)
            return F.when(F.size(found) > 0, F.filter(spans, lambda s: passes(kind, s["value"])).cast(SPAN)).otherwise(none)

        hint = text.rlike(HINTS[kind]) if kind in HINTS else F.contains(text, F.lit("@"))
        return F.when(hint, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), good)).otherwise(none)

    parts = [of_kind(number, kind, pattern) for number, (kind, pattern) in enumerate(PATTERNS.items())]
    return F.array_sort(F.concat(*parts))


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with their base spans as `spans`."""
    return docs.withColumn("spans", base_spans(F.coalesce(F.col(text), F.lit(""))))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    return F.filter(F.array_distinct(found), lambda t: F.length(t) > 1)


def masked(text: Column, spans: Column) -> Column:
    """The text with as many marks in place of each base span as it has characters."""
    return sanitised(text, all_spans(spans, F.array().cast(ADDED)), lambda s: F.repeat(F.lit(MASK), s["end"] - s["start"]))


def sized_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """The inner join with one row for each key, of which `rows` names the number of left rows and
    `total` their sum. The few keys with very many rows are not shuffled."""
    many = F.col(rows) > max(MANY, total // HOT)
    hot = F.broadcast(right.filter(many))
    rest = left.join(hot.select(*on), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(right.filter(~many), on))


def holding(held: DataFrame, total: int, stage: C.Stage) -> DataFrame:
    """(id, text_hash, masked, groups) of the documents with an entity; `groups` has (group, with_entity, most) of
    their sets of entities that stand in the same documents, `most` the documents a term may have to matter."""
    one = held.select("id", "text_hash", F.explode("spans").alias("s"))
    one = one.select("id", "text_hash", F.xxhash64(F.col("s.kind"), F.lower("s.value")).alias("entity"))
    one = stage.keep(one.distinct(), "entities")
    known = one.groupBy("entity").agg(
        F.count("*").alias("with_entity"), F.count_distinct("text_hash").alias("texts"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("y"),
    )
    least = F.lit(GENERALISE) * (F.col("texts") + 1) / F.col("texts")
    most = F.lit(float(total)) * F.pow(F.col("with_entity") / F.lit(float(total)), least) * (1 + 1e-9)
    known = known.select("entity", "with_entity", F.xxhash64("with_entity", "x", "y").alias("group"), most.alias("most"))
    own = sized_join(one.select("id", "entity"), known, ["entity"], "with_entity", one.count())
    own = own.groupBy("id").agg(F.collect_set(F.struct("group", "with_entity", "most")).alias("groups"))
    return stage.keep(held.select("id", "text_hash", "masked").join(own, "id"), "holding")


def term_counts(docs: DataFrame, held: DataFrame, text: str) -> DataFrame:
    """(term, with_term) over all documents. Their plain texts are counted, then those with base
    spans are taken out again and counted by what is outside the spans."""
    def of(rows: DataFrame, column: str, weight: int) -> DataFrame:
        return rows.select(F.explode(terms_of(F.col(column))).alias("term")).groupBy("term").agg(
            (F.count("*") * weight).alias("n")
        )

    parts = of(docs, text, 1).unionByName(of(held, "text", -1)).unionByName(of(held, "masked", 1))
    return parts.groupBy("term").agg(F.sum("n").alias("with_term"))


def paired(docs: DataFrame, held: DataFrame, own: DataFrame, text: str, total: int) -> DataFrame:
    """(id, text_hash, group, term, with_entity, with_term) of all pairs that can reach the lower threshold."""
    counts = term_counts(docs, held, text)
    terms = own.select("id", F.array_max(F.transform("groups", lambda g: g["most"])).alias("limit"), F.explode(terms_of(F.col("masked"))).alias("term"))
    rare = sized_join(terms, counts, ["term"], "with_term", total).filter(F.col("with_term") <= F.col("limit"))
    rare = rare.groupBy("id").agg(F.collect_list(F.struct("with_term", "term")).alias("rare"))
    pairs = own.select("id", "text_hash", "groups").join(rare, "id").select("id", "text_hash", "rare", F.explode("groups").alias("g"))
    fitting = F.filter("rare", lambda t: t["with_term"] <= F.col("g.most"))
    pairs = pairs.select("id", "text_hash", "g", F.explode(fitting).alias("t"))
    return pairs.select("id", "text_hash", "g.group", "t.term", "g.with_entity", "t.with_term")


def disclosing(pairs: DataFrame, total: int) -> DataFrame:
    """(group, term, both, disclosure) of the pairs from the lower threshold on."""
    found = pairs.groupBy("group", "term").agg(
        F.count("*").alias("both"), F.count_distinct("text_hash").alias("texts"),
        F.max("with_entity").alias("with_entity"), F.max("with_term").alias("with_term"),
    )
    total = F.lit(float(total))
    information = F.log2(total / F.col("with_entity"))
    shared = F.log2(F.col("both") * total / (F.col("with_entity") * F.col("with_term")))
    trust = F.col("texts") / (F.col("texts") + 1)
    # Rounded far below any difference that counts, so that a full share is exactly 1.
    disclosure = F.round(F.when(information > 0, shared / information), 9) * trust
    return found.withColumn("disclosure", disclosure).filter(F.col("disclosure") >= GENERALISE).select("group", "term", "both", "disclosure")


def class_of(term: Column) -> Column:
    """What a generalised term still says: that it is a number, a code, a name or a word."""
    return (
        F.when(term.rlike(r"^[\p{N}]+$"), "number")
        .when(term.rlike(r"[\p{N}_]"), "code")
        .when(term.rlike(r"^\p{Lu}"), "name")
        .otherwise("word")
    )


def placed_terms(own: DataFrame) -> DataFrame:
    """(id, term, start, end, class) of all terms of documents."""

    def placed(found: Column) -> Column:
        pair = F.zip_with(
            positions(F.col("masked"), found, TERM), found, lambda at, m: F.struct(at.alias("at"), m.alias("term"))
        )
        return F.when(F.size(found) > 0, pair)

    terms = F.explode(let(F.regexp_extract_all("masked", F.lit(TERM), F.lit(0)), placed)).alias("y")
    return own.select("id", terms).select(
        "id", F.lower("y.term").alias("term"), F.col("y.at").alias("start"),
        (F.col("y.at") + F.length("y.term")).alias("end"), class_of(F.col("y.term")).alias("class"),
    )


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row for each document: key, spans (start, kind, end, value) and added (start, end,
    kind), both in order, and `row`, the carried columns, among them the text."""
    stage = C.Stage(docs.sparkSession, "personal")
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *row)
    marked = with_spans(named, "text").withColumn("text_hash", F.xxhash64("text"))
    marked = marked.withColumn("id", F.monotonically_increasing_id())
    carried = text in (carry or [])
    marked = marked.drop("text") if carried else marked.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))
    marked = stage.keep(marked, "spans")
    held = marked.filter(F.size("spans") > 0)
    whole = F.col("row")[text].cast("string") if carried else F.col("text")
    held = held.select("id", "text_hash", "spans", whole.alias("text"))
    held = held.withColumn("masked", masked(F.col("text"), F.col("spans")))
    total = marked.count()
    own = holding(held, total, stage)
    pairs = stage.keep(paired(named, held, own, "text", total), "pairs")
    told = stage.keep(disclosing(pairs, total), "disclosing")
    rows = told.agg(F.sum("both")).first()[0] or 0
    telling = sized_join(pairs.select("id", "group", "term"), told, ["group", "term"], "both", rows)
    telling = telling.groupBy("id", "term").agg(F.max("disclosure").alias("disclosure"))
    telling = stage.keep(telling, "telling")
    places = placed_terms(own.join(telling.select("id").distinct(), "id", "left_semi"))
    added = places.join(telling, ["id", "term"])
    kind = F.when(F.col("disclosure") >= REMOVE, F.lit(REMOVED)).otherwise(F.col("class"))
    added = added.select("id", F.struct("start", "end", kind.alias("kind")).alias("span"))
    added = added.groupBy("id").agg(F.sort_array(F.collect_list("span")).alias("added"))
    return marked.join(added, "id", "left").select(
        "key", "spans", F.coalesce("added", F.array().cast(ADDED)).alias("added"), *(["row"] if carry else [])
    )


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def all_spans(base: Column, added: Column) -> Column:
    """(start, order, kind, end) of base and added spans, by start and kind."""
    def plain(start: Column, order: Column, kind: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), order.alias("order"), kind.alias("kind"), end.alias("end"))

    first = F.transform(base, lambda s: plain(s["start"], s["kind"], kind_name(s["kind"]), s["end"]))
    more = F.transform(added, lambda s: plain(s["start"], F.lit(len(KINDS)), s["kind"], s["end"]))
    return F.array_sort(F.concat(first, more))


def mark_of(span: Column) -> Column:
    """The kind or class in brackets, nothing for removed terms."""
    mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
    return F.when(span["kind"] == REMOVED, F.lit("")).otherwise(mark)


def in_steps(spans: Column) -> Column:
    """Runs of `STEP` spans, each with the greatest end of all runs before it."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / STEP).cast("int"))
    parts = F.transform(numbers, lambda b: F.slice(spans, b * STEP + 1, F.lit(STEP)))
    kind = "array<struct<before:int,part:array<struct<start:int,end:int,kind:string>>>>"

    def add(acc: Column, part: Column) -> Column:
        return F.struct(
            F.greatest(acc["before"], F.array_max(F.transform(part, lambda s: s["end"]))).alias("before"),
            F.concat(acc["parts"], F.array(F.struct(acc["before"].alias("before"), part.alias("part")))).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("before"), F.array().cast(kind).alias("parts"))
    return F.aggregate(parts, start, add, lambda acc: acc["parts"])


def united(spans: Column) -> Column:
    """(start, end, kind) of the union of at least one span, in order; the first names the kind.

    A span that starts before the greatest end so far belongs to the one that is open. Work stays
    near the number of spans, as sums in `positions`.
    """
    wide = "array<struct<start:int,end:int,kind:string,before:int>>"

    def runs(one: Column) -> Column:
        return F.aggregate(
            one["part"],
            F.struct(one["before"].alias("before"), F.array().cast(wide).alias("xs")),
            lambda acc, s: F.struct(
                F.greatest(acc["before"], s["end"]).alias("before"),
                F.concat(acc["xs"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
                                                     acc["before"].alias("before")))).alias("xs"),
            ),
            lambda acc: acc["xs"],
        )

    def heads(marked: Column) -> Column:
        first = F.filter(marked, lambda s: s["start"] >= s["before"])
        last = F.array_max(F.transform(marked, lambda s: s["end"]))
        return let(F.struct(first.alias("first"), last.alias("last")), with_ends)

    def with_ends(x: Column) -> Column:
        behind = F.transform(F.slice(x["first"], F.lit(2), F.size(x["first"])), lambda s: s["before"])
        return F.zip_with(x["first"], F.concat(behind, F.array(x["last"])), lambda s, end: F.struct(
            s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind")))

    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return let(F.flatten(F.transform(in_steps(plain), runs)), heads)


def sanitised(text: Column, spans: Column, mark: Callable[[Column], Column] = mark_of) -> Column:
    """The text with the union of the spans, by start, replaced by their marks.

    The text is cut into segments of `STEP` spans first, as finding a place in a text takes as long
    as the text is up to there.
    """

    def segment(x: Column) -> Column:
        begins = F.concat(F.array(x["base"]), F.transform(F.slice(x["part"], F.lit(1), F.size(x["part"]) - 1), lambda s: s["end"]))

        def piece(s: Column, before: Column) -> Column:
            return F.concat(F.substring(x["text"], before - x["base"] + 1, s["start"] - before), mark(s))

        return F.array_join(F.zip_with(x["part"], begins, piece), "")

    def pieces(merged: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(merged) - 1) / STEP).cast("int"))
        last = F.element_at(merged, -1)["end"]

        def cut(b: Column) -> Column:
            base = F.when(b == 0, F.lit(0)).otherwise(F.element_at(merged, F.greatest(b * STEP, F.lit(1)))["end"])
            part = F.slice(merged, b * STEP + 1, F.lit(STEP))
            end = F.element_at(merged, F.least((b + 1) * STEP, F.size(merged)))["end"]
            found = F.struct(base.alias("base"), part.alias("part"), F.substring(text, base + 1, end - base).alias("text"))
            return let(found, segment)

        tail = F.substring(text, last + 1, F.length(text))
        return F.concat(F.array_join(F.transform(numbers, cut), ""), tail)

    return F.when(F.size(spans) > 0, let(let(spans, united), pieces)).otherwise(text)


def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all `documents`: counts, the digest of the base spans, all spans."""
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = find_personal(docs)
    base = F.transform("spans", lambda s: F.struct(kind_name(s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    counts = [count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return found.select(
        F.col("key").alias("doc_id"),
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(all_spans(F.col("spans"), F.col("added"))).alias("spans"),
    )
