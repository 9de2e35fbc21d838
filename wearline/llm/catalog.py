"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .balltree import op12_ranked
from .codes import op13_codes
from .cotraining import op4_cotraining
from .decontaminate import op11_decontaminate
from .langid import op9_langid
from .mixing import op7_mixing
from .packing import op5_packing
from .personal import op8_personal
from .postings import op10_postings
from .simhash import op6_simhash
from .suffixes import op3_suffixes
from .token_store import op1_token_store
from .topk import op2_topk

#: name -> (spark, folder of the scale) -> DataFrame
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_topk": op2_topk,
    "op3_suffixes": op3_suffixes,
    "op4_cotraining": op4_cotraining,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_personal": op8_personal,
    "op9_langid": op9_langid,
    "op10_postings": op10_postings,
    "op11_decontaminate": op11_decontaminate,
    "op12_ranked": op12_ranked,
    "op13_codes": op13_codes,
}

#: Only A-Z in lower case.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _decontaminate_sql(window: int = 10) -> str:
    """Words as rows; a window's words are those that lead each other, joined by spaces."""
    words = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    run = "word" + "".join(
        f" || CASE WHEN n > {i} THEN ' ' || lead(word, {i}) OVER w ELSE '' END" for i in range(1, window)
    )
    return f"""
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS d, doc_id, coalesce({words}, []) AS words FROM documents
        ), items AS (
            SELECT row_number() OVER () AS i, item_id, {words} AS words FROM benchmark
        ), item_words AS (
            SELECT i, item_id, least({window}, len(words)) AS n, unnest(words) AS word,
                generate_subscripts(words, 1) AS pos
            FROM items
        ), windows AS (
            SELECT DISTINCT item_id, n, run FROM (
                SELECT item_id, n, {run} AS run FROM item_words WINDOW w AS (PARTITION BY i ORDER BY pos)
            ) WHERE run IS NOT NULL
        ), words AS (
            SELECT d, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
        ), runs AS (
            SELECT d, pos, n, {run} AS run FROM words, (SELECT DISTINCT n FROM windows)
            WINDOW w AS (PARTITION BY d, n ORDER BY pos)
        ), found AS MATERIALIZED (
            SELECT d, pos, n, item_id FROM runs JOIN windows USING (n, run)
        ), hit AS (
            SELECT d, count(DISTINCT pos + k) AS n_hit
            FROM (SELECT DISTINCT d, pos, n FROM found) CROSS JOIN range(0, {window}) AS r(k) WHERE k < n GROUP BY d
        ), named AS (
            SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT d, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY d
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (d) LEFT JOIN named USING (d)"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The rounds one after the other, distances as |a|^2 - 2ab + |b|^2 of whole numbers."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
            SELECT row, part, any_value(v) AS v, min({{'error': aa - 2 * list_inner_product(v, b) + bb, 'entry': entry}}) AS best
            FROM pieces JOIN book{r} USING (part) GROUP BY row, part)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (
            SELECT part, entry, list(mean ORDER BY pos) AS b FROM (
                SELECT part, entry, pos, floor(sum(x) / count(*)) AS mean FROM (
                    SELECT part, best.entry AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM near{r})
                GROUP BY part, entry, pos) GROUP BY part, entry), book{r + 1} AS MATERIALIZED (
            SELECT part, entry, b, list_inner_product(b, b) AS bb
            FROM (SELECT part, entry, coalesce(m.b, k.b) AS b FROM book{r} k LEFT JOIN mean{r} m USING (part, entry)))""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label,
                list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pieces AS MATERIALIZED (
            SELECT *, list_inner_product(v, v) AS aa FROM (
                SELECT row, part, e[CAST(part * len(e) / {parts} + 1 AS INT) : CAST((part + 1) * len(e) / {parts} AS INT)] AS v
                FROM kept CROSS JOIN range(0, {parts}) AS r(part))
        ), book0 AS MATERIALIZED (
            SELECT part, row AS entry, v AS b, aa AS bb FROM pieces WHERE row < {entries}
        ), {", ".join(steps)}, coded AS (
            SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code,
                CAST(sum(best.error) AS BIGINT) AS error
            FROM near{rounds} GROUP BY row
        ), books AS (
            SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
            FROM (SELECT part, entry, unnest(b) AS x, generate_subscripts(b, 1) AS pos FROM book{rounds})
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (row) CROSS JOIN books"""


def _ranked_sql(k: int = 50) -> str:
    terms = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH docs AS MATERIALIZED (
            SELECT * FROM (SELECT row_number() OVER () AS d, doc_id, {terms} AS terms FROM documents) WHERE len(terms) > 0
        ), totals AS (
            SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM docs
        ), counts AS MATERIALIZED (
            SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counts CROSS JOIN totals GROUP BY term
        ), items AS (
            SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)
        ), asked AS (
            SELECT DISTINCT q, item_id, unnest({terms}) AS term FROM items
        ), scored AS (
            SELECT q, item_id, d, CAST(sum(w * ((1000000000 * tf) //
                (1000 * tf + 20 * (100 - 50 + (50 * len(terms) * docs.total) // docs.words)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN counts USING (term)
                JOIN (SELECT d, terms, t.docs AS total, t.words FROM docs CROSS JOIN totals t) docs USING (d)
            GROUP BY q, item_id, d
        ), ranked AS (
            SELECT q, item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
                doc_id, score
            FROM scored JOIN docs USING (d) WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op2_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op11_decontaminate": _decontaminate_sql(),
    "op12_ranked": _ranked_sql(),
    "op13_codes": _codes_sql(),
}
