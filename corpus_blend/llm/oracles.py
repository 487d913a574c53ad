"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    # Every shortest run of 50 words, forwards from a line and backwards from one, as text; a run
    # whose text occurred before goes.
    "op2_line_dedup": r"""
        WITH raw AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw_line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
        lines AS (
            SELECT doc_id, no, raw_line, regexp_replace(raw_line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
            FROM raw),
        l AS (
            SELECT doc_id, no, line, len(string_split_regex(line, '[\x20\x09-\x0D]+')) AS w,
                   sum(w) OVER (PARTITION BY doc_id ORDER BY no) AS upto
            FROM lines WHERE line <> ''),
        runs AS (
            SELECT a.doc_id, a.no AS s, min(b.no) AS e FROM l a JOIN l b
            ON a.doc_id = b.doc_id AND b.no >= a.no AND b.upto >= a.upto - a.w + 50 GROUP BY 1, 2
            UNION
            SELECT b.doc_id, max(a.no) AS s, b.no AS e FROM l a JOIN l b
            ON a.doc_id = b.doc_id AND b.no >= a.no AND b.upto >= a.upto - a.w + 50 GROUP BY 1, 3),
        texts AS (
            SELECT r.doc_id, r.s, r.e, string_agg(l.line, chr(10) ORDER BY l.no) AS run
            FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.no BETWEEN r.s AND r.e GROUP BY 1, 2, 3),
        later AS (
            SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM texts),
        known AS (
            SELECT doc_id, no, raw_line,
                   CASE WHEN line <> '' THEN EXISTS (
                       SELECT 1 FROM later x WHERE x.k > 1 AND x.doc_id = lines.doc_id
                       AND lines.no BETWEEN x.s AND x.e) END AS hit
            FROM lines),
        marked AS (  -- a blank line goes with the lines before and after it
            SELECT doc_id, no, raw_line, coalesce(hit,
                last_value(hit IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                AND first_value(hit IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no
                    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS gone
            FROM known)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               sha256(coalesce(string_agg(raw_line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS text_sha256
        FROM marked GROUP BY doc_id
    """,
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
            ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
        r AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM c LEFT JOIN n USING (vec_id)
    """,
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    # Base 32 of a SHA-1: four times ten hexadecimal digits, which are eight digits to base 32 each.
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        o AS (
            SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
        b AS (
            SELECT *, lpad(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32), 8, '0')
                   || lpad(to_base(('0x' || substr(h, 11, 10))::BIGINT, 32), 8, '0')
                   || lpad(to_base(('0x' || substr(h, 21, 10))::BIGINT, 32), 8, '0')
                   || lpad(to_base(('0x' || substr(h, 31, 10))::BIGINT, 32), 8, '0') AS digits FROM o)
        SELECT page_id, strlen(html) AS payload_bytes,
               translate(digits, '0123456789ABCDEFGHIJKLMNOPQRSTUV',
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b
    """,
    "op13_lexical_search": r"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        d AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM d GROUP BY ALL),
        c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM n),
        m AS (SELECT doc_id, 100 - 90 + (90 * n * n_docs) // total AS m FROM n, c),
        w AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM d, c GROUP BY term, n_docs),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM q JOIN d USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
        r AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
                   doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10
    """,
}
