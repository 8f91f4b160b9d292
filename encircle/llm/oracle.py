"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH item AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item,
           regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), pattern AS (
    SELECT DISTINCT item, least(len(w), 10) AS m,
           unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ')
                   FOR i IN range(1, greatest(len(w) - 10, 0) + 2)]) AS win
    FROM item WHERE len(w) > 0
), doc AS (
    SELECT doc_id, row_number() OVER () AS r,
           coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), place AS (
    SELECT r, m, unnest([{{'i': i, 'win': array_to_string(w[i:i + m - 1], ' ')}}
                         FOR i IN range(1, len(w) - m + 2)], recursive := true)
    FROM doc, (SELECT DISTINCT m FROM pattern) WHERE len(w) >= m
), occurrence AS (
    SELECT r, i, m, item FROM place JOIN pattern USING (m, win)
), hit AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM occurrence) GROUP BY r
), held AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM occurrence) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""

OP7 = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN []
             WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
    FROM doc
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
        FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
    WHERE 100 * common >= 80 * (p.n + q.n - common)
), reach AS (
    SELECT doc_id AS a, doc_id AS c FROM doc
    UNION
    SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.a
)
SELECT doc.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM doc LEFT JOIN size ON size.doc_id = doc.doc_id
JOIN (SELECT a, min(c) AS component_id FROM reach GROUP BY a) ON a = doc.doc_id
"""

OP5 = """
WITH page AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digest AS (SELECT page_id, payload, strlen(payload) AS bytes, sha1(payload) AS hex FROM page),
grouped AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM digest)
SELECT page_id, bytes::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)
           FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM grouped
"""

OP9 = r"""
WITH doc AS (
    SELECT DISTINCT doc_id, md5(text) AS mark, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), filled AS (
    SELECT *, list_filter(range(1, len(lines) + 1), lambda x: regexp_matches(lines[x], '[^\x20\x09-\x0D]')) AS f FROM doc
), pair AS (
    SELECT doc_id, mark, lines, unnest([{'first': f[k], 'last': f[k + 1]} FOR k IN range(1, len(f))], recursive := true)
    FROM filled
), placed AS (
    SELECT doc_id, mark, first, last, count(*) OVER w > 1 AS often,
           row_number() OVER (w ORDER BY doc_id, mark, first) = 1 AS lead
    FROM (SELECT *, array_to_string(lines[first:last], chr(10)) AS chunk FROM pair)
    WINDOW w AS (PARTITION BY chunk)
), gone AS (
    SELECT doc_id, mark, i FROM (SELECT doc_id, mark, unnest(range(first, last + 1)) AS i, lead FROM placed WHERE often)
    GROUP BY ALL HAVING NOT bool_or(lead)
), line AS (
    SELECT doc_id, mark, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM doc
), rest AS (
    SELECT doc_id, mark, count(*) AS n_lines, count(gone.i) AS n_removed,
           coalesce(string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY line.i), '') AS text
    FROM line LEFT JOIN gone USING (doc_id, mark, i) GROUP BY doc_id, mark
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, rest.text
FROM documents d LEFT JOIN rest ON rest.doc_id = d.doc_id AND rest.mark = md5(d.text)
"""


def _apart(l: str, b: str, ol: str, ob: str) -> str:
    """Likelihood-ratio test of two groups of labelled pages and their bad ones."""
    total, bad = f"({l} + {ol} + 2)", f"({b} + {ob} + 1)"
    cells = [
        (f"({b} + 0.5::DOUBLE)", f"({l} + 1)", bad), (f"({l} - {b} + 0.5::DOUBLE)", f"({l} + 1)", f"({total} - {bad})"),
        (f"({ob} + 0.5::DOUBLE)", f"({ol} + 1)", bad), (f"({ol} - {ob} + 0.5::DOUBLE)", f"({ol} + 1)", f"({total} - {bad})"),
    ]
    ratio = " + ".join(f"{cell} * ln({cell} * {total} / ({row} * {column}))" for cell, row, column in cells)
    return f"coalesce({l} > 0 AND {ol} > 0 AND 2 * ({ratio}) > 1.96 * 1.96, false)"


def _op1(support: int = 2, testable: int = 4, prior: int = 4) -> str:
    return f"""
WITH RECURSIVE known AS (
    SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels
    WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
), address AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM address
), start AS (
    SELECT row_number() OVER () AS r, page_id, host, path, string_split(regexp_replace(path, '^/', ''), '/') AS segments,
           (bad IS NOT NULL)::BIGINT AS l, coalesce(bad, 0)::BIGINT AS b
    FROM part LEFT JOIN known ON doc_id = page_id
), tree AS (
    SELECT r, host, segments, l, b, '' AS template, 0 AS level FROM start
    UNION ALL
    SELECT r, host, segments, l, b,
           template || CASE WHEN side IS NULL THEN '/*' WHEN NOT alike THEN '/' || segment
               ELSE '/{{' || min(segment) OVER (PARTITION BY host, template, side, alike) || '}}' END, level + 1
    FROM (
        SELECT *, side <> 'only' AND sl > cl AND NOT {_apart("cl", "cb", "(sl - cl)", "(sb - cb)")} AS alike FROM (
            SELECT *, sum(l) OVER w AS sl, sum(b) OVER w AS sb FROM (
                SELECT *, max(pl) OVER () >= {testable} AS go,
                       CASE WHEN regexp_matches(segment, '^[0-9]+$') OR cn < {support} THEN NULL WHEN cn = pn THEN 'only'
                            WHEN {_apart("cl", "cb", "(pl - cl)", "(pb - cb)")}
                            THEN CASE WHEN cb * (pl - cl) > (pb - cb) * cl THEN 'worse' ELSE 'better' END END AS side
                FROM (
                    SELECT *, count(*) OVER c AS cn, sum(l) OVER c AS cl, sum(b) OVER c AS cb,
                           count(*) OVER p AS pn, sum(l) OVER p AS pl, sum(b) OVER p AS pb
                    FROM (SELECT *, segments[level + 1] AS segment FROM tree WHERE len(segments) > level)
                    WINDOW c AS (PARTITION BY host, template, segment), p AS (PARTITION BY host, template)))
            WINDOW w AS (PARTITION BY host, template, side)))
    WHERE go
), grown AS (
    SELECT r, arg_max(template, level) || CASE WHEN len(any_value(segments)) > max(level) THEN '/**' ELSE '' END AS template
    FROM tree GROUP BY r
), page AS (
    SELECT page_id, host, path, template, l, b FROM start JOIN grown USING (r)
),
t AS (SELECT host, template, sum(l) AS l, sum(b) AS b FROM page GROUP BY ALL),
base AS (SELECT coalesce(1 - sum(b) / nullif(sum(l), 0), 1) AS base FROM t),
h AS (SELECT host, (sum(l) - sum(b) + {prior} * any_value(base)) / (sum(l) + {prior}) AS share FROM t, base GROUP BY host),
good AS (SELECT host, template, (l - b + {prior} * share) / (l + {prior}) AS good FROM t JOIN h USING (host)),
rules(rule, name, start, decision) AS (VALUES
    ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
    ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fit AS (SELECT DISTINCT host, path, arg_max(rule, length(rule)) AS rule, arg_max(decision, length(rule)) AS decision
        FROM (SELECT DISTINCT host, path FROM page) p
        JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(decision, CASE WHEN good < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template
FROM page JOIN good USING (host, template) LEFT JOIN fit USING (host, path)
"""


OP1 = _op1()

OP11 = r"""
WITH doc AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), label AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
    FROM doc LEFT JOIN label USING (doc_id)
), cell AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM failed GROUP BY ALL
), letter(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), permutation AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letter a, letter b, letter c, letter d, letter e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), place AS (
    SELECT filter_order, step, bits[step] AS bit, list_sum(bits[:step - 1]) AS before
    FROM permutation, range(1, 6) r(step)
), figure AS (
    SELECT part, filter_order, step, bit, coalesce(before, 0)::INTEGER AS before,
           coalesce(sum(n) FILTER (mask & (coalesce(before, 0)::INTEGER | bit) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (mask & coalesce(before, 0)::INTEGER = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & coalesce(before, 0)::INTEGER <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (mask & coalesce(before, 0)::INTEGER = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (mask & coalesce(before, 0)::INTEGER = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
    FROM place, cell GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM figure
"""

OP13 = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), word AS (
    SELECT r, lang, source, unnest(w) AS term FROM doc
), counted AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM word GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL HAVING sum(d) >= 30
), language AS (
    SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), in_group AS (
    SELECT lang, source, coalesce(sum(n), 0) AS n
    FROM (SELECT DISTINCT lang, source FROM doc)
    LEFT JOIN (SELECT counted.* FROM counted JOIN kept USING (lang, term)) USING (lang, source)
    GROUP BY ALL
), share AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS cnt,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v) AS p,
           1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS q
    FROM in_group g JOIN language l USING (lang) JOIN kept k USING (lang)
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM in_group a JOIN in_group b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pair UNION ALL
          SELECT lang, source, 'term', term, p - q FROM share WHERE cnt > 0 AND p > q)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": OP1,
    "op2_benchmark_decontamination": OP2,
    "op5_warc": OP5,
    "op7_ngram_jaccard_join": OP7,
    "op9_line_dedup": OP9,
    "op11_filter_audit": OP11,
    "op13_source_divergence": OP13,
}
