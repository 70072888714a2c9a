"""DuckDB SQL with the same results as the corpus queries that SQL can express."""

from __future__ import annotations

#: Groups by exact n-gram sets: all pairs that share an n-gram, and components by walking links.
NGRAM_JOIN = r"""
WITH RECURSIVE texts AS (
    SELECT text, min(doc_id) AS one, count(*) - 1 AS n_copies,
           regexp_extract_all(lower(text), '\S+') AS w
    FROM documents GROUP BY text
), grams AS (
    SELECT DISTINCT one, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
    FROM texts, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT one, count(*) AS n FROM grams GROUP BY one
), links AS (
    SELECT a.one AS x, b.one AS y FROM grams a JOIN grams b ON a.g = b.g AND a.one <> b.one
    JOIN sizes s ON s.one = a.one JOIN sizes t ON t.one = b.one
    GROUP BY a.one, b.one, s.n, t.n HAVING count(*) >= 0.8 * (s.n + t.n - count(*))
), reach(x, y) AS (
    SELECT one, one FROM texts UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), classes AS (SELECT x AS one, min(y) AS class_id FROM reach GROUP BY x
), degrees AS (SELECT x AS one, count(*) AS n_links FROM links GROUP BY x)
SELECT d.doc_id, c.class_id, coalesce(g.n_links, 0) AS n_links, t.n_copies
FROM documents d JOIN texts t ON t.text = d.text JOIN classes c ON c.one = t.one LEFT JOIN degrees g ON g.one = t.one
"""

DECONTAMINATION = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), wins AS (
    SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
    FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS r(i) WHERE len(w) > 0
), grams AS (
    SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM d, (SELECT DISTINCT k FROM wins), unnest(range(1, len(w) - k + 2)) AS r(i)
), hits AS (SELECT rid, i, k, item FROM grams JOIN wins USING (k, g)
), places AS (SELECT DISTINCT rid, p FROM hits, unnest(range(i, i + k)) AS r(p)
), counted AS (
    SELECT rid, count(*) AS n_hit, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans
    FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM places) GROUP BY rid
), owners AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN counted USING (rid) LEFT JOIN owners USING (rid)
"""

LINE_FREQUENCY = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n
    FROM d, unnest(range(1, len(w) - 1)) AS r(i)
), repeats AS (
    SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM grams, unnest([0, 1, 2]) AS r(k) WHERE n > 1 GROUP BY rid
), lines AS (
    SELECT rid, doc_id, host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
    FROM (SELECT rid, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid
), normal AS (
    SELECT rid, doc_id, host, len(lw) AS n, regexp_replace(translate(array_to_string(lw, ' '),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS norm FROM lines
), hosts AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY host
), frequent AS (
    SELECT host, norm FROM normal JOIN hosts USING (host) GROUP BY host, norm, host_docs
    HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.002 * host_docs
), removed AS (
    SELECT rid, count(*) AS n_lines, sum(n) AS n_gone FROM normal JOIN frequent USING (host, norm) GROUP BY rid
), all_counts AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
           coalesce(n_lines, 0) AS n_removed_lines, (len(w) - coalesce(n_gone, 0))::BIGINT AS n_kept_words
    FROM d LEFT JOIN repeats USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN removed USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_kept_words >= n_words AS kept
FROM all_counts
"""

#: CRC-32 byte by byte over each distinct feature, weights by bucket, and the highest twentieth of the eligible.
TARGET_RESAMPLING = r"""
WITH RECURSIVE steps AS (
    SELECT n, 0 AS i, n AS v FROM range(256) r(n)
    UNION ALL SELECT n, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE i < 8
), tab AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE i = 8
), d AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), runs AS (
    SELECT rid, array_to_string(w[i:i + k], ' ') AS g FROM d, (VALUES (0), (1), (2)) ks(k), unnest(range(1, len(w) - k + 1)) AS r(i)
), target_runs AS (
    SELECT array_to_string(w[i:i + k], ' ') AS g FROM b, (VALUES (0), (1), (2)) ks(k), unnest(range(1, len(w) - k + 1)) AS r(i)
), sums AS (
    SELECT g, xor(list_reduce(list_transform(range(0, len(hex(g)) // 2), lambda i: ('0x' || substr(hex(g), 2 * i + 1, 2))::BIGINT),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT g FROM runs UNION SELECT g FROM target_runs), tab
), s AS (SELECT bucket, count(*) AS n FROM runs JOIN sums USING (g) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM target_runs JOIN sums USING (g) GROUP BY bucket
), totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all
), gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)
                                   / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
    FROM s FULL JOIN t USING (bucket), totals
), weights AS (
    SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM runs JOIN sums USING (g) JOIN gain USING (bucket) GROUP BY rid
), scored AS (
    SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE)
                                                      / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN weights USING (rid)
), ranked AS (
    SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 5 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (rid)
"""

WARC = r"""
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), g AS (SELECT payload, max(page_id) AS last FROM p GROUP BY payload
), d AS (
    SELECT payload, last, octet_length(payload) AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
               (('0x' || substr(sha1(payload) || '00', 2 * (i * 5 // 8) + 1, 4))::BIGINT >> (11 - i * 5 % 8)) % 32, 1)), '') AS payload_digest
    FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN d USING (payload)
"""

ORACLES = {
    "op1_ngram_join": NGRAM_JOIN,
    "op2_decontamination": DECONTAMINATION,
    "op3_line_frequency": LINE_FREQUENCY,
    "op11_target_resampling": TARGET_RESAMPLING,
    "op13_warc": WARC,
}
