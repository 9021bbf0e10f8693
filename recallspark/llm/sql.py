"""DuckDB SQL for the queries that SQL can say: every pair, every string, no index."""

from __future__ import annotations

_LINKED = """
reach(id, other) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), named AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
      AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings),
{_LINKED}
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN named ON named.id = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
"""

MINHASH_DEDUP = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM split
), items AS (SELECT r, len(s) AS n, unnest(s) AS item FROM sets),
shared AS (
    SELECT x.r AS a, y.r AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS inter FROM items x
    JOIN items y ON x.item = y.item AND x.r <> y.r AND x.n * 100 >= y.n * 80 AND y.n * 100 >= x.n * 80 GROUP BY ALL
), links AS (
    SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM shared JOIN sets x ON x.r = a JOIN sets y ON y.r = b
    WHERE inter * 100 >= (n + m - inter) * 80
), nodes AS (SELECT DISTINCT doc_id AS id FROM documents),
{_LINKED}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id,
    len(s) = 0 OR doc_id = component_id AS kept
FROM sets JOIN named ON named.id = sets.doc_id
"""

SUFFIX_DEDUP = """
WITH bytes AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
places AS (SELECT doc_id, unnest(h) AS byte, generate_subscripts(h, 1) AS i, len(h) AS n FROM bytes),
strings AS (
    SELECT doc_id, i, byte, CASE WHEN i + 49 <= n THEN md5_number(string_agg(byte, '') OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS s FROM places
), firsts AS (SELECT s, min(doc_id) AS d FROM strings WHERE s IS NOT NULL GROUP BY s),
marked AS (
    SELECT doc_id, i, byte, CASE WHEN d < doc_id THEN i END AS start FROM strings LEFT JOIN firsts USING (s)
), gone AS (
    SELECT doc_id, i, byte, coalesce(max(start) OVER (PARTITION BY doc_id ORDER BY i) >= i - 49, false) AS out FROM marked
), runs AS (SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM gone),
totals AS (
    SELECT doc_id, count(*) FILTER (WHERE out) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
        coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT out), '') AS kept
    FROM runs GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM bytes LEFT JOIN totals USING (doc_id)
"""

TARGET_RESAMPLING = r"""
WITH steps AS (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
        ORDER BY i) AS t FROM range(256) r(i)
), words AS (
    SELECT 0 AS side, doc_id AS id, row_number() OVER () AS place, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 1, item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), counted AS (SELECT side, place, word, count(*) AS n FROM (SELECT side, place, unnest(w) AS word FROM words) GROUP BY ALL),
spelled AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)),
bucketed AS (
    SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h) + 1, 2), lambda j: CAST('0x' || h[j:j+1] AS BIGINT))),
        lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM spelled, steps
), counts AS (
    SELECT bucket, sum(CASE side WHEN 0 THEN n ELSE 0 END) AS s, sum(CASE side WHEN 1 THEN n ELSE 0 END) AS t
    FROM counted JOIN bucketed USING (word) GROUP BY bucket
), totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (s_all + 10000)) / (CAST(s + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain
    FROM counts, totals
), sums AS (
    SELECT place, sum(n * gain) AS total FROM counted JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY place
), weighed AS (
    SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_features, CASE WHEN len(w) = 0 THEN 0
        ELSE CAST((total - (total % len(w) + len(w)) % len(w)) // len(w) AS BIGINT) END AS weight,
        CAST('0x' || substr(sha256('2024:' || id), 1, 8) AS BIGINT) AS h
    FROM words LEFT JOIN sums USING (place) WHERE side = 0
), scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM ranked WHERE r IS NOT NULL) // 100 THEN r END AS rank
FROM ranked
"""

EXACT_SEARCH = """
WITH usable AS (
    SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
      AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT q.vec_id AS query_id, q.v AS qv, x.vec_id, list_inner_product(q.v, x.v) AS score FROM usable q JOIN usable x
    ON q.vec_id % 20 = 0 AND len(q.v) = len(x.v) AND (q.vec_id <> x.vec_id OR q.v <> x.v)
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

FILL_IN_MIDDLE = r"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
        sha256('7:' || doc_id) AS hex FROM documents
), drawn AS (
    SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(hex, i * 8 + 1, 8) AS BIGINT)) AS h FROM split
), cut AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
            WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
    SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
), results AS (
    SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM results
"""
