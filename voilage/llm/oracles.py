"""The queries in plain SQL, where SQL can say what they return."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE lists AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
    FROM lists
), sets AS (
    SELECT s, min(doc_id) AS rep FROM shingles WHERE len(s) > 0 GROUP BY s
), by_set AS (
    SELECT d.doc_id, len(d.s) AS n, sets.rep FROM shingles d LEFT JOIN sets ON d.s = sets.s
), reps AS (
    SELECT sh.doc_id AS rep, sh.s FROM shingles sh JOIN sets ON sets.rep = sh.doc_id AND sets.s = sh.s
), items AS (
    SELECT rep, len(s) AS n, unnest(s) AS x FROM reps
), common AS (
    SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
    FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep
), links AS (
    SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, other) AS (
    SELECT rep, rep FROM reps UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
), tops AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM by_set LEFT JOIN tops ON rep = node
""",
    "op8_substring_dedup": r"""
WITH lists AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM lists WHERE len(w) >= 50)
), hits AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id
), gone AS (
    SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM hits GROUP BY doc_id
), kept AS (
    SELECT doc_id, w, gone, CASE WHEN gone IS NULL THEN w ELSE
        list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS k
    FROM lists LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
""",
    "op10_embedding_near_dedup": r"""
WITH RECURSIVE rows AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), fit AS (
    SELECT vec_id, v FROM rows
    WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95
), reach(node, other) AS (
    SELECT vec_id, vec_id FROM rows UNION SELECT node, b FROM reach JOIN links ON other = a
)
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, min(other) AS component_id,
    node = min(other) AS kept
FROM reach GROUP BY node
""",
    "op12_line_dedup": r"""
WITH lists AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
    SELECT doc_id, l[i] AS line, i,
        translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lists)
), judged AS (
    SELECT doc_id, line, i, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM lines
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op13_fill_in_middle": r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM units
), cut AS (
    SELECT doc_id, text, n, CASE
        WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
        array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
        array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
        AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut
""",
}
