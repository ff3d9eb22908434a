"""SQL in DuckDB's dialect for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

#: CRC-32 of the decimal text of a column, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({c}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)), 4294967295)"""

OP11 = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS words,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS own FROM turns GROUP BY conv_id),
convs AS (SELECT conv_id, {_CRC.format(c="conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base FROM own),
built AS (
    SELECT c.conv_id, t.place AS depth, role, words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
    UNION ALL
    SELECT c.conv_id, t.place - c.h + least(c.h, coalesce(b.own, 0)), role, words
    FROM convs c JOIN turns t USING (conv_id) LEFT JOIN own b ON b.conv_id = c.base WHERE t.place > c.h),
paths AS (
    SELECT conv_id, depth, length(words) AS chars, list({{r: role, w: words}}) OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM built
    UNION ALL SELECT conv_id, 0, 0, [] FROM own),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY node, depth),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
    SELECT a.node, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
    FROM nodes n LEFT JOIN children c USING (node) JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.node),
ends AS (
    SELECT p.node, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids
    FROM paths p JOIN (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id) l USING (conv_id, depth) GROUP BY p.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN children c USING (node) LEFT JOIN ends e USING (node)
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]"""

_TERMS = r"""regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP12 = f"""
WITH held AS (SELECT row_number() OVER () AS row, doc_id, unnest({_TERMS.format(c="text")}) AS term FROM documents),
lengths AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM held GROUP BY row),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format(c="text")}) AS term FROM benchmark) GROUP BY item_id, term),
tf AS (SELECT row, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
scores AS (
    SELECT a.item_id, l.doc_id, sum(a.times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * l.n * docs) // words))))::BIGINT AS score
    FROM tf JOIN asked a USING (term) JOIN weights w USING (term) JOIN lengths l USING (row), total GROUP BY a.item_id, l.row, l.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""
