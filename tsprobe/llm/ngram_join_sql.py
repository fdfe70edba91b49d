"""The n-gram join as DuckDB SQL, with exact n-grams in place of hashes and bands."""

JOIN_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT t, min(doc_id) AS id, count(*) AS copies FROM d GROUP BY 1),
w AS (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM x),
p AS (SELECT id, len(ws) AS n, unnest(range(1, greatest(len(ws) - 3, 2))) AS i, ws FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
k AS (SELECT c.a, c.b FROM c JOIN n u ON u.id = c.a JOIN n v ON v.id = c.b WHERE c.c * 5 >= 4 * (u.n + v.n - c.c)),
r AS (SELECT id, id AS root FROM x UNION SELECT k.b, r.root FROM r JOIN k ON k.a = r.id),
o AS (SELECT id, min(root) AS class_id FROM r GROUP BY 1),
l AS (SELECT k.a AS id, CAST(sum(x.copies) AS BIGINT) AS n FROM k JOIN x ON x.id = k.b GROUP BY 1)
SELECT d.doc_id, o.class_id, x.id AS copy_id, coalesce(l.n, 0) + x.copies - 1 AS n_links
FROM d JOIN x USING (t) JOIN o ON o.id = x.id LEFT JOIN l ON l.id = x.id"""
