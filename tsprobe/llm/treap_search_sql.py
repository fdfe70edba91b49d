"""The ten best documents of each item as DuckDB SQL, over all pairs of items and documents that share a term."""

SEARCH_SQL = r"""
WITH lowered AS (
    SELECT doc_id, row_number() OVER () AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (
    SELECT doc_id, d, term, count(*) AS tf FROM lowered GROUP BY ALL
), sizes AS (
    SELECT d, sum(tf)::BIGINT AS n FROM counts GROUP BY d
), whole AS (
    SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole GROUP BY term, n_docs
), asked AS (
    SELECT DISTINCT item_id, i, term FROM (
        SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), scored AS (
    SELECT item_id, i, doc_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (d), whole GROUP BY item_id, i, doc_id, d
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
