"""The quality rules' counts and verdicts as DuckDB SQL."""

from __future__ import annotations

from tsprobe.llm.quality_rules import BOILERPLATE, MENU

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = "[#*$%&|<>]"


def _count(value: str, pattern: str) -> str:
    return f"len(regexp_extract_all({value}, '{pattern}'))"


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_PHRASE = " OR ".join(f"contains(lower(bare), '{p}')" for p in BOILERPLATE)

RULES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d)),
g AS (SELECT doc_id, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest(range(0, 3)) AS k) WHERE n > 1 GROUP BY 1),
b AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT *, trim(regexp_replace(line, '{_SPACE}+$', '')) AS bare, length(line) - {_count("line", _SPACE)} AS chars, regexp_matches(line, '{_WORD}') AS has FROM l),
j AS (SELECT *, CASE WHEN NOT has THEN NULL
  WHEN {_count("line", _SYMBOL)} * 10 > length(line) OR {_count("line", "!!")} * 3 > {_count("line", _WORD)} THEN 'noisy'
  WHEN {_count("line", "[|»›•·]")} >= 2 OR lower(bare) IN ({_listed(MENU)}) THEN 'navigation'
  WHEN length(line) <= 300 AND ({_PHRASE}) THEN 'boilerplate'
  WHEN NOT regexp_matches(line, '[.!?:;…]["''”’»)\]]*({_SPACE}|$)') THEN 'unpunctuated' END AS failed FROM m),
s AS (SELECT doc_id, count(CASE WHEN has THEN 1 END) - count(DISTINCT CASE WHEN has THEN line END) AS n_dup_lines,
  CAST(coalesce(sum(CASE WHEN failed IS NOT NULL THEN chars END), 0) AS BIGINT) AS lost_chars,
  count(CASE WHEN failed = 'unpunctuated' THEN 1 END) AS n_unpunctuated, count(CASE WHEN failed = 'noisy' THEN 1 END) AS n_noisy,
  count(CASE WHEN failed = 'navigation' THEN 1 END) AS n_navigation, count(CASE WHEN failed = 'boilerplate' THEN 1 END) AS n_boilerplate FROM j GROUP BY 1),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(length(t) - {_count("t", _SPACE)} AS BIGINT) AS word_chars,
  CAST({_count("t", _SYMBOL)} AS BIGINT) AS n_symbols, n_dup_lines, lost_chars, n_unpunctuated, n_noisy, n_navigation, n_boilerplate
  FROM d LEFT JOIN b USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM a)
SELECT *, NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept FROM f"""
