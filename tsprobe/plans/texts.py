"""Queries over trends, answers, digit codes, prompts and QA records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsprobe.functions import labels as fl
from tsprobe.functions import series as fs
from tsprobe.functions import text as ft
from tsprobe.operators import metrics, qa, splits, trends
from tsprobe.plans.inputs import SERIES_SQL, SPLIT_SQL, series, split_vectors
from tsprobe.plans.registry import derive, query, table
from tsprobe.plans.sampling import H
from tsprobe.plans.windowing import STRIDE, WIDTH, WINDOW_CTES, _windows

# equal neighbours are rare in the raw values, so trends run on tens
TREND_CTES = f"""
series AS (SELECT user_id, p, floor(v / 10) AS v FROM ({SERIES_SQL})),
steps AS (SELECT user_id, p, v, lead(v) OVER w AS nv, lag(v) OVER w AS pv FROM series WINDOW w AS (PARTITION BY user_id ORDER BY p)),
t AS (SELECT *, CASE WHEN v = nv THEN 'steady' WHEN v < nv THEN 'increase' ELSE 'decrease' END AS trend,
      CASE WHEN pv = v THEN 'steady' WHEN pv < v THEN 'increase' WHEN pv > v THEN 'decrease' END AS ptrend FROM steps WHERE nv IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN ptrend IS NULL OR ptrend <> trend THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY p) - 1 AS seg FROM t),
segs AS (SELECT user_id, CAST(seg AS BIGINT) AS seg, any_value(trend) AS trend, round(min(p) * CAST(0.02 AS DOUBLE), 2) AS start_time, round((max(p) + 1) * CAST(0.02 AS DOUBLE), 2) AS end_time,
         arg_min(v, p) AS start_value, arg_max(nv, p) AS end_value, count(*) AS n_steps FROM g GROUP BY user_id, seg)"""


def _tens(spark, sf_dir):
    return series(spark, sf_dir).select("user_id", "p", F.floor(F.col("v") / 10).cast("double").alias("v"))


@query("step_trends", f"WITH {TREND_CTES} SELECT user_id, p, round(p * CAST(0.02 AS DOUBLE), 2) AS from_time, round((p + 1) * CAST(0.02 AS DOUBLE), 2) AS to_time, v::DOUBLE AS from_value, nv::DOUBLE AS to_value, trend FROM t")
def step_trends(spark, sf_dir):
    return trends.step_trends(_tens(spark, sf_dir), ["user_id"], "p", "v", 50).drop("starts")


@query("trend_segments", f"WITH {TREND_CTES} SELECT user_id, seg, trend, start_time, end_time, start_value::DOUBLE AS start_value, end_value::DOUBLE AS end_value, n_steps FROM segs")
def trend_segments(spark, sf_dir):
    return trends.trend_segments(_tens(spark, sf_dir), ["user_id"], "p", "v", 50)


@query("segment_values", f"""
WITH {TREND_CTES} SELECT user_id, CAST(seg AS BIGINT) AS seg, count(*) + 1 AS n_values, arg_min(v, p)::DOUBLE + sum(nv * (p - f + 2))::DOUBLE AS checksum
FROM (SELECT *, min(p) OVER (PARTITION BY user_id, seg) AS f FROM g) GROUP BY 1, 2""")
def segment_values(spark, sf_dir):
    out = trends.trend_segments(_tens(spark, sf_dir), ["user_id"], "p", "v", 50, with_values=True)
    return out.select("user_id", "seg", F.size("values").cast("bigint").alias("n_values"), fs.position_sum(F.col("values")).alias("checksum"))


@query("trend_totals", f"WITH {TREND_CTES} SELECT user_id, trend, round(sum(end_time - start_time), 2) AS total_time, count(*) AS n_segments FROM segs GROUP BY 1, 2")
def trend_totals(spark, sf_dir):
    return trends.trend_totals(trends.trend_segments(_tens(spark, sf_dir), ["user_id"], "p", "v", 50), ["user_id"])


@query("overall_trend", f"WITH {TREND_CTES} SELECT user_id, CASE WHEN arg_max(v, p) > arg_min(v, p) THEN 'upward' WHEN arg_max(v, p) < arg_min(v, p) THEN 'downward' ELSE 'steady' END AS overall FROM series GROUP BY 1")
def overall_trend(spark, sf_dir):
    return trends.overall_trend(_tens(spark, sf_dir), ["user_id"], "p", "v")


_WORDS = "CASE {t} WHEN 'increase' THEN ['increase', 'rise', 'growth'] WHEN 'upward' THEN ['increase', 'rise', 'growth'] WHEN 'steady' THEN ['steady', 'flat', 'constant'] ELSE ['decrease', 'fall', 'decline'] END[k]"
_TEXT_CTES = f"""
{WINDOW_CTES}, x AS (SELECT user_id, win, p - win * {STRIDE} AS o, floor(v / 10) AS v FROM wrows),
st AS (SELECT *, lead(v) OVER w AS nv, lag(v) OVER w AS pv FROM x WINDOW w AS (PARTITION BY user_id, win ORDER BY o)),
t AS (SELECT *, CASE WHEN v = nv THEN 'steady' WHEN v < nv THEN 'increase' ELSE 'decrease' END AS trend, CASE WHEN pv = v THEN 'steady' WHEN pv < v THEN 'increase' WHEN pv > v THEN 'decrease' END AS ptrend FROM st WHERE nv IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN ptrend IS NULL OR ptrend <> trend THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, win ORDER BY o) AS seg FROM t),
keyed AS (SELECT user_id, win, CAST('0x' || substr(md5('42|' || user_id || '|' || win), 1, 8) AS BIGINT) % 3 + 1 AS k,
          CASE WHEN arg_max(v, o) > arg_min(v, o) THEN 'upward' WHEN arg_max(v, o) < arg_min(v, o) THEN 'downward' ELSE 'steady' END AS alltrend FROM x GROUP BY 1, 2),
segs AS (SELECT user_id, win, seg, any_value(trend) AS trend, min(o) * CAST(0.02 AS DOUBLE) AS a, (max(o) + 1) * CAST(0.02 AS DOUBLE) AS b FROM g GROUP BY 1, 2, 3),
tot AS (SELECT user_id, win, k, trend, round(sum(b - a), 2) AS tt, count(*) AS n, min(seg) AS f FROM segs JOIN keyed USING (user_id, win) GROUP BY 1, 2, 3, 4)"""


def _texts(spark, sf_dir):
    w = _windows(spark, sf_dir).select("user_id", "win", F.transform("rows.v", lambda v: F.floor(v / 10).cast("double")).alias("x"))
    return trends.trend_text(w, "x", 50, "sensor", ["user_id", "win"])


@query("trend_summary", f"""
WITH {_TEXT_CTES}, p AS (SELECT user_id, win, count(*) AS nk, sum(n) AS ns, string_agg({_WORDS.format(t='trend')} || ' for ' || printf('%.2f', tt) || ' seconds', ', ' ORDER BY trend) AS spent FROM tot GROUP BY 1, 2)
SELECT user_id, win, 'The sensor runs from 0.00 to 0.30 seconds with ' || CASE WHEN nk = 1 THEN '1 kind of trend' ELSE nk || ' kinds of trend in ' || CAST(ns AS BIGINT) || ' segments' END || ': ' || spent || '.'
 || CASE WHEN ns > 1 THEN ' Overall: ' || {_WORDS.format(t='alltrend')} || '.' ELSE '' END AS summary FROM p JOIN keyed USING (user_id, win)""")
def trend_summary(spark, sf_dir):
    return _texts(spark, sf_dir).select("user_id", "win", "summary")


@query("trend_list", f"""
WITH {_TEXT_CTES}, l AS (SELECT user_id, win, string_agg(printf('%.2f', a) || 's to ' || printf('%.2f', b) || 's: ' || {_WORDS.format(t='trend')}, chr(10) ORDER BY seg) AS l FROM segs JOIN keyed USING (user_id, win) GROUP BY 1, 2),
c AS (SELECT user_id, win, count(*) AS nk, string_agg('Number of ' || {_WORDS.format(t='trend')} || ' segments: ' || n, chr(10) ORDER BY n DESC, f) AS c FROM tot GROUP BY 1, 2)
SELECT user_id, win, l || CASE WHEN nk > 1 THEN chr(10) || c ELSE '' END AS trend_list FROM l JOIN c USING (user_id, win)""")
def trend_list(spark, sf_dir):
    return _texts(spark, sf_dir).select("user_id", "win", "trend_list")


@query("totals_table", f"""
WITH {_TEXT_CTES} SELECT user_id, win, '| trend | total_time |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || trend || ' | ' || CAST(tt AS VARCHAR) || ' |', chr(10) ORDER BY trend) AS totals_table FROM tot GROUP BY 1, 2""")
def totals_table(spark, sf_dir):
    return _texts(spark, sf_dir).select("user_id", "win", "totals_table")


@query("trend_qa", f"WITH {_TEXT_CTES} SELECT user_id, win, 'ts' AS channel, 'simple_trend' AS type, count(*) AS n_segments FROM segs GROUP BY 1, 2")
def trend_qa(spark, sf_dir):
    """QA records built from the trend texts; the trend list has one line per segment."""
    t = _texts(spark, sf_dir).select("user_id", "win", "trend_list")
    docs = qa.trend_record(t, "trend_list")
    n = F.size(F.regexp_extract_all(F.col("pair.A"), F.lit("s to "), F.lit(0)))
    return docs.select("user_id", "win", F.lit("ts").alias("channel"), F.col("pair.type").alias("type"), n.cast("bigint").alias("n_segments"))


ANSWERS_SQL = """
SELECT o_orderkey AS id, CASE o_orderkey % 7
 WHEN 0 THEN 'The answer is [' || substr('ABCDEF', CAST(1 + o_custkey % 6 AS INT), 1) || '] x'
 WHEN 1 THEN 'maybe [A], then [' || substr('ABCDEF', CAST(1 + o_custkey % 6 AS INT), 1) || ']'
 WHEN 2 THEN 'Final answer: [Q] but [B]' WHEN 3 THEN 'no idea' WHEN 4 THEN 'Answer - [ C ] done'
 WHEN 5 THEN 'Final answer:[D], though the answer is [E]' ELSE '[Z] [' || o_orderstatus || ']' END AS txt, CAST(o_custkey % 5 AS INT) AS gt FROM {orders}"""
LETTERS = {c: i for i, c in enumerate("ABCDE")}
_LETTER_CTES = f"""
t AS ({ANSWERS_SQL}), c AS (SELECT *, trim(regexp_extract(txt, '[Tt]he answer is\\s*\\[([^\\[\\]]+)\\]', 1)) AS a1, trim(regexp_extract(txt, '[Ff]inal answer\\s*[:\\-]?\\s*\\[([^\\[\\]]+)\\]', 1)) AS a2,
 trim(regexp_extract(txt, '[Aa]nswer\\s*[:\\-]?\\s*\\[([^\\[\\]]+)\\]', 1)) AS a3, list_transform(regexp_extract_all(txt, '\\[([^\\[\\]]+)\\]', 1), lambda x: trim(x)) AS toks FROM t),
r AS (SELECT id, gt, CASE WHEN a1 IN ('A','B','C','D','E') THEN a1 WHEN a2 IN ('A','B','C','D','E') THEN a2 WHEN a3 IN ('A','B','C','D','E') THEN a3
 ELSE list_filter(toks, lambda x: x IN ('A','B','C','D','E'))[-1] END AS l FROM c),
p AS (SELECT id, gt, coalesce(l, 'no valid letter found') AS letter, coalesce(ascii(l) - 65, -1) AS pred FROM r)"""


@query("extract_letter", f"WITH {_LETTER_CTES} SELECT id, letter, pred, CASE WHEN pred >= 0 AND pred = gt THEN 1 ELSE 0 END AS correct FROM p")
def extract_letter(spark, sf_dir):
    out = ft.extract_letter(derive(spark, sf_dir, ANSWERS_SQL), "txt", LETTERS)
    return out.select("id", "letter", "pred", metrics.correct_flag(F.col("gt"), F.col("pred")).alias("correct"))


NUMBERS_SQL = """
SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'next hour will be ' || CAST(value AS VARCHAR(20)) WHEN 1 THEN '-5' WHEN 2 THEN '' WHEN 3 THEN 'from 3 to -' || CAST(value AS VARCHAR(20)) || ' C'
 WHEN 4 THEN 'none' ELSE '.5 then ' || user_id END AS txt FROM {events}"""


@query("last_number", f"WITH t AS ({NUMBERS_SQL}) SELECT id, try_cast(regexp_extract_all(txt, '[-+]?\\d*\\.\\d+|\\d+')[-1] AS DOUBLE) AS v FROM t")
def last_number(spark, sf_dir):
    return derive(spark, sf_dir, NUMBERS_SQL).select("id", ft.last_number(F.col("txt")).alias("v"))


FORECAST_SQL = """
SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'Sure: {"analysis": "up", "forecast": [' || CAST(value AS VARCHAR(20)) || ', 2, 3.25]} ok' WHEN 1 THEN '{"analysis": "x", "forecast": [1, 2]}'
 WHEN 2 THEN 'no json ' || event_id WHEN 3 THEN '{"forecast": [1, 2, 3]}' ELSE '{"analysis": "flat", "forecast": ["1.5", 2.5, ' || user_id || ']} ' END AS txt FROM {events}"""


@query("parse_forecast", f"""
WITH t AS ({FORECAST_SQL}), j AS (SELECT id, try_cast(nullif(regexp_extract(txt, '\\{{.*\\}}', 0, 's'), '') AS JSON) AS j FROM t),
f AS (SELECT id, j->>'$.analysis' AS analysis, list_transform(CAST(j->'$.forecast' AS JSON[]), lambda x: try_cast(x->>'$' AS DOUBLE)) AS f FROM j),
o AS (SELECT *, coalesce(analysis IS NOT NULL AND len(f) = 3 AND len(list_filter(f, lambda x: x IS NULL)) = 0, false) AS ok FROM f)
SELECT id, CASE WHEN ok THEN analysis END AS analysis, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, CASE WHEN ok THEN round(list_sum(f), 3) END AS total FROM o""")
def parse_forecast(spark, sf_dir):
    out = ft.parse_forecast(derive(spark, sf_dir, FORECAST_SQL), "txt", 3)
    return out.select("id", "analysis", "status", F.round(fs.total(F.col("forecast")), 3).alias("total"))


@query("event_props", "SELECT event_id AS id, CAST(props->>'$.k' AS BIGINT) AS k FROM {events}")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k bigint")["k"].alias("k"))


HEADER_SQL = """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '  Assistant says:' || chr(10) || ' ' || text || ' ' WHEN 1 THEN ' ' || text ELSE 'assistant' END AS txt FROM {conversations}"""


@query("strip_header", f"WITH t AS ({HEADER_SQL}) SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN trim(substr(txt, strpos(txt, chr(10)) + 1), ' ' || chr(10) || chr(9) || chr(13)) WHEN 1 THEN trim(txt, ' ' || chr(10) || chr(9) || chr(13)) ELSE '' END) AS h FROM t")
def strip_header(spark, sf_dir):
    return derive(spark, sf_dir, HEADER_SQL).select("conv_id", "turn", F.md5(ft.strip_header(F.col("txt"))).alias("h"))


@query("digit_text", """
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: struct_pack(s := x < 0, n := CAST(abs(round_even(CAST(x AS DOUBLE) * 1000, 0)) AS BIGINT))) AS l FROM {embeddings})
SELECT vec_id, array_to_string(list_transform(l, lambda y: trim(regexp_replace(CASE WHEN y.s THEN '-' ELSE '' END || (y.n // 1000) || lpad(CAST(y.n % 1000 AS VARCHAR), 3, '0'), '(.)', '\\1 ', 'g'))), ' , ') AS txt FROM d""")
def digit_text(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", ft.digit_text(F.col("embedding")).alias("txt"))


@query("scaled_digit_text", """
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN vec_id % 10 = 0 AND i = 3 THEN 'n a n' WHEN vec_id % 10 = 1 AND i = 3 THEN '- i n f'
 ELSE CASE WHEN round_even(CAST(x AS DOUBLE) * 10000, 0) < 0 THEN '- ' ELSE '' END || trim(regexp_replace(CAST(CAST(abs(round_even(CAST(x AS DOUBLE) * 10000, 0)) AS BIGINT) AS VARCHAR), '(.)', '\\1 ', 'g')) END) AS l FROM {embeddings})
SELECT vec_id, array_to_string(l, ' ,') AS series_text, array_to_string(list_transform(range(1, 33), lambda j: l[2 * j - 1] || ' |' || l[2 * j]), ' ,') AS matrix_text FROM d""")
def scaled_digit_text(spark, sf_dir):
    odd = F.when(F.col("vec_id") % 10 == 0, float("nan")).when(F.col("vec_id") % 10 == 1, float("-inf"))
    v = F.transform("embedding", lambda x, i: F.when(i == 2, F.coalesce(odd, x.cast("double"))).otherwise(x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", ft.scaled_digit_text(F.col("v")).alias("series_text"), ft.scaled_digit_text(fs.reshape(F.col("v"), 2), matrix=True).alias("matrix_text"))


@query("json_and_space_text", """
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) / 8 AS VARCHAR)) AS l FROM {embeddings})
SELECT vec_id, '[' || array_to_string(l, ', ') || ']' AS json_text, array_to_string(l, ' ') AS space_text FROM d""")
def json_and_space_text(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000) / 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", ft.json_text(v).alias("json_text"), ft.space_text(v).alias("space_text"))


_CELLS = "list_transform(range(0, 16), lambda t: list_transform(embedding[t * 4 + 1 : t * 4 + 4], lambda x: CAST(round_even(CAST(x AS DOUBLE) * 1000, 0) / 1000 AS VARCHAR)))"


@query("serialize_series", f"""
WITH d AS (SELECT vec_id, {_CELLS} AS c FROM {{embeddings}}),
k AS (SELECT vec_id, unnest(range(1, 17)) AS k, c FROM d),
r AS (SELECT vec_id, k, ceil(16 / k) AS n, '[' || array_to_string(list_transform(list_filter(range(0, 16), lambda t: t % k = 0), lambda t: '[' || array_to_string(c[t + 1], ', ') || ']'), ', ') || ']' AS txt FROM k),
f AS (SELECT vec_id, length(txt) AS full_len FROM r WHERE k = 1)
SELECT vec_id, CAST(k AS INT) AS factor, txt AS "text" FROM r JOIN f USING (vec_id) WHERE (full_len <= 200 AND k = 1) OR (full_len > 200 AND k >= ceil(full_len / 200) AND (length(txt) <= 200 OR n <= 2))
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY k) = 1""")
def serialize_series(spark, sf_dir):
    """JSON text of (16, 4) series, thinned to 200 characters."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", fs.reshape(F.col("embedding"), 4).alias("x"))
    return ft.serialize_series(x, "x", "text", max_chars=200).select("vec_id", "factor", "text")


@query("serialize_wide_series", f"""
WITH d AS (SELECT vec_id, {_CELLS} AS c FROM {{embeddings}}),
k AS (SELECT vec_id, unnest(range(1, 17)) AS k, c FROM d),
r AS (SELECT vec_id, k, ceil(16 / k) AS n, '[' || array_to_string(list_transform(range(0, 4), lambda j: '[' || array_to_string(list_transform(list_filter(range(0, 16), lambda t: t % k = 0), lambda t: c[t + 1][j + 1]), ', ') || ']'), ', ') || ']' AS txt FROM k),
f AS (SELECT vec_id, length(txt) AS full_len FROM r WHERE k = 1)
SELECT vec_id, CAST(k AS INT) AS factor, txt AS "text" FROM r JOIN f USING (vec_id) WHERE (full_len <= 200 AND k = 1) OR (full_len > 200 AND k >= ceil(full_len / 200) AND (length(txt) <= 200 OR n <= 2))
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY k) = 1""")
def serialize_wide_series(spark, sf_dir):
    """The longer axis is thinned also when it is the second one."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", fs.transpose(fs.reshape(F.col("embedding"), 4)).alias("x"))
    return ft.serialize_series(x, "x", "text", max_chars=200).select("vec_id", "factor", "text")


@query("build_prompts", f"""
WITH d AS (SELECT vec_id, {_CELLS} AS c, embedding AS e FROM {{embeddings}})
SELECT vec_id, 'Which class?' || chr(10) || chr(10) || 'Answer:' || chr(10) || chr(10) || 'Here are the raw time series values (JSON):' || chr(10) || '[' || array_to_string(list_transform(c, lambda r: '[' || array_to_string(r, ', ') || ']'), ', ') || ']' AS json_prompt,
 md5(array_to_string(list_transform(e, lambda x: trim(regexp_replace(CASE WHEN x < 0 THEN '-' ELSE '' END || (CAST(abs(round_even(CAST(x AS DOUBLE) * 1000, 0)) AS BIGINT) // 1000) || lpad(CAST(CAST(abs(round_even(CAST(x AS DOUBLE) * 1000, 0)) AS BIGINT) % 1000 AS VARCHAR), 3, '0'), '(.)', '\\1 ', 'g'))), ' , ')) AS digit_prompt FROM d""")
def build_prompts(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", fs.reshape(F.col("embedding"), 4).alias("x"))
    a = qa.build_prompts(x, "ts,ust", "x", " Which class? ", "Answer:").withColumnRenamed("user_text", "json_prompt")
    b = qa.build_prompts(a, "lets", "x")
    return b.select("vec_id", "json_prompt", F.md5("user_text").alias("digit_prompt"))


@query("forecast_prompt", f"""
WITH {WINDOW_CTES}, h AS (SELECT user_id, win, '[' || string_agg(CAST(round_even(v * 100, 0) / 100 AS VARCHAR), ', ' ORDER BY p) || ']' AS h FROM wrows WHERE p >= win * {STRIDE} + 4 GROUP BY 1, 2)
SELECT user_id, win, 'A plot of the last 12 steps is attached.' || chr(10) || 'Values of the last 12 steps: ' || h || chr(10) || 'Forecast the next value. Answer with: I predict the next value will be <value>' AS prompt FROM h""")
def forecast_prompt(spark, sf_dir):
    return _windows(spark, sf_dir).select("user_id", "win", qa.forecast_prompt(F.col("rows.v"), "dv", 12).alias("prompt"))


@query("few_shot_conversations", f"""
WITH s AS ({SPLIT_SQL}), r AS (SELECT idx, y, row_number() OVER (PARTITION BY y ORDER BY {H(1, 'idx')}, idx) AS rank FROM s WHERE split = 'train'),
m AS (SELECT count(*) AS n, string_agg('example ' || idx || ' -> The answer is ' || y, '; ' ORDER BY rank, y) AS t FROM r WHERE rank <= 2)
SELECT idx, n + 1 AS n_messages, t || '; query ' || idx AS messages FROM s, m WHERE split = 'test'""")
def few_shot_conversations(spark, sf_dir):
    s = split_vectors(spark, sf_dir).select("idx", "y", "split")
    shots = splits.interleave_shots(splits.few_shots(s.where("split = 'train'"), "y", ["idx"], 2, seed=1), "y")
    shots = shots.select(
        "shot_order", F.concat(F.lit("example "), F.col("idx").cast("string")).alias("q"), F.concat(F.lit("The answer is "), F.col("y").cast("string")).alias("a")
    )
    ask = s.where("split = 'test'").select("idx", F.concat(F.lit("query "), F.col("idx").cast("string")).alias("q"))
    out = qa.assemble_conversations(ask, qa.few_shot_messages(shots, "shot_order", "q", "a"), "q")
    text = F.array_join(F.transform("messages", lambda m: F.concat_ws(" -> ", m["user"], m["assistant"])), "; ")
    return out.select("idx", F.size("messages").cast("bigint").alias("n_messages"), text.alias("messages"))


_REGIONS = "(SELECT n_nationkey AS idx, n_regionkey AS y, r_name AS name, chr(65 + n_regionkey) AS letter FROM {nation} JOIN {region} ON n_regionkey = r_regionkey)"


def _region_options(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("label"), F.col("r_name").alias("name"))
    return fl.with_letters(r, "label").select("label", "letter", "name")


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_regionkey").alias("y"))


@query("classification_qa", f"""
WITH o AS (SELECT string_agg('[' || chr(65 + r_regionkey) || '] ' || r_name, ', ' ORDER BY r_regionkey) AS line FROM {{region}}), n AS {_REGIONS}
SELECT idx, c AS channel, 'Options for this window: ' || line || chr(10) || 'Pick one and close with the line "The answer is [X] [CLASS_NAME]".' AS q,
 'The answer is [' || letter || '] ' || name AS a, 'Class of the window: [' || letter || '] ' || name AS summary FROM n, o, (SELECT unnest(['x', 'y']) AS c)""")
def classification_qa(spark, sf_dir):
    out = qa.classification_qa(_nations(spark, sf_dir), "y", _region_options(spark, sf_dir), ["x", "y"])
    rows = out.select("idx", "summaries", F.explode("qa_pairs").alias("channel", "pairs"))
    p = F.get("pairs", F.lit(0))
    return rows.select("idx", "channel", p["Q"].alias("q"), p["A"].alias("a"), F.try_element_at("summaries", F.col("channel"))["A"].alias("summary"))


@query("stage2_class_qa", f"""
WITH n AS {_REGIONS} SELECT idx, 'x: Class of the window: [' || letter || '] ' || name || chr(10) || 'z:' AS smry, 'x: The answer is [' || letter || '] ' || name || chr(10) || 'z:' AS trend_text, name AS a FROM n""")
def stage2_class_qa(spark, sf_dir):
    q = qa.classification_qa(_nations(spark, sf_dir), "y", _region_options(spark, sf_dir), ["x", "y"])
    named = fl.attach_labels(q, "y", _region_options(spark, sf_dir))
    out = qa.stage2_class_qa(named, ["x", "z"], F.col("name"))
    return out.select("idx", F.col("qa_pair.smry").alias("smry"), F.col("qa_pair.trend_text").alias("trend_text"), F.col("qa_pair.A").alias("a"))


@query("stage2_text_qa", """
SELECT o_orderkey AS idx, 'Choose the class of this time-series window:' || chr(10) || chr(10) || '1. F.' || chr(10) || '2. O.' || chr(10) || '3. P.' || chr(10) || chr(10) || 'End with one option line exactly.' AS q,
 'Comparing the channel patterns over time.' || chr(10) || chr(10) || CASE o_orderstatus WHEN 'F' THEN '1. F.' WHEN 'O' THEN '2. O.' ELSE '3. P.' END AS a FROM {orders}""")
def stage2_text_qa(spark, sf_dir):
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    out = qa.stage2_text_qa(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), y.alias("y")), "y", ["F", "O", "P"])
    return out.select("idx", F.col("qa_pair.Q").alias("q"), F.col("qa_pair.A").alias("a"))


def _documents_as_qa(spark, sf_dir, first: bool = True, rest: bool = True):
    """A document as a QA record: first line is the summary, other lines are answers (empty ones have none)."""
    item = lambda a: F.struct(F.lit("q").alias("Q"), F.nullif(a, F.lit("")).alias("A"))
    lines = F.split("text", "\n")
    summaries = F.create_map(F.lit("ts"), item(F.get(lines, F.lit(0))))
    pairs = F.create_map(F.lit("ts"), F.transform(F.slice(lines, 2, 1 << 30), item))
    empty = "map<string,struct<Q:string,A:string>>"
    return table(spark, sf_dir, "documents").select(
        "doc_id", (summaries if first else F.lit(None).cast(empty)).alias("summaries"),
        (pairs if rest else F.lit(None).cast("map<string,array<struct<Q:string,A:string>>>")).alias("qa_pairs"),
    )


_LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


@query("collect_answers", f"SELECT doc_id, len({_LINES}) AS n, md5(array_to_string({_LINES}, chr(10) || chr(10))) AS h FROM {{documents}} WHERE len({_LINES}) > 0")
def collect_answers(spark, sf_dir):
    out = qa.join_answers(qa.collect_answers(_documents_as_qa(spark, sf_dir), "doc_id"))
    return out.select("doc_id", F.size("answers").cast("bigint").alias("n"), F.md5("text").alias("h"))


@query("merge_answer_stages", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents}), m AS (SELECT doc_id, list_concat(list_filter(l[2:], lambda x: x <> ''), list_filter(l[1:1], lambda x: x <> '')) AS a FROM l)
SELECT doc_id, len(a) AS n, md5(array_to_string(a, '|')) AS h FROM m WHERE len(a) > 0""")
def merge_answer_stages(spark, sf_dir):
    stages = [qa.collect_answers(_documents_as_qa(spark, sf_dir, f, r), "doc_id") for f, r in ((False, True), (True, False))]
    out = qa.merge_answers(stages, "doc_id")
    return out.select("doc_id", F.size("answers").cast("bigint").alias("n"), F.md5(F.array_join("answers", "|")).alias("h"))


@query("window_records", f"""
WITH {WINDOW_CTES}, c AS (SELECT user_id, win, max(CASE WHEN p = win * {STRIDE} + {WIDTH // 2} THEN label END) AS y FROM wrows GROUP BY 1, 2)
SELECT user_id, win, upper(y) AS activity_name, y AS activity, 0 AS seg_from, {WIDTH} AS seg_to FROM c""")
def window_records(spark, sf_dir):
    from tsprobe.operators.windows import label_center

    w = label_center(_windows(spark, sf_dir), "label", WIDTH)
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.upper("event_type").alias("name")).distinct()
    r = qa.window_records(w, "y", "rows", names, "win", F.col("user_id").cast("string"))
    return r.select("user_id", "win", *[F.col(f"record.{c}").alias(c) for c in ("activity_name", "activity")], F.col("record.segments")[0].alias("seg_from"), F.col("record.segments")[1].alias("seg_to"))


@query("export_records", f"""
WITH {WINDOW_CTES} SELECT CASE WHEN user_id % 10 = 3 THEN 'dropped_shape' WHEN user_id % 10 = 4 THEN 'dropped_nan' ELSE 'kept' END AS reason, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM wins GROUP BY 1, 2""")
def export_records(spark, sf_dir):
    """Question/series/label rows; windows with NaN or a wrong shape are counted by reason."""
    w = _windows(spark, sf_dir)
    v = F.when(F.col("user_id") % 10 == 3, F.slice("rows.v", 1, WIDTH - 1)).otherwise(F.col("rows.v"))
    x = F.transform(v, lambda a, i: F.array(F.when((F.col("user_id") % 10 == 4) & (i == 5), float("nan")).otherwise(a)))
    rows = w.select("user_id", F.when(F.col("user_id") % 2 == 0, "train").otherwise("test").alias("split"), x.alias("x"), F.lit(1).alias("y"))
    return qa.export_records(rows, F.lit("Which class?"), "x", "y", WIDTH, 1).groupBy("split", "reason").agg(F.count("*").alias("n"))
