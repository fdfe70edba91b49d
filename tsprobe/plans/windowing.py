"""Queries over windows of event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsprobe.functions import series as fs
from tsprobe.operators import ordering, scaling, splits, windows
from tsprobe.plans.inputs import SERIES_SQL, series
from tsprobe.plans.registry import query, table

WIDTH, STRIDE = 16, 8

WINDOW_CTES = f"""
series AS ({SERIES_SQL}),
lengths AS (SELECT user_id, count(*) AS n FROM series GROUP BY 1),
wins AS (SELECT user_id, unnest(generate_series(0, (n - {WIDTH}) // {STRIDE})) AS win FROM lengths WHERE n >= {WIDTH}),
wrows AS (SELECT w.user_id, w.win, s.p, s.v, s.label FROM wins w
          JOIN series s ON s.user_id = w.user_id AND s.p BETWEEN w.win * {STRIDE} AND w.win * {STRIDE} + {WIDTH} - 1),
votes AS (SELECT user_id, win, label, count(*) AS c FROM wrows GROUP BY ALL),
winner AS (SELECT user_id, win, label AS y, c AS cnt FROM votes
           QUALIFY row_number() OVER (PARTITION BY user_id, win ORDER BY c DESC, label) = 1)"""


def _windows(spark, sf_dir):
    return windows.count_windows(series(spark, sf_dir), ["user_id"], "p", ["v", "label"], WIDTH, STRIDE)


@query("window_class_split", f"""
WITH {WINDOW_CTES},
kept AS (SELECT * FROM winner WHERE cnt / {WIDTH} >= 0.3),
subjects AS (SELECT user_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42|' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT), user_id) AS r
             FROM (SELECT DISTINCT user_id FROM {{events}})),
parts AS (SELECT user_id, CASE WHEN r <= 5 THEN 'test' WHEN r <= 8 THEN 'dev' ELSE 'train' END AS split FROM subjects)
SELECT split, y, count(*) AS n_windows, count(DISTINCT user_id) AS n_subjects FROM kept JOIN parts USING (user_id) GROUP BY 1, 2""")
def window_class_split(spark, sf_dir):
    """Windows, majority label, subject-wise split, class histogram."""
    labelled = windows.label_majority(_windows(spark, sf_dir), "label", WIDTH, 0.3)
    people = table(spark, sf_dir, "events").select("user_id")
    cut = splits.group_split(labelled, people, "user_id", n_test=5, n_dev=3, seed=42)
    return splits.class_histogram(cut, ["split"], "y", "n_windows", subjects="user_id")


@query("count_windows_majority", f"""
WITH {WINDOW_CTES}
SELECT w.user_id, w.win, y, round(cnt / {WIDTH}, 6) AS share, round(sum(v), 4) AS sum_v,
       max(CASE WHEN p = w.win * {STRIDE} THEN v END) AS first_v, max(CASE WHEN p = w.win * {STRIDE} + {WIDTH} - 1 THEN v END) AS last_v
FROM wrows w JOIN winner USING (user_id, win) WHERE cnt / {WIDTH} >= 0.3 GROUP BY ALL""")
def count_windows_majority(spark, sf_dir):
    labelled = windows.label_majority(_windows(spark, sf_dir), "label", WIDTH, 0.3)
    total = F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["v"])
    return labelled.select(
        "user_id", "win", "y", F.round("share", 6).alias("share"), F.round(total, 4).alias("sum_v"),
        F.element_at("rows.v", 1).alias("first_v"), F.element_at("rows.v", -1).alias("last_v"),
    )


@query("count_windows_center", f"""
WITH {WINDOW_CTES}
SELECT user_id, win, max(CASE WHEN p = win * {STRIDE} + {WIDTH // 2} THEN label END) AS y, count(*) AS n FROM wrows GROUP BY 1, 2""")
def count_windows_center(spark, sf_dir):
    labelled = windows.label_center(_windows(spark, sf_dir), "label", WIDTH)
    return labelled.select("user_id", "win", "y", F.size("rows").cast("bigint").alias("n"))


@query("drop_null_class", f"""
WITH {WINDOW_CTES}
SELECT y, count(*) AS n FROM (SELECT user_id, win, max(CASE WHEN p = win * {STRIDE} + {WIDTH // 2} THEN label END) AS y FROM wrows GROUP BY 1, 2)
WHERE y <> 'error' GROUP BY 1""")
def drop_null_class(spark, sf_dir):
    labelled = windows.label_center(_windows(spark, sf_dir), "label", WIDTH)
    return labelled.where(F.col("y") != "error").groupBy("y").agg(F.count("*").alias("n"))


@query("lookback_horizon", f"""
WITH series AS ({SERIES_SQL}), lengths AS (SELECT user_id, count(*) AS n FROM series GROUP BY 1),
starts AS (SELECT user_id, n, unnest(generate_series(0, n - 30)) AS idx FROM lengths WHERE n >= 30),
j AS (SELECT st.user_id, idx, s.p - idx AS o, s.v FROM starts st JOIN series s ON s.user_id = st.user_id AND s.p BETWEEN idx AND idx + 29)
SELECT user_id, idx, max(CASE WHEN o = 0 THEN v END) AS x_first, max(CASE WHEN o = 23 THEN v END) AS x_last,
       round(sum(CASE WHEN o >= 24 THEN v END), 4) AS y_sum, max(CASE WHEN o = 24 THEN v END) AS y_first FROM j GROUP BY 1, 2""")
def lookback_horizon(spark, sf_dir):
    pairs = windows.lookback_horizon(series(spark, sf_dir), ["user_id"], "p", "v", 24, 6)
    return pairs.select(
        "user_id", "idx", F.element_at("x", 1).alias("x_first"), F.element_at("x", -1).alias("x_last"),
        F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 4).alias("y_sum"), F.element_at("y", 1).alias("y_first"),
    )


@query("chronological_split", f"""
WITH series AS ({SERIES_SQL}), lengths AS (SELECT user_id, count(*) - 29 AS n FROM series GROUP BY 1 HAVING count(*) >= 30),
idx AS (SELECT user_id, n, unnest(generate_series(0, n - 1)) AS idx FROM lengths)
SELECT user_id, CASE WHEN idx < floor(0.7 * n) THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx
FROM idx GROUP BY 1, 2""")
def chronological_split(spark, sf_dir):
    pairs = windows.lookback_horizon(series(spark, sf_dir), ["user_id"], "p", "v", 24, 6)
    parts = splits.chronological_split(pairs, ["user_id"], "idx", 0.7)
    return parts.groupBy("user_id", "split").agg(
        F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


@query("znorm_series", f"""
WITH series AS ({SERIES_SQL}), s AS (SELECT user_id, avg(v) AS m, stddev_pop(v) AS sd FROM series GROUP BY 1)
SELECT user_id, count(*) AS n, round(max((v - m) / (sd + 1e-6)), 6) AS z_max, round(min((v - m) / (sd + 1e-6)), 6) AS z_min,
       round(max(CASE WHEN p = 0 THEN (v - m) / (sd + 1e-6) END), 6) AS z_first
FROM series JOIN s USING (user_id) GROUP BY 1""")
def znorm_series(spark, sf_dir):
    z = scaling.znorm_long(series(spark, sf_dir), ["user_id"], "v")
    return z.groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.max("z"), 6).alias("z_max"), F.round(F.min("z"), 6).alias("z_min"),
        F.round(F.max(F.when(F.col("p") == 0, F.col("z"))), 6).alias("z_first"),
    )


@query("znorm_windows", f"""
WITH {WINDOW_CTES}, st AS (SELECT user_id, win, avg(v) AS m, stddev_pop(v) AS sd FROM wrows GROUP BY 1, 2)
SELECT user_id, win, round(sum((v - m) / (sd + 1e-6) * (p - win * {STRIDE} + 1)), 4) AS checksum FROM wrows JOIN st USING (user_id, win) GROUP BY 1, 2""")
def znorm_windows(spark, sf_dir):
    x = _windows(spark, sf_dir).select("user_id", "win", fs.as_matrix(F.col("rows.v")).alias("x"))
    z = scaling.znorm_windows(x, "x", on_constant="raise")
    return z.select("user_id", "win", F.round(fs.position_sum(F.flatten("x")), 4).alias("checksum"))


@query("channel_scaler", """
WITH base AS (SELECT CASE WHEN l_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, l_quantity AS c0, l_extendedprice AS c1, l_discount AS c2 FROM {lineitem}),
f AS (SELECT avg(c0) m0, stddev_pop(c0) s0, avg(c1) m1, stddev_pop(c1) s1, avg(c2) m2, stddev_pop(c2) s2 FROM base WHERE split = 'train')
SELECT split, count(*) AS n, round(avg((c0 - m0) / s0), 5) AS m0, round(stddev_pop((c0 - m0) / s0), 5) AS s0,
       round(avg((c1 - m1) / s1), 5) AS m1, round(stddev_pop((c1 - m1) / s1), 5) AS s1,
       round(avg((c2 - m2) / s2), 5) AS m2, round(stddev_pop((c2 - m2) / s2), 5) AS s2
FROM base, f GROUP BY 1""")
def channel_scaler(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    base = li.select(
        F.when(F.col("l_orderkey") % 4 == 0, "test").otherwise("train").alias("split"),
        F.array(F.array("l_quantity", "l_extendedprice", "l_discount")).alias("x"),
    )
    scaler = scaling.fit_channel_scaler(base.where("split = 'train'"), "x", 3)
    z = scaling.apply_scaler(base, "x", scaler)
    cells = [F.col("x")[0][i] for i in range(3)]
    aggs = [f(c).alias(f"{n}{i}") for i, c in enumerate(cells) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    out = z.groupBy("split").agg(F.count("*").alias("n"), *aggs)
    clean = [(F.round(n, 5) + 0.0).alias(n) for n in ("m0", "s0", "m1", "s1", "m2", "s2")]
    return out.select("split", "n", *clean)


@query("scaler_round_trip", """
SELECT count(*) AS n, 0 AS n_changed FROM {lineitem}""")
def scaler_round_trip(spark, sf_dir):
    """Inverse scaling restores every value."""
    base = table(spark, sf_dir, "lineitem").select(
        F.array(F.array("l_quantity", "l_extendedprice", "l_discount")).alias("x"), F.col("l_extendedprice").alias("orig")
    )
    scaler = scaling.fit_channel_scaler(base, "x", 3)
    back = scaling.invert_scaler(scaling.apply_scaler(base, "x", scaler), "x", scaler)
    bad = F.abs(F.col("x")[0][1] - F.col("orig")) > 1e-6
    return back.agg(F.count("*").alias("n"), F.count_if(bad).cast("int").alias("n_changed"))


@query("pad_trim_center", f"""
WITH series AS ({SERIES_SQL}), lens AS (SELECT user_id, count(*) AS n FROM series GROUP BY 1),
pos AS (SELECT user_id, v, CASE WHEN n >= 64 THEN p - (n - 64) // 2 ELSE p + (64 - n) // 2 END AS q FROM series JOIN lens USING (user_id))
SELECT user_id, 64 AS n, coalesce(max(CASE WHEN q = 0 THEN v END), 0.0) AS first_v, coalesce(max(CASE WHEN q = 63 THEN v END), 0.0) AS last_v,
       round(sum(CASE WHEN q BETWEEN 0 AND 63 THEN v * (q + 1) END), 3) AS checksum FROM pos GROUP BY 1""")
def pad_trim_center(spark, sf_dir):
    x = windows.pad_trim_center(series(spark, sf_dir), ["user_id"], "p", "v", 64)
    return x.select(
        "user_id", F.size("x").alias("n"), F.element_at("x", 1).alias("first_v"), F.element_at("x", -1).alias("last_v"),
        F.round(fs.position_sum(F.col("x")), 3).alias("checksum"),
    )


@query("chunk_left_pad", f"""
WITH series AS ({SERIES_SQL}), lens AS (SELECT user_id, count(*) AS n FROM series GROUP BY 1),
c AS (SELECT user_id, p // 20 AS chunk, least(20, n - (p // 20) * 20) AS length, p % 20 AS o, v FROM series JOIN lens USING (user_id))
SELECT user_id, chunk, length, 20 - length AS n_pad, round(sum(v * (o + 1 + 20 - length)), 3) AS checksum FROM c GROUP BY 1, 2, 3""")
def chunk_left_pad(spark, sf_dir):
    cut = windows.chunk_left_pad(series(spark, sf_dir), ["user_id"], "p", "v", 20)
    return cut.select(
        "user_id", "chunk", F.col("length").cast("bigint").alias("length"),
        F.size(F.filter("mask", lambda m: m == 0)).cast("bigint").alias("n_pad"),
        F.round(fs.position_sum(F.col("values")), 3).alias("checksum"),
    )


@query("token_windows", """
WITH t AS (SELECT doc_id, string_split(text, ' ') AS tok FROM {documents}), n AS (SELECT doc_id, tok, len(tok) AS n FROM t),
w AS (SELECT doc_id, tok, n, unnest(generate_series(0, greatest(0, CAST(ceil((n - 62) / 46) AS BIGINT)))) AS win FROM n)
SELECT doc_id, win, win * 46 AS start, least(62, n - win * 46) AS weight, md5(array_to_string(tok[win * 46 + 1 : win * 46 + 62], ' ')) AS h FROM w""")
def token_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("tok"))
    cut = windows.token_windows(docs, "tok", max_length=64, overlap=16)
    return cut.select(
        "doc_id", F.col("win").cast("bigint").alias("win"), F.col("start").cast("bigint").alias("start"),
        F.col("weight").cast("bigint").alias("weight"), F.md5(F.array_join("window", " ")).alias("h"),
    )


@query("stft_power", f"""
WITH series AS ({SERIES_SQL}), lengths AS (SELECT user_id, count(*) AS n FROM series GROUP BY 1),
wins AS (SELECT user_id, unnest(generate_series(0, (n - 16) // 8)) AS frame FROM lengths WHERE n >= 16),
x AS (SELECT w.user_id, w.frame, s.p - w.frame * 8 AS i, s.v FROM wins w JOIN series s ON s.user_id = w.user_id AND s.p BETWEEN w.frame * 8 AND w.frame * 8 + 15),
b AS (SELECT unnest(generate_series(0, 8)) AS bin)
SELECT user_id, frame, bin, round(pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 16)) * cos(2 * pi() * bin * i / 16)), 2)
     + pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 16)) * sin(2 * pi() * bin * i / 16)), 2), 3) AS power
FROM x, b GROUP BY 1, 2, 3""")
def stft_power(spark, sf_dir):
    frames = windows.count_windows(series(spark, sf_dir), ["user_id"], "p", ["v"], 16, 8)
    spec = frames.select("user_id", F.col("win").alias("frame"), F.posexplode(fs.hann_power(F.col("rows.v"), 16)).alias("bin", "power"))
    return spec.select("user_id", "frame", F.col("bin").cast("bigint").alias("bin"), F.round("power", 3).alias("power"))


@query("channel_reshape", """
SELECT vec_id, 16 AS n_steps, 3 AS n_channels, round(sum(CAST(embedding[i * 4 + c + 1] AS DOUBLE) * (i + 1) * (c + 1)), 5) AS checksum,
       round(sum(CAST(embedding[i * 4 + c + 1] AS DOUBLE) * (i + 1)) / 3, 5) AS mono_checksum
FROM {embeddings}, (SELECT unnest(generate_series(0, 15)) AS i), (SELECT unnest(generate_series(0, 2)) AS c) GROUP BY 1""")
def channel_reshape(spark, sf_dir):
    """(T*C) vector to (T, C), keep three channels, mono mix."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", fs.reshape(F.col("embedding").cast("array<double>"), 4).alias("x"))
    x = x.withColumn("x", fs.keep_channels(F.col("x"), 3)).withColumn("m", fs.mono(F.col("x")))
    per_step = F.transform("x", lambda r: fs.position_sum(r))
    return x.select(
        "vec_id", F.size("x").alias("n_steps"), F.size(F.col("x")[0]).alias("n_channels"),
        F.round(fs.position_sum(per_step), 5).alias("checksum"), F.round(fs.position_sum(F.col("m")), 5).alias("mono_checksum"),
    )


@query("transpose_series", """
SELECT vec_id, 4 AS n_steps, 16 AS n_channels, round(sum(CAST(embedding[i * 4 + c + 1] AS DOUBLE) * (i + 1) * (c + 1) * (c + 1)), 4) AS checksum
FROM {embeddings}, (SELECT unnest(generate_series(0, 15)) AS i), (SELECT unnest(generate_series(0, 3)) AS c) GROUP BY 1""")
def transpose_series(spark, sf_dir):
    """Channel-first series to the canonical (T, C) layout."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", fs.reshape(F.col("embedding").cast("array<double>"), 4).alias("x"))
    t = x.withColumn("x", fs.canonical(F.col("x"), channels_first=True))
    per_step = F.transform("x", lambda r, i: fs.position_sum(r) * (i + 1))
    return t.select(
        "vec_id", F.size("x").alias("n_steps"), F.size(F.col("x")[0]).alias("n_channels"),
        F.round(fs.position_sum(per_step), 4).alias("checksum"),
    )


@query("drop_channels", """
SELECT vec_id, round(sum(CAST(embedding[i * 8 + c + 1] AS DOUBLE) * (i + 1)), 5) AS checksum, 6 AS n_channels
FROM {embeddings}, (SELECT unnest(generate_series(0, 7)) AS i), (SELECT unnest([0, 1, 2, 5, 6, 7]) AS c) GROUP BY 1""")
def drop_channels(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", fs.reshape(F.col("embedding").cast("array<double>"), 8).alias("x"))
    x = x.withColumn("x", fs.drop_channels(F.col("x"), [3, 4]))
    per_step = F.transform("x", lambda r: F.aggregate(r, F.lit(0.0), lambda a, v: a + v))
    return x.select("vec_id", F.round(fs.position_sum(per_step), 5).alias("checksum"), F.size(F.col("x")[0]).alias("n_channels"))


@query("constant_window_policy", f"""
WITH {WINDOW_CTES}
SELECT user_id % 10 = 0 AS is_constant, count(*) AS n FROM wins GROUP BY 1""")
def constant_window_policy(spark, sf_dir):
    """Windows that are all zero after normalisation are flagged instead of stopping the job."""
    v = F.transform("rows", lambda r: F.array(F.when(F.col("user_id") % 10 == 0, 1.0).otherwise(r["v"])))
    z = scaling.znorm_windows(_windows(spark, sf_dir).select("user_id", v.alias("x")), "x", on_constant="flag")
    return z.groupBy("is_constant").agg(F.count("*").alias("n"))
