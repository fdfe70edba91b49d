"""Queries over prediction, attempt and forecast logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsprobe.operators import bootstrap, metrics, ordering, progress, windows
from tsprobe.plans.inputs import ATTEMPTS_SQL, PREDICTIONS_SQL, SERIES_SQL, attempts, predictions, series
from tsprobe.plans.registry import derive, query, table


def metrics_sql(source: str, keys: str) -> str:
    """Accuracy and macro-F1 per ``keys`` of a CTE ``source`` with gt and pred."""
    return f"""
lab AS (SELECT {keys}, gt AS l FROM {source} UNION SELECT {keys}, pred FROM {source}),
tp AS (SELECT {keys}, gt AS l, count(*) AS tp FROM {source} WHERE gt = pred GROUP BY ALL),
su AS (SELECT {keys}, gt AS l, count(*) AS su FROM {source} GROUP BY ALL),
ca AS (SELECT {keys}, pred AS l, count(*) AS ca FROM {source} GROUP BY ALL),
f1 AS (SELECT {keys}, l, 2 * coalesce(tp, 0) / (coalesce(su, 0) + coalesce(ca, 0)) AS f1
       FROM lab LEFT JOIN tp USING ({keys}, l) LEFT JOIN su USING ({keys}, l) LEFT JOIN ca USING ({keys}, l)),
m AS (SELECT {keys}, avg(f1) AS macro_f1 FROM f1 GROUP BY ALL),
a AS (SELECT {keys}, count(*) AS n, avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM {source} GROUP BY ALL)"""


def _rounded(df, *keys):
    return df.select(*keys, "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("classification_metrics", f"""
WITH p AS ({PREDICTIONS_SQL}), {metrics_sql('p', 'run')}
SELECT run, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM a JOIN m USING (run)""")
def classification_metrics(spark, sf_dir):
    return _rounded(metrics.classification_metrics(predictions(spark, sf_dir), ["run"]), "run")


@query("scored_results", f"""
WITH p AS ({PREDICTIONS_SQL}), q AS (SELECT 'runs/' || run || '/preds.jsonl' AS pred_path, gt, pred FROM p), {metrics_sql('q', 'pred_path')}
SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, pred_path, '2024-03-01 12:30:00' AS timestamp FROM a JOIN m USING (pred_path)""")
def scored_results(spark, sf_dir):
    """From prediction rows with their path to rows of the results table."""
    p = predictions(spark, sf_dir).withColumn("pred_path", F.concat(F.lit("runs/"), "run", F.lit("/preds.jsonl")))
    out = metrics.results_rows(p, "pred_path", F.lit("2024-03-01 12:30:00").cast("timestamp"))
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "pred_path", "timestamp")


DOC_PRED_SQL = """
SELECT source, lang, quality AS gt, CASE WHEN n_chars > 900 THEN 1 ELSE 0 END AS pred FROM {documents} JOIN {labels} USING (doc_id)"""


@query("macro_f1_by_group", f"""
WITH p AS ({DOC_PRED_SQL}), {metrics_sql('p', 'source, lang')}
SELECT source, lang, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM a JOIN m USING (source, lang)""")
def macro_f1_by_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.when(F.col("n_chars") > 900, 1).otherwise(0).alias("pred"))
    p = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gt")), "doc_id")
    return _rounded(metrics.classification_metrics(p, ["source", "lang"]), "source", "lang")


@query("metrics_with_empty_runs", f"""
WITH p AS ({PREDICTIONS_SQL}), q AS (SELECT run || '-' || (idx % 3) AS run, gt, pred FROM p WHERE idx % 3 <> 1), {metrics_sql('q', 'run')},
runs AS (SELECT DISTINCT run || '-' || (idx % 3) AS run FROM p)
SELECT run, coalesce(n, 0) AS n, round(coalesce(accuracy, 0), 6) AS accuracy, round(coalesce(macro_f1, 0), 6) AS macro_f1
FROM runs LEFT JOIN (SELECT * FROM a JOIN m USING (run)) USING (run)""")
def metrics_with_empty_runs(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("run", F.concat("run", F.lit("-"), (F.col("idx") % 3).cast("string")))
    scored = metrics.classification_metrics(p.where("idx % 3 <> 1"), ["run"])
    return _rounded(metrics.with_empty_runs(scored, p.select("run").distinct(), ["run"]), "run")


@query("correct_flag", f"""
WITH p AS ({PREDICTIONS_SQL}) SELECT idx, run, CASE WHEN pred >= 0 AND pred = gt THEN 1 ELSE 0 END AS correct FROM p""")
def correct_flag(spark, sf_dir):
    return predictions(spark, sf_dir).select("idx", "run", metrics.correct_flag(F.col("gt"), F.col("pred")).alias("correct"))


@query("running_accuracy", f"""
WITH p AS ({PREDICTIONS_SQL})
SELECT run, idx, count(*) OVER w AS seen, round(avg(CASE WHEN pred >= 0 AND pred = gt THEN 1.0 ELSE 0.0 END) OVER w, 6) AS running_accuracy
FROM p WINDOW w AS (PARTITION BY run ORDER BY idx ROWS UNBOUNDED PRECEDING)""")
def running_accuracy(spark, sf_dir):
    p = ordering.positions(predictions(spark, sf_dir), ["run"], ["idx"])
    out = metrics.running_accuracy(p, ["run"], "pos")
    return out.select("run", "idx", "seen", F.round("running_accuracy", 6).alias("running_accuracy"))


BOOT_SQL = """
SELECT vec_id AS idx, CAST(vec_id % 2 AS INT) AS run, label AS gt, CAST(CASE WHEN vec_id % 3 = 0 THEN (vec_id * 7) % 10 ELSE label END AS INT) AS pred FROM {embeddings}"""


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    """10,000 multinomial replicates per run (seeded numpy draws, no SQL form)."""
    p = predictions(spark, sf_dir)
    return bootstrap.bootstrap_ci(p, ["run"], n_boot=10_000)


@query("bootstrap_hash", f"""
WITH p AS ({BOOT_SQL}), cells AS (SELECT run, gt, pred, count(*) AS c FROM p GROUP BY ALL),
cdf AS (SELECT run, gt, pred, sum(c) OVER (PARTITION BY run ORDER BY gt, pred) AS hi, sum(c) OVER (PARTITION BY run ORDER BY gt, pred) - c AS lo FROM cells),
n AS (SELECT run, count(*) AS n FROM p GROUP BY 1), b AS (SELECT unnest(generate_series(0, 49)) AS replicate),
d AS (SELECT run, replicate, CAST('0x' || substr(md5('42|' || replicate || '|' || idx), 1, 8) AS BIGINT) % n AS j FROM p JOIN n USING (run), b),
q AS (SELECT d.run, replicate, gt, pred FROM d JOIN cdf ON d.run = cdf.run AND j >= lo AND j < hi), {metrics_sql('q', 'run, replicate')}
SELECT run, round(avg(macro_f1), 6) AS mean, round(quantile_cont(macro_f1, 0.025), 6) AS ci_lower, round(quantile_cont(macro_f1, 0.975), 6) AS ci_upper, count(*) AS n_boot
FROM m GROUP BY 1""")
def bootstrap_hash(spark, sf_dir):
    scored = bootstrap.bootstrap_hash_scores(derive(spark, sf_dir, BOOT_SQL), ["run"], "idx", 50)
    out = bootstrap.interval(scored, ["run"])
    return out.select("run", *[F.round(c, 6).alias(c) for c in ("mean", "ci_lower", "ci_upper")], "n_boot")


_KS = (1, 5, 10, 15, 20)
_PASS = ", ".join(
    f'round(avg(CASE WHEN c <= 0 THEN 0.0 WHEN 20 - c < {k} THEN 1.0 ELSE 1.0 - factorial(CAST(20 - c AS INT))::DOUBLE * factorial({20 - k})::DOUBLE'
    f' / (factorial(CAST(20 - c - {k} AS INT))::DOUBLE * factorial(20)::DOUBLE) END), 6) AS pass_{k}' for k in _KS
)


@query("pass_at_k", f"""
WITH a AS ({ATTEMPTS_SQL}), per AS (SELECT idx % 5 AS run, idx, count(*) AS n, sum(CASE WHEN pred >= 0 AND pred = gt THEN 1 ELSE 0 END) AS c FROM a GROUP BY 1, 2)
SELECT run, {_PASS}, count(*) AS n_idxs, max(n) AS n_per_idx FROM per GROUP BY 1""")
def pass_at_k(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("correct", metrics.correct_flag(F.col("gt"), F.col("pred"))).withColumn("run", F.col("idx") % 5)
    out = metrics.pass_at_k(a, ["run"], "idx", _KS, n=20)
    return out.select("run", *[F.round(F.col(f"`pass@{k}`"), 6).alias(f"pass_{k}") for k in _KS], "n_idxs", "n_per_idx")


_VOTES = f"""
a AS ({ATTEMPTS_SQL}), v AS (SELECT * FROM a WHERE attempt < 7),
tally AS (SELECT idx, gt, pred, count(*) AS c, min(attempt) AS f FROM v GROUP BY 1, 2, 3)"""


@query("majority_vote", f"""
WITH {_VOTES}, win AS (SELECT idx, gt, pred FROM tally QUALIFY row_number() OVER (PARTITION BY idx ORDER BY c DESC, f) = 1),
t AS (SELECT idx, string_agg(pred || ':' || c, ',' ORDER BY pred) AS tally, sum(c)::BIGINT AS n_votes FROM tally GROUP BY 1)
SELECT idx, gt, pred AS master_pred, CAST(pred = gt AS INT) AS correct, tally, n_votes FROM win JOIN t USING (idx)""")
def majority_vote(spark, sf_dir):
    out = metrics.vote(attempts(spark, sf_dir).where("attempt < 7"), ["idx"], "attempt")
    text = F.array_join(F.transform(F.map_entries("vote_tally"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return out.select("idx", "gt", "master_pred", "correct", text.alias("tally"), "n_votes")


@query("vote_list", f"""
WITH {_VOTES}, win AS (SELECT idx, pred FROM tally QUALIFY row_number() OVER (PARTITION BY idx ORDER BY c DESC, f) = 1)
SELECT v.idx, win.pred AS master_pred, string_agg(attempt || ':' || v.pred, ',' ORDER BY attempt) AS votes FROM v JOIN win USING (idx) GROUP BY 1, 2""")
def vote_list(spark, sf_dir):
    """Every vote of an id beside what they come to."""
    out = metrics.vote_list(attempts(spark, sf_dir).where("attempt < 7"), ["idx"], "attempt")
    text = F.array_join(F.transform("votes", lambda v: F.concat_ws(":", v["attempt"].cast("string"), v["pred"].cast("string"))), ",")
    return out.select("idx", "master_pred", text.alias("votes"))


@query("vote_metrics", f"""
WITH {_VOTES}, win AS (SELECT idx, gt, pred, 1 AS run FROM tally QUALIFY row_number() OVER (PARTITION BY idx ORDER BY c DESC, f) = 1), {metrics_sql('win', 'run')}
SELECT n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM a_ JOIN m USING (run)""".replace("a AS (SELECT run, count", "a_ AS (SELECT run, count"))
def vote_metrics(spark, sf_dir):
    votes = metrics.vote(attempts(spark, sf_dir).where("attempt < 7"), ["idx"], "attempt")
    return _rounded(metrics.classification_metrics(votes.withColumnRenamed("master_pred", "pred"), []))


_PAIRS = f"""
series AS ({SERIES_SQL}), lengths AS (SELECT user_id, count(*) AS n FROM series GROUP BY 1),
starts AS (SELECT user_id, unnest(generate_series(0, n - 30)) AS idx FROM lengths WHERE n >= 30),
steps AS (SELECT st.user_id, idx, s.p - idx - 24 AS step, s.v AS gt, l.v AS last_v FROM starts st
          JOIN series s ON s.user_id = st.user_id AND s.p BETWEEN idx + 24 AND idx + 29
          JOIN series l ON l.user_id = st.user_id AND l.p = idx + 23)"""


def _naive_forecasts(spark, sf_dir):
    """Repeat the last history value; every 7th user's forecast is one step short, every 11th has none."""
    pairs = windows.lookback_horizon(series(spark, sf_dir), ["user_id"], "p", "v", 24, 6)
    last = F.element_at("x", -1)
    pred = F.when(F.col("user_id") % 7 == 0, F.array_repeat(last, 5)).when(F.col("user_id") % 11 != 0, F.array_repeat(last, 6))
    return pairs.select("user_id", "idx", F.col("y").alias("gt"), pred.alias("pred"), F.col("x").alias("history"))


@query("forecast_error_rows", f"""
WITH {_PAIRS}, r AS (SELECT user_id, idx, avg(pow(gt - last_v, 2)) AS mse, avg(abs(gt - last_v)) AS mae, user_id % 7 <> 0 AND user_id % 11 <> 0 AS ok FROM steps GROUP BY ALL)
SELECT user_id % 4 AS run, round(avg(CASE WHEN ok THEN mse END), 4) AS avg_mse, round(avg(CASE WHEN ok THEN mae END), 4) AS avg_mae, count(*) AS num_entries,
 count(CASE WHEN ok THEN 1 END) AS num_non_errors, count(CASE WHEN NOT ok THEN 1 END) AS num_errors FROM r GROUP BY 1""")
def forecast_error_rows(spark, sf_dir):
    f = _naive_forecasts(spark, sf_dir).withColumn("run", F.col("user_id") % 4)
    out = metrics.forecast_error_rows(f, ["run"])
    return out.select("run", F.round("avg_mse", 4).alias("avg_mse"), F.round("avg_mae", 4).alias("avg_mae"), "num_entries", "num_non_errors", "num_errors")


@query("valid_forecasts", f"""
WITH {_PAIRS} SELECT DISTINCT user_id, idx, user_id % 7 <> 0 AND user_id % 11 <> 0 AS is_valid FROM steps""")
def valid_forecasts(spark, sf_dir):
    return metrics.forecast_pairs(_naive_forecasts(spark, sf_dir)).select("user_id", "idx", "is_valid")


@query("forecast_error_pooled", f"""
WITH {_PAIRS} SELECT user_id % 4 AS run, round(avg(pow(last_v - gt, 2)), 4) AS mse, round(avg(abs(last_v - gt)), 4) AS mae, count(*) AS n_points
FROM steps WHERE CASE WHEN user_id % 7 = 0 THEN step < 5 ELSE user_id % 11 <> 0 END GROUP BY 1""")
def forecast_error_pooled(spark, sf_dir):
    f = _naive_forecasts(spark, sf_dir).where("pred IS NOT NULL").withColumn("run", F.col("user_id") % 4)
    out = metrics.forecast_error_pooled(f, ["run"])
    return out.select("run", F.round("mse", 4).alias("mse"), F.round("mae", 4).alias("mae"), F.col("n_points").cast("bigint").alias("n_points"))


@query("running_mae", f"""
WITH {_PAIRS}, r AS (SELECT user_id, idx, CASE WHEN user_id % 7 <> 0 AND user_id % 11 <> 0 THEN sum(abs(gt - last_v)) END AS e FROM steps GROUP BY 1, 2)
SELECT user_id, idx, round(sum(e) OVER w / (6 * count(e) OVER w), 8) AS running_mae FROM r WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""")
def running_mae(spark, sf_dir):
    f = _naive_forecasts(spark, sf_dir)
    return metrics.running_mae(f, ["user_id"], "idx").select("user_id", "idx", F.round("running_mae", 8).alias("running_mae"))


@query("fill_forecast", f"""
WITH {_PAIRS}, q AS (SELECT *, CASE WHEN (idx + step) % 3 <> 0 THEN gt END AS pred FROM steps)
SELECT user_id, idx, step, coalesce(last_value(pred IGNORE NULLS) OVER (PARTITION BY user_id, idx ORDER BY step ROWS UNBOUNDED PRECEDING), last_v) AS filled FROM q""")
def fill_forecast(spark, sf_dir):
    f = _naive_forecasts(spark, sf_dir)
    steps = f.select("user_id", "idx", F.element_at("history", -1).alias("last_v"), F.posexplode("gt").alias("step", "v"))
    steps = steps.withColumn("step", F.col("step").cast("bigint")).withColumn("pred", F.when((F.col("idx") + F.col("step")) % 3 != 0, F.col("v")))
    return metrics.fill_forecast(steps, ["user_id", "idx"], "step", "pred", "last_v").select("user_id", "idx", "step", "filled")


@query("next_lookback", f"""
WITH series AS ({SERIES_SQL}), lengths AS (SELECT user_id, count(*) AS n FROM series GROUP BY 1),
starts AS (SELECT user_id, unnest(generate_series(0, n - 30)) AS idx FROM lengths WHERE n >= 30)
SELECT st.user_id, idx, round(sum(v * (p - idx - 5)), 3) AS checksum FROM starts st JOIN series s ON s.user_id = st.user_id AND s.p BETWEEN idx + 6 AND idx + 29 GROUP BY 1, 2""")
def next_lookback(spark, sf_dir):
    f = _naive_forecasts(spark, sf_dir)
    nxt = metrics.next_lookback(F.col("history"), F.col("gt"), 24)
    checksum = F.aggregate(F.transform(nxt, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return f.select("user_id", "idx", F.round(checksum, 3).alias("checksum"))


@query("pending_attempts", f"""
WITH a AS ({ATTEMPTS_SQL}) SELECT idx, attempt FROM a WHERE (idx + attempt) % 4 = 1""")
def pending_attempts(spark, sf_dir):
    done = attempts(spark, sf_dir).where("(idx + attempt) % 4 <> 1")
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    return progress.pending_attempts(expected, done, "idx", 20)


@query("attempt_progress", f"""
WITH a AS ({ATTEMPTS_SQL}) SELECT idx, count(DISTINCT attempt) AS n_done, max(CASE WHEN attempt = 0 THEN CASE WHEN pred >= 0 AND pred = gt THEN 1 ELSE 0 END END) AS first_correct
FROM a WHERE (idx + attempt) % 4 <> 1 GROUP BY 1""")
def attempt_progress(spark, sf_dir):
    a = attempts(spark, sf_dir).where("(idx + attempt) % 4 <> 1").withColumn("correct", metrics.correct_flag(F.col("gt"), F.col("pred")))
    return progress.attempt_progress(a, [], "idx")


@query("first_incomplete_batch", """
WITH n AS (SELECT count(*) AS n FROM {orders}), r AS (SELECT unnest(range(0, 6)) AS run),
log AS (SELECT run, o_orderkey // 5 AS b, count(*) AS c FROM {orders}, r WHERE o_orderkey <> 700 * (run + 1) GROUP BY 1, 2),
g AS (SELECT run, n, unnest(range(0, CAST(ceil(n / 5) AS BIGINT))) AS b FROM r, n)
SELECT CAST(run AS INT) AS run, CAST(coalesce(min(CASE WHEN coalesce(c, 0) < least(5, n - b * 5) THEN b END), any_value(ceil(n / 5))) AS INT) AS batch_start FROM g LEFT JOIN log USING (run, b) GROUP BY 1""")
def first_incomplete_batch(spark, sf_dir):
    """Six runs over all orders, each with one order missing somewhere (or none)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    log = o.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(5)))).where(F.col("o_orderkey") != 700 * (F.col("run") + 1))
    log = log.withColumn("batch_idx", F.floor(F.col("o_orderkey") / 5).cast("int"))
    return progress.first_incomplete_batch(log, log.select("run").distinct(), ["run"], o.count(), 5)


@query("run_completeness", f"""
WITH a AS ({ATTEMPTS_SQL}), l AS (SELECT idx % 3 AS run, idx, attempt FROM a WHERE idx % 3 <> 2 AND (idx % 3 = 0 OR (idx + attempt) % 50 <> 0)),
e AS (SELECT o_orderkey % 3 AS run, count(*) AS expected_examples FROM {{orders}} GROUP BY 1),
per AS (SELECT run, idx, count(DISTINCT attempt) AS c FROM l GROUP BY 1, 2),
r AS (SELECT run, count(*) AS present_idxs, count(CASE WHEN c = 20 THEN 1 END) AS complete_idxs, sum(c)::BIGINT AS rows_present FROM per GROUP BY 1)
SELECT run, expected_examples, coalesce(present_idxs, 0) AS present_idxs, coalesce(complete_idxs, 0) AS complete_idxs, coalesce(rows_present, 0) AS rows_present,
 expected_examples * 20 AS rows_expected, coalesce(rows_present, 0) >= expected_examples * 20 AND coalesce(complete_idxs, 0) >= expected_examples AS complete
FROM e LEFT JOIN r USING (run)""")
def run_completeness(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("run", F.col("idx") % 3)
    log = a.where("run <> 2 AND (run = 0 OR (idx + attempt) % 50 <> 0)")
    expected = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 3).alias("run")).agg(F.count("*").alias("expected_examples"))
    return progress.run_completeness(log, ["run"], "idx", 20, expected)


@query("progress_totals", f"""
WITH p AS ({PREDICTIONS_SQL}) SELECT run, count(*) AS total, sum(CASE WHEN pred >= 0 AND pred = gt THEN 1 ELSE 0 END)::BIGINT AS acc,
 round(avg(CASE WHEN pred >= 0 AND pred = gt THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1""")
def progress_totals(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("correct", metrics.correct_flag(F.col("gt"), F.col("pred")))
    return progress.progress_totals(p, ["run"]).withColumn("accuracy", F.round("accuracy", 6))


@query("variant_progress", """
WITH v AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'lets,ust' WHEN 1 THEN 'ust,lets' ELSE 'lets,vis,ust' END AS kinds, CAST(o_custkey % 2 AS INT) AS cot,
 CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 10 ELSE o_orderkey % 9 END AS variant FROM {orders})
SELECT array_to_string(list_sort(string_split(kinds, ',')), ',') AS kinds, cot, count(DISTINCT variant) AS n_variants, count(*) AS n_lines, count(DISTINCT variant) = 10 AS complete FROM v GROUP BY 1, 2""")
def variant_progress(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    v = table(spark, sf_dir, "orders").select(
        F.when(k == 0, "lets,ust").when(k == 1, "ust,lets").otherwise("lets,vis,ust").alias("kinds"),
        (F.col("o_custkey") % 2).cast("int").alias("cot"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 10).otherwise(F.col("o_orderkey") % 9).alias("variant"),
    )
    return progress.variant_progress(v, [])
