"""Queries over the results table: parsing, cleaning, picking, summarising."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsprobe.functions import labels as fl
from tsprobe.functions import paths
from tsprobe.operators import progress, results as ops
from tsprobe.plans.inputs import RESULTS_SQL, SCORES_SQL, results, scores
from tsprobe.plans.registry import query, table

_SHOT = r"^(.+?)_(\d+)-shot(?:_(Direct|CoT))?$"
_DIR = r"^(.+?)(?:_(Direct|CoT))?$"
KEYS = ["model", "dataset", "embedding_type", "style"]

RAW = f"""
raw AS ({RESULTS_SQL}),
split AS (SELECT *, string_split(pred_path, '/') AS pp FROM raw),
named AS (SELECT *, pp[3] AS model, pp[4] AS dataset, pp[5] AS method, pp[6] AS a, pp[7] AS b,
          regexp_replace(CASE WHEN pp[5] = 'logistic_regression' THEN pp[7] WHEN pp[5] IN ('random', 'visual_prompting') THEN pp[6] END, '\\.[^.]+$', '') AS stem FROM split),
src AS (SELECT *, CASE method WHEN 'logistic_regression' THEN regexp_extract(a, '{_DIR}', 1) WHEN 'visual_prompting' THEN regexp_extract(stem, '{_SHOT}', 1)
          WHEN 'knn' THEN a END AS emb0 FROM named),
parsed AS (SELECT try_cast(accuracy AS DOUBLE) AS accuracy, try_cast(macro_f1 AS DOUBLE) AS macro_f1, pred_path,
  try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, model, dataset, method,
  CASE WHEN method = 'random' THEN stem WHEN ends_with(replace(emb0, '-', '_'), '_ust') THEN replace(emb0, '-', '_') ELSE replace(emb0, '-', '_') || '_ust' END AS embedding_type,
  nullif(CASE method WHEN 'logistic_regression' THEN regexp_extract(a, '{_DIR}', 2) WHEN 'visual_prompting' THEN regexp_extract(stem, '{_SHOT}', 3) END, '') AS style,
  CASE WHEN method = 'random' THEN stem END AS variant,
  CASE WHEN method = 'logistic_regression' THEN CAST(regexp_extract(stem, '^layer(\\d+)$', 1) AS INT) END AS layer,
  CASE WHEN method = 'visual_prompting' THEN CAST(regexp_extract(stem, '{_SHOT}', 2) AS INT) END AS shots, stem AS pred_file_stem FROM src),
clean AS (SELECT * FROM parsed WHERE accuracy IS NOT NULL AND macro_f1 IS NOT NULL)"""

_OUT = "model, dataset, method, embedding_type, style, variant, layer, shots, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, pred_path, CAST(timestamp AS VARCHAR) AS timestamp, pred_file_stem"


def _clean(spark, sf_dir):
    return ops.clean_results(results(spark, sf_dir))


def _shown(df):
    return df.withColumns({"accuracy": F.round("accuracy", 6), "macro_f1": F.round("macro_f1", 6), "timestamp": F.col("timestamp").cast("string")})


@query("clean_results", f"WITH {RAW} SELECT {_OUT} FROM clean")
def clean_results(spark, sf_dir):
    return _shown(_clean(spark, sf_dir))


@query("parse_run_path_hyphen", f"""
WITH {RAW}, r AS (SELECT *, CASE method WHEN 'logistic_regression' THEN a WHEN 'visual_prompting' THEN stem END AS run FROM named)
SELECT pred_path, model, dataset, method, CASE WHEN method = 'random' THEN stem WHEN regexp_matches(run, '{_SHOT}') THEN regexp_extract(run, '{_SHOT}', 1) ELSE regexp_extract(run, '{_DIR}', 1) END AS embedding_type,
 nullif(CASE WHEN regexp_matches(run, '{_SHOT}') THEN regexp_extract(run, '{_SHOT}', 3) ELSE regexp_extract(run, '{_DIR}', 2) END, '') AS style,
 CASE WHEN regexp_matches(run, '{_SHOT}') THEN CAST(regexp_extract(run, '{_SHOT}', 2) AS INT) WHEN method = 'visual_prompting' THEN 0 END AS shots,
 CASE WHEN method = 'logistic_regression' THEN CAST(regexp_extract(b, '^layer(\\d+)\\.jsonl$', 1) AS INT) END AS layer, CASE WHEN method = 'random' THEN stem END AS variant,
 CASE WHEN method = 'logistic_regression' THEN b WHEN method IN ('random', 'visual_prompting') THEN a END AS pred_file, stem AS pred_stem, CASE WHEN method = 'logistic_regression' THEN a END AS run_dir FROM r""")
def parse_run_path_hyphen(spark, sf_dir):
    return paths.run_keys(results(spark, sf_dir).select("pred_path"), style="hyphen")


@query("parse_path_from_right", f"""
WITH {RAW}, r AS (SELECT *, string_split(pp[-2], '_') AS v, pp[-1] AS f FROM named)
SELECT pred_path, pp[-5] AS model, pp[-4] AS dataset, pp[-3] AS method, v[1] AS embedding_type, coalesce(v[3], 'Direct') AS style,
 coalesce(CASE WHEN regexp_matches(replace(replace(v[2], '-shot', ''), '.', ''), '^\\d+$') THEN CAST(replace(v[2], '-shot', '') AS DOUBLE) END, 0.0) AS shots,
 coalesce(CAST(nullif(regexp_extract(f, 'layer(\\d+)', 1), '') AS INT), 0) AS layer, pp[-2] AS variant, f AS pred_file, replace(f, '.jsonl', '') AS pred_stem, pp[-2] AS run_dir
FROM r WHERE len(pp) >= 5""")
def parse_path_from_right(spark, sf_dir):
    return paths.run_keys_from_right(results(spark, sf_dir).select("pred_path"))


@query("parse_modality", f"""
WITH {RAW} SELECT pred_path, model, dataset, method,
 CASE WHEN regexp_matches(a, '_\\d+-shot(_|$)') THEN regexp_extract(a, '^(.*?)_\\d+-shot(_|$)', 1) ELSE a END AS modality, CAST(contains(lower(a), 'cot') AS INT) AS style,
 coalesce(CAST(nullif(regexp_extract(a, '_(\\d+)-shot(_|$)', 1), '') AS INT), -1) AS shots, coalesce(CAST(nullif(regexp_extract(pred_path, '/layer(\\d+)\\.jsonl$', 1), '') AS INT), -1) AS layer FROM named""")
def parse_modality(spark, sf_dir):
    return paths.run_modality(results(spark, sf_dir).select("pred_path"))


@query("embedding_names", """
WITH n AS (SELECT DISTINCT p_type || CASE WHEN p_size % 3 = 0 THEN '-ust' WHEN p_size % 3 = 1 THEN '_x-y' ELSE '' END AS e FROM {part})
SELECT e, replace(e, '-', '_') || CASE WHEN ends_with(replace(e, '-', '_'), '_ust') THEN '' ELSE '_ust' END AS underscored, e AS hyphenated, regexp_replace(e, '[-_]ust$', '') AS stripped FROM n""")
def embedding_names(spark, sf_dir):
    k = F.col("p_size") % 3
    e = table(spark, sf_dir, "part").select(F.concat("p_type", F.when(k == 0, "-ust").when(k == 1, "_x-y").otherwise("")).alias("e")).distinct()
    c = F.col("e")
    return e.select("e", paths.normalise_embedding(c).alias("underscored"), paths.normalise_embedding(c, "hyphen", False).alias("hyphenated"), paths.strip_ust(c).alias("stripped"))


@query("modality_labels", """
WITH n AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'lets-ust' WHEN 1 THEN 'vis-ust' WHEN 2 THEN 'vis-lets-ust' WHEN 3 THEN 'ts-ust' ELSE 'VIS-LETS' END AS e FROM {part})
SELECT e, CASE WHEN lower(e) LIKE '%lets%' AND lower(e) LIKE '%vis%' THEN 'dv' WHEN lower(e) LIKE '%lets%' THEN 'd' ELSE '' END AS bucket,
 CASE WHEN lower(e) LIKE '%lets%' AND lower(e) LIKE '%vis%' THEN 'd+v' WHEN lower(e) LIKE '%lets%' THEN 'd' WHEN lower(e) LIKE '%vis%' THEN 'v' ELSE e END AS label FROM n""")
def modality_labels(spark, sf_dir):
    k = F.col("p_partkey") % 5
    e = F.when(k == 0, "lets-ust").when(k == 1, "vis-ust").when(k == 2, "vis-lets-ust").when(k == 3, "ts-ust").otherwise("VIS-LETS")
    names = table(spark, sf_dir, "part").select(e.alias("e")).distinct()
    return names.select("e", paths.modality_bucket(F.col("e")).alias("bucket"), paths.modality_label(F.col("e")).alias("label"))


@query("activity_ids", """
WITH a AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN ' Large-Brush ' WHEN 1 THEN p_name WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE 'other' END AS t FROM {part}),
c AS (SELECT id, regexp_replace(lower(trim(t)), '[ -]', '_', 'g') AS t FROM a)
SELECT id, coalesce(try_cast(t AS INT), CASE t WHEN 'large_brush' THEN 1 WHEN 'small_ring' THEN 2 END, CAST(id % 12 + 1 AS INT)) AS activity FROM c""")
def activity_ids(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, " Large-Brush ").when(k == 1, F.col("p_name")).when(k == 2, F.col("p_size").cast("string")).otherwise("other")
    file = F.format_string("a%dt%d.mat", F.col("p_partkey") % 12 + 1, F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), paths.activity_id(text, ["large_brush", "small_ring"], file).alias("activity")
    )


@query("variant_file_keys", """
WITH f AS (SELECT o_orderkey AS id, lpad(CAST(o_orderkey % 10 + 1 AS VARCHAR), 3, '0') AS k, CASE o_custkey % 2 WHEN 0 THEN 'lets,ust' ELSE 'lets,vis,ust' END AS kinds, CAST(o_orderkey % 2 AS INT) AS cot FROM {orders})
SELECT id, CAST(k AS INT) AS variant, kinds, cot FROM f""")
def variant_file_keys(spark, sf_dir):
    no = F.lpad((F.col("o_orderkey") % 10 + 1).cast("string"), 3, "0")
    kinds = F.when(F.col("o_custkey") % 2 == 0, "lets,ust").otherwise("lets,vis,ust")
    name = F.concat(F.lit("sys"), no, F.lit("_gq"), no, F.lit("_"), kinds, F.lit("_cot"), (F.col("o_orderkey") % 2).cast("string"), F.lit(".jsonl"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), paths.parse_variant_file(name).alias("k")).select("id", "k.*")


@query("keep_latest", f"""
WITH {RAW} SELECT {_OUT} FROM clean QUALIFY row_number() OVER (PARTITION BY pred_path ORDER BY timestamp DESC NULLS LAST, accuracy DESC, macro_f1 DESC) = 1""")
def keep_latest(spark, sf_dir):
    return _shown(ops.keep_latest(_clean(spark, sf_dir), ["pred_path"], "timestamp", ["accuracy", "macro_f1"]))


@query("upsert_results", f"""
WITH s AS ({SCORES_SQL}), o AS (SELECT dataset || '/' || model || '/' || layer AS pred_path, ts, accuracy, dataset IN ('ctu', 'emg') AS old, shots FROM s),
u AS (SELECT pred_path, ts, accuracy, 0 AS gen FROM o WHERE old UNION ALL SELECT pred_path, ts, accuracy, 1 FROM o WHERE NOT old
      UNION ALL SELECT pred_path, ts, accuracy + 1, 1 FROM o WHERE old AND shots = 1)
SELECT pred_path, CAST(ts AS VARCHAR) AS ts, CAST(gen AS INT) AS gen FROM u QUALIFY row_number() OVER (PARTITION BY pred_path ORDER BY ts DESC NULLS LAST, gen DESC) = 1""")
def upsert_results(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("pred_path", F.concat_ws("/", "dataset", "model", F.col("layer").cast("string")))
    s = s.select("pred_path", "ts", "accuracy", "dataset", "shots")
    is_old = F.col("dataset").isin("ctu", "emg")
    old = s.where(is_old).withColumn("gen", F.lit(0))
    again = s.where(is_old & (F.col("shots") == 1)).withColumn("accuracy", F.col("accuracy") + 1)
    new = s.where(~is_old).unionByName(again).withColumn("gen", F.lit(1))
    out = ops.upsert(old, new, "pred_path", "ts")
    return out.select("pred_path", F.col("ts").cast("string").alias("ts"), "gen")


@query("prefer_zero_shot", f"""
WITH s AS ({SCORES_SQL}) SELECT model, dataset, embedding_type, id, shots FROM s WHERE method = 'visual_prompting'
QUALIFY row_number() OVER (PARTITION BY model, dataset, embedding_type ORDER BY shots = 0 DESC, ts DESC NULLS FIRST, id DESC) = 1""")
def prefer_zero_shot(spark, sf_dir):
    s = scores(spark, sf_dir).where("method = 'visual_prompting'")
    return ops.prefer_zero_shot(s, ["model", "dataset", "embedding_type"], "ts", ["id"]).select("model", "dataset", "embedding_type", "id", "shots")


def _max_layer(null_safe: bool):
    def run(spark, sf_dir):
        s = scores(spark, sf_dir).where("method = 'logistic_regression'")
        return ops.max_layer_rows(s, KEYS, null_safe).select("id", *KEYS, "layer")

    return run


_TOP = f"""
WITH s AS (SELECT * FROM ({SCORES_SQL}) WHERE method = 'logistic_regression')
SELECT id, model, dataset, embedding_type, style, layer FROM s"""
query("max_layer_rows", f"{_TOP} QUALIFY layer = max(layer) OVER (PARTITION BY model, dataset, embedding_type, style)")(_max_layer(True))
query("max_layer_rows_drop_null_keys", f"{_TOP} WHERE style IS NOT NULL QUALIFY layer = max(layer) OVER (PARTITION BY model, dataset, embedding_type, style)")(_max_layer(False))


@query("last_layer", f"""
WITH s AS (SELECT *, round(layer / 100.0, 4) AS acc FROM ({SCORES_SQL}) WHERE method = 'logistic_regression')
SELECT id, model, dataset, embedding_type, style, layer, acc AS accuracy FROM s QUALIFY layer = max(layer) OVER (PARTITION BY model, dataset, embedding_type, style)
AND row_number() OVER (PARTITION BY model, dataset, embedding_type, style ORDER BY layer DESC, ts NULLS LAST, id) = 1""")
def last_layer(spark, sf_dir):
    s = scores(spark, sf_dir).where("method = 'logistic_regression'").withColumn("accuracy", F.round(F.col("layer") / 100.0, 4))
    return ops.last_layer(s, KEYS, "ts", ["accuracy"], ["id"]).select("id", *KEYS, "layer", "accuracy")


@query("last_layer_table", f"""
WITH s AS ({SCORES_SQL}), t AS (SELECT * FROM s WHERE method IN ('visual_prompting', 'random') UNION ALL
 SELECT * FROM (SELECT * FROM s WHERE method = 'logistic_regression' QUALIFY layer = max(layer) OVER (PARTITION BY model, dataset, embedding_type, style)))
SELECT method, model, count(*) AS n, round(sum(accuracy), 4) AS acc_sum FROM t GROUP BY 1, 2""")
def last_layer_table(spark, sf_dir):
    t = ops.last_layer_table(scores(spark, sf_dir), KEYS)
    return t.groupBy("method", "model").agg(F.count("*").alias("n"), F.round(F.sum("accuracy"), 4).alias("acc_sum"))


@query("standardise_results", f"""
WITH s AS ({SCORES_SQL}), o AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'x' ELSE CAST(layer AS VARCHAR) END AS layer_text, CASE WHEN id % 5 = 0 THEN NULL ELSE shots END AS k, CASE WHEN id % 9 = 0 THEN ' ' ELSE dataset END AS ds FROM s)
SELECT id, ds AS dataset, coalesce(k, 0)::DOUBLE AS shots, layer, 'layer' || layer_text || '.jsonl' AS pred_file, 'layer' || layer_text AS pred_stem, round(macro_f1, 6) AS macro_f1,
 CASE WHEN method = 'logistic_regression' THEN embedding_type || '_' || coalesce(k, 0) || '-shot' || coalesce('_' || style, '') ELSE '' END AS run_dir
FROM o WHERE layer_text <> 'x' AND trim(ds) <> ''""")
def standardise_results(spark, sf_dir):
    s = scores(spark, sf_dir)
    text = F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("layer").cast("string"))
    old = s.select(
        "id", "model", F.when(F.col("id") % 9 == 0, " ").otherwise(F.col("dataset")).alias("dataset"), "method", "embedding_type", "style",
        text.alias("layer"), F.when(F.col("id") % 5 != 0, F.col("shots")).alias("shots"), "accuracy", F.col("macro_f1").alias("f1"),
        F.concat(F.lit("out/layer"), text, F.lit(".jsonl")).alias("pred_path"),
    )
    out = ops.standardise(old)
    return out.select("id", "dataset", "shots", "layer", "pred_file", "pred_stem", F.round("macro_f1", 6).alias("macro_f1"), "run_dir")


@query("apply_filters", f"""
WITH s AS ({SCORES_SQL}) SELECT dataset, model, count(*) AS n FROM s WHERE dataset = 'har' AND model IN ('alder', 'birch') AND style = 'Direct' AND CAST(shots AS VARCHAR) IN ('0', '2') GROUP BY 1, 2""")
def apply_filters(spark, sf_dir):
    s = ops.apply_filters(scores(spark, sf_dir), "dataset=har, model=alder|birch, style=Direct, shots=0|2")
    return s.groupBy("dataset", "model").agg(F.count("*").alias("n"))


@query("variant_summary", f"""
WITH s AS ({SCORES_SQL}) SELECT dataset, model, embedding_type, style, round(min(macro_f1), 6) AS min_f1, round(max(macro_f1), 6) AS max_f1, round(avg(macro_f1), 6) AS mean_f1,
 round(median(macro_f1), 6) AS median_f1, round(max(macro_f1) - min(macro_f1), 6) AS delta_f1, count(*) AS n FROM s WHERE style IS NOT NULL GROUP BY 1, 2, 3, 4""")
def variant_summary(spark, sf_dir):
    return ops.variant_summary(scores(spark, sf_dir), ["dataset", "model", "embedding_type", "style"], "macro_f1")


_STAB = f"""
WITH s AS ({SCORES_SQL}) SELECT dataset, regexp_replace(model, '_[^_]*$', '') AS family, shots, avg(accuracy) AS mean, coalesce(stddev_samp(accuracy), 0) AS std, max(accuracy) - min(accuracy) AS range,
 count(*)::DOUBLE AS runs FROM s GROUP BY 1, 2, 3"""


def _stability(spark, sf_dir, interval):
    s = scores(spark, sf_dir).withColumn("family", ops.model_family(F.col("model")))
    out = ops.stability(s, ["dataset", "family", "shots"], "accuracy", interval)
    return out.select("dataset", "family", "shots", "runs", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("dataset", "family", "shots", "runs")])


@query("stability_report", f"SELECT dataset, family, shots, round(mean, 6) AS mean, round(std, 6) AS std, round(range, 6) AS range, runs FROM ({_STAB})")
def stability_report(spark, sf_dir):
    return _stability(spark, sf_dir, False)


@query("stability_interval")
def stability_interval(spark, sf_dir):
    """With the 95% t half-width (DuckDB has no t quantile; checked against tables in the tests)."""
    return _stability(spark, sf_dir, True)


@query("cost_summary", """
SELECT p_type AS embedding_type, round(avg(p_size), 4) AS avg_tokens, round(avg(p_retailprice / 1e6 * 1000), 4) AS cost_per_1k FROM {part} GROUP BY 1""")
def cost_summary(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("embedding_type"), F.col("p_size").alias("avg_total_tokens"), (F.col("p_retailprice") / 1e6).alias("avg_cost_usd")
    )
    return ops.cost_summary(p).select("embedding_type", F.round("avg_tokens", 4).alias("avg_tokens"), F.round("cost_per_1k", 4).alias("cost_per_1k"))


def _curve(agg: str, sql: str):
    def run(spark, sf_dir):
        s = scores(spark, sf_dir).where("method = 'logistic_regression'")
        out = ops.probe_curve(s, "macro_f1", "embedding_type", keep=["model"], avg_over=["dataset"], agg=agg)
        return out.select("layer", "label", F.round("macro_f1", 6).alias("macro_f1"))

    query(f"probe_curve_{agg}", f"""
WITH s AS ({SCORES_SQL}) SELECT layer, 'embedding_type=' || embedding_type || ' | model=' || model AS label, round({sql}(macro_f1), 6) AS macro_f1
FROM s WHERE method = 'logistic_regression' GROUP BY 1, 2""")(run)


for _agg, _sql in (("mean", "avg"), ("max", "max"), ("median", "median")):
    _curve(_agg, _sql)


@query("prompt_baselines", f"""
WITH s AS ({SCORES_SQL}), p AS (SELECT * FROM s WHERE method = 'visual_prompting' AND model IN ('alder', 'birch', 'cedar')
 QUALIFY row_number() OVER (PARTITION BY model, dataset, embedding_type ORDER BY shots = 0 DESC, ts DESC NULLS FIRST, id DESC) = 1),
m AS (SELECT model, embedding_type, avg(macro_f1) AS f FROM p GROUP BY 1, 2)
SELECT embedding_type, round(avg(f), 6) AS macro_f1 FROM m GROUP BY 1""")
def prompt_baselines(spark, sf_dir):
    out = ops.prompt_baselines(scores(spark, sf_dir), "macro_f1", "embedding_type", "ts", ["id"], {"model": ["alder", "birch", "cedar"]})
    return out.select("embedding_type", F.round("macro_f1", 6).alias("macro_f1"))


@query("prompt_baselines_by_model", f"""
WITH s AS ({SCORES_SQL}), p AS (SELECT * FROM s WHERE method = 'visual_prompting'
 QUALIFY row_number() OVER (PARTITION BY model, dataset, embedding_type ORDER BY shots = 0 DESC, ts DESC NULLS FIRST, id DESC) = 1)
SELECT model, round(avg(accuracy), 6) AS accuracy FROM p GROUP BY 1""")
def prompt_baselines_by_model(spark, sf_dir):
    out = ops.prompt_baselines(scores(spark, sf_dir), "accuracy", "model", "ts", ["id"])
    return out.select("model", F.round("accuracy", 6).alias("accuracy"))


@query("flat_lines", f"""
WITH s AS (SELECT model, embedding_type, CASE WHEN model LIKE '%random' AND embedding_type <> 'lets-ust' THEN NULL ELSE layer END AS layer, accuracy FROM ({SCORES_SQL})),
g AS (SELECT model, embedding_type, avg(accuracy) AS accuracy FROM s GROUP BY 1, 2 HAVING count(layer) = 0), r AS (SELECT min(layer) AS lo, max(layer) AS hi FROM s)
SELECT model, embedding_type, CAST(unnest(generate_series(lo, hi)) AS INT) AS layer, round(accuracy, 6) AS accuracy FROM g, r""")
def flat_lines(spark, sf_dir):
    hide = F.col("model").endswith("random") & (F.col("embedding_type") != "lets-ust")
    s = scores(spark, sf_dir).withColumn("layer", F.when(~hide, F.col("layer")))
    return ops.flat_lines(s, ["model", "embedding_type"], "accuracy").withColumn("accuracy", F.round("accuracy", 6))


_BOX = f"""
WITH s AS (SELECT embedding_type, CASE WHEN id % 50 = 0 THEN accuracy + 2 ELSE accuracy END AS v, id FROM ({SCORES_SQL})),
q AS (SELECT embedding_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM s GROUP BY 1),
w AS (SELECT embedding_type, count(*) AS n, least(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), any_value(q1)) AS whisker_low, greatest(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), any_value(q3)) AS whisker_high,
 count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers FROM s JOIN q USING (embedding_type) GROUP BY 1)"""


def _boxed(spark, sf_dir):
    return scores(spark, sf_dir).select("id", "embedding_type", F.when(F.col("id") % 50 == 0, F.col("accuracy") + 2).otherwise(F.col("accuracy")).alias("v"))


@query("box_stats", f"""{_BOX} SELECT embedding_type, n, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high, n_outliers
FROM w JOIN q USING (embedding_type)""")
def box_stats(spark, sf_dir):
    out = ops.box_stats(_boxed(spark, sf_dir), ["embedding_type"], "v")
    return out.select("embedding_type", "n", *[F.round(c, 6).alias(c) for c in ("q1", "med", "q3", "whisker_low", "whisker_high")], "n_outliers")


@query("box_outliers", f"{_BOX} SELECT id, embedding_type, round(v, 6) AS v FROM s JOIN w USING (embedding_type) WHERE v < whisker_low OR v > whisker_high")
def box_outliers(spark, sf_dir):
    return ops.box_outliers(_boxed(spark, sf_dir), ["embedding_type"], "v").select("id", "embedding_type", F.round("v", 6).alias("v"))


_PAIRS = f"""
s AS (SELECT *, CASE WHEN model LIKE '%\\_random' ESCAPE '\\' THEN 1 ELSE 0 END AS ctl, regexp_replace(model, '_random$', '') AS base_model FROM ({SCORES_SQL})),
f AS (SELECT base_model, ctl, dataset, embedding_type, shots, arg_min(macro_f1, id) AS f1 FROM s GROUP BY ALL),
pairs AS (SELECT b.base_model, b.dataset, b.embedding_type, b.shots, b.f1 AS base_score, c.f1 AS random_score, b.f1 - c.f1 AS delta
 FROM (SELECT * FROM f WHERE ctl = 0) b JOIN (SELECT * FROM f WHERE ctl = 1) c USING (base_model, dataset, embedding_type, shots))"""


def _pairs(spark, sf_dir):
    return ops.base_vs_control(scores(spark, sf_dir), ["dataset", "embedding_type", "shots"], "macro_f1", ["id"])


@query("base_vs_control", f"""WITH {_PAIRS} SELECT base_model, dataset, embedding_type, shots, round(base_score, 6) AS base_score, round(random_score, 6) AS random_score, round(delta, 6) AS delta FROM pairs""")
def base_vs_control(spark, sf_dir):
    return _pairs(spark, sf_dir).select("base_model", "dataset", "embedding_type", "shots", *[F.round(c, 6).alias(c) for c in ("base_score", "random_score", "delta")])


@query("signed_ranks", f"""
WITH {_PAIRS}, d AS (SELECT base_model, round(delta, 2) AS delta FROM pairs WHERE round(delta, 2) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY base_model ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY base_model, abs(delta)) - 1) / 2 AS r,
 count(*) OVER (PARTITION BY base_model, abs(delta)) AS c FROM d)
SELECT base_model, count(*) AS n, round(sum(CASE WHEN delta > 0 THEN r ELSE 0 END), 4) AS w_plus, sum(c * c - 1)::DOUBLE AS ties FROM r GROUP BY 1""")
def signed_ranks(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("delta", F.round("delta", 2))
    return ops.signed_ranks(pairs, "base_model", "delta").withColumn("w_plus", F.round("w_plus", 4))


@query("wilcoxon_greater")
def wilcoxon_greater(spark, sf_dir):
    """With p-values (no such function in DuckDB; exact and normal forms are checked in the tests)."""
    return ops.wilcoxon_greater(_pairs(spark, sf_dir), "base_model", "delta")


@query("common_categories", f"WITH s AS ({SCORES_SQL}) SELECT embedding_type FROM s WHERE model = 'alder' INTERSECT SELECT embedding_type FROM s WHERE model = 'birch_random' AND layer > 3")
def common_categories(spark, sf_dir):
    s = scores(spark, sf_dir).where("model <> 'birch_random' OR layer > 3")
    return ops.common_values(s, "embedding_type", "alder", "birch_random")


@query("top3_common", f"""
WITH s AS ({SCORES_SQL}), b AS (SELECT * FROM s WHERE model IN ('alder', 'alder_random'))
SELECT embedding_type, count(*) AS n FROM b WHERE embedding_type IN (SELECT embedding_type FROM b WHERE model = 'alder' INTERSECT SELECT embedding_type FROM b WHERE model = 'alder_random')
GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3""")
def top3_common(spark, sf_dir):
    return ops.top_common(scores(spark, sf_dir), "embedding_type", "alder", "alder_random", 3)


@query("top_of_bucket", f"""
WITH s AS ({SCORES_SQL}), b AS (SELECT * FROM s WHERE model IN ('cedar', 'cedar_random') AND embedding_type LIKE '%lets%' AND embedding_type NOT LIKE '%vis%')
SELECT embedding_type, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1""")
def top_of_bucket(spark, sf_dir):
    s = scores(spark, sf_dir).where(paths.modality_bucket(F.col("embedding_type")) == "d")
    return ops.top_common(s, "embedding_type", "cedar", "cedar_random", 1)


@query("numeric_key_order", """
WITH k AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_partkey % 120 AS VARCHAR) END AS k FROM {part})
SELECT k, row_number() OVER (ORDER BY try_cast(k AS INT) IS NULL, try_cast(k AS INT), k) - 1 AS pos FROM k""")
def numeric_key_order(spark, sf_dir):
    k = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise((F.col("p_partkey") % 120).cast("string")).alias("k")).distinct()
    return fl.numeric_order(k, "k").select("k", "pos")


@query("grid_completeness", f"""
WITH s AS ({SCORES_SQL}), g AS (SELECT m.x AS model, d.x AS dataset, e.x AS embedding_type FROM (SELECT unnest(['alder', 'birch', 'oak']) AS x) m, (SELECT unnest(['ctu', 'har', 'rwc']) AS x) d, (SELECT unnest(['lets-ust', 'vis-ust']) AS x) e),
o AS (SELECT model, dataset, embedding_type, count(*) AS n, count(CASE WHEN accuracy < 0.0005 THEN 1 END) AS bad FROM s GROUP BY ALL)
SELECT model, dataset, embedding_type, coalesce(n, 0) AS n_rows, CASE WHEN n IS NULL THEN 'missing' WHEN bad > 0 THEN 'unreadable' ELSE 'present' END AS status FROM g LEFT JOIN o USING (model, dataset, embedding_type)""")
def grid_completeness(spark, sf_dir):
    dims = {"model": ["alder", "birch", "oak"], "dataset": ["ctu", "har", "rwc"], "embedding_type": ["lets-ust", "vis-ust"]}
    return progress.completeness(progress.grid(spark, dims), scores(spark, sf_dir), list(dims), F.col("accuracy") >= 0.0005)


@query("presentation_rounding", f"WITH s AS ({SCORES_SQL}) SELECT id, round(accuracy, 3) AS r3, round(accuracy, 5) AS r5, round(macro_f1, 6) AS r6 FROM s")
def presentation_rounding(spark, sf_dir):
    return scores(spark, sf_dir).select("id", F.round("accuracy", 3).alias("r3"), F.round("accuracy", 5).alias("r5"), F.round("macro_f1", 6).alias("r6"))


@query("best_by_method", f"WITH s AS ({SCORES_SQL}) SELECT method, dataset, round(max(macro_f1), 6) AS best, count(DISTINCT model) AS n_models FROM s WHERE dataset IN ('ctu', 'tee') AND model NOT LIKE '%random' GROUP BY 1, 2")
def best_by_method(spark, sf_dir):
    """Method, model and dataset filters before the aggregation."""
    s = scores(spark, sf_dir).where(F.col("dataset").isin("ctu", "tee") & ~F.col("model").endswith("random"))
    return s.groupBy("method", "dataset").agg(F.round(F.max("macro_f1"), 6).alias("best"), F.countDistinct("model").alias("n_models"))
