"""Queries over text formats; the lines are built from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tsprobe.functions import series as fs
from tsprobe.plans.registry import derive, query, table
from tsprobe.sources import datasets, logs, recordings

JSONL_SQL = """
SELECT o_orderkey, CAST(o_custkey % 3 AS INT) AS file, CASE WHEN o_orderkey % 29 = 0 THEN '  ' WHEN o_orderkey % 31 = 0 THEN '{"idx": ' || o_orderkey || ', "gt": 1, "pr'
 ELSE '{"idx": ' || o_orderkey || ', "gt": ' || (o_custkey % 5) || ', "pred": ' || (o_orderkey % 5) || ', "model_output": "' || o_orderpriority || '"}' END AS value FROM {orders}"""
LOG = T.StructType([T.StructField("idx", T.LongType()), T.StructField("gt", T.IntegerType()), T.StructField("pred", T.IntegerType()), T.StructField("model_output", T.StringType())])


@query("jsonl_counts", f"""
WITH l AS ({JSONL_SQL}) SELECT file, count(*) AS lines_total, count(CASE WHEN o_orderkey % 29 <> 0 AND o_orderkey % 31 <> 0 THEN 1 END) AS lines_valid,
 count(CASE WHEN o_orderkey % 29 <> 0 AND o_orderkey % 31 = 0 THEN 1 END) AS lines_torn FROM l GROUP BY 1""")
def jsonl_counts(spark, sf_dir):
    return logs.line_counts(logs.parse_jsonl(derive(spark, sf_dir, JSONL_SQL), LOG), ["file"])


@query("jsonl_tolerant", "SELECT o_orderkey AS idx, CAST(o_custkey % 5 AS INT) AS gt, CAST(o_orderkey % 5 AS INT) AS pred, o_orderpriority AS model_output FROM {orders} WHERE o_orderkey % 29 <> 0 AND o_orderkey % 31 <> 0")
def jsonl_tolerant(spark, sf_dir):
    return logs.valid_rows(logs.parse_jsonl(derive(spark, sf_dir, JSONL_SQL), LOG)).select("idx", "gt", "pred", "model_output")


RAGGED_SQL = """
SELECT CASE WHEN o_orderkey % 41 = 0 THEN ' ' WHEN o_orderkey % 7 = 0 THEN o_orderkey || chr(9) || o_orderstatus WHEN o_orderkey % 11 = 0 THEN o_orderkey || chr(9) || o_orderstatus || chr(9) || o_custkey || chr(9) || chr(9)
 ELSE o_orderkey || chr(9) || o_orderstatus || chr(9) || o_custkey END AS value FROM {orders} UNION ALL SELECT DISTINCT 'id' || chr(9) || 'status' || chr(9) || 'cust' FROM {region}"""
HEADER = ["id", "status", "cust"]


@query("ragged_tsv", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS cust, o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 AS repaired FROM {orders} WHERE o_orderkey % 41 <> 0")
def ragged_tsv(spark, sf_dir):
    return logs.parse_ragged(derive(spark, sf_dir, RAGGED_SQL), HEADER)


@query("ragged_counts", "SELECT count(CASE WHEN o_orderkey % 41 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) THEN 1 END) AS repaired, count(CASE WHEN o_orderkey % 41 = 0 THEN 1 END) AS dropped FROM {orders}")
def ragged_counts(spark, sf_dir):
    return logs.ragged_counts(derive(spark, sf_dir, RAGGED_SQL), HEADER)


@query("auto_delimiter", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, '2024-01-0' || CAST(1 + o_orderkey % 9 AS VARCHAR) || ' 10:00:0' || CAST(o_orderkey % 10 AS VARCHAR) AS timestamp FROM {orders}")
def auto_delimiter(spark, sf_dir):
    """Space-separated rows whose time was split in two fields."""
    lines = derive(spark, sf_dir, """
SELECT o_orderkey || '  ' || o_orderstatus || ' 2024-01-0' || CAST(1 + o_orderkey % 9 AS VARCHAR(4)) || ' 10:00:0' || CAST(o_orderkey % 10 AS VARCHAR(4)) AS value FROM {orders}""")
    return logs.parse_auto(lines, "id status timestamp")


@query("ts_reader", """
SELECT vec_id AS idx, 16 AS n_steps, 4 AS n_channels, round(sum(floor(CAST(embedding[c * 16 + t + 1] AS DOUBLE) * 100) / 4 * (t + 1) * (c + 1)), 3) AS checksum, any_value(label) AS y
FROM {embeddings}, (SELECT unnest(range(0, 16)) AS t), (SELECT unnest(range(0, 4)) AS c) GROUP BY 1""")
def ts_reader(spark, sf_dir):
    cells = F.transform("embedding", lambda v: (F.floor(v.cast("double") * 100) / 4).cast("string"))
    channels = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.array_join(F.slice("cells", c * 16 + 1, 16), ","))
    e = table(spark, sf_dir, "embeddings").withColumn("cells", cells)
    lines = e.select(F.col("vec_id").alias("idx"), F.concat(F.array_join(channels, ":"), F.lit(":"), F.col("label").cast("string")).alias("value"))
    x = recordings.parse_ts(lines)
    per_step = F.transform("x", lambda r: fs.position_sum(r))
    return x.select("idx", F.size("x").alias("n_steps"), F.size(F.col("x")[0]).alias("n_channels"), F.round(fs.position_sum(per_step), 3).alias("checksum"), "y")


@query("ts_writer", """
WITH c AS (SELECT vec_id, label, list_transform(embedding, lambda x: regexp_replace(regexp_replace(printf('%.2f', floor(CAST(x AS DOUBLE) * 100) / 4), '0+$', ''), '\\.$', '')) AS c FROM {embeddings})
SELECT vec_id, array_to_string(list_transform(range(0, 32), lambda i: c[2 * i + 1]), ',') || ' : ' || array_to_string(list_transform(range(0, 32), lambda i: c[2 * i + 2]), ',') || ' : ' || label AS value FROM c""")
def ts_writer(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100) / 4)
    e = table(spark, sf_dir, "embeddings").select("vec_id", fs.reshape(v, 2).alias("x"), F.col("label").alias("y"))
    return recordings.format_ts(e, "x", "y", 6).select("vec_id", "value")


@query("ts_header", """
SELECT unnest(['@problemName demo', '@timestamps false', '@univariate false', '@equalLength true', '@seriesLength 16', '@missing false',
 '@classLabel true ' || (SELECT string_agg(CAST(label AS VARCHAR), ' ' ORDER BY label) FROM (SELECT DISTINCT label FROM {embeddings})), '@data']) AS value""")
def ts_header(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(fs.reshape(F.col("embedding"), 4).alias("x"), F.col("label").alias("y"))
    return recordings.ts_header(e, "x", "y", "demo")


@query("sensor_log", "SELECT event_id AS id, user_id AS subject_id, value + 1 AS ch1, CAST(event_id % 12 AS INT) AS label FROM {events}")
def sensor_log(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.format_string("log_subject%d.log", F.col("user_id")).alias("file_name"),
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("\t"), (F.col("value") + 1).cast("string"), F.lit("  "), (F.col("event_id") % 12).cast("string")).alias("value"),
    )
    return recordings.parse_sensor_log(lines, 3).select("id", "subject_id", F.get("ch", F.lit(1)).alias("ch1"), "label")


_LABELS = "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN 'filename,label' ELSE 'a/b/clip' || o_orderkey || '.wav, ' || (o_orderkey % 3) END AS value FROM {orders} WHERE o_orderkey % 5 <> 0"


@query("label_csv", "SELECT 'clip' || o_orderkey AS stem, CAST(least(o_orderkey % 3, 1) AS INT) AS y FROM {orders} WHERE o_orderkey % 5 <> 0 AND o_orderkey % 50 <> 7")
def label_csv(spark, sf_dir):
    return recordings.parse_label_csv(derive(spark, sf_dir, _LABELS).select("value"))


def _clips(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("clip"), F.col("o_orderkey").cast("string")).alias("stem"), F.col("o_totalprice").alias("v"))


@query("labelled_recordings", "SELECT CAST(least(o_orderkey % 3, 1) AS INT) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} WHERE o_orderkey % 5 <> 0 AND o_orderkey % 50 <> 7 GROUP BY 1")
def labelled_recordings(spark, sf_dir):
    labels = recordings.parse_label_csv(derive(spark, sf_dir, _LABELS).select("value"))
    return recordings.label_recordings(_clips(spark, sf_dir), labels).groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("unlabelled_recordings", "SELECT 'clip' || o_orderkey AS stem FROM {orders} WHERE o_orderkey % 5 = 0 OR o_orderkey % 50 = 7")
def unlabelled_recordings(spark, sf_dir):
    labels = recordings.parse_label_csv(derive(spark, sf_dir, _LABELS).select("value"))
    return recordings.unlabelled(_clips(spark, sf_dir), labels).select("stem")


@query("variant_pairs", """
WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey, 'sys_' || s_suppkey) - 1 AS rank FROM {supplier}), q AS (SELECT i.item_id, i.text, row_number() OVER (ORDER BY i.item_id) - 1 AS rank FROM {benchmark} i)
SELECT rank + 1 AS variant, 'system ' || s_suppkey AS system, md5(text) AS question FROM s JOIN q USING (rank)""")
def variant_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("sys_"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("system "), F.col("s_suppkey").cast("string")).alias("text"))
    q = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("gq"), F.col("item_id").cast("string")).alias("name"), "text")
    out = recordings.pair_variants(recordings.rank_variants(s), recordings.rank_variants(q))
    return out.select("variant", "system", F.md5("question").alias("question"))


@query("class_shot_artifact", """
SELECT l_orderkey AS source, CAST(l_linenumber AS INT) AS label, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS INT) AS rank, l_partkey AS idx FROM {lineitem}""")
def class_shot_artifact(spark, sf_dir):
    """Shot lists written as JSON text and read back."""
    li = table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey")))["l_partkey"].alias("idxs"))
    text = per.select(F.col("l_orderkey").alias("source"), F.to_json(F.create_map(F.col("l_linenumber").cast("string"), F.col("idxs"))).alias("value"))
    return datasets.parse_class_shots(text)


@query("label_map_artifact", """
SELECT n_nationkey AS source, CAST(r_regionkey AS VARCHAR) AS label, chr(CAST(65 + r_regionkey AS INT)) AS letter, r_name AS name FROM {nation}, {region}""")
def label_map_artifact(spark, sf_dir):
    """Label maps written as JSON text and read back, one document per nation."""
    r = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("label"), F.char((65 + F.col("r_regionkey")).cast("int")).alias("letter"), F.col("r_name").alias("name"), F.lit(1).alias("rank"), F.lit(0).alias("idx")
    )
    text = datasets.artifact_texts(r, r, "q")["label_maps.json"]
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source")).withColumn("value", text.scalar())
    return datasets.parse_label_maps(docs)


@query("series_positions", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, value AS v FROM {events}")
def series_positions(spark, sf_dir):
    """One long series positioned by time."""
    from tsprobe.operators.ordering import positions

    ev = table(spark, sf_dir, "events").select("event_id", "ts", F.col("value").alias("v"))
    return positions(ev, [], ["ts", "event_id"]).select("event_id", "pos", "v")
