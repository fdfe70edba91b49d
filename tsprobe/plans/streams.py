"""Streaming queries run to the end of their input; each equals its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tsprobe.functions import series as fs
from tsprobe.plans.inputs import PREDICTIONS_SQL, SCORES_SQL, scores, series
from tsprobe.plans.registry import query, table
from tsprobe.plans.windowing import STRIDE, WIDTH, WINDOW_CTES
from tsprobe.session import scratch_dir
from tsprobe.streaming import live


def _orders_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "orders").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)


def _as_predictions(orders):
    gt = F.substring("o_orderpriority", 1, 1).cast("int")
    pred = F.when(F.col("o_orderkey") % 17 == 0, -1).when(F.col("o_orderkey") % 3 == 0, (1 + F.col("o_custkey") % 5).cast("int")).otherwise(gt)
    return orders.select(
        F.col("o_orderkey").alias("idx"), F.concat(F.lit("run"), (F.col("o_custkey") % 4).cast("string")).alias("run"), gt.alias("gt"), pred.alias("pred"),
        F.col("o_orderdate").cast("timestamp").alias("ingested_at"),
    )


_ACC = f"""
WITH p AS ({PREDICTIONS_SQL}) SELECT run, count(*) AS seen, sum(CASE WHEN pred >= 0 AND pred = gt THEN 1 ELSE 0 END)::BIGINT AS "right",
 round(avg(CASE WHEN pred >= 0 AND pred = gt THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1"""


@query("stream_live_accuracy", _ACC)
def stream_live_accuracy(spark, sf_dir):
    name = "live_" + uuid.uuid4().hex
    out = live.live_accuracy(_as_predictions(_orders_stream(spark, sf_dir)), ["run"])
    # the memory sink only receives one row per run
    live.run_to_end(out.writeStream.format("memory").queryName(name).outputMode("complete"), scratch_dir(spark, "cp"))
    return spark.table(name).withColumn("accuracy", F.round("accuracy", 6))


@query("stream_exactly_once", _ACC)
def stream_exactly_once(spark, sf_dir):
    """Every row arrives twice; the duplicate is ignored."""
    once = _as_predictions(_orders_stream(spark, sf_dir))
    twice = once.union(once)
    path = scratch_dir(spark, "attempts")
    kept = live.exactly_once(twice, ["run", "idx"], "ingested_at", "1 day")
    live.run_to_end(kept.writeStream.foreachBatch(live.batch_writer(path)), scratch_dir(spark, "cp"))
    return live.live_accuracy(spark.read.parquet(path), ["run"]).withColumn("accuracy", F.round("accuracy", 6))


@query("stream_count_windows", f"""
WITH {WINDOW_CTES} SELECT user_id, win * {STRIDE} AS start, round(sum(v * (p - win * {STRIDE} + 1)), 3) AS checksum, max(CASE WHEN p = win * {STRIDE} + {WIDTH - 1} THEN label END) AS last_label FROM wrows GROUP BY 1, 2""")
def stream_count_windows(spark, sf_dir):
    source, path = scratch_dir(spark, "samples"), scratch_dir(spark, "windows")
    samples = series(spark, sf_dir).select("user_id", "p", "v", "label", "ts")
    samples.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(source)
    stream = spark.readStream.schema(samples.schema).parquet(source)
    out = live.stream_windows(stream, ["user_id"], "p", "v", "label", WIDTH, STRIDE, "ts", "1 hour")
    live.run_to_end(out.writeStream.foreachBatch(live.batch_writer(path)), scratch_dir(spark, "cp"))
    w = spark.read.parquet(path)
    return w.select("user_id", "start", F.round(fs.position_sum(F.col("values")), 3).alias("checksum"), F.element_at("labels", -1).alias("last_label"))


@query("stream_upsert", f"""
WITH s AS (SELECT dataset || '/' || model || '/' || layer AS pred_path, ts, id FROM ({SCORES_SQL})) SELECT pred_path, CAST(max(ts) AS VARCHAR) AS ts FROM s GROUP BY 1""")
def stream_upsert(spark, sf_dir):
    source, path = scratch_dir(spark, "scores"), scratch_dir(spark, "leaderboard")
    rows = scores(spark, sf_dir).select(F.concat_ws("/", "dataset", "model", F.col("layer").cast("string")).alias("pred_path"), "ts", "accuracy")
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(source)
    live.run_to_end(stream.writeStream.foreachBatch(live.upsert_writer(path, "pred_path", "ts")), scratch_dir(spark, "cp"))
    return live.latest_rows(spark, path, rows.schema).select("pred_path", F.col("ts").cast("string").alias("ts"))
