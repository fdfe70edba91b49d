"""Inputs that the queries derive from the test tables.

The ``*_SQL`` texts run unchanged in Spark and DuckDB, so a query and its oracle
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tsprobe.operators.ordering import positions
from tsprobe.plans.registry import derive, table

# one series per user: position p, value v, label
SERIES_SQL = """
SELECT user_id, event_id, ts, value AS v, event_type AS label,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p
FROM {events}"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", F.col("value").alias("v"), F.col("event_type").alias("label")
    )
    return positions(ev, ["user_id"], ["ts", "event_id"], "p")


# labelled examples with a train/test split by id
SPLIT_SQL = """
SELECT vec_id AS idx, label AS y, embedding AS vec,
       CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM {embeddings}"""


def split_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, SPLIT_SQL)


# prediction log: one run per customer segment of orders, some answers unparsed (-1)
PREDICTIONS_SQL = """
SELECT o_orderkey AS idx,
       'run' || CAST(o_custkey % 4 AS VARCHAR(10)) AS run,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS gt,
       CASE WHEN o_orderkey % 17 = 0 THEN -1
            WHEN o_orderkey % 3 = 0 THEN CAST(1 + o_custkey % 5 AS INT)
            ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END AS pred
FROM {orders}"""

# attempts: five answers per order
ATTEMPTS_N = 20
ATTEMPTS_SQL = """
SELECT o_orderkey AS idx, a.attempt AS attempt, CAST(substr(o_orderpriority, 1, 1) AS INT) AS gt,
       CASE WHEN (o_orderkey * 7 + a.attempt * 13 + o_custkey) % 11 = 0 THEN -1
            ELSE CAST(1 + (o_custkey * (a.attempt + 3) + o_orderkey) % 5 AS INT) END AS pred
FROM {orders} CROSS JOIN (SELECT DISTINCT CAST(n_nationkey AS INT) AS attempt FROM {nation} WHERE n_nationkey < 20) a"""

# leaderboard rows as they are logged: metrics, prediction path, time text
RESULTS_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 23 = 0 THEN 'n/a'
            ELSE CAST(floor((o_totalprice * 100) % 10007) / 10007 AS VARCHAR(30)) END AS accuracy,
       CAST(floor((o_totalprice * 100) % 9973) / 9973 AS VARCHAR(30)) AS macro_f1,
       'data/sample_generations/' || model || '/' || dataset || '/' || method || '/' ||
       CASE WHEN method = 'random' THEN variant || '.jsonl'
            WHEN method = 'logistic_regression' THEN emb || '_' || shots || '-shot' || style || '/layer' || layer || '.jsonl'
            WHEN method = 'visual_prompting' THEN emb || '_' || shots || '-shot' || style || '.jsonl'
            ELSE emb || '/preds.jsonl' END AS pred_path,
       CASE WHEN o_orderkey % 19 = 0 THEN 'unknown'
            ELSE '20' || CAST(20 + o_orderkey % 6 AS VARCHAR(4)) || '-0' || CAST(1 + o_orderkey % 9 AS VARCHAR(4)) ||
                 '-1' || CAST(o_custkey % 10 AS VARCHAR(4)) || ' 10:' || CAST(10 + o_orderkey % 50 AS VARCHAR(4)) ||
                 ':' || CAST(10 + o_custkey % 50 AS VARCHAR(4)) END AS timestamp
FROM (
  SELECT o_orderkey, o_custkey, o_totalprice,
         CASE WHEN o_custkey % 6 = 0 THEN 'alder' WHEN o_custkey % 6 = 1 THEN 'alder_random'
              WHEN o_custkey % 6 = 2 THEN 'birch' WHEN o_custkey % 6 = 3 THEN 'birch_random'
              WHEN o_custkey % 6 = 4 THEN 'cedar' ELSE 'cedar_random' END AS model,
         CASE WHEN o_orderkey % 4 = 0 THEN 'ctu' WHEN o_orderkey % 4 = 1 THEN 'emg'
              WHEN o_orderkey % 4 = 2 THEN 'har' ELSE 'tee' END AS dataset,
         CASE WHEN o_orderkey % 10 < 6 THEN 'logistic_regression' WHEN o_orderkey % 10 < 8 THEN 'visual_prompting'
              WHEN o_orderkey % 10 = 8 THEN 'random' ELSE 'knn' END AS method,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'lets-ust' WHEN o_orderpriority = '2-HIGH' THEN 'vis-ust'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'vis-lets-ust' ELSE 'lets' END AS emb,
         CASE WHEN o_orderstatus = 'F' THEN '_Direct' WHEN o_orderstatus = 'O' THEN '_CoT' ELSE '' END AS style,
         CASE WHEN o_orderstatus = 'F' THEN 'prior' WHEN o_orderstatus = 'O' THEN 'uniform' ELSE 'majority' END AS variant,
         CAST((o_orderkey + o_custkey) % 3 AS VARCHAR(4)) AS shots,
         CAST(o_custkey % 33 AS VARCHAR(4)) AS layer
  FROM {orders}) o"""

# the same rows with keys already split out
SCORES_SQL = """
SELECT o_orderkey AS id,
       CASE WHEN o_custkey % 6 = 0 THEN 'alder' WHEN o_custkey % 6 = 1 THEN 'alder_random'
            WHEN o_custkey % 6 = 2 THEN 'birch' WHEN o_custkey % 6 = 3 THEN 'birch_random'
            WHEN o_custkey % 6 = 4 THEN 'cedar' ELSE 'cedar_random' END AS model,
       CASE WHEN o_orderkey % 4 = 0 THEN 'ctu' WHEN o_orderkey % 4 = 1 THEN 'emg'
            WHEN o_orderkey % 4 = 2 THEN 'har' ELSE 'tee' END AS dataset,
       CASE WHEN o_orderkey % 10 < 6 THEN 'logistic_regression' WHEN o_orderkey % 10 < 8 THEN 'visual_prompting'
            ELSE 'random' END AS method,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'lets-ust' WHEN o_orderpriority = '2-HIGH' THEN 'vis-ust'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'vis-lets-ust' ELSE 'ts-ust' END AS embedding_type,
       CASE WHEN o_orderstatus = 'F' THEN 'Direct' WHEN o_orderstatus = 'O' THEN 'CoT' END AS style,
       CAST((o_orderkey + o_custkey) % 3 AS INT) AS shots,
       CAST(o_custkey % 33 AS INT) AS layer,
       floor((o_totalprice * 100) % 10007) / 10007 AS accuracy,
       floor((o_totalprice * 100) % 9973) / 9973 AS macro_f1,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END AS ts
FROM {orders}"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, PREDICTIONS_SQL)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty attempts per order, generated in place (no join)."""
    o = table(spark, sf_dir, "orders")
    grid = o.select(
        F.col("o_orderkey").alias("idx"), "o_custkey",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("gt"),
        F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS_N - 1))).alias("attempt"),
    )
    a, k, c = F.col("attempt"), F.col("idx"), F.col("o_custkey")
    answer = F.when((k * 7 + a * 13 + c) % 11 == 0, F.lit(-1)).otherwise((1 + (c * (a + 3) + k) % 5).cast("int"))
    return grid.select("idx", "attempt", "gt", answer.alias("pred"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, RESULTS_SQL).drop("o_orderkey")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, SCORES_SQL)
