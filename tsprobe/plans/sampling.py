"""Queries over splits, samples, folds, shots and chance baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsprobe.functions import labels as fl
from tsprobe.operators import checks, metrics, splits
from tsprobe.plans.inputs import SPLIT_SQL, split_vectors
from tsprobe.plans.registry import query, table


def H(seed, col: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || CAST({col} AS VARCHAR)), 1, 8) AS BIGINT)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("y"), "o_orderstatus", "o_custkey"
    )


@query("group_split", f"""
WITH r AS (SELECT o_custkey, row_number() OVER (ORDER BY {H(7, 'o_custkey')}, o_custkey) AS r FROM (SELECT DISTINCT o_custkey FROM {{orders}}))
SELECT CASE WHEN r <= 100 THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_subjects,
       sum(o_orderkey)::BIGINT AS id_sum FROM {{orders}} JOIN r USING (o_custkey) GROUP BY 1""")
def group_split(spark, sf_dir):
    o = _orders(spark, sf_dir)
    out = splits.group_split(o, o, "o_custkey", n_test=100, seed=7)
    return out.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_subjects"), F.sum("idx").alias("id_sum")
    )


@query("stratified_split", f"""
WITH r AS (SELECT o_orderkey, o_orderpriority AS y, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H(42, 'o_orderkey')}, o_orderkey) AS r,
           count(*) OVER (PARTITION BY o_orderpriority) AS n FROM {{orders}}),
k AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE least(greatest(1, floor(0.85 * n)), n - 1) END AS k FROM r)
SELECT o_orderkey AS idx, y, CASE WHEN r <= k THEN 'train' ELSE 'test' END AS split FROM k""")
def stratified_split(spark, sf_dir):
    return splits.stratified_split(_orders(spark, sf_dir), "y", ["idx"], 0.85).select("idx", "y", "split")


@query("stratified_sample", f"""
WITH r AS (SELECT o_orderkey, o_orderpriority AS y, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H(42, 'o_orderkey')}, o_orderkey) AS r,
           count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS total FROM {{orders}}),
s AS (SELECT * FROM r WHERE r <= least(greatest(1, round_even(1003 * n / total, 0)), n)),
t AS (SELECT *, row_number() OVER (ORDER BY {H('42-trim', 'o_orderkey')}, o_orderkey) AS t FROM s)
SELECT o_orderkey AS idx, y FROM t WHERE t <= 1003""")
def stratified_sample(spark, sf_dir):
    return splits.stratified_sample(_orders(spark, sf_dir), "y", ["idx"], 1003).select("idx", "y")


@query("uniform_sample", f"""
SELECT o_orderkey AS idx FROM {{orders}} QUALIFY row_number() OVER (ORDER BY {H(5, 'o_orderkey')}, o_orderkey) <= 2000""")
def uniform_sample(spark, sf_dir):
    return splits.uniform_sample(_orders(spark, sf_dir), ["idx"], 2000, seed=5).select("idx")


@query("first_n", "SELECT o_orderkey AS idx, o_orderpriority AS y FROM {orders} WHERE o_orderkey < 500")
def first_n(spark, sf_dir):
    return splits.first_n(_orders(spark, sf_dir), "idx", 500).select("idx", "y")


@query("shuffle_reindex", f"""
SELECT o_orderkey AS idx, o_orderstatus AS split, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H(9, 'o_orderkey')}, o_orderkey) - 1 AS new_idx FROM {{orders}}""")
def shuffle_reindex(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumnRenamed("o_orderstatus", "split")
    return splits.shuffle_reindex(o, ["split"], ["idx"], seed=9).select("idx", "split", "new_idx")


@query("few_shot_interleave", f"""
WITH s AS ({SPLIT_SQL}), r AS (SELECT idx, y, row_number() OVER (PARTITION BY y ORDER BY {H(1, 'idx')}, idx) AS rank FROM s WHERE split = 'train')
SELECT idx, y, rank::BIGINT AS rank, row_number() OVER (ORDER BY rank, y) - 1 AS shot_order FROM r WHERE rank <= 3""")
def few_shot_interleave(spark, sf_dir):
    train = split_vectors(spark, sf_dir).where("split = 'train'")
    shots = splits.few_shots(train.select("idx", "y"), "y", ["idx"], 5, seed=1)
    out = splits.interleave_shots(shots, "y", n=3)
    return out.select("idx", "y", F.col("rank").cast("bigint").alias("rank"), "shot_order")


@query("few_shot_clip", f"""
WITH s AS ({SPLIT_SQL}), r AS (SELECT idx, y, row_number() OVER (PARTITION BY y ORDER BY {H(1, 'idx')}, idx) AS rank FROM s WHERE split = 'train')
SELECT y, count(*) AS n, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY rank) AS idxs FROM r WHERE rank <= 2 GROUP BY 1""")
def few_shot_clip(spark, sf_dir):
    """Shots kept class by class, without interleaving."""
    train = split_vectors(spark, sf_dir).where("split = 'train'")
    shots = splits.few_shots(train.select("idx", "y"), "y", ["idx"], 2, seed=1)
    idxs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "idx"))), lambda s: s["idx"].cast("string")), ",")
    return shots.groupBy("y").agg(F.count("*").alias("n"), idxs.alias("idxs"))


@query("shots_after_subset", f"""
WITH s AS ({SPLIT_SQL}), t AS (SELECT idx, y FROM s WHERE split = 'train'),
sub AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new_idx FROM t WHERE idx % 2 = 1),
r AS (SELECT idx, y, row_number() OVER (PARTITION BY y ORDER BY {H(1, 'idx')}, idx) AS rank FROM t)
SELECT r.idx, y, new_idx FROM r JOIN sub ON r.idx = sub.idx WHERE rank <= 5""")
def shots_after_subset(spark, sf_dir):
    train = split_vectors(spark, sf_dir).where("split = 'train'").select("idx", "y")
    subset = splits.reindex(train.where("idx % 2 = 1"), [], "idx")
    return splits.take_with_shots(splits.few_shots(train, "y", ["idx"], 5, seed=1), subset, "idx").select("idx", "y", "new_idx")


@query("kfold_contiguous", """
WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS p, count(*) OVER () AS n FROM {embeddings})
SELECT vec_id AS idx, CAST(CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1) ELSE (p - n % 7) // (n // 7) END AS INT) AS fold FROM p""")
def kfold_contiguous(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"))
    return splits.kfold_contiguous(e, "idx", 7)


@query("kfold_stratified", """
WITH c AS (SELECT label, count(*) AS n, min(vec_id) AS f FROM {embeddings} GROUP BY 1),
e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM {embeddings}),
o AS (SELECT label, row_number() OVER (ORDER BY f) - 1 AS code FROM c),
flat AS (SELECT code, row_number() OVER (ORDER BY code, vec_id) - 1 AS j FROM e JOIN o USING (label)),
alloc AS (SELECT code, j % 5 AS fold, count(*) AS a FROM flat GROUP BY 1, 2),
upto AS (SELECT code, fold, sum(a) OVER (PARTITION BY code ORDER BY fold) AS hi, sum(a) OVER (PARTITION BY code ORDER BY fold) - a AS lo FROM alloc)
SELECT vec_id AS idx, label AS y, CAST(fold AS INT) AS fold FROM e JOIN o USING (label) JOIN upto USING (code) WHERE r >= lo AND r < hi""")
def kfold_stratified(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").alias("y"))
    return splits.kfold_stratified(e, "y", "idx", 5)


@query("time_folds", """
WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS p, count(*) OVER () AS n FROM {embeddings}),
f AS (SELECT unnest(generate_series(0, 4)) AS fold),
j AS (SELECT fold, vec_id, CASE WHEN p < n - (5 - fold) * (n // 6) THEN 'train' WHEN p < n - (4 - fold) * (n // 6) THEN 'val' END AS role FROM p, f)
SELECT CAST(fold AS INT) AS fold, role, count(*) AS n, min(vec_id) AS first_idx, max(vec_id) AS last_idx FROM j WHERE role IS NOT NULL GROUP BY 1, 2""")
def time_folds(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"))
    out = splits.time_folds(e, "idx", 5)
    return out.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


_METRICS = """
cells AS (SELECT gt, pred, count(*) AS c FROM p GROUP BY 1, 2),
lab AS (SELECT gt AS l FROM cells UNION SELECT pred FROM cells),
f AS (SELECT l, coalesce((SELECT sum(c) FROM cells WHERE gt = l AND pred = l), 0) AS tp,
             coalesce((SELECT sum(c) FROM cells WHERE gt = l), 0) AS support, coalesce((SELECT sum(c) FROM cells WHERE pred = l), 0) AS called FROM lab)
SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END) FROM p), 6) AS accuracy,
       round(avg(CASE WHEN support + called = 0 THEN 0 ELSE 2 * tp / (support + called) END), 6) AS macro_f1 FROM f"""


def _baseline(mode: str):
    def run(spark, sf_dir):
        s = split_vectors(spark, sf_dir).select("idx", "y", "split")
        train, test = s.where("split = 'train'"), s.where("split = 'test'")
        p = splits.baseline_predict(train, test, "y", "idx", mode)
        m = metrics.classification_metrics(p.withColumnRenamed("y", "gt"), [])
        return m.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))

    return run


query("baseline_uniform", f"""
WITH s AS ({SPLIT_SQL}), t AS (SELECT list_sort(list(DISTINCT y)) AS l FROM s WHERE split = 'train'),
p AS (SELECT idx, y AS gt, l[{H(42, 'idx')} % len(l) + 1] AS pred FROM s, t WHERE split = 'test'), {_METRICS}""")(_baseline("uniform"))

query("baseline_prior", f"""
WITH s AS ({SPLIT_SQL}), c AS (SELECT y, count(*) AS c FROM s WHERE split = 'train' GROUP BY 1),
cdf AS (SELECT y, sum(c) OVER (ORDER BY y) - c AS lo, sum(c) OVER (ORDER BY y) AS hi, sum(c) OVER () AS n FROM c),
p AS (SELECT idx, s.y AS gt, cdf.y AS pred FROM s JOIN cdf ON {H(42, 'idx')} / 4294967296.0 * n >= lo AND {H(42, 'idx')} / 4294967296.0 * n < hi WHERE split = 'test'), {_METRICS}""")(_baseline("prior"))

query("baseline_majority", f"""
WITH s AS ({SPLIT_SQL}), m AS (SELECT y FROM (SELECT y, count(*) AS c, min(idx) AS f FROM s WHERE split = 'train' GROUP BY 1) ORDER BY c DESC, f LIMIT 1),
p AS (SELECT idx, s.y AS gt, m.y AS pred FROM s, m WHERE split = 'test'), {_METRICS}""")(_baseline("majority"))


@query("train_prior", f"""
WITH s AS ({SPLIT_SQL}) SELECT y, count(*) AS n, round(count(*) / (SELECT count(*) FROM s WHERE split = 'train'), 6) AS p FROM s WHERE split = 'train' GROUP BY 1""")
def train_prior(spark, sf_dir):
    train = split_vectors(spark, sf_dir).where("split = 'train'").select("y")
    return splits.prior(train, "y").select("y", "n", F.round("p", 6).alias("p"))


_KIND = "p_brand || ' ' || p_type || ' ' || p_name"


@query("unseen_labels", f"SELECT DISTINCT {_KIND} AS y FROM {{part}} WHERE p_size > 45 AND {_KIND} NOT IN (SELECT {_KIND} FROM {{part}} WHERE p_size <= 45)")
def unseen_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.expr(_KIND).alias("y"), "p_size")
    return splits.unseen_labels(p.where("p_size <= 45"), p.where("p_size > 45"), "y")


@query("class_histogram", f"WITH s AS ({SPLIT_SQL}) SELECT split, y, count(*) AS n FROM s GROUP BY 1, 2")
def class_histogram(spark, sf_dir):
    return splits.class_histogram(split_vectors(spark, sf_dir), ["split"], "y")


@query("dataset_statistics", f"""
WITH s AS (SELECT *, 8 + idx % 5 AS n FROM ({SPLIT_SQL})) SELECT split, count(*) AS n_rows, CAST(min(n) AS INT) AS least_steps, round(avg(n), 6) AS mean_steps, CAST(max(n) AS INT) AS n_steps,
 count(DISTINCT n || '/' || (1 + idx % 2)) AS n_shapes, CAST(max(1 + idx % 2) AS INT) AS n_channels, count(DISTINCT idx % 17) AS n_subjects, count(DISTINCT y) AS n_classes,
 (SELECT '{{' || string_agg('"' || y || '":' || c, ',' ORDER BY y) || '}}' FROM (SELECT split AS sp, y, count(*) AS c FROM s GROUP BY 1, 2) WHERE sp = s.split) AS histogram FROM s GROUP BY 1""")
def dataset_statistics(spark, sf_dir):
    """Samples of 8 to 12 steps and one or two channels, of 17 subjects, cut from the vectors."""
    i = F.col("idx").cast("int")
    cut = lambda first: F.slice("vec", F.lit(first), 8 + i % 5)
    s = split_vectors(spark, sf_dir).withColumn("subject", i % 17)
    s = s.withColumn("x", F.slice(F.array(cut(1), cut(20)), F.lit(1), 1 + i % 2))
    out = checks.dataset_statistics(s, "split", "y", "x", "subject")
    return out.withColumn("mean_steps", F.round("mean_steps", 6))


@query("label_remap", """
SELECT o_orderkey AS idx, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 0 WHEN '4' THEN 1 END AS y FROM {orders}
WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '4')""")
def label_remap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.substring("o_orderpriority", 1, 1).cast("int").alias("y"))
    return fl.remap(o, "y", {1: 0, 2: 0, 4: 1})


@query("zero_base_shift", """
WITH o AS (SELECT o_orderkey AS idx, CAST(substr(o_orderpriority, 1, 1) AS INT) AS y, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM {orders})
SELECT idx, split, y - (SELECT min(y) FROM o WHERE split = 'train') AS y FROM o""")
def zero_base_shift(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"), F.substring("o_orderpriority", 1, 1).cast("int").alias("y"),
        F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("split"),
    )
    return fl.zero_base(o, "y", "split")


@query("dense_label_index", """
WITH d AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS y FROM (SELECT DISTINCT p_brand FROM {part} WHERE p_partkey % 4 <> 0))
SELECT p_partkey AS idx, d.y AS y FROM {part} JOIN d USING (p_brand)""")
def dense_label_index(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("name"))
    return fl.dense_index(p.where("idx % 4 <> 0"), p, "name").select("idx", "y")


@query("label_letters", """
WITH ids AS (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN 'x' || p_size ELSE CAST(p_size AS VARCHAR) END AS id FROM {part}),
r AS (SELECT id, row_number() OVER (ORDER BY try_cast(id AS INT) IS NULL, try_cast(id AS INT), id) AS r FROM ids)
SELECT id AS label, CASE WHEN r <= 26 THEN chr(CAST(64 + r AS INT)) ELSE chr(CAST(64 + (r - 1) // 26 AS INT)) || chr(CAST(65 + (r - 1) % 26 AS INT)) END AS letter FROM r""")
def label_letters(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("x"), F.col("p_size"))).otherwise(F.col("p_size").cast("string")).alias("label")
    ).distinct()
    return fl.with_letters(ids, "label").select("label", "letter")


@query("option_block", """
WITH b AS (SELECT DISTINCT p_type AS t, p_brand AS name FROM {part}),
r AS (SELECT t, name, row_number() OVER (PARTITION BY t ORDER BY name) AS r FROM b)
SELECT t, 'Your options are:' || chr(10) || chr(9) || string_agg('[' || chr(CAST(64 + r AS INT)) || '] ' || name, chr(10) || chr(9) ORDER BY r) AS block FROM r GROUP BY 1""")
def option_block(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("t"), F.col("p_brand").alias("name")).distinct()
    return fl.option_block(fl.with_letters(names, "name", ["t"]), ["t"], "name")


@query("label_lookup", """
SELECT n_nationkey AS idx, n_name, r_name AS name, chr(CAST(65 + n_regionkey AS INT)) AS letter FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""")
def label_lookup(spark, sf_dir):
    maps = fl.with_letters(
        table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("label"), F.col("r_name").alias("name")), "label"
    )
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), "n_name", F.col("n_regionkey").alias("y"))
    return fl.attach_labels(n, "y", maps).select("idx", "n_name", "name", "letter")


@query("cross_dataset_split", """
SELECT 'a-to-b' AS dataset, CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS split, y, count(*) AS n FROM (
 SELECT 'train' AS split, CASE WHEN label IN (1, 2, 3) THEN 0 ELSE 1 END AS y FROM {embeddings} WHERE vec_id % 2 = 0 AND vec_id % 5 <> 0 AND label IN (1, 2, 3, 4)
 UNION ALL SELECT 'test', label FROM {embeddings} WHERE vec_id % 2 = 1 AND vec_id % 5 = 0 AND label IN (0, 1)) GROUP BY ALL""")
def cross_dataset_split(spark, sf_dir):
    s = split_vectors(spark, sf_dir)
    a = fl.remap(s.where("idx % 2 = 0"), "y", {1: 0, 2: 0, 3: 0, 4: 1})
    b = s.where("idx % 2 = 1 AND y IN (0, 1)")
    return splits.class_histogram(checks.cross_dataset(a, b, "a-to-b"), ["dataset", "split"], "y")


@query("class_coverage", f"""
WITH s AS ({SPLIT_SQL}), a AS (SELECT DISTINCT y FROM s WHERE split = 'train'), b AS (SELECT DISTINCT y FROM s WHERE split = 'test')
SELECT coalesce(a.y, b.y) AS y, a.y IS NOT NULL AS in_train, b.y IS NOT NULL AS in_test, a.y IS NOT NULL AND b.y IS NOT NULL AS ok FROM a FULL JOIN b ON a.y = b.y""")
def class_coverage(spark, sf_dir):
    s = split_vectors(spark, sf_dir).select("y", "split")
    return checks.class_coverage(s.where("split = 'train'"), s.where("split = 'test'"), "y")


@query("row_alignment", """
SELECT count(CASE WHEN doc_id IS NOT NULL AND vec_id IS NOT NULL THEN 1 END) AS n_rows, count(CASE WHEN vec_id IS NULL THEN 1 END) AS only_left, count(CASE WHEN doc_id IS NULL THEN 1 END) AS only_right,
 count(DISTINCT len(embedding)) AS n_dims, count(CASE WHEN quality <> label THEN 1 END) AS label_mismatch FROM {labels} FULL OUTER JOIN {embeddings} ON doc_id = vec_id""")
def row_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").alias("y"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"), F.col("label").alias("y"))
    return checks.row_alignment(rows, vecs, "idx", "vec", "y")


@query("input_kinds", """
WITH k AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'ts,ust' WHEN 1 THEN 'ust,vis,lets' WHEN 2 THEN 'ts,lets,ust' WHEN 3 THEN 'vis' WHEN 4 THEN 'lets,vis' ELSE 'vis,ust' END AS kinds FROM {part})
SELECT kinds, kinds IN ('ts,ust', 'ust,vis,lets', 'vis,ust') AS valid, count(*) AS n FROM k GROUP BY 1, 2""")
def input_kinds(spark, sf_dir):
    k = F.col("p_partkey") % 6
    kinds = F.when(k == 0, "ts,ust").when(k == 1, "ust,vis,lets").when(k == 2, "ts,lets,ust").when(k == 3, "vis").when(k == 4, "lets,vis").otherwise("vis,ust")
    p = table(spark, sf_dir, "part").select(kinds.alias("kinds"))
    return p.groupBy("kinds", checks.valid_kinds(F.col("kinds")).alias("valid")).agg(F.count("*").alias("n"))
