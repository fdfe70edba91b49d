"""Queries over vectors and probe models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tsprobe.functions import series as fs
from tsprobe.functions import vectors as fv
from tsprobe.operators import checks, knn, metrics, probes, scaling, vectors, windows
from tsprobe.plans.evaluation import metrics_sql
from tsprobe.plans.inputs import SPLIT_SQL, series, split_vectors
from tsprobe.plans.registry import query, table
from tsprobe.session import materialise


def _vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").alias("y"), F.col("embedding").alias("vec"))


@query("vector_mean", """
WITH x AS (SELECT label, unnest(range(1, 65)) AS i, embedding AS e, vec_id % 7 + 1 AS w FROM {embeddings}),
m AS (SELECT label, i, sum(w * CAST(e[i] AS DOUBLE)) / sum(w) AS m, sum(w) AS sw FROM x GROUP BY 1, 2)
SELECT label AS y, round(sum(m * i), 5) AS checksum, max(sw)::DOUBLE AS weight FROM m GROUP BY 1""")
def vector_mean(spark, sf_dir):
    v = _vecs(spark, sf_dir).withColumn("w", F.col("idx") % 7 + 1)
    out = vectors.vector_mean(v, ["y"], "vec", "w")
    return out.select("y", F.round(fs.position_sum(F.col("vec")), 5).alias("checksum"), "weight")


@query("tail_patch_pool", """
WITH p AS (SELECT vec_id // 8 AS win, vec_id % 8 AS patch, embedding AS e FROM {embeddings}),
k AS (SELECT * FROM p WHERE patch >= 8 - greatest(1, ceil((win * 5 % 64) / 8))), x AS (SELECT win, e, unnest(range(1, 65)) AS i FROM k),
m AS (SELECT win, i, avg(CAST(e[i] AS DOUBLE)) AS m, count(*) AS n FROM x GROUP BY 1, 2)
SELECT win, round(sum(m * i), 5) AS checksum, max(n)::DOUBLE AS n_patches FROM m GROUP BY 1""")
def tail_patch_pool(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    p = v.select(F.floor(F.col("idx") / 8).alias("win"), (F.col("idx") % 8).alias("patch"), "vec").withColumn("len", F.col("win") * 5 % 64)
    out = vectors.tail_patch_pool(p, ["win"], "patch", 8, "len", "vec")
    return out.select("win", F.round(fs.position_sum(F.col("vec")), 5).alias("checksum"), F.col("weight").alias("n_patches"))


@query("masked_mean_pool", """
WITH p AS (SELECT vec_id // 8 AS seq, embedding AS e FROM {embeddings} WHERE vec_id % 8 < 1 + vec_id // 8 % 8), x AS (SELECT seq, e, unnest(range(1, 65)) AS i FROM p),
m AS (SELECT seq, i, avg(CAST(e[i] AS DOUBLE)) AS m, count(*) AS n FROM x GROUP BY 1, 2)
SELECT seq, round(sum(m * i), 5) AS checksum, max(n)::DOUBLE AS n_tokens FROM m GROUP BY 1""")
def masked_mean_pool(spark, sf_dir):
    v = _vecs(spark, sf_dir).withColumn("seq", F.floor(F.col("idx") / 8))
    v = v.withColumn("mask", (F.col("idx") % 8 < 1 + F.col("seq") % 8).cast("int"))
    out = vectors.masked_mean_pool(v, ["seq"], "vec", "mask")
    return out.select("seq", F.round(fs.position_sum(F.col("vec")), 5).alias("checksum"), F.col("weight").alias("n_tokens"))


@query("l2_normalise", """
WITH x AS (SELECT vec_id, unnest(range(1, 65)) AS i, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS n FROM {embeddings})
SELECT vec_id AS idx, round(sum(CAST(e[i] AS DOUBLE) / n * i), 5) AS checksum, 1.0::DOUBLE AS norm FROM x GROUP BY 1""")
def l2_normalise(spark, sf_dir):
    v = _vecs(spark, sf_dir).withColumn("u", fv.l2_normalise(F.col("vec")))
    return v.select("idx", F.round(fs.position_sum(F.col("u")), 5).alias("checksum"), F.round(fv.norm(F.col("u")), 6).alias("norm"))


@query("vector_distances", """
WITH p AS (SELECT a.vec_id AS idx, list_transform(a.embedding, lambda v: CAST(v AS DOUBLE)) AS a, list_transform(b.embedding, lambda v: CAST(v AS DOUBLE)) AS b FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1)
SELECT idx, round(1 - list_cosine_similarity(a, b), 6) AS cosine, round(list_distance(a, b), 6) AS euclidean, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) AS manhattan FROM p""")
def vector_distances(spark, sf_dir):
    v = _vecs(spark, sf_dir).select("idx", "vec")
    p = v.join(v.select((F.col("idx") - 1).alias("idx"), F.col("vec").alias("other")), "idx")
    a, b = F.col("vec"), F.col("other")
    return p.select(
        "idx", F.round(fv.cosine_distance(a, b), 6).alias("cosine"), F.round(fv.euclidean_distance(a, b), 6).alias("euclidean"),
        F.round(fv.manhattan_distance(a, b), 6).alias("manhattan"),
    )


def _layered(spark, sf_dir):
    return _vecs(spark, sf_dir).withColumn("layer", (F.col("idx") % 5).cast("int")).withColumn("split", F.when(F.col("idx") % 3 == 0, "test").otherwise("train"))


@query("select_last_layer", "SELECT vec_id AS idx, 4 AS layer FROM {embeddings} WHERE vec_id % 5 = 4")
def select_last_layer(spark, sf_dir):
    return vectors.select_layer(_layered(spark, sf_dir), -1).select("idx", "layer")


@query("select_layer", "SELECT vec_id AS idx, 2 AS layer FROM {embeddings} WHERE vec_id % 5 = 2")
def select_layer(spark, sf_dir):
    return vectors.select_layer(_layered(spark, sf_dir), 2).select("idx", "layer")


@query("layer_alignment", "SELECT CAST(vec_id % 5 AS INT) AS layer, count(CASE WHEN vec_id % 3 <> 0 THEN 1 END) AS n_train, count(CASE WHEN vec_id % 3 = 0 THEN 1 END) AS n_test, 1::BIGINT AS n_dims, true AS ok FROM {embeddings} GROUP BY 1")
def layer_alignment(spark, sf_dir):
    return checks.layer_alignment(_layered(spark, sf_dir))


@query("vector_scaler", """
WITH x AS (SELECT vec_id, i, CAST(e[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding AS e, unnest(range(1, 65)) AS i FROM {embeddings})),
s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM x WHERE vec_id % 5 <> 0 GROUP BY 1)
SELECT vec_id AS idx, round(sum((v - m) / sd * i), 4) AS checksum FROM x JOIN s USING (i) GROUP BY 1""")
def vector_scaler(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    z = scaling.apply_vector_scaler(v, "vec", scaling.fit_vector_scaler(v.where("idx % 5 <> 0"), "vec"))
    return z.select("idx", F.round(fs.position_sum(F.col("vec")), 4).alias("checksum"))


_DIST = {
    "cosine": "1 - list_cosine_similarity(a.v, b.v)",
    "euclidean": "list_distance(a.v, b.v)",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
}
_VECS = f"s AS (SELECT idx, y, split, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM ({SPLIT_SQL}))"


def _vote(k: str) -> str:
    return f"(SELECT idx, nb_y, count(*) AS c FROM nn WHERE rank <= {k} GROUP BY 1, 2)"


def _knn(metric: str, k: int):
    def run(spark, sf_dir):
        s = split_vectors(spark, sf_dir)
        return knn.knn_predict(s.where("split = 'train'"), s.where("split = 'test'"), k, metric)

    query(f"knn_{metric}", f"""
WITH {_VECS}, nn AS (SELECT a.idx, a.y AS gt, b.y AS nb_y, row_number() OVER (PARTITION BY a.idx ORDER BY round({_DIST[metric]}, 9), b.idx) AS rank
 FROM s a JOIN s b ON a.split = 'test' AND b.split = 'train')
SELECT idx, y AS gt, nb_y AS pred FROM {_vote(str(k))} JOIN s USING (idx) QUALIFY row_number() OVER (PARTITION BY idx ORDER BY c DESC, nb_y) = 1""")(run)


for _m, _k in (("cosine", 5), ("euclidean", 7), ("manhattan", 3)):
    _knn(_m, _k)


@query("knn_neighbours", f"""
WITH {_VECS}, nn AS (SELECT a.idx, b.idx AS nb_idx, round({_DIST['cosine']}, 9) AS d FROM s a JOIN s b ON a.split = 'test' AND b.split = 'train')
SELECT idx, nb_idx, round(d, 6) AS dist, CAST(row_number() OVER (PARTITION BY idx ORDER BY d, nb_idx) AS INT) AS rank FROM nn QUALIFY row_number() OVER (PARTITION BY idx ORDER BY d, nb_idx) <= 21""")
def knn_neighbours(spark, sf_dir):
    s = split_vectors(spark, sf_dir)
    nn = knn.nearest(s.where("split = 'train'"), s.where("split = 'test'"), 21)
    return nn.select("idx", "nb_idx", F.round("dist", 6).alias("dist"), "rank")


@query("knn_recall", f"""
WITH {_VECS} SELECT 10 AS k, (SELECT count(*) FROM s WHERE split = 'test') AS n_queries, count(*) AS n_exact, true AS reached
FROM (SELECT a.idx FROM s a JOIN s b ON a.split = 'test' AND b.split = 'train' QUALIFY row_number() OVER (PARTITION BY a.idx ORDER BY round({_DIST['cosine']}, 9), b.idx) <= 10)""")
def knn_recall(spark, sf_dir):
    """Approximate neighbours of all test rows against the exact ones: 0.9 of them at least are found."""
    s = split_vectors(spark, sf_dir)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    share = knn.recall(knn.nearest(train, test, 10), knn.nearest_approximate(train, test, 10, probes=24))
    n_queries = test.agg(F.count("*")).scalar()
    return share.select(F.lit(10).alias("k"), n_queries.alias("n_queries"), F.col("n").alias("n_exact"), (F.col("recall") >= 0.9).alias("reached"))


_GRID = f"""
{_VECS}, t AS (SELECT idx, y, v FROM s WHERE split = 'train'),
cl AS (SELECT y, count(*) AS n, min(idx) AS f FROM t GROUP BY 1), o AS (SELECT y, row_number() OVER (ORDER BY f) AS code FROM cl),
flat AS (SELECT idx, code, row_number() OVER (ORDER BY code, idx) - 1 AS j, row_number() OVER (PARTITION BY code ORDER BY idx) - 1 AS r FROM t JOIN o USING (y)),
al AS (SELECT code, j % 5 AS fold, count(*) AS a FROM flat GROUP BY 1, 2), up AS (SELECT code, fold, sum(a) OVER (PARTITION BY code ORDER BY fold) AS hi, sum(a) OVER (PARTITION BY code ORDER BY fold) - a AS lo FROM al),
fo AS (SELECT idx, fold FROM flat JOIN up USING (code) WHERE r >= lo AND r < hi), tf AS (SELECT t.*, fold FROM t JOIN fo USING (idx)),
cvn AS (SELECT a.idx, a.fold, a.y AS gt, b.y AS nb_y, row_number() OVER (PARTITION BY a.idx ORDER BY round({_DIST['cosine']}, 9), b.idx) AS rank FROM tf a JOIN tf b ON a.fold <> b.fold),
ks AS (SELECT unnest([1, 3, 5, 7, 9, 11, 15, 21]) AS k), cvv AS (SELECT k, idx, fold, gt, nb_y, count(*) AS c FROM cvn, ks WHERE rank <= k GROUP BY ALL),
cvp AS (SELECT k, fold, gt, nb_y AS pred FROM cvv QUALIFY row_number() OVER (PARTITION BY k, idx ORDER BY c DESC, nb_y) = 1), {metrics_sql('cvp', 'k, fold')},
sc AS (SELECT k, avg(macro_f1) AS cv_f1 FROM m GROUP BY 1)"""


@query("knn_cv_scores", f"WITH {_GRID} SELECT k, round(cv_f1, 6) AS cv_f1 FROM sc")
def knn_cv_scores(spark, sf_dir):
    s = split_vectors(spark, sf_dir).where("split = 'train'").select("idx", "y", "vec")
    return knn.knn_cv(s).withColumn("cv_f1", F.round("cv_f1", 6))


@query("knn_grid", f"""
WITH {_GRID}, best AS (SELECT k FROM sc ORDER BY round(cv_f1, 9) DESC, k LIMIT 1),
nn AS (SELECT a.idx, b.y AS nb_y, row_number() OVER (PARTITION BY a.idx ORDER BY round({_DIST['cosine']}, 9), b.idx) AS rank FROM s a JOIN s b ON a.split = 'test' AND b.split = 'train')
SELECT idx, y AS gt, (SELECT k FROM best) AS k, nb_y AS pred FROM {_vote('(SELECT k FROM best)')} JOIN s USING (idx) QUALIFY row_number() OVER (PARTITION BY idx ORDER BY c DESC, nb_y) = 1""")
def knn_grid(spark, sf_dir):
    s = split_vectors(spark, sf_dir).select("idx", "y", "vec", "split")
    return knn.knn_grid(s.where("split = 'train'"), s.where("split = 'test'"))


@query("logistic_probe")
def logistic_probe(spark, sf_dir):
    """Full grid (6 C x 5 folds) on the embeddings; iterative, so checked by its gradient in the tests."""
    s = split_vectors(spark, sf_dir).select("idx", "y", "vec", "split")
    return probes.logistic_probe(s.where("split = 'train'"), s.where("split = 'test'")).predictions


@query("logistic_balanced")
def logistic_balanced(spark, sf_dir):
    """Balanced class weights on the flattened series."""
    s = split_vectors(spark, sf_dir).select("idx", "y", F.flatten(fs.reshape(F.col("vec"), 4)).alias("vec"), "split")
    return probes.logistic_probe(s.where("split = 'train'"), s.where("split = 'test'"), balanced=True).predictions


def _forecast_rows(spark, sf_dir):
    """Lookback windows in a fixed global order."""
    pairs = windows.lookback_horizon(series(spark, sf_dir), ["user_id"], "p", "v", 24, 6)
    return materialise(pairs.withColumn("row_id", F.struct("user_id", "idx")).select("row_id", "user_id", "x", F.col("y").alias("gt")))


def _errors(out):
    m = metrics.forecast_error_pooled(out, [])
    return m.select(F.round("mse", 5).alias("mse"), F.round("mae", 5).alias("mae"), "n_points")


@query("ridge_probe")
def ridge_probe(spark, sf_dir):
    """Ridge on lookback windows, alpha by five plain folds; closed form checked in the tests."""
    rows = _forecast_rows(spark, sf_dir)
    fit = probes.ridge_probe(rows.where("user_id % 5 <> 0"), "x", "gt", "row_id")
    return _errors(rows.where("user_id % 5 = 0").withColumn("pred", fit.predict(F.col("x"))))


@query("ridge_time_probe")
def ridge_time_probe(spark, sf_dir):
    """Ridge on standardised windows with expanding time folds and an unstandardised target."""
    rows = _forecast_rows(spark, sf_dir)
    train = rows.where("user_id % 5 <> 0")
    scaler = scaling.fit_vector_scaler(train, "x")
    fit = probes.ridge_time_probe(scaling.apply_vector_scaler(train, "x", scaler), "x", "gt", "row_id")
    test = scaling.apply_vector_scaler(rows.where("user_id % 5 = 0"), "x", scaler)
    return _errors(test.withColumn("pred", fit.predict(F.col("x"))))


@query("ridge_one_feature", """
WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM {lineitem}),
f AS (SELECT regr_sxy(y, x) / (regr_sxx(y, x) + 10.0) AS w, avg(x) AS mx, avg(y) AS my FROM t)
SELECT round(w, 3) AS w, round(my - w * mx, 2) AS b FROM f""")
def ridge_one_feature(spark, sf_dir):
    """The normal equation of one feature, as SQL states it."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber").alias("id"), F.array(F.col("l_quantity").cast("double")).alias("x"), F.array(F.col("l_extendedprice").cast("double")).alias("y")
    )
    fit = probes.ridge_probe(rows, "x", "y", "id", alphas=(10.0,))
    out = spark.createDataFrame([(float(fit.weights[0, 0]), float(fit.intercept[0]))], "w double, b double")
    return out.select(F.round("w", 3).alias("w"), F.round("b", 2).alias("b"))


@query("ridge_layers", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 = 0 AS test, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t, CAST(l_extendedprice AS DOUBLE) AS y FROM {lineitem}),
x AS (SELECT l_orderkey, l_linenumber, test, 0 AS layer, q AS a, d AS b, y FROM r UNION ALL SELECT l_orderkey, l_linenumber, test, 1, q * t, CAST(l_linenumber AS DOUBLE), y FROM r),
f AS (SELECT layer, count(*) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my, stddev_pop(y) AS sy, corr(a, b) AS ab, corr(a, y) AS ay, corr(b, y) AS by_ FROM x WHERE NOT test GROUP BY 1),
w AS (SELECT *, (n * ay * (n + 10.0) - n * by_ * n * ab) / (power(n + 10.0, 2) - power(n * ab, 2)) AS wa, (n * by_ * (n + 10.0) - n * ay * n * ab) / (power(n + 10.0, 2) - power(n * ab, 2)) AS wb FROM f)
SELECT layer, l_orderkey, l_linenumber, round(my + sy * (wa * (a - ma) / sa + wb * (b - mb) / sb), 2) AS pred, 10.0::DOUBLE AS best_alpha FROM x JOIN w USING (layer) WHERE test""")
def ridge_layers(spark, sf_dir):
    """Two layers of two features each: standardised ridge of both in one pass, predictions on the scale of the price."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax", "extendedprice")])
    split = F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("split")
    pairs = [("quantity", "discount"), (F.col("quantity") * F.col("tax"), F.col("l_linenumber").cast("double"))]
    layers = [rows.select(F.lit(i).alias("layer"), split, "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("id"), F.array(*p).alias("x"), F.array("extendedprice").alias("y")) for i, p in enumerate(pairs)]
    out = probes.ridge_layers(layers[0].unionByName(layers[1]), [0, 1], "x", "y", "id", alphas=(10.0,))
    return out.select("layer", "l_orderkey", "l_linenumber", F.round(F.col("pred")[0], 2).alias("pred"), "best_alpha")


def _nested_layers(spark, sf_dir):
    """Five layers derived from the embeddings: each half the size of the one below."""
    s = split_vectors(spark, sf_dir).select("idx", "y", "vec", "split")
    layers = [s.withColumn("layer", F.lit(k)).withColumn("vec", F.slice("vec", 1, 64 >> k)) for k in range(5)]
    return reduce(DataFrame.unionByName, layers)


@query("logistic_probe_layers")
def logistic_probe_layers(spark, sf_dir):
    """One record per layer: grid, best parameters and scores."""
    found = probes.logistic_probe_layers(_nested_layers(spark, sf_dir), list(range(5)))
    return probes.layer_records(found, model="derived", dataset="embeddings").drop("timestamp")
