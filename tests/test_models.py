import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tsprobe.operators import knn, probes, vectors


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 6))
    y = rng.integers(0, 3, 150)
    x = centres[y] + rng.normal(size=(150, 6)) * 1.2
    df = spark.createDataFrame([(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x))], "idx long, y int, vec array<double>")
    return df.cache(), x, y


def test_knn_blocks(spark, data, monkeypatch):
    df, x, y = data
    train, test = df.where("idx >= 40"), df.where("idx < 40")
    monkeypatch.setattr(knn, "BLOCK_BYTES", 8 * 6 * 7)  # cells in chunks, queries in parts
    for metric in ("cosine", "euclidean", "manhattan"):
        got = {(r["idx"], r["rank"]): r["nb_idx"] for r in knn.nearest(train, test, 4, metric).collect()}
        for i in range(0, 40, 9):
            d = np.round(knn._distances(x[i:i + 1], x[40:], metric)[0], 9)
            assert [got[(i, r)] for r in range(1, 5)] == (np.lexsort((np.arange(110), d))[:4] + 40).tolist()


def test_knn_prunes_what_is_too_far(spark, monkeypatch):
    monkeypatch.setattr(knn, "PIVOT_ROWS", 20)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 40
    x = centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 8))
    x[7] = x[390] = 0  # no direction
    df = spark.createDataFrame([(i, 0, x[i].tolist()) for i in range(400)], "idx long, y int, vec array<double>").cache()
    train, test = df.where("idx >= 60"), df.where("idx < 60")
    for metric in ("cosine", "euclidean", "manhattan"):
        got = {(r["idx"], r["rank"]): r["nb_idx"] for r in knn.nearest(train, test, 3, metric).collect()}
        d = np.round(knn._distances(x[:60], x[60:], metric), 9)
        assert got == {(i, r + 1): int(j) + 60 for i in range(60) for r, j in enumerate(np.lexsort((np.arange(340), d[i]))[:3])}
        work = knn.visited_pairs(train, test, 3, metric).first()
        assert work["product"] == 60 * 340 and work["pairs"] < 0.5 * work["product"]


def test_knn_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(i, i, [float(i), 1.0]) for i in range(4)], "idx long, y int, vec array<double>")
    got = knn.nearest(df.where("idx < 2"), df.where("idx >= 2"), 5, "euclidean").collect()
    assert sorted((r["idx"], r["rank"], r["nb_idx"]) for r in got) == [(2, 1, 1), (2, 2, 0), (3, 1, 1), (3, 2, 0)]
    assert knn.nearest(df.where("false"), df, 3).count() == 0 and knn.nearest(df, df.where("false"), 3).count() == 0
    with pytest.raises(ValueError, match="unknown metric"):
        knn.nearest(df, df, 1, "chebyshev")


def test_approximate_neighbours(spark, data, monkeypatch):
    df, x, y = data
    train, test = df.where("idx >= 40"), df.where("idx < 40")
    exact = knn.nearest(train, test, 5)
    share = {p: knn.recall(exact, knn.nearest_approximate(train, test, 5, probes=p)).first() for p in (1, 12, 64)}
    assert share[64]["recall"] == 1 and share[64]["n"] == 200
    assert share[1]["recall"] <= share[12]["recall"] and share[12]["recall"] >= 0.9
    monkeypatch.setattr(knn, "BLOCK_BYTES", 8 * 6)  # cells in chunks
    assert knn.recall(exact, knn.nearest_approximate(train, test, 5, probes=12)).first() == share[12]


def test_knn_hot_duplicates(spark):
    # a third of all vectors are the same one: ties at the edge are settled by id
    rows = [(i, i % 2, [1.0, 0.0] if i % 3 == 0 else [float(i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, y int, vec array<double>")
    got = knn.nearest(df.where("idx > 0"), df.where("idx = 0"), 5, "euclidean").orderBy("rank").collect()
    assert [r["nb_idx"] for r in got] == [3, 6, 9, 12, 15]


def test_knn_rows_travel_once_for_each_place(spark, monkeypatch):
    # no clusters: nothing can be pruned, and 20 cells fit two places
    monkeypatch.setattr(knn, "PIVOT_ROWS", 20)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 8 * 16 * 240)
    x = np.random.default_rng(6).normal(size=(480, 16))
    df = spark.createDataFrame([(i, 0, x[i].tolist()) for i in range(480)], "idx long, y int, vec array<double>").cache()
    cells, dealt, asked, again, found = knn._rounds(df.where("idx >= 80"), df.where("idx < 80"), 5, "cosine", False)
    assert len(cells.pivots) == 20 and cells.places == 2
    assert asked.count() == 80 and again.count() <= 80  # once for each cell before: 20 times
    assert found.count() == 80 * 5 and dealt.count() == 400 * dealt.agg(F.max("part") + 1).first()[0]


def test_knn_keeps_few_rows_in_python(monkeypatch):
    # equal train rows, a far origin and folds: held rows stay bounded and the answer is exact
    monkeypatch.setattr(knn, "TILE_BYTES", 8 * 64 * 50)
    rng = np.random.default_rng(8)
    t = np.concatenate([np.repeat(rng.normal(size=(1, 4)), 300, axis=0), rng.normal(size=(300, 4))]) + 1e4
    ids, home, folds = rng.permutation(600), rng.integers(0, 3, 600), rng.integers(0, 3, 600)
    kept = knn._useful(t, home, ids, folds, 4)
    assert len(kept) <= 300 + 9 * 4 and (np.diff(home[kept]) >= 0).all()
    q, q_folds = np.concatenate([t[:1], rng.normal(size=(30, 4)) + 1e4]), rng.integers(0, 3, 31)
    for metric in ("cosine", "euclidean", "manhattan"):
        a, b = (knn._unit(q)[0], knn._unit(t)[0]) if metric == "cosine" else (q, t)
        tile = knn._Tile(a, metric, 4, np.full(31, np.inf), q_folds)
        for cell in range(3):
            mine = kept[home[kept] == cell]
            tile.meet(np.arange(31), b[mine], int(np.flatnonzero(kept == mine[0])[0]), ids[kept], folds[mine])
        rows, found, dist = tile.settle(ids[kept])
        assert tile.size <= 31 * 4
        d = np.round(knn._distances(q, t, metric), 9)
        d[q_folds[:, None] == folds[None, :]] = np.inf
        for i in range(31):
            assert dist[rows == i] == pytest.approx(np.sort(d[i])[:4], abs=2e-9)
            if metric != "cosine":  # cosines at a far origin differ by less than their rounding
                assert ids[kept[found[rows == i]]].tolist() == ids[np.lexsort((ids, d[i]))[:4]].tolist()


def mllib(df, c, n):
    """The same objective by MLlib."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    shaped = df.select(F.dense_rank().over(Window.orderBy("y")).alias("label"), array_to_vector("vec").alias("features")).withColumn("label", F.col("label") - 1.0)
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12).fit(shaped)


def test_logistic_optimum(spark, data):
    df, x, y = data
    out = probes.logistic_probe(df.where("idx >= 30"), df.where("idx < 30"), cs=(0.1, 1.0), folds=3)
    assert set(out.cv_scores) == {0.1, 1.0} and out.best_cv_f1_macro == max(out.cv_scores.values())
    assert out.predictions.count() == 30 and 0 <= out.test_f1_macro <= 1 and out.record()["best_c"] == out.best_c
    w, b, c = out.weights[:, :-1], out.weights[:, -1], out.best_c
    z = x[30:] @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    grad = c * (p - np.eye(3)[y[30:]]).T @ x[30:] + w
    assert np.abs(grad).max() < 1e-3 * max(1, c)
    m = mllib(df.where("idx >= 30"), c, 120)
    theirs = m.coefficientMatrix.toArray()
    assert w - w.mean(axis=0) == pytest.approx(theirs - theirs.mean(axis=0), abs=1e-3)
    assert {r["idx"]: r["pred"] for r in out.predictions.collect()} == dict(enumerate(((x[:30] @ w.T + b).argmax(axis=1)).tolist()))


def test_balanced_weights_are_those_of_the_rows_seen(spark, data):
    df, x, y = data
    few = df.where("y > 0 and (y = 1 or idx % 5 = 0)").cache()
    out = probes.logistic_probe(few, df.where("y > 0"), cs=(0.5,), folds=3, balanced=True)
    keep = np.array([r["idx"] for r in few.orderBy("idx").collect()])
    t = y[keep] - 1
    n = np.bincount(t)
    weight = len(t) / (2 * n[t])
    w = out.weights[0]
    p = 1 / (1 + np.exp(-(x[keep] @ w[:-1] + w[-1])))
    assert np.abs(0.5 * (weight * (p - t)) @ x[keep] + w[:-1]).max() < 1e-3
    assert abs((weight * (p - t)).sum()) < 1e-2


def test_two_classes_have_one_weight_vector(spark, data):
    df, x, y = data
    two = df.where("y > 0").withColumn("y", F.col("y") * 3)  # labels 3 and 6
    out = probes.logistic_probe(two.where("idx >= 30"), two.where("idx < 30"), cs=(0.01,), folds=3)
    assert {r["pred"] for r in out.predictions.collect()} <= {3, 6} and out.test_accuracy > 0.5
    assert out.record()["grid"] == {"C": [0.01], "max_iter": [1000]} and out.weights.shape == (1, 7)
    keep = np.flatnonzero((y > 0) & (np.arange(150) >= 30))
    w, b = out.weights[0, :-1], out.weights[0, -1]
    p = 1 / (1 + np.exp(-(x[keep] @ w + b)))
    assert np.abs(0.01 * (p - (y[keep] - 1)) @ x[keep] + w).max() < 1e-4
    assert w == pytest.approx(mllib(two.where("idx >= 30"), 0.01, len(keep)).coefficientMatrix.toArray()[0], abs=1e-4)


def test_layers_in_several_rounds_are_the_same(spark, data, monkeypatch):
    df, x, y = data
    split = F.when(F.col("idx") < 30, "test").otherwise("train")
    layered = [df.select(F.lit(k).alias("layer"), split.alias("split"), "idx", "y", F.slice("vec", 1, 6 - k).alias("vec")) for k in (0, 1, 2)]
    table = layered[0].union(layered[1]).union(layered[2])
    once = probes.logistic_probe_layers(table, [0, 1, 2], cs=(0.1, 10.0), folds=3)
    monkeypatch.setattr(probes, "STATE_BYTES", 1)
    monkeypatch.setattr(probes.logistic, "SCORES", 100)
    monkeypatch.setattr(probes.logistic, "PART_BYTES", 1000)
    for a, b in zip(once, probes.logistic_probe_layers(table, [0, 1, 2], cs=(0.1, 10.0), folds=3)):
        assert a.record() == b.record() and a.cv_scores == pytest.approx(b.cv_scores) and a.weights == pytest.approx(b.weights, abs=1e-3)


def test_ridge_keeps_digits_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3)) + 1e7
    y = (x - 1e7) @ np.array([[1.0], [2.0], [3.0]]) + 5
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(120)], "idx long, x array<double>, y array<double>")
    fit = probes.ridge_probe(df, "x", "y", "idx", alphas=(1e-6, 10.0))
    assert fit.best_alpha == 1e-6 and fit.weights[:, 0] == pytest.approx([1, 2, 3], abs=1e-5) and fit.cv_mse[1e-6] < 1e-8


def test_scaled_ridge_layers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4)) * [1, 10, 100, 1000]
    y = x @ rng.normal(size=(4, 2)) * 50 + 1000
    rows = [(i, k, "train" if i < 70 else "test", (x[i] * (1 + k)).tolist(), y[i].tolist()) for i in range(90) for k in range(2)]
    df = spark.createDataFrame(rows, "idx long, layer int, split string, x array<double>, y array<double>")
    out = probes.ridge_layers(df, [0, 1], "x", "y", "idx", alphas=(0.01, 1.0)).collect()
    assert len(out) == 40 and {r["layer"] for r in out} == {0, 1}
    for k in (0, 1):  # the layers at once are the layers one by one
        mine = df.where(F.col("layer") == k)
        fit, alone = probes.scaled_ridge(mine.where("split = 'train'"), mine.where("split = 'test'"), "x", "y", "idx", alphas=(0.01, 1.0))
        want = {r["idx"]: r["pred"] for r in alone.collect()}
        assert {r["best_alpha"] for r in out if r["layer"] == k} == {fit.best_alpha}
        assert all(r["pred"] == pytest.approx(want[r["idx"]], rel=1e-8) for r in out if r["layer"] == k)
    assert all(r["pred"] == pytest.approx(r["y"], rel=0.01, abs=60) for r in out)


def brute_ridge(x, y, alpha):
    xm, ym = x.mean(0), y.mean(0)
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


def test_ridge_grid(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(83, 5))
    y = x @ rng.normal(size=(5, 2)) + rng.normal(size=(83, 2))
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(83)], "idx long, x array<double>, y array<double>").repartition(4)
    fit = probes.ridge_probe(df, "x", "y", "idx", folds=5)
    folds = np.array_split(np.arange(83), 5)
    for a in probes.ALPHA_GRID:
        errs = []
        for f in folds:
            tr = np.setdiff1d(np.arange(83), f)
            w, b = brute_ridge(x[tr], y[tr], a)
            errs.append(((x[f] @ w + b - y[f]) ** 2).mean())
        assert fit.cv_mse[a] == pytest.approx(np.mean(errs), rel=1e-8)
    w, b = brute_ridge(x, y, fit.best_alpha)
    assert fit.weights == pytest.approx(w) and fit.intercept == pytest.approx(b)
    pred = df.orderBy("idx").select(fit.predict(F.col("x")).alias("p")).collect()
    assert np.array([r["p"] for r in pred]) == pytest.approx(x @ w + b)
    timed = probes.ridge_time_probe(df, "x", "y", "idx", folds=4)
    step, errs = 83 // 5, []
    for i in range(4):
        s = 83 - (4 - i) * step
        w, b = brute_ridge(x[:s], y[:s], 1.0)
        errs.append(((x[s:s + step] @ w + b - y[s:s + step]) ** 2).mean())
    assert timed.cv_mse[1.0] == pytest.approx(np.mean(errs), rel=1e-8)


def test_vector_mean_and_layers(rows):
    df = rows("k int, v array<double>, w int", [(1, [1.0, 2.0], 1), (1, [4.0, 8.0], 3), (1, [9.0, 9.0], 0)])
    assert vectors.vector_mean(df, ["k"], "v", "w").first()["vec"] == [3.25, 6.5]
    layers = rows("layer int, v int", [(0, 1), (2, 5)])
    assert [r["v"] for r in vectors.select_layer(layers, -1).collect()] == [5]
    with pytest.raises(Exception, match="layer 7 not found; available: 0, 2"):
        vectors.select_layer(layers, 7).collect()


def test_layer_query_searches_the_whole_grid(spark, sf_dir, monkeypatch):
    from tsprobe.plans.catalogue import QUERIES

    asked, solve = [], probes.logistic.solve
    monkeypatch.setattr(probes.logistic, "solve", lambda rdd, fits, *others: asked.append((list(fits), others[-1])) or solve(rdd, fits, *others))
    rows = QUERIES["logistic_probe_layers"](spark, sf_dir).collect()
    (grid, steps), (refits, _) = asked
    assert steps == 1000 and {(f.layer, f.c, f.held) for f in grid} == {(k, c, f) for k in range(5) for c in (0.001, 0.01, 0.1, 1.0, 10.0, 100.0) for f in range(5)}
    assert [f.held for f in refits] == [-1] * 5 and all(len(r["grid_c"]) == 6 for r in rows)


def test_layer_records_by_brute_force(spark, data):
    df, x, y = data
    keep = np.flatnonzero(y > 0)[:70]
    two = df.where(F.col("idx").isin(keep.tolist()))
    train, test = (two.where(F.col("idx").isin(k.tolist())) for k in (keep[20:], keep[:20]))
    layers = [s.withColumn("split", F.lit(n)).withColumn("layer", F.lit(k)).withColumn("vec", F.slice("vec", 1, 6 >> k)) for k in (0, 1) for n, s in (("train", train), ("test", test))]
    found = probes.logistic_probe_layers(layers[0].union(layers[1]).union(layers[2]).union(layers[3]), [0, 1])
    fold = {r["idx"]: r["fold"] for r in probes.kfold_stratified(train, "y", "idx", 5).collect()}

    def fit(a, t, c):
        a, w = np.c_[a, np.ones(len(a))], np.zeros(a.shape[1] + 1)
        ridge = np.diag([1 / c] * (len(w) - 1) + [0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-a @ w))
            w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - t) + ridge @ w)
        return w

    def f1(w, a, t):
        p = (np.c_[a, np.ones(len(a))] @ w > 0).astype(int)
        return np.mean([2 * ((p == k) & (t == k)).sum() / max(1, (p == k).sum() + (t == k).sum()) for k in (0, 1)])

    f = np.array([fold[i] for i in keep[20:].tolist()])
    for layer, r in enumerate(found):
        a, t = x[keep][:, : 6 >> layer], y[keep] - 1
        own, mine = a[20:], t[20:]
        cv = {c: np.mean([f1(fit(own[f != k], mine[f != k], c), own[f == k], mine[f == k]) for k in range(5)]) for c in probes.C_GRID}
        assert r.cv_scores == pytest.approx(cv)
        assert cv[r.best_c] == pytest.approx(max(cv.values())) and r.max_iter == 1000
        assert r.test_f1_macro == pytest.approx(f1(fit(own, mine, r.best_c), a[:20], t[:20]))
