import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsprobe.functions import stats
from tsprobe.operators import bootstrap, metrics, progress, results


def brute_f1(gt, pred):
    labels = sorted(set(gt) | set(pred))
    out = []
    for v in labels:
        tp = sum(a == b == v for a, b in zip(gt, pred))
        size = gt.count(v) + pred.count(v)
        out.append(2 * tp / size if size else 0.0)
    return sum(out) / len(out)


def test_metrics_fixture(rows):
    df = rows("gt int, pred int", [(0, 0), (0, 1), (1, 1), (1, -1)])
    m = metrics.classification_metrics(df, []).first()
    assert (m["n"], m["accuracy"], m["macro_f1"]) == (4, 0.5, pytest.approx(0.388889, abs=1e-6))


def test_pass_at_k(rows):
    df = rows("idx int, correct int", [(i, int(j < c)) for i, c in ((1, 3), (2, 0), (3, 16)) for j in range(20)])
    got = metrics.pass_at_k(df, ["idx"], "idx", [1, 5], n=20).orderBy("idx").collect()
    assert [r["pass@5"] for r in got] == pytest.approx([1 - math.comb(17, 5) / math.comb(20, 5), 0.0, 1.0])
    assert [r["pass@1"] for r in got] == pytest.approx([0.15, 0, 0.8])
    with pytest.raises(Exception, match="attempts of"):
        metrics.pass_at_k(df.limit(19), ["idx"], "idx", [1], n=20).collect()
    with pytest.raises(Exception, match="larger than"):
        metrics.pass_at_k(df, ["idx"], "idx", [30]).collect()


def test_vote_tie(rows):
    df = rows("idx int, gt int, pred int, r int", [(1, 2, p, i) for i, p in enumerate([2, 1, 1, 2, 3])])
    v = metrics.vote(df, ["idx"], "r").first()
    assert v["master_pred"] == 2 and v["correct"] == 1 and v["vote_tally"] == {1: 2, 2: 2, 3: 1}


def test_forecast_errors(rows):
    df = rows("gt array<double>, pred array<double>", [([0.0, 0.0], [1.0, 1.0]), ([0.0] * 4, [0.0] * 4), ([1.0], None)])
    row = metrics.forecast_error_rows(df, []).first()
    assert (row["avg_mse"], row["num_entries"], row["num_errors"]) == (0.5, 3, 1)
    pooled = metrics.forecast_error_pooled(df.where("pred IS NOT NULL"), []).first()
    assert pooled["mse"] == pytest.approx(1 / 3)
    assert math.isnan(metrics.forecast_error_pooled(df.where("false"), []).first()["mse"] or float("nan"))


def test_fill(rows):
    df = rows("idx int, step int, pred double, last double", [(1, 0, None, 9.0), (1, 1, 4.0, 9.0), (1, 2, None, 9.0)])
    assert [r["filled"] for r in metrics.fill_forecast(df, ["idx"], "step", "pred", "last").orderBy("step").collect()] == [9, 4, 4]


def test_bootstrap_matches_row_resampling(spark):
    rng = np.random.default_rng(0)
    gt = rng.integers(0, 3, 120)
    pred = np.where(rng.random(120) < 0.6, gt, rng.integers(-1, 3, 120))
    df = spark.createDataFrame([(1, int(a), int(b), i) for i, (a, b) in enumerate(zip(gt, pred))], "run int, gt int, pred int, idx int")
    got = bootstrap.bootstrap_ci(df, ["run"], n_boot=3000).first()
    brute = []
    for _ in range(1500):
        i = rng.integers(0, 120, 120)
        brute.append(brute_f1(gt[i].tolist(), pred[i].tolist()))
    assert got["mean"] == pytest.approx(np.mean(brute), abs=0.006)
    assert got["ci_lower"] == pytest.approx(np.percentile(brute, 2.5), abs=0.02)
    assert got["ci_upper"] == pytest.approx(np.percentile(brute, 97.5), abs=0.02)
    assert got["ci_lower"] <= brute_f1(gt.tolist(), pred.tolist()) <= got["ci_upper"] and got["sample_size"] == 120
    again = bootstrap.bootstrap_ci(df.repartition(5), ["run"], n_boot=3000).first()
    assert again == got  # seeded per run and block, whatever the partitioning


def test_pending(rows):
    done = rows("idx int, attempt int", [(0, 0), (0, 2), (1, 1)])
    got = progress.pending_attempts(rows("idx int", [(0,), (1,)]), done, "idx", 3).collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 0), (1, 2)]


def test_pending_keeps_the_log_off_the_driver(spark, rows):
    log = [(i, a) for i in range(6) for a in range(130) if (i * a) % 7 != 3] + [(2, None), (None, 1), (4, 500), (5, -1), (0, 0)]
    done = rows("idx int, attempt int", log)
    ids = rows("idx int", [(i,) for i in range(7)] + [(3,), (None,)])
    out = progress.pending_attempts(ids, done, "idx", 130)
    want = [(i, a) for i in [*range(7), 3, None] for a in range(130) if i is None or (i, a) not in log]
    key = str
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    # an estimate of the log's size says little of what an explode makes of it: no side is broadcast
    small = progress.pending_attempts(spark.range(50), done.select(F.col("idx").alias("id"), "attempt"), "id", 20)
    for df in (out, small):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_t_quantile():
    # 0.975 quantiles from printed t tables
    for dof, want in ((1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042), (120, 1.980), (1000, 1.962)):
        assert stats.t_quantile(0.975, dof) == pytest.approx(want, abs=6e-4)


def brute_signed_rank(deltas):
    d = sorted((x for x in deltas if x), key=abs)
    n = len(d)
    w = sum(i for i, x in enumerate(d, 1) if x > 0)
    hits = sum(sum(i for i in range(1, n + 1) if m >> (i - 1) & 1) >= w for m in range(2 ** n))
    return hits / 2 ** n


def test_wilcoxon(rows):
    deltas = [0.1, -0.2, 0.3, 0.45, -0.05, 0.6, 0.0, 0.7, 0.8]
    df = rows("f string, d double", [("a", d) for d in deltas] + [("b", d) for d in (0.1, 0.1, -0.1, 0.2)])
    got = {r["f"]: r for r in results.wilcoxon_greater(df, "f", "d").collect()}
    assert got["a"]["p_value"] == pytest.approx(brute_signed_rank(deltas))
    assert got["a"]["observations"] == 9 and got["a"]["n"] == 8 and got["a"]["adj_alpha"] == 0.025
    # ties: ranks 2, 2, 2, 4; W+ = 8, mean 5, variance (4*5*9 - 24/2)/24
    z = (8 - 5) / math.sqrt((180 - 12) / 24)
    assert got["b"]["p_value"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))


def test_last_layer(rows):
    schema = "model string, layer int, accuracy double, macro_f1 double, ts string"
    same = rows(schema, [("m", 3, 0.1, 0.1, "1"), ("m", 5, 0.2, 0.3, "3"), ("m", 5, 0.2, 0.3, "2")])
    got = results.last_layer(same, ["model"], "ts").collect()
    assert len(got) == 1 and got[0]["ts"] == "2" and got[0]["layer"] == 5
    bad = rows(schema, [("m", 5, 0.2, 0.3, "3"), ("m", 5, 0.4, 0.3, "2")])
    with pytest.raises(Exception, match="different scores"):
        results.last_layer(bad, ["model"], "ts").collect()


def test_box_fixture(rows):
    df = rows("m string, v double", [("d", float(v)) for v in (1, 2, 3, 4, 100)])
    b = results.box_stats(df, ["m"], "v").first()
    assert (b["q1"], b["med"], b["q3"], b["whisker_low"], b["whisker_high"], b["n_outliers"]) == (2, 3, 4, 1, 4, 1)
    assert [r["v"] for r in results.box_outliers(df, ["m"], "v").collect()] == [100]


def test_filters(rows):
    df = rows("a string, b int", [("x", 1), ("y", 2)])
    assert results.apply_filters(df, "a=x|z, b=1").count() == 1
    assert results.apply_filters(df, " a = x | y ,, b=2 ").count() == 1 and results.apply_filters(df, "").count() == 2
    assert results.apply_filters(df, {"a": ["x", "y"], "b": [1]}).count() == 1
    for text in ("a", "a=", "=x", "a=x,b", "a= | "):
        with pytest.raises(ValueError, match="cannot read"):
            results.apply_filters(df, text)
    with pytest.raises(ValueError, match="missing"):
        results.apply_filters(df, "c=1")


def test_vote_without_answers(rows):
    df = rows("id int, gt int, r int, pred int", [(1, 2, 0, None), (1, 2, 1, 2), (1, 2, 2, 2), (2, 0, 0, None), (2, 0, 1, None)])
    got = {r["id"]: r for r in metrics.vote_list(df, ["id"], "r").collect()}
    assert got[1]["master_pred"] == 2 and got[1]["vote_tally"] == {-1: 1, 2: 2} and [tuple(v) for v in got[1]["votes"]] == [(0, -1), (1, 2), (2, 2)]
    assert got[2]["master_pred"] == -1 and got[2]["correct"] == 0


def test_upsert_tie_does_not_depend_on_order(rows):
    old, new = rows("k int, t int, v int", [(1, 5, 0)]), [(1, 5, 3), (1, 5, 7), (1, 5, 4)]
    for order in (new, new[::-1]):
        assert results.upsert(old, rows("k int, t int, v int", order), "k", "t").collect()[0]["v"] == 7


def test_stability(rows):
    df = rows("m string, v double", [("a", 0.5), ("a", 0.7), ("a", 0.6), ("b", 0.1)])
    got = {r["m"]: r for r in results.stability(df, ["m"], "v").collect()}
    assert got["a"]["ci_95"] == pytest.approx(4.302653 * 0.1 / math.sqrt(3), abs=1e-5)
    assert (got["b"]["std"], got["b"]["ci_95"]) == (0, 0)


def test_voting_ignores_row_order(spark):
    data = [(i % 7, i % 3, (i * 5) % 4, i) for i in range(80)]
    a = spark.createDataFrame(data, "idx int, gt int, pred int, r int")
    a = a.withColumn("gt", F.col("idx") % 3)
    x = sorted(map(str, metrics.vote(a, ["idx"], "r").collect()))
    y = sorted(map(str, metrics.vote(a.orderBy(F.rand(1)), ["idx"], "r").collect()))
    assert x == y and Counter(len(v) > 0 for v in x) == {True: 7}
