import pytest
from pyspark.sql import functions as F

from tsprobe.functions import labels as fl
from tsprobe.operators import splits


def classes(spark, sizes):
    data = [(c, f"{c}-{i}") for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "y int, id string")


def test_stratified_split(spark):
    df = classes(spark, {0: 1, 1: 2, 2: 10})
    got = {r["y"]: r["count"] for r in splits.stratified_split(df, "y", ["id"], 0.85).where("split = 'train'").groupBy("y").count().collect()}
    assert got == {0: 1, 1: 1, 2: 8}


def test_stratified_sample(spark):
    df = classes(spark, {0: 95, 1: 5})
    assert splits.stratified_sample(df, "y", ["id"], 10).count() == 10
    assert splits.stratified_sample(df, "y", ["id"], 100).count() == 100
    assert splits.uniform_sample(df, ["id"], -1).count() == 100
    assert splits.uniform_sample(df, ["id"], 7).count() == 7


def test_group_split_is_disjoint(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    out = splits.group_split(ev, ev, "user_id", 3, 2)
    per = out.groupBy("user_id").agg(F.countDistinct("split").alias("n"))
    assert per.where("n > 1").count() == 0
    got = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.countDistinct("user_id").alias("n")).collect()}
    assert got["test"] == 3 and got["dev"] == 2 and got["train"] >= 1
    with pytest.raises(Exception, match="no train subject"):
        splits.group_split(ev, ev, "user_id", 500).collect()


def test_first_n(spark):
    df = spark.range(10).withColumnRenamed("id", "idx")
    assert splits.first_n(df, "idx", -1).count() == 10 and splits.first_n(df, "idx", 4).count() == 4
    with pytest.raises(ValueError):
        splits.first_n(df, "idx", -2)


def test_interleave(rows):
    shots = rows("label int, rank int, idx int", [(0, 1, 7), (0, 2, 9), (1, 1, 4)])
    got = splits.interleave_shots(shots, "label", 2).orderBy("shot_order").collect()
    assert [r["idx"] for r in got] == [7, 4, 9]


def brute_stratified(y, k):
    """Fold per row for labels in index order."""
    first = list(dict.fromkeys(y))
    code = [first.index(v) for v in y]
    order = sorted(code)
    alloc = [[order[i::k].count(c) for c in range(len(first))] for i in range(k)]
    pools = {c: [f for f in range(k) for _ in range(alloc[f][c])] for c in range(len(first))}
    return [pools[c].pop(0) for c in code]


@pytest.mark.parametrize("k", [2, 3, 5])
def test_kfold_stratified(spark, k):
    y = [(i * i + i // 3) % 4 for i in range(53)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "idx long, y int")
    got = [r["fold"] for r in splits.kfold_stratified(df, "y", "idx", k).orderBy("idx").collect()]
    assert got == brute_stratified(y, k)


def test_kfold_contiguous_and_time(spark):
    df = spark.range(13).withColumnRenamed("id", "idx")
    folds = [r["fold"] for r in splits.kfold_contiguous(df, "idx", 5).orderBy("idx").collect()]
    assert folds == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 2 + [4] * 2
    t = splits.time_folds(df, "idx", 3)
    val = {r["fold"]: (r["a"], r["b"]) for r in t.where("role = 'val'").groupBy("fold").agg(F.min("idx").alias("a"), F.max("idx").alias("b")).collect()}
    assert val == {0: (4, 6), 1: (7, 9), 2: (10, 12)}
    train = {r["fold"]: r["b"] for r in t.where("role = 'train'").groupBy("fold").agg(F.max("idx").alias("b")).collect()}
    assert train == {0: 3, 1: 6, 2: 9}


def test_shuffle_is_a_permutation(spark):
    df = spark.range(200).selectExpr("id AS idx", "id % 2 AS s")
    out = splits.shuffle_reindex(df, ["s"], ["idx"])
    for s in (0, 1):
        assert sorted(r["new_idx"] for r in out.where(F.col("s") == s).collect()) == list(range(100))


def test_majority_tie_is_first_seen(rows):
    train = rows("idx long, y int", [(0, 5), (1, 3), (2, 3), (3, 5)])
    test = rows("idx long, y int", [(9, 1)])
    assert splits.baseline_predict(train, test, "y", "idx", "majority").first()["pred"] == 5
    for mode in ("uniform", "prior"):
        assert splits.baseline_predict(train, test, "y", "idx", mode).first()["pred"] in (3, 5)


def test_labels(rows):
    df = rows("label string", [("10",), ("2",), ("b",), ("a",)])
    assert {r["label"]: r["letter"] for r in fl.with_letters(df, "label").collect()} == {"2": "A", "10": "B", "a": "C", "b": "D"}
    n = rows("r long", [(1,), (26,), (27,), (52,), (53,), (702,), (703,)])
    assert [r[0] for r in n.select(fl.letter(F.col("r"))).collect()] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    train, test = rows("y string", [("a",), ("b",)]), rows("y string", [("c",)])
    with pytest.raises(Exception, match="not in train"):
        fl.dense_index(train, test, "y", "code").collect()
