import pytest
from pyspark.sql import functions as F

from tsprobe.functions import series as fs
from tsprobe.operators import scaling, trends, windows
from tsprobe.operators.ordering import positions


def samples(spark, lengths, labels=None):
    data = [(k, i, float(i + 1), (labels or [0])[i % len(labels or [0])]) for k, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(data, "k int, p bigint, v double, label int")


def test_count_windows_fixture(spark):
    w = windows.count_windows(samples(spark, [10, 3]), ["k"], "p", ["v", "label"], 4, 3)
    assert sorted((r["k"], r["start"], [x["v"] for x in r["rows"]]) for r in w.collect()) == [
        (0, 0, [1, 2, 3, 4]), (0, 3, [4, 5, 6, 7]), (0, 6, [7, 8, 9, 10])]


@pytest.mark.parametrize("width,stride,min_chunk", [(4, 1, 1), (4, 4, 1), (5, 7, 1), (16, 8, 1024), (3, 2, 6)])
def test_window_count_formula(spark, width, stride, min_chunk):
    lengths = [1, 4, 5, 37, 100]
    w = windows.count_windows(samples(spark, lengths), ["k"], "p", ["v"], width, stride, min_chunk)
    assert w.count() == sum(max(0, (n - width) // stride + 1) for n in lengths)
    bad = w.where((F.size("rows") != width) | (F.col("rows")[0]["p"] != F.col("start")) | (F.col("start") != F.col("win") * stride))
    assert bad.count() == 0


def test_labels(spark, rows):
    w = windows.count_windows(samples(spark, [4], [2, 2, 1, 1]), ["k"], "p", ["label"], 4, 4)
    assert windows.label_majority(w, "label", 4, 0.6).count() == 0
    assert windows.label_majority(w, "label", 4, 0.5).first()["y"] == 1
    w = windows.count_windows(samples(spark, [4], [5, 6, 7, 8]), ["k"], "p", ["label"], 4, 4)
    assert windows.label_center(w, "label", 4).first()["y"] == 7


def test_lookback_horizon(spark):
    got = windows.lookback_horizon(samples(spark, [6]), ["k"], "p", "v", 3, 2).orderBy("idx").collect()
    assert [(r["x"], r["y"]) for r in got] == [([1, 2, 3], [4, 5]), ([2, 3, 4], [5, 6])]


def test_pad_trim(spark, rows):
    df = rows("v array<double>", [([1.0, 2.0, 3.0],), ([float(i) for i in range(1, 8)],)])
    got = [r[0] for r in df.select(fs.pad_trim_center(F.col("v"), 6)).collect()]
    assert got == [[0, 1, 2, 3, 0, 0], [1, 2, 3, 4, 5, 6]]
    assert df.select(fs.pad_trim_center(F.col("v"), 4)).collect()[1][0] == [2, 3, 4, 5]
    long = windows.pad_trim_center(samples(spark, [3, 7]), ["k"], "p", "v", 4).orderBy("k").collect()
    assert [r["x"] for r in long] == [[1, 2, 3, 0], [2, 3, 4, 5]]


def test_left_pad(spark):
    got = windows.chunk_left_pad(samples(spark, [600]), ["k"], "p", "v", 512).orderBy("chunk").collect()
    assert [(r["length"], len(r["values"]), sum(r["mask"])) for r in got] == [(512, 512, 512), (88, 512, 88)]
    assert got[1]["values"][423:425] == [0.0, 513.0]


def test_token_windows(rows):
    df = rows("d int, t array<int>", [(1, list(range(20))), (2, [7]), (3, list(range(8)))])
    got = windows.token_windows(df, "t", max_length=10, overlap=3).collect()
    assert [(r["d"], r["start"], r["weight"]) for r in got] == [(1, 0, 8), (1, 5, 8), (1, 10, 8), (1, 15, 5), (2, 0, 1), (3, 0, 8)]


def test_znorm_and_policy(rows):
    df = rows("id int, x array<array<double>>", [(1, [[1.0], [2.0], [3.0]]), (2, [[5.0], [5.0], [5.0]])])
    flagged = {r["id"]: r for r in scaling.znorm_windows(df, "x", "flag").collect()}
    assert [v[0] for v in flagged[1]["x"]] == pytest.approx([-1.224743, 0, 1.224743], abs=1e-5)
    assert flagged[2]["is_constant"] and not flagged[1]["is_constant"]
    assert scaling.znorm_windows(df, "x", "drop").count() == 1
    with pytest.raises(Exception, match="all-zero"):
        scaling.znorm_windows(df, "x").collect()


def test_scaler_leaves_unit_train(rows):
    df = rows("x array<array<double>>", [([[1.0, 10.0, 3.0], [3.0, 10.0, 5.0]],), ([[5.0, 10.0, 9.0], [9.0, 10.0, 1.0]],)])
    z = scaling.apply_scaler(df, "x", scaling.fit_channel_scaler(df, "x", 3)).select(F.explode("x").alias("r"))
    s = z.agg(*[f(F.col("r")[i]) for i in (0, 2) for f in (F.avg, F.stddev_pop)]).first()
    assert list(s) == pytest.approx([0, 1, 0, 1], abs=1e-9)
    assert z.where(F.col("r")[1] != 0).count() == 0  # a constant channel divides by 1


def test_value_scaler_fit_on(rows):
    df = rows("v double", [(1.0,), (3.0,)])
    assert tuple(scaling.fit_value_scaler(df, "v").first()["stats"]) == (2.0, 1.0)


def test_trend_fixture(spark, rows):
    df = rows("k int, p bigint, v double", [(1, i, v) for i, v in enumerate([1.0, 2.0, 3.0, 3.0, 2.0])])
    for chunk in (2, 1 << 16):
        seg = trends.trend_segments(df, ["k"], "p", "v", 1, with_values=True, chunk=chunk).orderBy("seg").collect()
        assert [(r["trend"], r["start_time"], r["end_time"], r["values"]) for r in seg] == [
            ("increase", 0, 2, [1, 2, 3]), ("steady", 2, 3, [3, 3]), ("decrease", 3, 4, [3, 2])]
    tot = {r["trend"]: r["total_time"] for r in trends.trend_totals(trends.trend_segments(df, ["k"], "p", "v", 1), ["k"]).collect()}
    assert tot == {"increase": 2.0, "steady": 1.0, "decrease": 1.0}


@pytest.mark.parametrize("chunk", [2, 5, 64])
def test_long_and_array_segments_agree(spark, sf_dir, chunk):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", F.floor(F.col("value") / 25).cast("double").alias("v"))
    p = positions(ev, ["user_id"], ["ts", "event_id"], "p")
    long = trends.trend_segments(p, ["user_id"], "p", "v", 10, chunk=chunk)
    arr = p.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("p", "v")))["v"].alias("x"))
    flat = trends.window_segments(arr, "x", 10).select("user_id", F.posexplode("segments").alias("seg", "s")).select("user_id", "seg", "s.*")
    cols = ["user_id", "seg", "start_time", "end_time", "start_value", "end_value", "trend", "n_steps"]
    assert sorted(map(tuple, long.select(*cols).collect())) == sorted(map(tuple, flat.select(*cols).collect()))


def test_shapes(rows):
    df = rows("x array<array<double>>", [([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]],)])
    assert df.select(fs.canonical(F.col("x"))).first()[0] == [[1, 4], [2, 5], [3, 6]]
    assert df.select(fs.canonical(F.col("x"), channels_first=False)).first()[0] == [[1, 2, 3], [4, 5, 6]]
    assert df.select(fs.mono(F.col("x"))).first()[0] == [2, 5]
    assert df.select(fs.drop_channels(F.col("x"), [0, 2])).first()[0] == [[2], [5]]
    with pytest.raises(Exception, match="leading"):
        rows("x array<array<array<double>>>", [([[[1.0]], [[2.0]]],)]).select(fs.squeeze_leading(F.col("x"))).collect()
