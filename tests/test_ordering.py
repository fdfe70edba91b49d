"""Sliced ranking must equal the plain window functions, whatever the slicing."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from tsprobe.operators import ordering as o


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value", "event_type")
    # one hot key: a third of all rows
    return ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id"))).cache()


def same(a, b, cols):
    key = lambda r: repr(r)
    return sorted(map(key, a.select(*cols).collect())) == sorted(map(key, b.select(*cols).collect()))


@pytest.fixture
def slices(spark):
    """slices(n): shuffles have n partitions for the rest of the test."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, n)
    spark.conf.set(name, before)


@pytest.mark.parametrize("n", [1, 7, 60])
@pytest.mark.parametrize("keys,order", [(["user_id"], ["ts", "event_id"]), ([], ["ts", "event_id"]), (["event_type"], ["value", "event_id"]), (["user_id"], ["event_type", "event_id"])])
def test_positions(events, slices, keys, order, n):
    slices(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    plain = events.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))
    assert same(o.positions(events, keys, order, "pos"), plain, ["event_id", "pos"])


@pytest.mark.parametrize("place", ["concat('data/sample/with/a/long/common/prefix/', lpad(id, 6, '0'))", "cast(id % 2 AS int)", "id"])
def test_bounds_follow_the_whole_tuple(spark, slices, place):
    slices(20)
    df = spark.range(1000).selectExpr(f"{place} AS a", "id AS b")
    bounds = [tuple(r.b) for r in o.slice_bounds(df, ["a", "b"]).orderBy("b").collect()]
    ordered = sorted(tuple(r) for r in df.collect())
    cuts = [0, *[ordered.index(b) for b in bounds], len(ordered)]
    assert len(bounds) == 19 and max(y - x for x, y in zip(cuts, cuts[1:])) < 150
    w = Window.orderBy("a", "b")
    assert same(o.positions(df, [], ["a", "b"], "pos"), df.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")), ["b", "pos"])


def test_positions_of_no_rows(spark):
    assert o.positions(spark.range(0), [], ["id"]).count() == 0


def test_null_order_and_null_keys(rows):
    df = rows("k string, v double, id int", [(None, None, 1), (None, 2.0, 2), ("a", None, 3), ("a", 1.0, 4), (None, 1.0, 5), ("a", float("nan"), 6)])
    got = {r["id"]: r["pos"] for r in o.positions(df, ["k"], ["v", "id"], "pos").collect()}
    assert got == {1: 0, 5: 1, 2: 2, 3: 0, 4: 1, 6: 2}


def test_hash_rank_and_select(events):
    ranked = o.hash_rank(events, ["event_type"], ["event_id"], 3)
    plain = events.withColumn("_h", o.hash_key(3, "event_id")).withColumn(
        "rank", (F.row_number().over(Window.partitionBy("event_type").orderBy("_h", "event_id")) - 1).cast("bigint"))
    assert same(ranked, plain, ["event_id", "rank"])
    picked = o.hash_select(events, ["event_type"], ["event_id"], 3, F.floor(F.col("n") * 0.3))
    n = events.groupBy("event_type").count().select("event_type", F.floor(F.col("count") * 0.3).alias("k"))
    want = plain.join(n, "event_type").withColumn("picked", F.col("rank") < F.col("k"))
    assert same(picked, want, ["event_id", "picked"])
    assert o.hash_select(events, [], ["event_id"], 3, F.lit(0)).where("picked").count() == 0
    assert o.hash_select(events, [], ["event_id"], 3, F.lit(10**6)).where("picked").count() == events.count()


def test_results_do_not_depend_on_partitioning(events):
    a = o.hash_select(events.repartition(7), ["event_type"], ["event_id"], 1, F.lit(5)).where("picked")
    b = o.hash_select(events.coalesce(1), ["event_type"], ["event_id"], 1, F.lit(5)).where("picked")
    assert same(a, b, ["event_id"])


@pytest.mark.parametrize("chunk", [3, 16, 1 << 16])
def test_neighbours_and_running_sums(events, chunk):
    p = o.positions(events, ["user_id"], ["ts", "event_id"], "p")
    w = Window.partitionBy("user_id").orderBy("p")
    plain = p.withColumn("b", F.lag("value").over(w)).withColumn("a", F.lead("value").over(w))
    assert same(o.neighbours(p, ["user_id"], "p", {"b": "value"}, {"a": "value"}, chunk), plain, ["event_id", "a", "b"])
    got = o.running_sums(p, ["user_id"], "p", {"s": F.col("event_id")}, chunk)
    assert same(got, p.withColumn("s", F.sum("event_id").over(w)), ["event_id", "s"])


@pytest.mark.parametrize("bins,levels", [(2, 1), (3, 4), (1024, 2)])
@pytest.mark.parametrize("keys", [["event_type"], [], ["event_type", "third"]])
def test_exact_quantiles(events, bins, levels, keys):
    probs = {"q1": 0.25, "m": 0.5, "hi": 0.975, "least": 0.0, "most": 1.0}
    df = events.withColumn("third", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3))
    got = o.exact_quantiles(df, keys, "value", probs, bins, levels)
    want = df.groupBy(*keys).agg(*[F.percentile("value", p).alias(n) for n, p in probs.items()])
    a = {tuple(r[k] for k in keys): r for r in got.collect()}
    rows = want.collect()
    assert len(a) == len(rows)
    for r in rows:
        assert [a[tuple(r[k] for k in keys)][c] for c in probs] == pytest.approx([r[c] for c in probs])


def test_quantiles_of_ties_infinities_and_no_rows(rows):
    inf, nan = float("inf"), float("nan")
    data = [("a", v) for v in (1e308, -1e308, inf, -inf, nan, 0.0, 0.0)] + [("b", 5.0)] * 9 + [("c", None), (None, 2.0), (None, 4.0), ("d", nan)]
    df = rows("k string, v double", data)
    got = {r["k"]: r for r in o.exact_quantiles(df, ["k"], "v", {"p0": 0.0, "p2": 2 / 6, "m": 0.5, "p5": 5 / 6, "p6": 1.0}, bins=2).collect()}
    assert tuple(got["a"])[1:4] == (-inf, 0.0, 0.0) and got["a"]["p5"] == inf and got["a"]["p6"] != got["a"]["p6"]
    assert tuple(got["b"])[1:] == (5.0,) * 5 and got[None]["m"] == 3.0 and "c" not in got
    assert got["d"]["m"] != got["d"]["m"]
    assert o.exact_quantiles(df.where("false"), ["k"], "v", {"m": 0.5}).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(-5, 5)), min_size=1, max_size=30), st.integers(1, 6))
def test_positions_property(spark, data, n):
    spark.conf.set("spark.sql.shuffle.partitions", n)
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)], "k int, v double, id int")
    got = {r["id"]: r["pos"] for r in o.positions(df, ["k"], ["v", "id"], "pos").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for k in {k for k, _ in data}:
        order = sorted((v + 0.0, i) for i, (kk, v) in enumerate(data) if kk == k)
        assert [got[i] for _, i in order] == list(range(len(order)))


def test_segments_cut_without_moving_rows(spark, monkeypatch):
    monkeypatch.setattr(o, "SAMPLED", 40)
    monkeypatch.setattr(o, "ORDERED", 25)
    data = [(g, (i * 7919) % 600, f"k{i % 3}") for g in (0, 1) for i in range(600)] + [(2, i, "x") for i in range(5)]
    df = spark.createDataFrame(data, "g int, i long, s string").select("g", F.struct("i", "s").alias("id"))
    starts = {0: [1, 100, 355, 599], 1: [300], 2: [2, 5, 9]}
    got = df.withColumn("seg", o.segments(df, "g", ["id"], starts))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    placed = o.positions(got, ["g"], ["id"], "p").collect()
    assert len(placed) == 1205 and all(r["seg"] == sum(r["p"] >= s for s in starts[r["g"]]) for r in placed)
    twice = df.union(df)
    with pytest.raises(ValueError, match="equal"):
        o.segments(twice, "g", ["id"], {0: [101]})
