import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tsprobe.operators import windows
from tsprobe.streaming import live


def test_stream_windows_out_of_order(spark, tmp_path):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    data = [(k, i, float(i * (k + 1)), str(i % 3), start + timedelta(seconds=i)) for k, n in enumerate((70, 5, 33)) for i in range(n)]
    rng.shuffle(data)
    schema = "k int, p long, v double, label string, ts timestamp"
    for part in range(5):
        spark.createDataFrame(data[part::5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for min_chunk in (1, 1024):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        out = live.stream_windows(stream, ["k"], "p", "v", "label", 8, 3, "ts", "5 minutes", min_chunk)
        path = str(tmp_path / f"out{min_chunk}")
        live.run_to_end(out.writeStream.foreachBatch(live.batch_writer(path)), str(tmp_path / f"cp{min_chunk}"))
        got = sorted((r["k"], r["start"], r["values"]) for r in spark.read.parquet(path).collect())
        batch = windows.count_windows(spark.createDataFrame(data, schema), ["k"], "p", ["v"], 8, 3)
        want = sorted((r["k"], r["start"], [x["v"] for x in r["rows"]]) for r in batch.collect())
        assert got == want


def test_window_state_expires(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "k int, p long, v double, label string, ts timestamp"

    def row(k, i, late=0):
        return k, i, float(i), "x", start + timedelta(seconds=i + late)

    batches = [
        [row(1, i) for i in range(40)] + [row(2, i) for i in range(5)],
        [row(1, i) for i in range(40)],  # repeats within the delay: no window comes twice
        [row(3, 0, 10_000)],  # the watermark passes all that came before
        [row(1, i) for i in range(40)] + [row(3, 1, 10_000)],  # repeats that are too late open no new state
    ]
    src, path = str(tmp_path / "in"), str(tmp_path / "out")
    totals, dropped = [], 0
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        out = live.stream_windows(stream, ["k"], "p", "v", "label", 8, 4, "ts", "1 minute", 1)
        for p in live.run_to_end(out.writeStream.foreachBatch(live.batch_writer(path)), str(tmp_path / "cp")):
            totals.append(p["stateOperators"][0]["numRowsTotal"])
            dropped += p["stateOperators"][0]["numRowsDroppedByWatermark"]
    got = sorted((r["k"], r["start"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, s) for s in range(0, 33, 4)]
    assert max(totals) >= 3 and totals[-1] == 1 and dropped >= 40  # recording 3 alone is left


def test_duplicates_of_later_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "run string, idx int, ts timestamp"
    first = [("a", i, start + timedelta(seconds=i)) for i in range(20)]
    batches = [first, first[5:] + [("a", 20, start + timedelta(seconds=30))], [("b", 1, start + timedelta(hours=3))], [("b", 1, start + timedelta(hours=3)), ("a", 7, start + timedelta(seconds=7))]]
    src, path, state = str(tmp_path / "in"), str(tmp_path / "out"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        kept = live.exactly_once(spark.readStream.schema(schema).parquet(src), ["run", "idx"], "ts", "10 minutes")
        state += [p["stateOperators"][0] for p in live.run_to_end(kept.writeStream.foreachBatch(live.batch_writer(path)), str(tmp_path / "cp"))]
    got = sorted((r["run"], r["idx"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", i) for i in range(21)] + [("b", 1)]
    assert max(s["numRowsTotal"] for s in state) == 22 and state[-1]["numRowsTotal"] == 1
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1  # the repeat after its state is gone


def test_resume_and_repeat(spark, tmp_path):
    schema = "pred_path string, ts string, v int"
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for rows in ([("a", "1", 1), ("b", "5", 2)], [("a", "2", 3), ("b", "4", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        live.run_to_end(stream.writeStream.foreachBatch(live.upsert_writer(out, "pred_path", "ts")), cp)
    shape = spark.createDataFrame([], schema).schema
    got = {r["pred_path"]: r["v"] for r in live.latest_rows(spark, out, shape).collect()}
    assert got == {"a": 3, "b": 2}
    # repeating the last batch changes nothing
    live.upsert_writer(out, "pred_path", "ts")(spark.createDataFrame([("a", "2", 3), ("b", "4", 4)], schema), 1)
    assert {r["pred_path"]: r["v"] for r in live.latest_rows(spark, out, shape).collect()} == got


def test_upserts_rewrite_touched_buckets_alone(spark, tmp_path):
    schema = "pred_path string, ts string, v int"
    shape, out = spark.createDataFrame([], schema).schema, str(tmp_path / "out")
    write = live.upsert_writer(out, "pred_path", "ts", buckets=16)
    assert live.latest_rows(spark, out, shape).count() == 0
    write(spark.createDataFrame([(f"p{i}", "1", i) for i in range(200)], schema), 0)
    first = {p.name for p in (tmp_path / "out/version=0").iterdir() if p.name.startswith("bucket=")}
    assert len(first) == 16
    write(spark.createDataFrame([("p7", "2", -7)], schema), 1)
    touched = [p.name for p in (tmp_path / "out/version=1").iterdir() if p.name.startswith("bucket=")]
    assert len(touched) == 1 and (tmp_path / "out/version=0" / touched[0]).exists()  # the manifest before still names it
    (tmp_path / "out/version=2").mkdir()  # a batch that was lost before its manifest
    want = {f"p{i}": i for i in range(200)} | {"p7": -7}
    assert {r["pred_path"]: r["v"] for r in live.latest_rows(spark, out, shape).collect()} == want
    write(spark.createDataFrame([("p7", "3", -8), ("new", "1", 5)], schema), 2)
    want |= {"p7": -8, "new": 5}
    assert {r["pred_path"]: r["v"] for r in live.latest_rows(spark, out, shape).collect()} == want
    assert not (tmp_path / "out/version=0" / touched[0]).exists() and not (tmp_path / "out/manifest-0").exists()
    assert len({p.name for p in (tmp_path / "out/version=0").iterdir()} & first) >= 14
    write(spark.createDataFrame([(f"p{i}", "9", 1) for i in range(200)], schema), 3)
    write(spark.createDataFrame([(f"p{i}", "9", 1) for i in range(200)], schema), 4)
    assert not (tmp_path / "out/version=0").exists() and not (tmp_path / "out/version=2").exists()
    assert live.latest_rows(spark, out, shape).where("v = 1").count() == 200


def test_log_stream(spark, tmp_path):
    (tmp_path / "in/r1").mkdir(parents=True)
    (tmp_path / "in/r1/a.jsonl").write_text('{"run": "x", "idx": 1, "gt": 1, "pred": 1}\n{"run": "x", "idx": 2, "gt": 1, "pred": -1}\n{"run": "x", "idx": 3, "gt')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("run", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("idx", "gt", "pred")])
    stream = live.read_log_stream(spark, str(tmp_path / "in"), schema)
    torn = str(tmp_path / "torn")
    live.run_to_end(live.torn_lines(stream).writeStream.foreachBatch(live.batch_writer(torn)), str(tmp_path / "cp-torn"))
    assert [r["line"] for r in spark.read.parquet(torn).collect()] == ['{"run": "x", "idx": 3, "gt']
    s = live.whole_lines(stream)
    once = live.exactly_once(s.union(s), ["run", "idx"], "ingested_at", "1 hour")
    path = str(tmp_path / "out")
    live.run_to_end(once.writeStream.foreachBatch(live.batch_writer(path)), str(tmp_path / "cp"))
    row = live.live_accuracy(spark.read.parquet(path), ["run"]).first()
    assert (row["seen"], row["right"], row["accuracy"]) == (2, 1, 0.5)
    assert spark.read.parquet(path).where(F.col("idx").isNull()).count() == 0
