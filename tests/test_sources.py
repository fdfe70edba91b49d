import json

import pytest
from pyspark.sql import functions as F

from tsprobe.operators import qa
from tsprobe.schema import PREDICTIONS
from tsprobe.sources import datasets, logs, recordings


def test_jsonl(spark, tmp_path):
    run = tmp_path / "sample_generations/alder/had/logistic_regression/lets-ust_0-shot_Direct"
    (run / "best_params").mkdir(parents=True)
    lines = [json.dumps({"idx": i, "gt": 1, "pred": i % 2}) for i in range(4)]
    (run / "layer3.jsonl").write_text("\n".join(lines) + '\n\n{"idx": 9, "gt')
    (run / "best_params" / "layer3.jsonl").write_text('{"C": 1}\n')
    got = logs.scan_layers(spark, str(tmp_path), PREDICTIONS)
    assert got.count() == 4 and {(r["model"], r["layer"], r["style"]) for r in got.collect()} == {("alder", 3, "Direct")}
    counts = logs.line_counts(logs.parse_jsonl(logs.read_lines(spark, str(run / "layer3.jsonl")), PREDICTIONS)).first()
    assert (counts["lines_total"], counts["lines_valid"], counts["lines_torn"]) == (6, 4, 1)
    with pytest.raises(Exception):
        logs.read_jsonl(spark, str(run / "layer3.jsonl"), PREDICTIONS).collect()
    logs.write_jsonl(got.select("idx"), str(tmp_path / "out"))
    logs.write_jsonl(got.select("idx"), str(tmp_path / "out"))
    assert logs.read_jsonl(spark, str(tmp_path / "out"), PREDICTIONS).count() == 8


def test_tsv(spark, tmp_path):
    f = tmp_path / "r.tsv"
    f.write_text("a\tb\tc\n1\t2\n1\t2\t3\t\t\n\n4\t5\t6\n")
    got = logs.read_ragged_tsv(spark, str(f)).collect()
    assert [(r["a"], r["c"], r["repaired"]) for r in got] == [("1", "", True), ("1", "3", True), ("4", "6", False)]
    assert tuple(logs.ragged_counts(spark.read.text(str(f)), ["a", "b", "c"]).first()) == (2, 1)
    assert logs.read_tsv(spark, str(f)).dtypes[0] == ("a", "string")


def test_upsert_snapshot(spark, rows, tmp_path):
    old = rows("pred_path string, timestamp string, v int", [("a", "2024-01-01", 1), ("b", "2024-01-05", 2)])
    logs.append_results(old, str(tmp_path / "s0"))
    new = rows("pred_path string, timestamp string, v int", [("a", "2024-01-02", 3), ("b", "2024-01-05", 4), ("c", None, 5)])
    got = logs.upsert_snapshot(spark, str(tmp_path / "s0"), new, str(tmp_path / "s1"))
    assert {r["pred_path"]: r["v"] for r in got.collect()} == {"a": 3, "b": 4, "c": 5}
    logs.export_tsv(got, str(tmp_path / "tsv"))
    assert logs.read_tsv(spark, str(tmp_path / "tsv")).count() == 3


def test_ts_round_trip(spark, rows, tmp_path):
    df = rows("y int, x array<array<double>>", [(1, [[1.5, -2.0], [0.25, 100.0]]), (0, [[3.0, 4.0], [5.0, 0.000001]])])
    recordings.write_ts(df, "x", "y", str(tmp_path / "d"), "demo")
    header = [r[0] for r in spark.read.text(str(tmp_path / "d/header")).collect()]
    assert "@classLabel true 0 1" in header and header[-1] == "@data"
    back = {r["y"]: r["x"] for r in recordings.read_ts(spark, str(tmp_path / "d/cases")).collect()}
    assert back == {r["y"]: r["x"] for r in df.collect()}


def test_split_folder(spark, rows, tmp_path):
    df = rows("dataset string, split string, idx long, y int, x array<array<float>>",
              [("d", s, i, i % 2, [[float(i)], [i + 1.0]]) for s in ("train", "test") for i in range(4)])
    datasets.write_split(df, str(tmp_path / "w"))
    with pytest.raises(Exception):
        datasets.write_split(df, str(tmp_path / "w"))
    datasets.write_split(df, str(tmp_path / "w"), overwrite=True)
    names = rows("label string, name string, letter string", [("0", "no", "A"), ("1", "yes", "B")])
    got = datasets.load_windows(spark, str(tmp_path / "w"), "d", "train", normalise=True, label_map=names)
    assert got.count() == 4 and {r["name"] for r in got.collect()} == {"no", "yes"}
    assert "PartitionFilters: [isnotnull(dataset" in got._jdf.queryExecution().executedPlan().toString()


def test_artifacts(spark, rows, tmp_path):
    shots = rows("label int, rank int, idx long", [(0, 1, 7), (0, 2, 9), (1, 1, 4)])
    labels = rows("label int, letter string, name string", [(0, "A", "no"), (1, "B", "yes")])
    for name, df in datasets.artifact_texts(shots, labels, " Which? ").items():
        (tmp_path / name).write_text(df.first()["value"])
    got = datasets.load_artifacts(spark, str(tmp_path))
    assert sorted(map(tuple, got["class_shots"].select("label", "rank", "idx").collect())) == [(0, 1, 7), (0, 2, 9), (1, 1, 4)]
    assert sorted(map(tuple, got["label_map"].select("label", "letter", "name").collect())) == [("0", "A", "no"), ("1", "B", "yes")]
    assert got["question"].first()[0] == "Which?"
    with pytest.warns(UserWarning, match="missing artifact"):
        assert datasets.load_artifacts(spark, str(tmp_path / "none"))["label_map"] is None


def test_logs_labels_variants(spark, rows, tmp_path):
    (tmp_path / "mh_subject12.log").write_text("1.0 2.0 3\n4.5\t5.0  0\n")
    got = recordings.parse_sensor_log(logs.read_lines(spark, str(tmp_path / "mh_subject12.log")).drop("file_path"), 3).collect()
    assert [(r["subject_id"], r["ch"], r["label"]) for r in got] == [(12, [1.0, 2.0], 3), (12, [4.5, 5.0], 0)]
    bad = rows("value string, file_name string", [("1 2", "s1.log")])
    with pytest.raises(Exception, match="columns, expected 3"):
        recordings.parse_sensor_log(bad, 3).collect()
    labels = rows("value string", [("filename,label",), ("a/x.y.wav,1",), ("z.wav,2",), ("q.wav,0.0",)])
    assert {r["stem"]: r["y"] for r in recordings.parse_label_csv(labels).collect()} == {"x.y": 1, "z": 1, "q": 0}
    with pytest.raises(Exception, match="unexpected label"):
        recordings.parse_label_csv(rows("value string", [("a.wav,7",)])).collect()
    for n in ("v10", "v2", "v1"):
        (tmp_path / f"{n}.txt").write_text(n)
    assert [r["text"] for r in recordings.read_variants(spark, str(tmp_path)).orderBy("rank").collect()] == ["v1", "v2", "v10"]


def test_qa_documents(spark, tmp_path):
    doc = {"dataset": [
        {"index": "0", "summaries": {"x": {"A": "s"}}, "qa_pairs": {"x": [{"Q": "q", "A": "a1"}, {"A": "a2"}]}},
        {"index": "1", "qa_pair": {"A": "ignored"}}]}
    (tmp_path / "qa.json").write_text(json.dumps(doc, indent=1))
    rec = datasets.read_qa(spark, str(tmp_path / "qa.json"))
    got = qa.collect_answers(rec, "index").collect()
    assert [(r["index"], r["answers"]) for r in got] == [(0, ["s", "a1", "a2"])]
    datasets.write_qa(rec, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    meta = spark.createDataFrame([("d", 2, ["a"])], "dataset string, n_channels int, names array<string>")
    with pytest.raises(Exception, match="channel names"):
        datasets.check_channels(meta).select(F.size("names")).collect()


def test_scans_of_runs_and_variants(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in ("idx", "gt", "pred")])
    runs = tmp_path / "sample_generations"
    files = {
        "alder/har/logistic_regression/vis_ust_2-shot_CoT/layer7.jsonl": [(1, 0, 1), (2, 1, 1)],
        "alder/har/visual_prompting/ts-ust_1-shot_Direct.jsonl": [(3, 1, 0)],
        "birch/emg/random/prior.jsonl": [(4, 0, 0)],
        "birch/emg/knn/vis_ust/best_params/grid.jsonl": [(9, 9, 9)],
    }
    for name, lines in files.items():
        (runs / name).parent.mkdir(parents=True, exist_ok=True)
        (runs / name).write_text("".join(json.dumps(dict(zip(("idx", "gt", "pred"), x))) + "\n" for x in lines) + '{"idx": 5, "gt"')
    got = logs.scan_predictions(spark, str(runs), schema).select("idx", "model", "dataset", "method", "embedding_type", "style", "shots", "variant", "layer").collect()
    assert sorted(map(tuple, got)) == [
        (1, "alder", "har", "logistic_regression", "vis_ust_2_shot_ust", "CoT", None, None, 7), (2, "alder", "har", "logistic_regression", "vis_ust_2_shot_ust", "CoT", None, None, 7),
        (3, "alder", "har", "visual_prompting", "ts_ust", "Direct", 1, None, None), (4, "birch", "emg", "random", "prior", None, None, "prior", None),
    ]
    (tmp_path / "variants").mkdir()
    (tmp_path / "variants/sys003_gq003_ts-ust_cot1.jsonl").write_text('{"idx": 1, "gt": 1, "pred": 1}\n')
    (tmp_path / "variants/sys012_gq012_vis_cot.jsonl").write_text('{"idx": 2, "gt": 1, "pred": 0}\n')
    got = logs.scan_variants(spark, str(tmp_path / "variants"), schema).select("idx", "variant", "kinds", "cot").collect()
    assert sorted(map(tuple, got)) == [(1, 3, "ts-ust", 1), (2, 12, "vis", 0)]
    (tmp_path / "variants/sys001_gq002_vis_cot.jsonl").write_text('{"idx": 3, "gt": 1, "pred": 0}\n')
    with pytest.raises(Exception, match="sys/gq mismatch"):
        logs.scan_variants(spark, str(tmp_path / "variants"), schema).collect()


def test_pairs_by_place_and_one_series(spark, rows, tmp_path):
    left = rows("rank long, text string", [(0, "s0"), (1, "s1")])
    right = rows("rank long, text string", [(0, "q0"), (1, "q1"), (2, "q2")])
    cut = recordings.pair_variants(left, right)
    assert sorted((r["system"], r["question"]) for r in cut.collect()) == [("s0", "q0"), ("s1", "q1")]
    with pytest.raises(Exception, match="no partner at place 2"):
        recordings.pair_variants(left, right, strict=True).collect()
    both = recordings.zip_equal(left.withColumnRenamed("text", "a"), right.where("rank < 2").withColumnRenamed("text", "b"), "rank")
    assert sorted(map(tuple, both.select("rank", "a", "b").collect())) == [(0, "s0", "q0"), (1, "s1", "q1")]
    (tmp_path / "one.csv").write_text("when,value\n2024-01-02,5\n2024-01-01,3.5\n2024-01-03,x\n")
    series = recordings.read_series_csv(spark, str(tmp_path / "one.csv"), "when string, value string", "when", "value")
    assert [(r["pos"], r["v"]) for r in series.where("pos < 2").orderBy("pos").collect()] == [(0, 3.5), (1, 5.0)]
