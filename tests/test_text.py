import json
import random

import pytest
from pyspark.sql import functions as F

from tsprobe.functions import labels, paths
from tsprobe.functions import text as ft
from tsprobe.operators import checks, qa


def test_extract_letter(rows):
    df = rows("t string", [("The answer is [B] x",), ("maybe [A], then [C]",), ("[Z]",), ("Answer: [Q] then [A]",), ("Final answer - [ C ]",), (None,)])
    got = [(r["letter"], r["pred"]) for r in ft.extract_letter(df, "t", {"A": 0, "B": 1, "C": 2}).collect()]
    assert got == [("B", 1), ("C", 2), (ft.NO_LETTER, -1), ("A", 0), ("C", 2), (ft.NO_LETTER, -1)]


def test_last_number(rows):
    df = rows("t string", [("next hour will be 37.6",), ("-5",), ("",), ("-.5 and +3.25",), (None,)])
    assert [r[0] for r in df.select(ft.last_number(F.col("t"))).collect()] == [37.6, 5.0, None, 3.25, None]


def test_digit_texts(rows):
    df = rows("v array<double>", [([1.5, -0.25],)])
    assert df.select(ft.digit_text(F.col("v"))).first()[0] == "1 5 0 0 , - 0 2 5 0"
    assert df.select(ft.scaled_digit_text(F.col("v"))).first()[0] == "1 5 0 0 0 ,- 2 5 0 0"


def test_parse_forecast(rows):
    df = rows("t string", [('x {"analysis": "up", "forecast": [1, 2.00049]} y',), ('{"analysis": "up", "forecast": [1]}',), ("{broken",), (None,), ('{"analysis": "a", "forecast": [1, "z"]}',)])
    got = [(r["status"], r["forecast"]) for r in ft.parse_forecast(df, "t", 2).collect()]
    assert got == [("success", [1.0, 2.0])] + [("failed", None)] * 4


def brute_serialise(x, max_chars):
    r = [[round(v * 1000) / 1000 for v in row] for row in x]
    text, k = json.dumps(r), 1
    if len(text) <= max_chars:
        return text
    axis = 0 if len(r) >= len(r[0]) else 1
    size = max(len(r), len(r[0]))
    k = -(-len(text) // max_chars)
    while True:
        cut = r[::k] if axis == 0 else [row[::k] for row in r]
        text = json.dumps(cut)
        if len(text) <= max_chars or -(-size // k) <= 2:
            return text
        k += 1


@pytest.mark.parametrize("t,c,limit", [(30, 2, 120), (2, 40, 150), (5, 5, 60), (50, 1, 10_000), (50, 1, 30), (12, 3, 10)])
def test_serialise(rows, t, c, limit):
    rnd = random.Random(t * c)
    x = [[rnd.randrange(-40000, 40000) / 4000 for _ in range(c)] for _ in range(t)]
    df = rows("x array<array<double>>", [(x,)])
    assert ft.serialize_series(df, "x", "text", limit).first()["text"] == brute_serialise(x, limit)


def test_float_text(rows):
    vals = [0.001, 1e7, 123456789.25, -0.0, 0.1, 1e-3]
    df = rows("v double", [(v,) for v in vals])
    assert [r[0] for r in df.select(ft.float_text(F.col("v"))).collect()] == [repr(v) for v in vals]


def test_run_keys(rows):
    base = "d/sample_generations/alder/had/"
    df = rows("pred_path string", [
        (base + "logistic_regression/lets-ust_0-shot_Direct/layer10.jsonl",), (base + "visual_prompting/ts-ust_2-shot.jsonl",),
        (base + "random/prior.jsonl",), ("nothing/here.txt",), (base + "visual_prompting/vis_CoT.jsonl",)])
    got = [r.asDict() for r in paths.run_keys(df, style="hyphen").collect()]
    pick = lambda r: tuple(r[k] for k in ("model", "dataset", "embedding_type", "shots", "style", "layer", "variant"))
    assert [pick(r) for r in got] == [
        ("alder", "had", "lets-ust", 0, "Direct", 10, None), ("alder", "had", "ts-ust", 2, None, None, None),
        ("alder", "had", "prior", None, None, None, "prior"), (None,) * 7, ("alder", "had", "vis", 0, "CoT", None, None)]
    under = paths.run_keys(df).collect()
    assert under[0]["embedding_type"] == "lets_ust_0_shot_ust" and under[1]["embedding_type"] == "ts_ust" and under[4]["embedding_type"] is None


def test_modality_without_root(rows):
    df = rows("pred_path string", [("a/layer3.jsonl",), ("x/sample_generations/m/d/k/10-shot_cot/layer2.jsonl",)])
    got = [tuple(r)[1:] for r in paths.run_modality(df).collect()]
    assert got == [("", "", "", "", 0, -1, 3), ("m", "d", "k", "", 1, 10, 2)]


def test_variant_file_mismatch(rows):
    df = rows("n string", [("sys001_gq002_lets,ust_cot1.jsonl",)])
    with pytest.raises(Exception, match="mismatch"):
        df.select(paths.parse_variant_file(F.col("n")).alias("k")).select("k.*").collect()


def test_kinds(rows):
    valid = ["ts,ust", "ust,vis", "vis,ust,lets", "ust,lets"]
    wrong = ["ust", "ts,lets,ust", "ts,vis", "ust,ust", "ust,ust,vis", "ust,text", "", "ust,vis,ts,lets", None]
    got = {r["k"]: r["v"] for r in rows("k string", [(k,) for k in valid + wrong]).select("k", checks.valid_kinds(F.col("k")).alias("v")).collect()}
    assert all(got[k] for k in valid) and not any(got[k] for k in wrong)


def test_letters_beyond_three(spark):
    ranks = [1, 26, 27, 702, 703, 18_278, 18_279, 26**4]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in ranks], "r long").select(labels.letter(F.col("r"))).collect()]
    assert got == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA", "YYYZ"]


def test_question_kinds():
    with pytest.raises(ValueError):
        qa.check_kinds("ust")
    with pytest.raises(ValueError):
        qa.check_kinds("ts,lets")


def test_header_and_channels(rows):
    df = rows("t string", [(" Assistant:\n hi ",), ("assistant",), (" plain ",)])
    assert [r[0] for r in df.select(ft.strip_header(F.col("t"))).collect()] == ["hi", "", "plain"]
    assert qa.channel_names(3, ["x", "y", "z"]) == ["x", "y", "z"] and qa.channel_names(1, None) == ["time_series"]
    with pytest.raises(ValueError):
        qa.channel_names(2, ["x", "y", "z"])
