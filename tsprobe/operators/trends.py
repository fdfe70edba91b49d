"""Trends of neighbouring values, merged segments and their descriptions.

Two forms: long tables for recordings of any length (chunks with a one-row halo,
so one series may span many tasks) and array expressions for bounded windows
(no shuffle at all).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tsprobe.functions.hashing import hash_key
from tsprobe.functions.text import markdown_table
from tsprobe.operators.ordering import CHUNK, neighbours, running_sums

# up, down, flat wording; one triple per description
WORDS = (("increase", "decrease", "steady"), ("rise", "fall", "flat"), ("growth", "decline", "constant"))


def compare(a: Column, b: Column) -> Column:
    return F.when(a == b, "steady").when(a < b, "increase").otherwise("decrease")


def time_of(pos: Column, sample_rate: float) -> Column:
    return F.round(pos * F.lit(1.0 / sample_rate), 2)


def step_trends(df: DataFrame, keys: Sequence[str], pos: str, value: str, sample_rate: float, chunk: int = CHUNK) -> DataFrame:
    """One row per neighbouring pair: from/to time and value, trend, and whether a new segment starts here."""
    near = neighbours(df.select(*keys, pos, value), keys, pos, back={"_prev": value}, ahead={"_next": value}, chunk=chunk)
    v = F.col(value)
    steps = near.where(F.col("_next").isNotNull()).withColumn("trend", compare(v, F.col("_next")))
    before = F.when(F.col("_prev").isNotNull(), compare(F.col("_prev"), v))
    return steps.select(
        *keys, pos,
        time_of(F.col(pos), sample_rate).alias("from_time"), time_of(F.col(pos) + 1, sample_rate).alias("to_time"),
        v.alias("from_value"), F.col("_next").alias("to_value"), "trend",
        (before.isNull() | (before != F.col("trend"))).alias("starts"),
    )


def segment_steps(steps: DataFrame, keys: Sequence[str], pos: str, chunk: int = CHUNK) -> DataFrame:
    """Number the segments: ``seg`` on every step."""
    return running_sums(steps, keys, pos, {"seg": F.col("starts").cast("bigint")}, chunk).withColumn("seg", F.col("seg") - 1)


def trend_segments(df: DataFrame, keys: Sequence[str], pos: str, value: str, sample_rate: float, with_values: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of equal trend. ``with_values`` adds the value list, which is as long as the segment."""
    steps = segment_steps(step_trends(df, keys, pos, value, sample_rate, chunk), keys, pos, chunk)
    p = F.col(pos)
    aggs = [
        F.min("from_time").alias("start_time"), F.max("to_time").alias("end_time"),
        F.min_by("from_value", p).alias("start_value"), F.max_by("to_value", p).alias("end_value"),
        F.count(F.lit(1)).alias("n_steps"),
    ]
    if with_values:
        tail = F.sort_array(F.collect_list(F.struct(p, "to_value")))["to_value"]
        aggs.append(F.concat(F.array(F.min_by("from_value", p)), tail).alias("values"))
    # the trend is constant in a segment: as a key it keeps the aggregation hash-based
    return steps.groupBy(*keys, "seg", "trend").agg(*aggs)


def trend_totals(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total time and number of segments per trend."""
    return segments.groupBy(*keys, "trend").agg(
        F.round(F.sum(F.col("end_time") - F.col("start_time")), 2).alias("total_time"), F.count(F.lit(1)).alias("n_segments")
    )


def overall_trend(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Sign of last minus first value as upward / downward / steady."""
    d = F.max_by(value, pos) - F.min_by(value, pos)
    return df.groupBy(*keys).agg(F.when(d > 0, "upward").when(d < 0, "downward").otherwise("steady").alias("overall"))


def window_segments(df: DataFrame, values: str, sample_rate: float, name: str = "segments") -> DataFrame:
    """Segments of a bounded window as ARRAY<STRUCT<start_time, end_time, start_value, end_value, trend, n_steps>>."""
    n = F.size(values)
    steps = F.transform(F.sequence(F.lit(0), n - 2), lambda i: compare(F.get(values, i), F.get(values, i + 1)))
    out = df.withColumn("_steps", F.when(n >= 2, steps).otherwise(F.array().cast("array<string>")))
    marks = F.filter(
        F.transform("_steps", lambda s, i: F.when((i == 0) | (F.get("_steps", i - 1) != s), i)), lambda i: i.isNotNull()
    )
    out = out.withColumn("_marks", marks)

    def segment(a: Column, j: Column) -> Column:
        b = F.coalesce(F.get("_marks", j + 1), F.size("_steps"))
        return F.struct(
            time_of(a, sample_rate).alias("start_time"), time_of(b, sample_rate).alias("end_time"),
            F.get(values, a).alias("start_value"), F.get(values, b).alias("end_value"),
            F.get("_steps", a).alias("trend"), (b - a).alias("n_steps"),
        )

    return out.withColumn(name, F.transform("_marks", segment)).drop("_steps", "_marks")


def _word(trend: Column, words: Column) -> Column:
    return F.when(trend.isin("increase", "upward"), words["up"]).when(trend == "steady", words["flat"]).otherwise(words["down"])


def _secs(t: Column) -> Column:
    return F.format_string("%.2f", t)


def trend_text(df: DataFrame, values: str, sample_rate: float, sensor: Column | str, ids: Sequence[str], seed=42) -> DataFrame:
    """Add ``summary``, ``trend_list`` and ``totals_table`` texts for a bounded window.

    The wording is one template set; the word triple is picked by the row's hash key.
    """
    sensor = F.lit(sensor) if isinstance(sensor, str) else sensor
    cols = df.columns
    triples = F.array(*[F.struct(*[F.lit(w).alias(n) for w, n in zip(t, ("up", "down", "flat"))]) for t in WORDS])
    out = window_segments(df, values, sample_rate, "_seg")
    out = out.withColumn("_w", F.element_at(triples, (hash_key(seed, *ids) % len(WORDS)).cast("int") + 1))

    def totals(name: str) -> Column:
        mine = F.filter("_seg", lambda s: s["trend"] == name)
        spent = F.aggregate(mine, F.lit(0.0), lambda a, s: a + s["end_time"] - s["start_time"])
        return F.struct(
            F.lit(name).alias("trend"), F.round(spent, 2).alias("t"), F.size(mine).alias("n"),
            F.array_position(F.col("_seg.trend"), name).alias("first"),
        )

    kinds = F.filter(F.array(*[totals(t) for t in ("decrease", "increase", "steady")]), lambda k: k["n"] > 0)
    out = out.withColumn("_tot", kinds)
    delta = F.element_at(values, -1) - F.element_at(values, 1)
    out = out.withColumn("_all", F.when(delta > 0, "upward").when(delta < 0, "downward").otherwise("steady"))
    span = F.concat(
        F.lit("The "), sensor, F.lit(" runs from "), _secs(F.element_at("_seg", 1)["start_time"]),
        F.lit(" to "), _secs(F.element_at("_seg", -1)["end_time"]), F.lit(" seconds"),
    )
    counts = F.when(
        F.size("_tot") == 1, F.lit("with 1 kind of trend")
    ).otherwise(F.concat(F.lit("with "), F.size("_tot").cast("string"), F.lit(" kinds of trend in "), F.size("_seg").cast("string"), F.lit(" segments")))
    spent = F.array_join(
        F.transform("_tot", lambda k: F.concat(_word(k["trend"], F.col("_w")), F.lit(" for "), _secs(k["t"]), F.lit(" seconds"))), ", "
    )
    overall = F.when(
        F.size("_seg") > 1, F.concat(F.lit(" Overall: "), _word(F.col("_all"), F.col("_w")), F.lit("."))
    ).otherwise("")
    summary = F.concat(span, F.lit(" "), counts, F.lit(": "), spent, F.lit("."), overall)
    lines = F.transform(
        "_seg", lambda s: F.concat(_secs(s["start_time"]), F.lit("s to "), _secs(s["end_time"]), F.lit("s: "), _word(s["trend"], F.col("_w")))
    )
    by_count = F.array_sort(F.transform("_tot", lambda k: F.struct((-k["n"]).alias("o"), k["first"].alias("f"), k["trend"].alias("trend"))))
    counted = F.transform(
        by_count, lambda k: F.concat(F.lit("Number of "), _word(k["trend"], F.col("_w")), F.lit(" segments: "), (-k["o"]).cast("string"))
    )
    trend_list = F.array_join(F.concat(lines, F.when(F.size("_tot") > 1, counted).otherwise(F.array().cast("array<string>"))), "\n")
    cells = F.transform("_tot", lambda k: F.array(k["trend"], k["t"].cast("string")))
    return out.select(
        *cols, summary.alias("summary"), trend_list.alias("trend_list"),
        markdown_table(["trend", "total_time"], cells).alias("totals_table"),
    )
