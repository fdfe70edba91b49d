"""Fit on train, apply anywhere: channel, vector and per-series scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tsprobe.functions import series as fs
from tsprobe.operators.ordering import null_safe_join


def fit_channel_scaler(train: DataFrame, x: str, n_channels: int, floor: float = 1e-8) -> DataFrame:
    """One row ``stats``: ARRAY<STRUCT<m, s>> over all rows and time steps; population std, tiny std becomes 1."""
    steps = train.select(F.explode(x).alias("r"))
    aggs = []
    for i in range(n_channels):
        v = F.col("r")[i].cast("double")
        sd = F.stddev_pop(v)
        aggs.append(F.struct(F.avg(v).alias("m"), F.when(sd < floor, 1.0).otherwise(sd).alias("s")))
    return steps.agg(F.array(*aggs).alias("stats"))


def apply_scaler(df: DataFrame, x: str, scaler: DataFrame) -> DataFrame:
    """Standardise (T, C) windows with another table's statistics (a scalar subquery, no join)."""
    scaled = F.transform(x, lambda r: F.zip_with(r, F.col("_st"), lambda v, s: (v - s["m"]) / s["s"]))
    return df.withColumn("_st", scaler.select("stats").scalar()).withColumn(x, scaled).drop("_st")


def invert_scaler(df: DataFrame, x: str, scaler: DataFrame) -> DataFrame:
    restored = F.transform(x, lambda r: F.zip_with(r, F.col("_st"), lambda v, s: v * s["s"] + s["m"]))
    return df.withColumn("_st", scaler.select("stats").scalar()).withColumn(x, restored).drop("_st")


def fit_value_scaler(df: DataFrame, value: str) -> DataFrame:
    """Mean and population std of one column as a one-row table; fit it on the train rows or on all rows."""
    return df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).select(
        F.struct("m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")).alias("stats")
    )


def fit_vector_scaler(train: DataFrame, vec: str) -> DataFrame:
    """Mean and population std per dimension of an embedding column in one pass, without exploding vectors."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vec)))
    row = train.agg(summary.alias("s"))
    n = F.col("s.count")
    std = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return row.select(
        F.zip_with(
            vector_to_array("s.mean"), std,
            lambda m, d: F.struct(m.alias("m"), F.when(d == 0, 1.0).otherwise(d).alias("s")),
        ).alias("stats")
    )


def apply_vector_scaler(df: DataFrame, vec: str, scaler: DataFrame) -> DataFrame:
    scaled = F.zip_with(F.col(vec).cast("array<double>"), F.col("_st"), lambda v, s: (v - s["m"]) / s["s"])
    return df.withColumn("_st", scaler.select("stats").scalar()).withColumn(vec, scaled).drop("_st")


def invert_vector_scaler(df: DataFrame, vec: str, scaler: DataFrame) -> DataFrame:
    """Back to the scale that ``apply_vector_scaler`` came from."""
    back = F.zip_with(F.col(vec).cast("array<double>"), F.col("_st"), lambda v, s: v * s["s"] + s["m"])
    return df.withColumn("_st", scaler.select("stats").scalar()).withColumn(vec, back).drop("_st")


def znorm_windows(df: DataFrame, x: str, on_constant: str = "raise") -> DataFrame:
    """z-normalise each window and channel; constant windows raise, are flagged or are dropped."""
    out = df.withColumn(x, fs.znorm_channels(F.col(x)))
    zero = fs.is_all_zero(F.col(x))
    if on_constant == "flag":
        return out.withColumn("is_constant", zero)
    if on_constant == "drop":
        return out.where(~zero)
    if on_constant == "raise":
        message = F.lit("all-zero series after normalisation")
        return out.withColumn(x, F.when(zero, F.raise_error(message)).otherwise(F.col(x)))
    raise ValueError(f"unknown policy {on_constant!r}")


def znorm_long(df: DataFrame, keys: Sequence[str], value: str, name: str = "z", eps: float = 1e-6) -> DataFrame:
    """z-normalise long-form series: partial aggregates per series, then one join back."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    out = null_safe_join(df, stats, keys)
    return out.withColumn(name, (F.col(value) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")
