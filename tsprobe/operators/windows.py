"""Fixed-length windows over positioned samples.

Samples are grouped once into position chunks with a halo of ``width - stride``
rows; overlapping windows are then sliced out of the chunk array. Each sample is
shuffled about once, however much the windows overlap, and a long recording is
spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tsprobe.functions import series as fs
from tsprobe.operators.ordering import null_safe_join


def chunk_arrays(df: DataFrame, keys: Sequence[str], pos: str, payload: Sequence[str], size: int, halo: int) -> DataFrame:
    """One row per (keys, chunk) with ``rows``: the chunk's samples plus ``halo`` following ones, in order."""
    p = F.col(pos)
    first = F.greatest(F.lit(0), F.floor((p - halo) / size))
    spread = df.select(*keys, p.alias("p"), *payload, F.explode(F.sequence(first, F.floor(p / size))).alias("chunk"))
    rows = F.sort_array(F.collect_list(F.struct("p", *payload)))
    return spread.groupBy(*keys, "chunk").agg(rows.alias("rows"))


def count_windows(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    payload: Sequence[str],
    width: int,
    stride: int,
    min_chunk: int = 1024,
) -> DataFrame:
    """Windows starting at 0, stride, 2*stride, ... while complete; the short tail is dropped.

    Output: keys, ``win`` (window number), ``start``, ``rows`` (array of structs ``p`` + payload).
    """
    if width < 1 or stride < 1:
        raise ValueError("width and stride must be positive")
    size = stride * max(1, -(-max(min_chunk, 4 * width) // stride))
    chunks = chunk_arrays(df, keys, pos, payload, size, max(0, width - stride))
    last = F.least(F.lit(size - stride), F.size("rows") - width)
    starts = F.when(F.size("rows") >= width, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(
        F.array().cast("array<int>")
    )
    cut = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("rows", s + 1, width).alias("rows")))
    start = F.col("chunk") * size + F.col("w.s")
    return chunks.select(*keys, "chunk", F.explode(cut).alias("w")).select(
        *keys,
        F.floor(start / stride).alias("win"),
        start.cast("bigint").alias("start"),
        F.col("w.rows").alias("rows"),
    )


def majority(labels: Column) -> Column:
    """STRUCT<label, cnt> of the most frequent element; ties go to the smallest label."""
    counted = F.transform(
        F.array_distinct(labels),
        lambda v: F.struct(F.size(F.filter(labels, lambda x: x == v)).alias("cnt"), v.alias("label")),
    )
    return F.aggregate(
        F.slice(counted, 2, 1 << 30),
        F.element_at(counted, 1),
        lambda best, c: F.when(
            (c["cnt"] > best["cnt"]) | ((c["cnt"] == best["cnt"]) & (c["label"] < best["label"])), c
        ).otherwise(best),
    )


def label_majority(windows: DataFrame, label: str, width: int, min_share: float) -> DataFrame:
    """Label each window by majority and drop it when the winner's share is below ``min_share``."""
    labelled = windows.withColumn("_m", majority(F.col(f"rows.{label}")))
    return (
        labelled.where(F.col("_m.cnt") / width >= min_share)
        .withColumn("y", F.col("_m.label"))
        .withColumn("share", F.col("_m.cnt") / width)
        .drop("_m")
    )


def label_center(windows: DataFrame, label: str, width: int) -> DataFrame:
    """Label each window by the sample at offset ``width // 2``."""
    return windows.withColumn("y", F.element_at(F.col(f"rows.{label}"), width // 2 + 1))


def lookback_horizon(df: DataFrame, keys: Sequence[str], pos: str, value: str, lookback: int, horizon: int) -> DataFrame:
    """Stride-1 forecast pairs: ``x`` holds ``lookback`` values, ``y`` the next ``horizon``."""
    wins = count_windows(df, keys, pos, [value], lookback + horizon, 1)
    vals = F.col(f"rows.{value}")
    return wins.select(
        *keys,
        F.col("start").alias("idx"),
        F.slice(vals, 1, lookback).alias("x"),
        F.slice(vals, lookback + 1, horizon).alias("y"),
    )


def pad_trim_center(df: DataFrame, keys: Sequence[str], pos: str, value: str, length: int) -> DataFrame:
    """Long-form series to arrays of exactly ``length`` values, cut or zero-padded around the centre.

    Positions outside the kept range are dropped before anything is collected.
    """
    keys = list(keys)
    sized = null_safe_join(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    start = F.greatest(F.lit(0), F.floor((F.col("_n") - length) / 2))
    kept = sized.where((F.col(pos) >= start) & (F.col(pos) < start + length))
    grouped = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("_v"))
    return grouped.select(*keys, fs.pad_trim_center(F.col(f"_v.{value}"), length).alias("x"))


def chunk_left_pad(df: DataFrame, keys: Sequence[str], pos: str, value: str, width: int = 512) -> DataFrame:
    """Long-form series to ``width``-long pieces, zero-padded on the left, with mask and true length."""
    pieces = chunk_arrays(df, keys, pos, [value], width, 0)
    v = F.col(f"rows.{value}")
    return pieces.select(
        *keys, "chunk", F.size(v).alias("length"), fs.left_pad(v, width).alias("values"), fs.valid_mask(v, width).alias("mask")
    )


def token_windows(df: DataFrame, tokens: str, max_length: int = 512, overlap: int = 64) -> DataFrame:
    """Overlapping windows over a token array; the last one stops at the end.

    ``weight`` is the number of content tokens (two places are kept for the
    encoder's start and end marks).
    """
    content = max_length - 2
    step = max(1, content - overlap)
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - content) / step).cast("int"))
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(k.alias("k"), F.slice(tokens, k * step + 1, content).alias("t")),
    )
    return df.select("*", F.explode(cut).alias("_c")).select(
        *df.columns,
        F.col("_c.k").alias("win"),
        (F.col("_c.k") * step).alias("start"),
        F.col("_c.t").alias("window"),
        F.size("_c.t").alias("weight"),
    )
