"""Pooling of vectors and selection of layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F


def vector_mean(df: DataFrame, keys: Sequence[str], vec: str, weight: str | None = None, name: str = "vec") -> DataFrame:
    """Weighted mean vector per key. Partial sums are merged map-side, so a hot key costs one row per task."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = Summarizer.metrics("mean").summary(array_to_vector(F.col(vec)), w)
    out = df.where(w > 0).groupBy(*keys).agg(mean.alias("_s"), F.sum(w).alias("weight"))
    return out.select(*keys, vector_to_array("_s.mean").alias(name), "weight")


def tail_patch_pool(df: DataFrame, keys: Sequence[str], patch: str, n_patches: int, length: str, vec: str, patch_len: int = 8) -> DataFrame:
    """Mean of the last ceil(length / patch_len) patch vectors (at least one) of a left-padded window."""
    real = F.greatest(F.lit(1), F.ceil(F.col(length) / patch_len))
    return vector_mean(df.where(F.col(patch) >= F.lit(n_patches) - real), keys, vec)


def masked_mean_pool(df: DataFrame, keys: Sequence[str], vec: str, mask: str) -> DataFrame:
    """Mean over valid tokens."""
    return vector_mean(df, keys, vec, weight=mask)


def select_layer(df: DataFrame, layer: int = -1) -> DataFrame:
    """Rows of one layer; -1 is the highest. A layer that does not exist is an error naming those that do."""
    if layer < 0:
        return df.where(F.col("layer") == df.agg(F.max("layer")).scalar())
    check_layer(df, layer)
    return df.where(F.col("layer") == layer)  # a plain filter: it reaches the scan


def check_layer(df: DataFrame, layer: int) -> None:
    """Raise if no row has the layer; the layers that exist are looked up only then."""
    if df.where(F.col("layer") == layer).isEmpty():
        found = sorted(r[0] for r in df.select("layer").distinct().collect() if r[0] is not None)
        raise ValueError(f"layer {layer} not found; available: {', '.join(map(str, found))}")
