"""Array expressions on one series or one (T, C) window; no shuffle."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def position_sum(values: Column) -> Column:
    """Sum of value times 1-based position: a cheap order-sensitive fingerprint."""
    return total(F.transform(values, lambda v, i: v * (i + 1)))


def mean_std(values: Column) -> Column:
    """STRUCT<m, s> with the population standard deviation."""
    n = F.size(values)
    m = total(values) / n
    return F.struct(
        m.alias("m"), F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n).alias("s")
    )


def znorm(values: Column, eps: float = 1e-6) -> Column:
    """(x - mean) / (std + eps) along the array."""
    # a one-element transform binds the statistics once per row
    return F.transform(
        F.array(mean_std(values)), lambda st: F.transform(values, lambda v: (v - st["m"]) / (st["s"] + eps))
    )[0]


def pad_trim_center(values: Column, length: int, fill: float = 0.0) -> Column:
    """Exactly ``length`` values: cut evenly around the centre or pad, the odd one on the right."""
    n = F.size(values)
    left = F.floor((length - n) / 2).cast("int")
    pad = F.concat(F.array_repeat(F.lit(fill), left), values, F.array_repeat(F.lit(fill), length - n - left))
    cut = F.slice(values, F.floor((n - length) / 2).cast("int") + 1, length)
    return F.when(n > length, cut).when(n < length, pad).otherwise(values)


def left_pad(values: Column, width: int, fill: float = 0.0) -> Column:
    return F.concat(F.array_repeat(F.lit(fill), width - F.size(values)), values)


def valid_mask(values: Column, width: int) -> Column:
    """0 for the left padding, 1 for real values."""
    return F.concat(F.array_repeat(F.lit(0), width - F.size(values)), F.array_repeat(F.lit(1), F.size(values)))


def reshape(vec: Column, n_channels: int) -> Column:
    """Flat row-major vector to (T, C)."""
    steps = (F.size(vec) / n_channels).cast("int")
    return F.transform(F.sequence(F.lit(0), steps - 1), lambda t: F.slice(vec, t * n_channels + 1, n_channels))


def as_matrix(values: Column) -> Column:
    """(T,) to (T, 1)."""
    return F.transform(values, lambda v: F.array(v))


def transpose(x: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(F.element_at(x, 1)) - 1), lambda c: F.transform(x, lambda row: F.get(row, c))
    )


def canonical(x: Column, channels_first: bool | None = None, max_channels: int = 16) -> Column:
    """A 2-D series as (T, C). With no hint, a first axis of at most ``max_channels`` that is the shorter one is channels."""
    if channels_first is True:
        return transpose(x)
    if channels_first is False:
        return x
    t, c = F.size(x), F.size(F.element_at(x, 1))
    return F.when((t <= max_channels) & (t < c), transpose(x)).otherwise(x)


def squeeze_leading(x: Column) -> Column:
    """(1, T, C) to (T, C); more than one leading block is an error."""
    return F.when(F.size(x) == 1, F.element_at(x, 1)).otherwise(
        F.raise_error(F.lit("expected one leading block"))
    )


def keep_channels(x: Column, n: int) -> Column:
    return F.transform(x, lambda row: F.slice(row, 1, n))


def drop_channels(x: Column, channels: Sequence[int]) -> Column:
    return F.transform(x, lambda row: F.filter(row, lambda _, i: ~i.isin(list(channels))))


def mono(x: Column) -> Column:
    """Mean over channels per step."""
    return F.transform(x, lambda row: total(row.cast("array<double>")) / F.size(row))


def znorm_channels(x: Column) -> Column:
    """z-normalise every channel of a (T, C) window over time."""
    return transpose(F.transform(transpose(x), lambda ch: znorm(ch)))


def is_all_zero(x: Column) -> Column:
    return F.forall(x, lambda row: F.forall(row, lambda v: v == 0))


def hann_power(values: Column, n: int) -> Column:
    """One-sided power of an ``n``-sample frame under a periodic Hann window: |sum w x e^(-2 pi i k t / n)|^2.

    The basis depends on ``n`` only and travels as one constant.
    """
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)]
    basis = [
        {
            "c": [w * math.cos(2 * math.pi * k * i / n) for i, w in enumerate(window)],
            "s": [w * math.sin(2 * math.pi * k * i / n) for i, w in enumerate(window)],
        }
        for k in range(n // 2 + 1)
    ]
    table = F.from_json(F.lit(json.dumps(basis)), "array<struct<c array<double>, s array<double>>>")
    return F.transform(table, lambda b: F.pow(dot(values, b["c"]), F.lit(2)) + F.pow(dot(values, b["s"]), F.lit(2)))
