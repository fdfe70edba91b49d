"""Distances and norms of array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tsprobe.functions.series import dot, total


def _double(c: Column) -> Column:
    return c.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(dot(_double(v), _double(v)))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.transform(
        F.array(norm(v)), lambda n: F.transform(_double(v), lambda x: F.when(n == 0, x).otherwise(x / n))
    )[0]


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(_double(a), _double(b)) / (norm(a) * norm(b))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def manhattan_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))
