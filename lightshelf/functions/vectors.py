"""Distances of array<float> columns in double precision, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lightshelf.functions.scalar import col


def _summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _double(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    return _summed(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_summed(F.transform(_double(a), lambda x: x * x)))


def l2(a, b) -> Column:
    return F.sqrt(_summed(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def cosine_distance(a, b) -> Column:
    return 1.0 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_double(a), lambda x: x / n)).otherwise(_double(a))


def mean_vector(parts: Column, dims: int) -> list[Column]:
    """Averages of each place, for use in an aggregate."""
    return [F.avg(parts[i].cast("double")) for i in range(dims)]
