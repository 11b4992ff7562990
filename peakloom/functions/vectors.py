"""Distances on array<double> columns, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def rms_euclid(a: Column, b: Column) -> Column:
    """Euclidean distance divided by the square root of the dimension."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(total(squares) / F.greatest(F.size(a), F.lit(1)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 when either vector has no length."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    flat = (na <= 1e-12) | (nb <= 1e-12)
    return F.when(flat, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / F.nullif(na * nb, F.lit(0.0)))


def sorted_median(values: Column) -> Column:
    """Median of a short array: mean of the two middle values."""
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def differences(values: Column) -> Column:
    """Consecutive differences of an array."""
    n = F.size(values)
    head = F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tail = F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(tail, head, lambda b, a: b - a)
