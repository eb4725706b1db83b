"""Arithmetic on array<double> columns with JVM higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column, eps: float = 1e-12) -> Column:
    """x / max(|x|, eps); a zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x / n)


def scaled_add(a: Column, b: Column, alpha: Column) -> Column:
    """(1 - alpha) * a + alpha * b, element by element."""
    return F.zip_with(a, b, lambda x, y: (1 - alpha) * x + alpha * y)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """As in numerical libraries: NaN is never close; infinities only to themselves."""
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & ((a == b) | ((F.abs(a - b) <= atol + rtol * F.abs(b)) & (F.abs(b) < float("inf")))), F.lit(False))
