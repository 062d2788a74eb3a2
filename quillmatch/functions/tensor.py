"""Vectors as array columns: arithmetic, products, activations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def joined(a: Column, b: Column) -> Column:
    """The values of a, then those of b."""
    return F.concat(a, b)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(float(k)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is below 1e-8."""
    return F.when((norm(a) < 1e-8) | (norm(b) < 1e-8), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def matvec(rows: Column, v: Column) -> Column:
    return F.transform(rows, lambda r: dot(r, v))


def sigmoid(a: Column) -> Column:
    return F.transform(a, lambda x: 1.0 / (1.0 + F.exp(-x)))


def tanh(a: Column) -> Column:
    return F.transform(a, F.tanh)


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def softmax(a: Column) -> Column:
    """Shifted by the maximum, so it can't overflow."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))
