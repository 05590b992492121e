"""Vector functions over ARRAY<FLOAT|DOUBLE>, accumulated in doubles, and their text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """``[0.1, 0.2]`` to an array."""
    return F.from_json(text, "array<float>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _both(a: Column, b: Column, f) -> Column:
    """Null where a vector is null or the dimensions differ."""
    d = lambda x: x.cast("double")
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: f(d(x), d(y))))


def dot(a: Column, b: Column) -> Column:
    return _sum(_both(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_both(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 1.0).otherwise(1 - dot(a, b) / n)


def neg_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    return {"cosine": cosine, "l2": l2, "dot": neg_dot}[metric](a, b)


def dims(a: Column) -> Column:
    return F.size(a)


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def add(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x - y)
