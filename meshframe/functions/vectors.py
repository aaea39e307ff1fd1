"""3-vectors as array columns of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    return F.array(*(F.col(c) if isinstance(c, str) else c for c in (x, y, z)))


def diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, s) -> Column:
    return F.transform(a, lambda x: x * s)


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length_squared(a: Column) -> Column:
    return dot(a, a)


def length(a: Column) -> Column:
    return F.sqrt(length_squared(a))


def normalize(a: Column) -> Column:
    """Unit vector; a vector of (almost) no length stays as it is."""
    n = length(a)
    return F.when(n > 1e-28, F.transform(a, lambda x: x / n)).otherwise(a)
