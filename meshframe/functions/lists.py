"""Ordered lists as array columns; positions count from 0, absent entries are at -1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def append(a: Column, x) -> Column:
    return F.array_append(a, x)


def append_new(a: Column, x) -> Column:
    return F.when(F.array_contains(a, x), a).otherwise(F.array_append(a, x))


def locate(a: Column, x) -> Column:
    return (F.array_position(a, x) - 1).cast("int")


def contains(a: Column, x) -> Column:
    return F.array_contains(a, x)


def search(a: Column, test) -> Column:
    """The first entry for which ``test`` holds; null without one."""
    return F.get(F.filter(a, test), F.lit(0))


def insert_at(a: Column, x, i: int) -> Column:
    return F.array_insert(a, F.lit(i + 1), x if isinstance(x, Column) else F.lit(x))


def insert_before(a: Column, x, entry) -> Column:
    """``x`` before the first ``entry``; at the end where there is none."""
    at = F.array_position(a, entry).cast("int")
    x = x if isinstance(x, Column) else F.lit(x)
    return F.when(at > 0, F.concat(F.slice(a, F.lit(1), at - 1), F.array(x), F.slice(a, F.greatest(at, F.lit(1)), F.size(a)))).otherwise(F.array_append(a, x))


def remove_at(a: Column, i) -> Column:
    return F.filter(a, lambda _, k: k != i)


def remove(a: Column, x) -> Column:
    """Without the first ``x``."""
    at = F.array_position(a, x) - 1
    return F.filter(a, lambda _, k: k != at)


def replace_at(a: Column, i, x) -> Column:
    return F.transform(a, lambda y, k: F.when(k == i, x).otherwise(y))


def replace(a: Column, x, new) -> Column:
    at = F.array_position(a, x) - 1
    return F.transform(a, lambda y, k: F.when(k == at, new).otherwise(y))


def entry(a: Column, i) -> Column:
    return F.get(a, F.lit(i) if isinstance(i, int) else i)


def concatenate(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def count(a: Column) -> Column:
    return F.size(a)


def ordered(a: Column, comparator=None) -> Column:
    return F.array_sort(a, comparator) if comparator else F.array_sort(a)


def rotate(a: Column, start, reverse: bool = False) -> Column:
    """The cyclic list beginning at the first ``start``, backwards if asked."""
    a = F.reverse(a) if reverse else a
    k = F.greatest(F.array_position(a, start), F.lit(1)).cast("int")
    return F.concat(F.slice(a, k, F.size(a)), F.slice(a, F.lit(1), k - 1))
