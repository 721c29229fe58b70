"""Scalar encodings of labels and vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(col: Column | str, seed: int) -> Column:
    """A keyed uniform integer in [0, 2**32): the same on every engine and partitioning."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")


def six(x: Column) -> Column:
    """Rounded to six places; a negative zero becomes zero."""
    return F.round(x, 6) + F.lit(0.0)


def onehot_pm1(label: Column, k: int) -> Column:
    """+1 at the label, -1 elsewhere; all -1 for a null label."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == label, F.lit(1)).otherwise(F.lit(-1)))


def onehot_01(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)))


def argmax_label(v: Column) -> Column:
    """The first place of the maximum, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def threshold(u: Column, t: float = 0.0) -> Column:
    """In sequence: below t becomes 0; then above t becomes 1 (so with t < 0 the zeros become 1)."""
    first = F.when(u < t, F.lit(0.0)).otherwise(u)
    return F.when(first > t, F.lit(1.0)).otherwise(first)
