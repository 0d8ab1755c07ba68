"""Array expressions for numeric vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def normalised(a: Column) -> Column:
    """(v - min) / max of a vector of counts; zeros where all are zero."""
    return F.when(F.array_max(a) == 0, a).otherwise(F.transform(a, lambda x: (x - F.array_min(a)) / F.array_max(a)))
