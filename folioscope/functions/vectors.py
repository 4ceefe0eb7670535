"""Vector column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(first: Column, second: Column) -> Column:
    """Dot product of two float arrays, accumulated in double."""
    products = F.zip_with(first, second, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_normalise(vector: Column) -> Column:
    """Scale to unit length; a zero vector is returned unchanged."""
    norm = F.sqrt(inner_product(vector, vector))
    return F.when(norm == 0, vector).otherwise(
        F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))
    )
