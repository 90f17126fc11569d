"""Vector functions on array columns, summed in array order and in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def is_usable(vector: Column, dimensions: Column) -> Column:
    """Not null, as wide as stated, finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def truncate_renormalise(vector: Column, width: int) -> Column:
    """The first ``width`` elements at unit length; null for a zero vector."""
    cut = F.transform(F.slice(vector, 1, width), lambda x: x.cast("double"))
    n = norm(cut)
    return F.when(n > 0, F.transform(cut, lambda x: x / n))
