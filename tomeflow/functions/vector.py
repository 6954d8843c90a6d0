"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tomeflow.functions.text import col


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine in double precision; 0 where a vector is null, empty or zero, or the lengths differ."""
    a, b = col(a), col(b)
    bad = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b))
    na, nb = dot(a, a), dot(b, b)
    return F.when(bad, 0.0).otherwise(F.coalesce(F.when((na > 0) & (nb > 0), dot(a, b) / (F.sqrt(na) * F.sqrt(nb))), F.lit(0.0)))
