"""Dense vectors held as arrays, scored inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    # The length stands in an array of its own: inside the lambda it would be computed for each coordinate.
    return F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))
