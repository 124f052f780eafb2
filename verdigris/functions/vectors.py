"""Vector arithmetic on ARRAY<FLOAT> columns, accumulated in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products from the first element on; null if a side is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` at length 1; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)
