"""Vector columns (``array<float>`` or ``array<double>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector is returned as it is.

    The sum of squares is bound once by the closing step, not per element.
    """
    values = v.cast("array<double>")
    return F.aggregate(
        values, F.lit(0.0), lambda acc, x: acc + x * x,
        lambda total: F.when(total == 0, values).otherwise(F.transform(values, lambda x: x / F.sqrt(total))),
    )
