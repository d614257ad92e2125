"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: Sequence[str | Column], array: Column, value: str, position: str | None = None) -> DataFrame:
    """One row per element of a computed array; empty arrays give none.

    For a plain ``explode`` the optimiser adds the filter "array is not empty"
    and pushes it down to the scan, so a costly array is computed three times.
    The outer form with a filter behind it computes it once.
    """
    place = position or "__position"
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, value)).filter(F.col(place).isNotNull())
    return rows if position else rows.drop(place)
