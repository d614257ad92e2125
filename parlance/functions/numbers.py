"""Score arithmetic. Scores are decimals and are rounded once, at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE = "decimal(4,1)"
GAP_THRESHOLD = 0.5
TREND_BAND = 0.3


def clamp_score(value: Column) -> Column:
    """0 to 10, one decimal."""
    bounded = F.least(F.lit(10), F.greatest(F.lit(0), value.cast("decimal(20,10)")))
    return F.round(bounded, 1).cast(SCORE)


def tenths(column: Column) -> Column:
    """A one-decimal number as a count of tenths: sums of long numbers stay fast and exact."""
    return (column * 10).cast("bigint")


def rounded_mean(sum_of_tenths: Column, n: Column, digits: int) -> Column:
    """Mean from a sum of tenths, rounded half up; NULL without values."""
    return F.round(sum_of_tenths.cast("decimal(20,0)") / (F.nullif(n, F.lit(0)) * 10), digits).cast("double")


def mean_of(column: Column, digits: int) -> Column:
    """Exact decimal mean, rounded half up, as double. NULL without values."""
    return rounded_mean(F.sum(tenths(column)), F.count(column), digits)


def row_mean(columns: list[Column]) -> Column:
    """Mean of the non-null scores of one row, one decimal; NULL when all are NULL.

    Whole numbers only: scores are not negative, so adding half and dividing
    rounds half up. Every column is evaluated once: the state packs the sum of
    tenths and, in its low bits, the count, and the closing step binds it.
    """
    packed = F.aggregate(
        F.array(*[tenths(c) for c in columns]), F.lit(0).cast("bigint"), lambda acc, x: F.coalesce(acc + x * 1024 + 1, acc), _mean_of_packed)
    return (packed.cast("decimal(10,0)") / 10).cast(SCORE)


def _mean_of_packed(packed: Column) -> Column:
    """Mean in tenths, rounded half up, of a sum with its count in the low ten bits; NULL for none."""
    total, n = F.shiftright(packed, 10), packed.bitwiseAND(F.lit(1023).cast("bigint"))
    return F.when(n > 0, F.floor((total * 2 + n) / (n * 2)))


def sign_of_change(before: Column, after: Column, band: float, inclusive: bool) -> Column:
    """``up``, ``down`` or ``flat``; the band itself counts as a change if ``inclusive``."""
    delta = (after - before)
    limit = F.lit(band).cast("decimal(4,1)")
    up, down = (delta >= limit, delta <= -limit) if inclusive else (delta > limit, delta < -limit)
    return F.when(up, "up").when(down, "down").otherwise("flat")
