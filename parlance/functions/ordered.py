"""Ordered numbering and running values that survive a hot key.

``row_number() over (partition by key ...)`` sends a whole key to one task.
When only the first few rows per key are wanted that is harmless, because Spark
prunes each partition before the shuffle. When *every* row needs its position,
or the running value up to it, the functions below cut the rows into ranges of
(key, order) of about equal size, whatever the keys are. Each range is scanned
by itself, and what a key had in the ranges before is carried over the border:
one row per range, as only the first key of a range can have begun earlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: The low bits of ``monotonically_increasing_id``: the place in a partition.
_PLACE = (1 << 33) - 1


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = 1,
                  rank_column: str = "rank") -> DataFrame:
    """The first ``limit`` rows per key, with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_column, F.row_number().over(window)).filter(F.col(rank_column) <= limit)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows in ranges of (keys, order): ``__range`` ascends, ``__row`` counts from 0 in a range.

    Written once, so that the numbers stay what they are. ``order`` should end
    with a column that tells rows of a key apart, as equal rows share a range.
    ``df`` is evaluated twice (Spark samples it for the borders); an expensive
    one should be written first.
    """
    columns = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return cut_lineage(placed.withColumns({
        "__range": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)),
    }))


def _ends(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(__range, __first, __last, __stop): first and last key of every range and its last place; one row per range."""
    key = F.struct(*[F.col(k) for k in keys])
    return rows.groupBy("__range").agg(
        F.min_by(key, "__row").alias("__first"), F.max_by(key, "__row").alias("__last"), F.max("__row").alias("__stop")
    )


def _over_borders(of_last: DataFrame, through: Column) -> DataFrame:
    """(__range, __first, __carry): what the first key of a range had in all ranges before, where it had any.

    of_last: one row per range, with its first and last key and a value of the
    last; ``through`` combines such values up to a range, over a window.
    """
    before = Window.orderBy("__range")
    return (
        of_last.withColumn("__through", through)
        .select("__range", "__first", F.lag("__last").over(before).alias("__previous"), F.lag("__through").over(before).alias("__carry"))
        .filter(F.col("__previous").eqNullSafe(F.col("__first"))).drop("__previous")
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, result: str,
            how=F.max) -> DataFrame:
    """Adds the maximum (or the sum, ``how=F.sum``) of ``value`` from the first row of the key to this one.

    NULL values do not count; a NULL in a key is a key like any other. Rows that
    are equal in keys and order are taken in any order.
    """
    rows = ranged(df.withColumn("__value_of_row", value), keys, order)
    inside = Window.partitionBy("__range", *keys).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumn("__inside", how("__value_of_row").over(inside))
    key = F.struct(*[F.col(k) for k in keys])
    # One row per range, so never more than there are shuffle partitions.
    of_last = rows.join(F.broadcast(_ends(rows, keys)), "__range").filter(key.eqNullSafe(F.col("__last"))).groupBy("__range").agg(
        F.first("__first").alias("__first"), F.first("__last").alias("__last"), how("__value_of_row").alias("__value")
    )
    so_far = Window.partitionBy("__last").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    met = scanned.join(F.broadcast(_over_borders(of_last, how("__value").over(so_far))), "__range", "left")
    carry = F.when(key.eqNullSafe(F.col("__first")), F.col("__carry"))
    if how is F.max:
        total = F.greatest("__inside", carry)
    elif how is F.sum:
        total = F.when(F.col("__inside").isNotNull() | carry.isNotNull(), F.coalesce("__inside", F.lit(0)) + F.coalesce(carry, F.lit(0)))
    else:
        raise ValueError("running values are maxima (F.max) or sums (F.sum)")
    return met.withColumn(result, total).select(*[F.col(c) for c in df.columns if c != result], result)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], position_column: str = "position") -> DataFrame:
    """1-based position of every row in its key. Rows with a NULL key get no position."""
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    counted = running(df, keys, order, F.lit(1).cast("bigint"), position_column, F.sum)
    return counted.withColumn(position_column, F.when(known, F.col(position_column)))


def recent(df: DataFrame, keys: Sequence[str], order: Sequence[Column], item: Column, limit: int, result: str,
           frame: int | None = None) -> DataFrame:
    """Adds the array of the last ``limit`` items before each row in its key, oldest first.

    A NULL item does not count. It is enough to look at the ``frame`` rows
    before (``limit`` unless given): the caller knows how many can be NULL.
    """
    frame = frame or limit
    rows = ranged(df.withColumn("__item_of_row", item), keys, order)
    inside = Window.partitionBy("__range", *keys).orderBy("__row").rowsBetween(-frame, -1)
    scanned = rows.withColumn("__inside", F.collect_list("__item_of_row").over(inside))
    key = F.struct(*[F.col(k) for k in keys])
    # A range hands on its last rows, ``frame`` of them at most; one row per range.
    tails = (
        rows.join(F.broadcast(_ends(rows, keys)), "__range")
        .filter(key.eqNullSafe(F.col("__last")) & (F.col("__row") > F.col("__stop") - frame)).groupBy("__range").agg(
            F.first("__first").alias("__first"), F.first("__last").alias("__last"),
            F.sort_array(F.collect_list(F.struct("__row", "__item_of_row"))).alias("__tail"))
        .withColumn("__tail", F.array_compact(F.transform("__tail", lambda x: x["__item_of_row"])))
    )

    def last(items: Column) -> Column:
        return F.slice(items, F.greatest(F.lit(1), F.size(items) - limit + 1), limit)

    # Every range of a key that is passed over whole has one row of it at least.
    so_far = Window.partitionBy("__last").orderBy("__range").rowsBetween(1 - frame, 0)
    met = scanned.join(F.broadcast(_over_borders(tails, last(F.flatten(F.collect_list("__tail").over(so_far))))), "__range", "left")
    carry = F.when(key.eqNullSafe(F.col("__first")), F.col("__carry"))
    return met.withColumn(result, last(F.concat(F.coalesce(carry, F.slice("__inside", 1, 0)), "__inside"))).select(
        *[F.col(c) for c in df.columns if c != result], result
    )
