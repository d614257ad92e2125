"""Tables that tasks need next to the rows they scan, brought there by Spark's own joins and shuffles.

Nothing is collected while a query is built: a small table rides on the first row
of every partition, a keyed one streams in front of the rows of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The low bits of ``monotonically_increasing_id``: the place in a partition.
_PLACE = (1 << 33) - 1


def on_first_row(rows: DataFrame, single: DataFrame) -> DataFrame:
    """``rows`` with the columns of the one row of ``single`` on the first row of each partition, NULL on the others.

    Rows keep their partitions and their order. ``single`` is broadcast, so the
    caller bounds its size.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    marked = rows.withColumn("__slot", F.when(at == 0, F.lit(0).cast("bigint")))
    # Not a literal on both sides, or the join would have no key left to hash.
    slot = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("bigint"))
    return marked.join(F.broadcast(single.withColumn("__slot", slot)), "__slot", "left").drop("__slot")


def in_front(rows: DataFrame, side: DataFrame, key: str, spread_by: str, order: list, splits: int = 32) -> DataFrame:
    """Rows of both tables in one stream: those of ``side`` with a key (in ``order``) stand before the ``rows`` with it.

    Columns: the key, __split, __side (struct, NULL for rows) and __row (struct,
    NULL for the side). The rows of a key are dealt over ``splits`` parts by
    ``spread_by`` and each part gets the side of its key, so a task holds the
    side of one key at a time, and no key is one task.
    """
    split = F.pmod(F.xxhash64(spread_by), F.lit(splits)).cast("int")
    of_rows = F.struct(*[F.col(c) for c in rows.columns]).alias("__row")
    of_side = F.struct(*[F.col(c) for c in side.columns]).alias("__side")
    right = side.filter(F.col(key).isNotNull()).select(key, F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("__split"), of_side)
    left = rows.select(key, split.alias("__split"), of_rows)
    both = right.unionByName(left, allowMissingColumns=True).select(key, "__split", "__side", "__row")
    return both.repartition(key, "__split").sortWithinPartitions(
        key, "__split", F.col("__side").isNull(), *[F.when(F.col("__side").isNotNull(), o) for o in order])
