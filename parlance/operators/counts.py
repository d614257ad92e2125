"""Many counts per workspace from many tables with one shuffle."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_workspace(
    sources: list[tuple[DataFrame, Mapping[str, Column]]],
    workspaces: DataFrame | None = None,
) -> DataFrame:
    """One row per workspace; each source adds columns as sums of its expressions.

    An expression is a condition (counted) or a number (added up). Instead of a
    join per table, all sources are stacked, and one aggregation with partial
    sums does the rest. ``workspaces`` adds the workspaces that own nothing.
    """
    names = [name for _, metrics in sources for name in metrics]
    stacked = []
    for df, metrics in sources:
        values = []
        for name in names:
            expression = metrics.get(name)
            value = F.lit(0) if expression is None else F.coalesce(expression.cast("bigint"), F.lit(0))
            values.append(value.cast("bigint").alias(name))
        stacked.append(df.select("workspace_id", *values))
    if workspaces is not None:
        stacked.append(workspaces.select("workspace_id", *[F.lit(0).cast("bigint").alias(n) for n in names]))
    return reduce(DataFrame.unionByName, stacked).groupBy("workspace_id").agg(
        *[F.sum(n).alias(n) for n in names]
    )


def every_row() -> Column:
    return F.lit(1)
