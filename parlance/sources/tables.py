"""Table scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(
    spark: SparkSession,
    path: str,
    workspaces: Sequence[int] | DataFrame | None = None,
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet scan; the workspace filter and the columns reach the file reader.

    ``workspaces`` may be a table with workspace_id: over a table that is
    partitioned by workspace (:func:`write_by_workspace`) only the folders of
    those are read, as Spark prunes them while the query runs.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if isinstance(workspaces, DataFrame):
        df = df.join(workspaces.select("workspace_id"), "workspace_id", "left_semi")
    elif workspaces is not None:
        df = df.filter(F.col("workspace_id").isin(*workspaces))
    return df.select(*columns) if columns else df


def write_by_workspace(df: DataFrame, path: str, files_per_workspace: int = 8) -> None:
    """A table with a folder per workspace, rows of one dealt over several files."""
    part = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_workspace))
    df.repartition("workspace_id", part).write.mode("overwrite").partitionBy("workspace_id").parquet(path)


def scan_vectors(spark: SparkSession, path: str, workspaces: Sequence[int] | DataFrame | None = None,
                 documents: DataFrame | None = None) -> DataFrame:
    """Vectors of some workspaces, optionally only those of a table of documents."""
    df = scan(spark, path, workspaces)
    return df if documents is None else df.join(documents.select("document_id"), "document_id", "left_semi")

