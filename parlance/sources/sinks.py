"""Append and export sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTE_ORDER_MARK = "﻿"


def append(df: DataFrame, path: str, *partition_columns: str) -> None:
    """Append rows to a parquet table, one folder per partition value."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_columns) if partition_columns else writer).parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: str, source: str, *partition_columns: str) -> None:
    """Append one batch so that writing it again replaces it: a retry leaves no row twice.

    The batch is the first partition and only its folders are overwritten. Rows
    get ``source`` and ``row_hash`` (over their columns) as provenance.
    """
    rows = df.withColumns({"source": F.lit(source), "row_hash": F.xxhash64(*df.columns), "batch_id": F.lit(batch_id)})
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id", *partition_columns).parquet(path))


def export_ordered(df: DataFrame, path: str, *order) -> None:
    """CSV files in a global order: ranges of it file by file, by name, each with header and mark."""
    export_csv(df.orderBy(*order), path)


def import_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of :func:`export_csv` with the schema they had; NULL and the empty text are both written as an empty cell, which is NULL here."""
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def export_csv(df: DataFrame, path: str, partition_column: str | None = None, mark: bool = True) -> None:
    """CSV with a header; the byte order mark leads the first header cell of every file.

    Spread sheets then read the accents right. The mark is part of the name of
    the first exported column, so each part file starts with it.
    """
    first = next(c for c in df.columns if c != partition_column)
    if mark:
        df = df.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    writer = df.write.mode("overwrite").option("header", "true").option("emptyValue", "").option(
        "quoteAll", "false"
    ).option("escape", '"')
    (writer.partitionBy(partition_column) if partition_column else writer).csv(path)


def json_column(*columns: str):
    """Struct of the columns as JSON text; accents stay as they are."""
    return F.to_json(F.struct(*columns))
