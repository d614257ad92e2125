"""File admission and plain text to numbered paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import unnest

# ---- fixed values ----
SUPPORTED_EXTENSIONS = (".pdf", ".docx", ".doc", ".txt", ".md")
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
UNSAFE_NAME = r'[<>:"/\\|?*\x00-\x1f]'
FALLBACK_NAME = "tai-lieu"
PARAGRAPH_BREAK = rf"\n[{tx.SPACE}]*\n"
PARAGRAPH_LOCATOR = "đoạn "
CELL_SEPARATOR = " | "
# ---- end of fixed values ----


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder as (path, filename, size_bytes), without their content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(
            "path",
            F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
            F.col("length").alias("size_bytes"),
        )
    )


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"[^/](\.[^./]+)$", 1))


def admit(manifest: DataFrame) -> DataFrame:
    """Verdict per file: ``admitted`` or ``error`` with the first reason that applies."""
    ext = extension(F.col("filename"))
    reason = (
        F.when(~ext.isin(*SUPPORTED_EXTENSIONS), "unsupported_extension")
        .when(F.col("size_bytes") == 0, "empty_file")
        .when(F.col("size_bytes") > MAX_UPLOAD_BYTES, "too_large")
    )
    return manifest.select(
        "*",
        ext.alias("ext"),
        F.when(reason.isNull(), "admitted").otherwise("error").alias("status"),
        reason.alias("reason"),
    )


def batch_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Totals of an upload batch; whatever is not ready has failed."""
    ready = F.count_if(F.col("status") == "ready")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        ready.alias("n_ready"),
        (F.count(F.lit(1)) - ready).alias("n_failed"),
    )


def paragraphs(text: Column, separator: str = PARAGRAPH_BREAK) -> Column:
    """Non-blank paragraphs of an already normalised text, in order."""
    parts = F.transform(F.split(text, separator), tx.strip)
    return F.filter(parts, lambda p: p != "")


def paragraph_rows(documents: DataFrame, separator: str = PARAGRAPH_BREAK) -> DataFrame:
    """One row per paragraph; numbers start at 1 and skip blank paragraphs."""
    blocks = documents.withColumn("__text", tx.normalise_text(F.col("text"))).withColumn(
        "__blocks", paragraphs(F.col("__text"), separator)
    )
    kept = [c for c in documents.columns if c != "text"]
    return (
        unnest(blocks, kept, F.col("__blocks"), "text", "block_idx")
        .withColumn("locator", F.concat(F.lit(PARAGRAPH_LOCATOR), (F.col("block_idx") + 1).cast("string")))
    )


def row_text(cells: Column) -> Column:
    """A table row as one line: trimmed cells, empty ones left out."""
    filled = F.filter(F.transform(cells, tx.strip), lambda c: c != "")
    return F.concat_ws(CELL_SEPARATOR, filled)


def safe_filename(name: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(name, UNSAFE_NAME, "_"), r"^[ .]+|[ .]+$", "")
    return F.when(cleaned == "", F.lit(FALLBACK_NAME)).otherwise(cleaned)
