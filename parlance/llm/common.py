"""Helpers the operators of this subpackage share.

Contract of all operators, unless their docstring says otherwise:

* a null text is the empty text; a null id is a value like any other and its fold is that of the empty string;
* rows that occur twice are two rows, also in the result;
* an input column with the name of a result column is replaced by the result;
* an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, prepare

#: White space between words, as the contracts of the text operators define it.
SPACES = " \t\n\x0b\x0c\r"

#: A batch that goes to Python holds so many rows at most, and about so many bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "128", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings of the library and small Python batches."""
    prepare(spark)
    for key, value in BATCH.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: they outlive lost executors."""
    return cut_lineage(df)


def dealt(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``rows`` small rows that cost much each, dealt evenly over tasks of about ``each``."""
    return df.repartition(max(1, -(-rows // each)))


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % F.lit(folds)


def chance(id_column: Column, salt: int) -> Column:
    """A reproducible number from 0 up to 1 for an id."""
    return F.pmod(F.xxhash64(F.lit(salt), F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))


def slices(text: str, border: re.Pattern, size: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about ``size`` characters that end only where ``border`` matches."""
    start = 0
    while len(text) - start > size:
        found = border.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


class Memo(dict):
    """A dictionary that computes what it lacks and keeps a bounded number of short keys.

    When it is full, its keys become the old generation; those that are asked for
    again return from there, so frequent keys stay.
    """

    def __init__(self, compute, limit: int = 200_000, longest: int = 64, start: dict | None = None):
        super().__init__(start or {})
        self.compute, self.start, self.longest, self.old = compute, start or {}, longest, {}
        self.limit = limit // 2 + len(self.start)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
                self.update(self.start)
            self[key] = value
        return value


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, salt: int,
                    key: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """About ``limit`` labelled rows of ``docs``: key, text and label; for fitting small models.

    Ids are chosen by a hash, with a threshold that follows from the number of
    labels, so the choice is reproducible and needs no sort. The chosen ids are
    few, whatever the input, and may be broadcast. Of a repeated id one row stays;
    of contradicting labels the larger.
    """
    known = labels.select(F.col(key).alias("__id"), F.col(label).cast("double").alias("__label")).filter("__id IS NOT NULL AND __label IS NOT NULL")
    if where is not None:
        known = known.filter(where)
    total = known.count()
    chosen = known.filter(chance(F.col("__id"), salt) < F.lit(limit / max(total, 1))).groupBy("__id").agg(F.max("__label").alias("__label"))
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    met = rows.join(F.broadcast(chosen), "__id")
    one = met.groupBy("__id", "__label").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"))
    return one.select(F.col("__id").alias("key"), F.col("__text").alias("text"), F.col("__label").alias("label"))
