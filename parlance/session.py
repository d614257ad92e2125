"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only, so they can be applied to a session that exists.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A join key may hold a third of the rows: split it even if that costs a shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Ten thousand documents are no batch: a worker holds a few copies of one.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a session."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only where none is named (tests, one machine) a temporary folder is used,
    which goes with the process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    fallback = tempfile.mkdtemp(prefix="parlance-")
    atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def run_dir(spark: SparkSession, label: str) -> str:
    """A new sub-folder name below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{label}-{os.urandom(6).hex()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder and read back.

    For frames that an operator reads several times: the files outlive lost
    executors, and the optimiser knows their size. They stay until the folder
    is cleaned.
    """
    spark = df.sparkSession
    path = run_dir(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
