"""Streams over the driver tables, run to the end of the input.

Each query feeds a table through the streaming operator with ``availableNow``
and returns the written rows; its oracle is the batch statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as au
from ..session import run_dir
from ..streaming import audit as sa
from ..streaming import documents as sd
from .audit import ALLOWED, CONSENT, allowed
from .glossary import FOLD as STANDING_FOLD
from .registry import query

# the same fold, without terms that were there before
FOLD = STANDING_FOLD.replace("s.term_vi_norm = r.term_key", "s.term_vi_norm = r.term_key AND false")


def as_stream(t, df: DataFrame, order: str, batches: int = 4, rows_per_batch: int = 8_000_000, rows_per_file: int = 250_000,
              bytes_per_file: int = 64 << 20) -> DataFrame:
    """A table as a file stream whose micro-batches are ordered ranges of ``order``; one job writes all.

    There are ``batches`` of them, or more if they would exceed ``rows_per_batch``:
    what a batch costs by itself is not paid once per file. A batch of many rows
    or long texts is several files, so that no task writes or reads a whole one.
    """
    folder = f"{run_dir(t.spark, 'stream')}/in"
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(sum(texts, F.lit(0).cast("bigint"))), F.lit(0)).alias("chars")).first()
    batches = max(batches, -(-size.rows // rows_per_batch))
    files = max(1, -(-size.rows // (batches * rows_per_file)), -(-size.chars // (batches * bytes_per_file)))
    df.repartitionByRange(batches * files, order).sortWithinPartitions(order).write.parquet(folder)
    # The source takes the oldest file first, so their times follow their numbers.
    path = t.spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(t.spark._jsparkSession.sessionState().newHadoopConf())
    written = sorted(str(f.getPath()) for f in store.listStatus(path) if f.getPath().getName().startswith("part-"))
    for number, name in enumerate(written):
        store.setTimes(t.spark._jvm.org.apache.hadoop.fs.Path(name), 1_700_000_000_000 + number * 1000, -1)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def drained(t, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows the stream gives until its input is used up."""
    folder = run_dir(t.spark, "stream")
    done = (
        stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").start()
    )
    done.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def timed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


@query("st1_windowed_counts", """
    WITH w AS (SELECT date_trunc('hour', created_at) AS h, * FROM fx_audit)
    SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, provider, status, count(*) AS n_calls,
           CAST(count(*) FILTER (status LIKE 'attempt%') AS BIGINT) AS n_attempted, max(n_chars) AS max_chars
    FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM fx_audit) - INTERVAL 10 MINUTE GROUP BY 1, 2, 3""")
def windowed_counts(t):
    log = timed(t["fx_audit"], "created_at").select("created_at", "provider", "status", "n_chars")
    rows = drained(t, sa.windowed_counts(as_stream(t, log, "created_at")))
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("st2_consented_requests", f"WITH {CONSENT} SELECT ok.id, has_consent FROM ok")
def consented_requests(t):
    """Both sides end with beats some days later, of workspaces that do not exist, so that every verdict is out."""
    keys = ["workspace_id", "destination", "provider"]
    requests = timed(t["fx_calls"], "ts").select("id", "ts", "operation_id", *keys)
    grants = timed(t["fx_grants"], "granted_at", "expires_at").select("operation_id", "granted_at", "expires_at", *keys)
    ends = requests.agg(F.max("ts").alias("end")).select("end", F.explode(F.array(F.lit(1), F.lit(2))).alias("days"))

    def with_beats(df: DataFrame, column: str, workspace: int) -> DataFrame:
        """No column is NULL that the join asks for: such rows are filtered before they move the watermark."""
        beats = ends.select((F.col("end") + F.make_dt_interval(days=F.col("days"))).alias(column), F.lit(workspace).cast("bigint").alias("workspace_id"),
                            F.lit("").alias("destination"), F.lit("").alias("provider"))
        if "expires_at" in df.columns:
            beats = beats.withColumn("expires_at", F.col(column))
        return df.unionByName(beats, allowMissingColumns=True)

    verdicts = sa.consented(as_stream(t, with_beats(requests, "ts", -1), "ts"), as_stream(t, with_beats(grants, "granted_at", -2), "granted_at"), keys)
    return drained(t, verdicts).filter("id IS NOT NULL").select("id", "has_consent")


# Operations end in the evening; what they declared comes with each call.
ENDS = "CAST(substr(operation_id, -10) AS TIMESTAMP) + INTERVAL '18' HOUR"


@query("st3_admitted_calls", f"""
    WITH {ALLOWED}, e AS (SELECT *, {ENDS} AS expires_at FROM fx_calls),
    n AS (SELECT *, row_number() OVER (PARTITION BY operation_id, destination, provider, ts < expires_at ORDER BY ts, id) AS call_no FROM e)
    SELECT n.id, n.operation_id, n.destination, n.provider, coalesce(n.ts < n.expires_at AND call_no <= allowed_calls, false) AS admitted FROM n LEFT JOIN allowed a
    ON a.operation_id = n.operation_id AND a.destination = n.destination AND a.provider = n.provider""")
def admitted_calls(t):
    calls = timed(t["fx_calls"], "ts").withColumn("expires_at", F.expr(ENDS).cast("timestamp")).join(allowed(t), au.CALL_KEY, "left").select(
        "id", "ts", *au.CALL_KEY, "expires_at", F.coalesce("allowed_calls", F.lit(0)).cast("int").alias("allowed_calls"))
    return drained(t, sa.admitted_calls(as_stream(t, calls, "ts")))


@query("st4_first_arrivals", """
    SELECT workspace_id, sha256(text) AS content_hash, 1 AS n FROM fx_documents GROUP BY 1, 2""")
def first_arrivals(t):
    arrivals = t["fx_documents"].select(
        "workspace_id", "text", F.timestamp_seconds(1_700_000_000 + F.col("doc_id") / 1000).alias("arrived_at"), "doc_id")
    rows = drained(t, sd.first_arrivals(as_stream(t, arrivals, "doc_id"), "arrived_at"))
    return rows.groupBy("workspace_id", "content_hash").agg(F.count(F.lit(1)).alias("n"))


@query("st5_glossary_stream", f"""
    WITH {FOLD}
    SELECT workspace_id, term_key AS term_vi_norm, arg_min(term_vi, seq) AS term_vi,
           coalesce(max(CASE WHEN outcome = 'updated' THEN term_en END), max(CASE WHEN outcome = 'added' THEN term_en END)) AS term_en,
           coalesce(max(CASE WHEN outcome = 'updated' THEN confidence END), max(CASE WHEN outcome = 'added' THEN confidence END)) AS confidence,
           'auto' AS status, 1 + count(*) FILTER (outcome IN ('bumped', 'updated')) AS frequency
    FROM judged GROUP BY 1, 2""")
def glossary_stream(t):
    folder = run_dir(t.spark, "glossary")
    log = sd.GlossaryLog(f"{folder}/log")
    source = as_stream(t, t["fx_candidates"], "seq", 3)
    started = sd.upsert_stream(source, log, f"{folder}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return log.read(t.spark).select("workspace_id", "term_vi_norm", "term_vi", "term_en", "confidence", "status", "frequency")
