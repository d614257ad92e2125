"""Streams of arriving documents and term candidates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import glossary as gl
from ..operators.documents import content_hash
from ..sources.sinks import append_batch
from .audit import use_rocksdb


def first_arrivals(uploads: DataFrame, time_column: str, lateness: str = "1 hour") -> DataFrame:
    """Uploads whose content is new in their workspace within the watermark."""
    return (
        uploads.withColumn("content_hash", content_hash(F.col("text")))
        .withWatermark(time_column, lateness)
        .dropDuplicatesWithinWatermark(["workspace_id", "content_hash"])
    )


TEXTS = ["term_vi", "term_en", "pronunciation", "definition", "category", "confidence", "source_type", "source_ref"]
TERM = ", ".join(f"{c} string" for c in TEXTS) + ", frequency bigint, en_key string, rank int, changes bigint"
CHANGE = "kind string, workspace_id bigint, term_key string, " + TERM


class TermFold(StatefulProcessor):
    """The glossary row of one (workspace, term), folded over its candidates in ``seq`` order.

    State: the row with its rank and how often it has changed, and the other
    translations that were refused, one entry each. A batch puts out the row
    once and every refusal that is new. Only the candidates of the term in the
    present micro-batch are in memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.term = handle.getValueState("term", TERM)
        self.refused = handle.getMapState("refused", "term_en string", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = dict(zip([*TEXTS, "frequency", "en_key", "rank", "changes"], self.term.get())) if self.term.exists() else None
        changed, met = False, set()     # the store is asked once per refused translation, not per candidate
        for row in sorted(rows, key=lambda r: r.seq):
            if now is None:
                now = {c: row[c] for c in TEXTS} | {"frequency": 1, "en_key": row.en_key, "rank": row.rank, "changes": 0}
            elif row.en_key == now["en_key"]:
                now["frequency"] += 1
                for field in ("pronunciation", "definition"):
                    now[field] = now[field] or row[field]
            elif row.rank > now["rank"]:
                kept = {field: row[field] or now[field] for field in ("pronunciation", "definition")}
                now |= {c: row[c] for c in TEXTS if c != "term_vi"} | kept | {"frequency": now["frequency"] + 1, "en_key": row.en_key, "rank": row.rank}
            else:
                if row.term_en not in met and not self.refused.containsKey((row.term_en,)):
                    self.refused.updateValue((row.term_en,), (True,))
                    yield Row(kind="conflict", workspace_id=key[0], term_key=key[1], **{c: row[c] for c in TEXTS}, frequency=1,
                              en_key=row.en_key, rank=row.rank, changes=0)
                met.add(row.term_en)
                continue
            changed = True
        if changed:
            now["changes"] += 1
            self.term.update(tuple(now.values()))
            yield Row(kind="term", workspace_id=key[0], term_key=key[1], **now)

    def close(self) -> None:
        pass


def folded_terms(candidates: DataFrame) -> DataFrame:
    """Changed glossary rows and new refusals of a candidate stream (update mode).

    candidates: workspace_id, seq and the candidate fields. ``changes`` numbers
    the versions of a term: the highest is the term. Candidates whose term has no
    letter are dropped; seq must ascend from batch to batch.
    """
    use_rocksdb(candidates.sparkSession)
    keyed = candidates.select(
        F.col("workspace_id").cast("bigint").alias("workspace_id"), F.col("seq").cast("bigint").alias("seq"), *TEXTS,
        gl.tx.term_key(F.col("term_vi")).alias("term_key"), gl.tx.term_key(F.col("term_en")).alias("en_key"),
        gl.trust_rank(F.lit("auto"), F.col("confidence")).cast("int").alias("rank"),
    ).filter(F.col("term_key") != "")
    return keyed.groupBy("workspace_id", "term_key").transformWithState(TermFold(), outputStructType=CHANGE, outputMode="Update", timeMode="none")


class GlossaryLog:
    """The changes of a glossary stream as appended batches; a batch that is written again replaces itself."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, batch: DataFrame, epoch: int) -> None:
        """``foreachBatch`` callback: rows in proportion to the terms that changed."""
        append_batch(batch, self.path, str(epoch), "glossary stream", "kind")

    def _rows(self, spark: SparkSession, kind: str) -> DataFrame:
        rows = spark.read.schema(f"{CHANGE}, source string, row_hash bigint, batch_id string").parquet(self.path)
        return rows.filter(F.col("kind") == kind)

    def read(self, spark: SparkSession) -> DataFrame:
        """The glossary: of every term the row with most changes."""
        fields = [*TEXTS, "frequency"]
        newest = self._rows(spark, "term").groupBy("workspace_id", F.col("term_key").alias("term_vi_norm")).agg(
            F.max_by(F.struct(*fields), "changes").alias("t"))
        return newest.select("workspace_id", "term_vi_norm", *[F.col(f"t.{c}").alias(c) for c in fields], F.lit("auto").alias("status"))

    def read_conflicts(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "conflict").select(
            "workspace_id", "term_key", F.col("term_en").alias("proposed_term_en"), F.nullif("definition", F.lit("")).alias("proposed_definition"),
            "source_ref", "confidence")


def upsert_stream(candidates: DataFrame, log: GlossaryLog, checkpoint: str):
    """Starts the query that keeps ``log`` up to date with a candidate stream."""
    return (
        folded_terms(candidates).writeStream.outputMode("update").foreachBatch(lambda batch, epoch: log.write(batch, epoch))
        .option("checkpointLocation", checkpoint)
    )
