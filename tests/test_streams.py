"""Streams against their batch twins over several micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import glossary
from parlance.streaming import audit as sa
from parlance.streaming import documents as sd

from .test_models import CANDIDATE, random_candidates

STATE = ["workspace_id", "term_vi_norm", "term_en", "confidence", "status", "frequency", "pronunciation", "definition"]


def state(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*STATE).collect())


def test_ten_glossary_batches_equal_one_upsert(spark, tmp_path):
    """Rows that are written follow the terms that change, not the glossary; a batch written again changes nothing."""
    rows = [tuple(r.values()) for r in random_candidates(random.Random(11), 300)]
    whole = glossary.upsert(spark.createDataFrame(rows, CANDIDATE))
    log = sd.GlossaryLog(str(tmp_path / "log"))
    source = fed(spark, tmp_path / "in", [rows[i:i + 30] for i in range(0, 300, 30)], CANDIDATE, 1_700_000_000)
    sd.upsert_stream(source, log, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(240)
    assert state(log.read(spark)) == state(whole.glossary)
    conflicts = ["workspace_id", "term_key", "proposed_term_en", "proposed_definition", "source_ref", "confidence"]
    assert sorted(map(str, log.read_conflicts(spark).collect())) == sorted(map(str, whole.conflicts.select(*conflicts).collect()))
    written = spark.read.parquet(str(tmp_path / "log"))
    assert written.select("batch_id").distinct().count() == 10
    for number in range(10):
        part = rows[number * 30:number * 30 + 30]
        n_terms = written.filter(f"batch_id = '{number}' AND kind = 'term'").count()
        assert n_terms <= len({(r[0], r[2]) for r in part})
    last = written.filter("batch_id = '9'").drop("batch_id", "source", "row_hash").select(*sd.folded_terms(source).columns)
    log.write(last, 9)
    assert state(log.read(spark)) == state(whole.glossary)


def batches(spark, tmp_path, df, order, n):
    """A stream of ``n`` files, one per micro-batch, in order."""
    import time

    folder = tmp_path / "in"
    edges = df.count() // n + 1
    rows = df.orderBy(order).collect()
    for i in range(n):
        part = rows[i * edges:(i + 1) * edges]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(spark, tmp_path, stream):
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
             .option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


CALLS = "id bigint, ts timestamp, operation_id string, destination string, provider string, allowed_calls int, expires_at timestamp"


def test_budget_is_kept_over_batches(spark, tmp_path):
    start = dt.datetime(2024, 3, 1)
    calls = [(i, start + dt.timedelta(seconds=i), f"op{i % 4}", "llm", "p", 1 + i % 4, start + dt.timedelta(hours=1)) for i in range(40)]
    calls += [(100, start + dt.timedelta(seconds=20), None, "llm", "p", 5, None), (101, start, "undeclared", "llm", "p", 0, None)]
    df = spark.createDataFrame(calls, CALLS)
    got = drain(spark, tmp_path, sa.admitted_calls(batches(spark, tmp_path, df, "ts", 3))).collect()
    admitted = {}
    for r in got:
        admitted.setdefault(r.operation_id, set()).update({r.id} if r.admitted else set())
    assert sorted(r.id for r in got) == [*range(40), 100, 101]
    assert admitted == {f"op{k}": {k + 4 * j for j in range(1 + k)} for k in range(4)} | {None: set(), "undeclared": set()}


def test_a_quiet_half_hour_gives_no_new_budget(spark, tmp_path):
    """The operation lives for an hour: what it used counts on, and after its end nothing is admitted."""
    start = dt.datetime(2024, 3, 1)
    minutes = [0, 1, 32, 33, 34, 59, 60, 61, 150, 151]
    calls = [(i, start + dt.timedelta(minutes=m), "op", "llm", "p", 4, start + dt.timedelta(hours=1)) for i, m in enumerate(minutes)]
    got = drain(spark, tmp_path, sa.admitted_calls(batches(spark, tmp_path, spark.createDataFrame(calls, CALLS), "ts", 5))).collect()
    assert {r.id: r.admitted for r in got} == {i: i < 4 for i in range(10)}


def test_duplicates_are_dropped_over_batches(spark, tmp_path):
    start = dt.datetime(2024, 3, 1)
    rows = [(1 + i % 2, f"text {i % 5}", start + dt.timedelta(minutes=i), i) for i in range(30)]
    df = spark.createDataFrame(rows, "workspace_id bigint, text string, at timestamp, i int")
    got = drain(spark, tmp_path, sd.first_arrivals(batches(spark, tmp_path, df, "i", 3), "at")).collect()
    assert sorted((r.workspace_id, r.text) for r in got) == sorted({r[:2] for r in rows})


KEYS = "workspace_id bigint, destination string, provider string, operation_id string"


def fed(spark, folder, rows, schema, times):
    """A stream with one file per batch, in order."""
    import os

    for number, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / str(number)))
        for name in (folder / str(number)).glob("part-*"):
            os.utime(name, (times + number, times + number))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_every_request_has_its_verdict(spark, tmp_path):
    """Grants before and after the requests they cover, late ones, other keys; state goes with the watermark."""
    at = lambda h, m=0: dt.datetime(2024, 3, 1, 0) + dt.timedelta(hours=h, minutes=m)
    key = (7, "llm", "p")
    requests = [
        [(1, at(12), *key, "op"), (2, at(12), 7, "tts", "p", "op"), (3, at(12, 1), 7, "llm", "q", None)],
        [(4, at(12, 30), *key, "other"), (5, at(14), *key, "op"), (6, at(14, 1), 8, "llm", "p", "op")],
        [(7, at(30), *key, "op")], [(None, at(60), -1, "", "", None)], [(None, at(90), -1, "", "", None)],
    ]
    grants = [
        [(at(11, 55), at(12, 10), *key, None)],                                  # covers 1, has ended for 4
        [(at(12, 5), at(12, 40), *key, "op"), (at(13), at(15), *key, "op"), (at(13), at(14, 30), *key, None)],   # two cover 5
        [(at(29), at(31), 8, "llm", "p", None)],
        [(at(60), at(61), -2, "", "", None)],
        [(at(13, 30), at(21), 8, "llm", "p", None), (at(90), at(91), -2, "", "", None)],      # the first is too late for 6
    ]
    r = fed(spark, tmp_path / "r", requests, "id bigint, ts timestamp, " + KEYS, 1_700_000_000)
    g = fed(spark, tmp_path / "g", grants, "granted_at timestamp, expires_at timestamp, " + KEYS, 1_700_000_000)
    stream = sa.consented(r, g)
    started = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
               .option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    started.awaitTermination(180)
    got = [x for x in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect() if x.id]
    assert {x.id: x.has_consent for x in got} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: False} and len(got) == 7
    # nothing but the last beats is left in the join
    assert sum(o["numRowsTotal"] for o in started.lastProgress["stateOperators"]) <= 6


def test_windowed_counts_on_a_table(spark):
    at = dt.datetime(2024, 3, 1, 12)
    log = spark.createDataFrame([(at, "p", "blocked", 5), (at, "p", "attempt_failed", 9), (at + dt.timedelta(hours=1), "p", "blocked", 1)],
                                "created_at timestamp, provider string, status string, n_chars bigint")
    got = sa.windowed_counts(log).orderBy("window_start", F.col("status")).collect()
    assert [(r.status, r.n_calls, r.n_attempted, r.max_chars) for r in got] == [("attempt_failed", 1, 1, 9), ("blocked", 1, 0, 5), ("blocked", 1, 0, 1)]
