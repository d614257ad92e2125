"""Openings, challenges and answers of operations; appended and exported logs; pruned scans."""

import datetime as dt

from pyspark.sql import functions as F

from parlance.operators import audit as au
from parlance.sources import sinks, tables

from .test_plans import plan

NOW = dt.datetime(2024, 5, 1, 12)
PAIRS = [("llm", "p"), ("search", "q")]


def at(m):
    return NOW + dt.timedelta(minutes=m)


def openings(spark, rows):
    return spark.createDataFrame(rows, "opening_id bigint, resume_id bigint, workspace_id bigint, kind string, fingerprint string, ts timestamp, "
                                       "is_confidential boolean, declares array<struct<destination:string,provider:string>>")


def test_asked_once_for_all_that_is_declared_then_resumed(spark):
    asked = openings(spark, [
        (1, None, 7, "qa", "f", NOW, True, PAIRS),              # asks for both
        (2, 1, 7, "qa", "f", at(3), True, PAIRS),               # resumed after the answer
        (3, 1, 7, "qa", "other", at(4), True, PAIRS),           # another request: a new operation that asks again
        (4, None, 8, "qa", "f", NOW, False, PAIRS),             # not confidential
        (5, None, None, "qa", "f", NOW, True, PAIRS),           # of no workspace
        (6, None, 7, "run", "g", at(5), True, PAIRS[:1] * 2),   # one pair, twice
    ])
    known = spark.createDataFrame([(1, 7, "qa", "f", at(15), None)],
                                  "operation_id bigint, workspace_id bigint, kind string, fingerprint string, expires_at timestamp, completed_at timestamp")
    rows = au.opened(asked, known)
    assert {r.opening_id: (r.operation_id, r.resumed) for r in rows.collect()} == {
        1: ("1", False), 2: ("1", True), 3: ("3", False), 4: ("4", False), 5: ("5", False), 6: ("6", False)}
    none = spark.createDataFrame([], "workspace_id bigint, destination string, provider string, operation_id string, granted_at timestamp, expires_at timestamp")
    first = au.challenges(au.missing_at_opening(rows.filter("opening_id = 1"), none))
    assert [(r.challenge_id, r.n_missing, r.expires_at) for r in first.collect()] == [(1, 2, at(10))]
    answers = spark.createDataFrame([(1, "operation", at(2)), (1, "session", at(4)), (99, "session", at(1))], "challenge_id bigint, scope string, answered_at timestamp")
    given = au.grants_from_challenges(answers, first, rows.filter("opening_id = 1").select("operation_id", "workspace_id", "declares"))
    missing = au.missing_at_opening(rows, given.select(*none.columns))
    assert sorted((r.opening_id, r.destination) for r in missing.collect()) == [(1, "llm"), (1, "search"), (3, "llm"), (3, "search"), (6, "llm"), (6, "llm")]
    blocked = au.blocked_rows(missing.filter("opening_id = 3")).orderBy("destination").collect()
    assert [(r.operation_id, r.module, r.endpoint, r.status, r.n_chars, r.summary) for r in blocked] == [
        ("3", "qa", "p:(chưa gọi)", "blocked", 0, "Bị chặn: hồ sơ mật chưa cho phép qa"), ("3", "qa", "q:(chưa gọi)", "blocked", 0, "Bị chặn: hồ sơ mật chưa cho phép qa")]
    states = {r.operation_id: (r.n_openings, r.n_refused, r.state) for r in au.operation_states(rows, missing, au.blocked_rows(missing)).collect()}
    assert states == {"1": (2, 1, "open"), "3": (1, 1, "waiting"), "4": (1, 0, "open"), "5": (1, 0, "open"), "6": (1, 1, "waiting")}


def test_a_batch_that_is_written_again_is_there_once(spark, tmp_path):
    path = str(tmp_path / "log")
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(3, "c")], "id int, v string")
    for batch, rows in (("1", one), ("2", two), ("1", one)):
        sinks.append_batch(rows, path, batch, "test")
    got = spark.read.option("basePath", path).parquet(path).collect()
    assert sorted((r.id, r.v, str(r.batch_id), r.source) for r in got) == [(1, "a", "1", "test"), (2, "b", "1", "test"), (3, "c", "2", "test")]
    assert len({r.row_hash for r in got}) == 3


def test_export_in_order_over_files(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = spark.range(5000).select("id", F.concat(F.lit('é "x", \n'), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "").otherwise(F.lit(None)).alias("note"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.export_ordered(rows, path, F.col("id").desc())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "csv").glob("*.csv"))
    assert len(files) > 1 and all(f.read_text(encoding="utf-8").startswith("﻿id,") for f in files)
    back = sinks.import_csv(spark, path, rows.schema)
    assert sorted(tuple(r)[:2] for r in back.collect()) == sorted(tuple(r)[:2] for r in rows.collect()) and back.filter("note IS NOT NULL").isEmpty()
    ranges = [[r.id for r in sinks.import_csv(spark, str(f), rows.schema).collect()] for f in files]
    assert [i for part in ranges for i in part] == list(range(4999, -1, -1))


def test_folders_of_other_workspaces_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_by_workspace(spark.range(1000).select((F.col("id") % 10).cast("int").alias("workspace_id"), "id"), path)
    wanted = spark.createDataFrame([(3, "x"), (4, "y"), (5, "x")], "workspace_id int, name string").filter("name = 'x'")
    rows = tables.scan(spark, path, wanted, ["workspace_id", "id"])
    assert "dynamicpruning" in plan(rows)
    assert {r.workspace_id for r in rows.collect()} == {3, 5} and rows.count() == 200
