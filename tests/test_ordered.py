"""Running values and positions against plain loops; no key is one task."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import ordered
from parlance.operators import audit

SCHEMA = "id long, key string, other int, at long, value long"


def rows(seed, n=3000):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", "c", None]
    return [(i, rng.choice(keys), rng.choice([0, 0, 0, 1, None]), rng.randrange(200), rng.choice([None, rng.randrange(1000)])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_running_values_and_positions(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    order = [F.col("at"), F.col("id")]
    most = {r.id: r.result for r in ordered.running(df, ["key", "other"], order, F.col("value"), "result").collect()}
    sums = {r.id: r.result for r in ordered.running(df, ["key", "other"], order, F.col("value"), "result", F.sum).collect()}
    places = {r.id: r.position for r in ordered.positions(df, ["key", "other"], order).collect()}
    seen = {}
    for i, key, other, at, value in sorted(data, key=lambda r: (r[3], r[0])):
        before = seen.setdefault((key, other), [None, None, 0])
        if value is not None:
            before[:2] = [max(value, before[0] or 0), value + (before[1] or 0)]
        before[2] += 1
        assert (most[i], sums[i]) == tuple(before[:2])
        assert places[i] == (None if key is None or other is None else before[2])
    assert len(most) == len(sums) == len(places) == len(data)


def test_recent_items_over_borders(spark):
    """Ranges smaller than the window, hot and rare keys, items that do not count."""
    data = rows(7, 400)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        got = {r.id: r.last for r in ordered.recent(df, ["key"], [F.col("at"), F.col("id")], F.col("value"), 8, "last", 400).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    seen = {}
    for i, key, _, at, value in sorted(data, key=lambda r: (r[3], r[0])):
        before = seen.setdefault(key, [])
        assert got[i] == before[-8:], i
        before += [] if value is None else [value]


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ordered.positions(none, ["key"], [F.col("id")]).collect() == []
    one = spark.createDataFrame([(1, "k", 0, 5, None)], SCHEMA)
    assert ordered.running(one, ["key"], [F.col("at")], F.col("value"), "value").collect()[0].value is None


def test_half_of_the_rows_in_one_key_and_day_are_dealt_evenly(spark):
    df = spark.range(40_000).select(
        "id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("key"),
        F.lit(1).alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # these rows would fit into one range
    try:
        sizes = [r["count"] for r in ordered.ranged(df, ["key"], [F.col("at"), F.col("id")]).groupBy("__range").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 40_000 and len(sizes) == 8 and max(sizes) < 2.5 * 40_000 / 8


def test_calls_of_one_operation_on_one_day(spark):
    """One operation has half of all calls; its budget is spent in order, over every border."""
    start = dt.datetime(2024, 1, 1)
    calls = spark.range(4000).select(
        "id", (F.lit(start) + F.make_dt_interval(secs=F.col("id") % 997)).alias("ts"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("operation_id"),
        F.lit("llm").alias("destination"), F.lit("p").alias("provider"))
    allowed = calls.select("operation_id", "destination", "provider").distinct().withColumn("allowed_calls", F.lit(1500))
    got = audit.with_budget(calls, allowed, F.col("id") % 10 != 0).collect()
    hot = sorted((r for r in got if r.operation_id == "hot" and r.id % 10), key=lambda r: (r.ts, r.id))
    assert [r.call_no for r in hot] == list(range(1, 1601))
    assert sum(r.within_budget for r in hot) == 1500 and all(r.call_no is None and not r.within_budget for r in got if r.id % 10 == 0)


def test_consent_needs_all_three_keys(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    grants = spark.createDataFrame(
        [(1, "llm", "p", None, at(1), at(9)), (1, "tts", "q", "op", at(1), at(3)), (None, "llm", "p", None, at(1), at(9))],
        "workspace_id long, destination string, provider string, operation_id string, granted_at timestamp, expires_at timestamp")
    asked = [(1, 1, "llm", "p", "x", at(2), True), (2, 1, "llm", "q", "x", at(2), False), (3, 1, "tts", "p", "op", at(2), False),
             (4, 1, "tts", "q", "op", at(2), True), (5, 1, "tts", "q", "other", at(2), False), (6, 1, "tts", "q", None, at(2), False),
             (7, 1, "llm", "p", None, at(1), True), (8, 1, "llm", "p", None, at(9), False), (9, None, "llm", "p", None, at(2), False)]
    requests = spark.createDataFrame(asked, "id long, workspace_id long, destination string, provider string, operation_id string, ts timestamp, wanted boolean")
    assert all(r.has_consent == r.wanted for r in audit.with_consent(requests, grants).collect())
