"""Streams over the audit log: counters, consent, budgets."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import CALL_KEY, attempted

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups over which the keys of a stream are dealt.
KEY_PARTS = 1024


def windowed_counts(log: DataFrame, length: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Calls per tumbling window, provider and status; works on a stream and on a table."""
    return (
        log.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", length), "provider", "status")
        .agg(F.count(F.lit(1)).alias("n_calls"), F.sum(attempted().cast("bigint")).alias("n_attempted"),
             F.max("n_chars").alias("max_chars"))
        .select(F.col("window.start").alias("window_start"), "provider", "status", "n_calls", "n_attempted", "max_chars")
    )


class ConsentWait(StatefulProcessor):
    """Verdicts on the requests of some keys. Rows: keys, op, at, and id for a request or stop for a grant.

    The state are the times that grants cover, per key and operation, as disjoint
    intervals, and the requests that none covers yet. A covered request goes out
    at once, the others when the watermark passes them; intervals go when it
    passes their end. Only the keys of one part and the requests of the present
    micro-batch and its wait are in memory, however many grants meet them.
    """

    def __init__(self, keys: Sequence[str], types: Sequence[str], id_type: str):
        self.keys = list(keys)
        self.columns = ", ".join(f"{key} {kind}" for key, kind in zip(keys, types))
        self.id_type = id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = handle
        self.grants = handle.getListState("grants", f"{self.columns}, op string, at bigint, stop bigint")
        self.waiting = handle.getListState("waiting", f"{self.columns}, op string, at bigint, id {self.id_type}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = len(self.keys)
        covers: dict[tuple, list[tuple[int, int]]] = {}
        for *of, at, stop in self.grants.get():
            covers.setdefault(tuple(of), []).append((at, stop))
        room = dict.fromkeys(covers, 1024)
        asked = [tuple(w) for w in self.waiting.get()]
        for row in rows:
            of = (*(row[k] for k in self.keys), row.op)
            if row.stop is None:
                asked.append((*of, row.at, row.id))
                continue
            times = covers.setdefault(of, [])
            times.append((row.at, row.stop))
            if len(times) > room.get(of, 1024):
                times[:] = merged(times)
                room[of] = 2 * len(times) + 1024
        covers = {of: merged(times) for of, times in covers.items()}
        passed, left = timerValues.getCurrentWatermarkInMs() * 1000, []
        for of, at, call in ((w[:n + 1], w[n + 1], w[n + 2]) for w in asked):
            scopes = () if None in of[:n] else {(*of[:n], None), of}
            if any(within(covers.get(scope, ()), at) for scope in scopes):
                yield Row(id=call, at=at, **dict(zip(self.keys, of)), has_consent=True)
            elif at <= passed:
                yield Row(id=call, at=at, **dict(zip(self.keys, of)), has_consent=False)
            else:
                left.append((*of, at, call))
        self._keep([(*of, *time) for of, times in covers.items() for time in times if time[1] > passed], left)

    def _keep(self, grants: list[tuple], waiting: list[tuple]) -> None:
        """The state, and a timer behind the last of each kind."""
        for state, rows, place in ((self.grants, grants, -1), (self.waiting, waiting, -2)):
            if rows:
                state.put(rows)
                self.timers.registerTimer(max(row[place] for row in rows) // 1000 + 1)
            else:
                state.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        left = []
        for w in self.waiting.get():
            if w[-2] <= passed:
                yield Row(id=w[-1], at=w[-2], **dict(zip(self.keys, w)), has_consent=False)
            else:
                left.append(tuple(w))
        kept = [tuple(g) for g in self.grants.get() if g[-1] > passed]
        for state, rows in ((self.grants, kept), (self.waiting, left)):
            if rows:
                state.put(rows)
            else:
                state.clear()


def merged(times: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals [start, stop) as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(times):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        elif stop > start:
            out.append((start, stop))
    return out


def within(times: Sequence[tuple[int, int]], at: int) -> bool:
    """Whether one of the disjoint intervals holds a moment."""
    place = bisect_right(times, at, key=lambda time: time[0])
    return place > 0 and at < times[place - 1][1]


def consented(requests: DataFrame, grants: DataFrame, keys: Sequence[str] = ("workspace_id", "destination", "provider"),
              lateness: str = "10 minutes", ttl: str = "8 hours", parts: int = KEY_PARTS) -> DataFrame:
    """Every request with its verdict: id, ts, keys and has_consent, once the watermark allows it.

    requests: id (unique), ts, operation_id and keys. grants: granted_at,
    expires_at, operation_id (NULL for any) and keys; none lives longer than
    ``ttl``. A grant covers requests from granted_at until expires_at, also if it
    arrives after them, unless the watermark has passed it: such a grant
    authorises nothing. A covered request comes out with its first grant, a
    refused one when no grant can cover it any more.

    No request is paired with a grant: what the grants of a key cover is kept as
    intervals (:class:`ConsentWait`). The keys are dealt over ``parts`` groups,
    as the state of a group is read and written as a whole.
    """
    use_rocksdb(requests.sparkSession)
    keys, kinds = list(keys), dict(requests.dtypes)
    group = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("__part")
    r = requests.filter("ts IS NOT NULL").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"]).select(
        F.col("ts").alias("__time"), group, *keys, F.col("operation_id").alias("op"), F.unix_micros("ts").alias("at"),
        F.lit(None).cast("bigint").alias("stop"), "id")
    known = F.col("granted_at").isNotNull() & F.col("expires_at").isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    end = F.least(F.unix_micros("expires_at"), F.unix_micros(F.col("granted_at") + F.expr(f"INTERVAL {ttl}")) + 1)
    g = grants.filter(known).withWatermark("granted_at", lateness).select(
        F.col("granted_at").alias("__time"), group, *keys, F.col("operation_id").alias("op"), F.unix_micros("granted_at").alias("at"),
        end.alias("stop"), F.lit(None).cast(kinds["id"]).alias("id"))
    types = [kinds[key] for key in keys]
    verdict = ", ".join([f"id {kinds['id']}, at bigint", *[f"{key} {kind}" for key, kind in zip(keys, types)], "has_consent boolean"])
    judged = r.unionByName(g).groupBy("__part").transformWithState(
        ConsentWait(keys, types, kinds["id"]), outputStructType=verdict, outputMode="append", timeMode="eventTime")
    return judged.select("id", F.timestamp_micros("at").alias("ts"), *keys, "has_consent")


class CallBudget(StatefulProcessor):
    """Verdicts on the calls of some operations.

    The state is, per (operation, destination, provider), the number of admitted
    calls and the end of the operation, and it goes when the watermark passes that
    end. The calls of a batch pass by one at a time: of those before the end, the
    first by (ts, id) are kept as far as the budget goes, and a call that drops
    out of them is refused at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = handle
        self.operations = handle.getListState("operations", "operation_id string, destination string, provider string, used int, ends bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        def verdict(of: tuple, call: int, admitted: bool) -> Row:
            return Row(id=call, operation_id=of[0], destination=of[1], provider=of[2], admitted=admitted)

        # used, end, and the first calls of this batch with the latest of them on top
        known = {tuple(o[:3]): [o[3], o[4], []] for o in self.operations.get()}
        for row in rows:
            of = (row.operation_id, row.destination, row.provider)
            operation = known.setdefault(of, [0, None, []])
            used, ends, first = operation
            ends = operation[1] = row.ends if ends is None else ends
            free = row.allowed_calls - used
            if ends is None or row.at >= ends or free <= 0:
                yield verdict(of, row.id, False)
            elif len(first) < free:
                heapq.heappush(first, (-row.at, -row.id))
            else:
                yield verdict(of, -heapq.heappushpop(first, (-row.at, -row.id))[1], False)
        for of, (_, _, first) in known.items():
            for _, call in first:
                yield verdict(of, -call, True)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        live = [(*of, used + len(first), ends) for of, (used, ends, first) in known.items() if used + len(first) and ends > passed]
        self._keep(live)
        if live:
            self.timers.registerTimer(-(-max(o[4] for o in live) // 1000))

    def _keep(self, live: list[tuple]) -> None:
        if live:
            self.operations.put(live)
        else:
            self.operations.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        self._keep([tuple(o) for o in self.operations.get() if o[4] > passed])
        return iter(())


def admitted_calls(calls: DataFrame, lateness: str = "10 minutes", parts: int = KEY_PARTS) -> DataFrame:
    """Budget admission of a call stream. calls: CALL_KEY, id, ts, allowed_calls, expires_at.

    ``expires_at`` is the end of the call's operation (NULL if none was opened):
    calls from then on are refused, however quiet the operation was before, and
    its state goes when event time passes it. Calls of one key are counted in
    the order of the micro-batches and by (ts, id) inside one. Calls without a
    full key belong to no operation and are refused without any state.

    The keys are dealt over ``parts`` groups: the live operations of a group are
    one state, as a state per operation costs several calls to its store for each.
    """
    use_rocksdb(calls.sparkSession)
    verdict = "id bigint, operation_id string, destination string, provider string, admitted boolean"
    known = F.lit(True)
    for key in CALL_KEY:
        known = known & F.col(key).isNotNull()
    orphans = calls.filter(~known).select("id", *CALL_KEY, F.lit(False).alias("admitted"))
    # Moments travel as microseconds, which have no time zone.
    timed = calls.filter(known).withWatermark("ts", lateness).select(
        "ts", "id", *CALL_KEY, "allowed_calls", F.unix_micros("ts").alias("at"), F.unix_micros("expires_at").alias("ends"),
        F.pmod(F.xxhash64(*CALL_KEY), F.lit(parts)).cast("int").alias("__part"))
    counted = timed.groupBy("__part").transformWithState(
        CallBudget(), outputStructType=verdict, outputMode="append", timeMode="eventTime",
    )
    return counted.unionByName(orphans)


def use_rocksdb(spark: SparkSession) -> None:
    """Processors with their own state need the store that has column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
