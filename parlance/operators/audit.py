"""Outbound-call audit: reports, consent, budgets, decisions, retention, storage."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..session import cut_lineage

# ---- fixed values ----
OVERSIZED_CHARS = 40_000
MAX_PAYLOAD_CHARS = 60_000
OPERATION_TTL = "INTERVAL 15 MINUTES"
SESSION_TTL = "INTERVAL 8 HOURS"
PENDING_TTL = "INTERVAL 10 MINUTES"
NOT_CALLED = ":(chưa gọi)"
BLOCKED_SUMMARY = "Bị chặn: hồ sơ mật chưa cho phép "
RATE_LIMIT_WAIT = 20
RATE_LIMIT_MAX_WAIT = 60
RETRY_DELAY = r"retryDelay['\"\s:]*(\d+)s"
CACHE_KEY_CHARS = 32
# ---- end of fixed values ----


def attempted() -> Column:
    return F.startswith("status", F.lit("attempt"))


# ------------------------------------------------------------------ reports


def recent(log: DataFrame, limit: int = 300, workspace_id: int | None = None) -> DataFrame:
    rows = log if workspace_id is None else log.filter(F.col("workspace_id") == workspace_id)
    return rows.orderBy(F.col("id").desc()).limit(limit)


def summary(log: DataFrame) -> DataFrame:
    """Attempted, successful, blocked and oversized calls per workspace, over all rows."""
    return log.groupBy("workspace_id").agg(
        F.count_if(attempted()).alias("n_attempted"),
        F.count_if(F.col("status") == "attempt_succeeded").alias("n_provider_ok"),
        F.count_if(F.col("status") == "blocked").alias("n_blocked"),
        F.count_if(attempted() & (F.col("n_chars") > OVERSIZED_CHARS)).alias("n_oversized"),
    )


def by_provider(log: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Attempts per workspace and provider label, with a zero row for a label never used.

    labels: provider to label, the registered providers. Attempts are counted
    in one column per label, which become rows at the end: one aggregation.
    """
    shown = sorted(set(labels.values()))
    tallies = [
        F.count_if(attempted() & F.col("provider").isin(*[p for p, l in labels.items() if l == label])).alias(f"__{i}")
        for i, label in enumerate(shown)
    ]
    rows = F.array(*[F.struct(F.lit(l).alias("label"), F.col(f"__{i}").alias("n_attempted")) for i, l in enumerate(shown)])
    return log.groupBy("workspace_id").agg(*tallies).select("workspace_id", F.inline(rows))


def by_destination(log: DataFrame) -> DataFrame:
    """Rows (blocked ones included), attempts, failures and largest payload per destination."""
    return log.groupBy("destination").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(attempted()).alias("n_attempted"),
        F.count_if(F.col("status") == "attempt_failed").alias("n_failed"),
        F.max("n_chars").alias("max_chars"),
    )


# ------------------------------------------------------------------ consent


def with_consent(
    requests: DataFrame, grants: DataFrame, keys: Sequence[str] = ("workspace_id", "destination", "provider"),
) -> DataFrame:
    """Adds ``has_consent``: a grant for the same keys and this operation, or for any, is in force.

    requests: id (unique), ts, operation_id and keys. grants: granted_at,
    expires_at, operation_id (NULL for any operation) and keys; a NULL key
    opens nothing. In force means granted_at <= ts < expires_at.

    A request is covered when some grant given before it ends after it, and
    that is so exactly when the latest end seen so far lies after it. A running
    maximum over both tables in time order therefore replaces the interval
    join: no request ever meets a grant, however many a workspace has. A
    request stands in it twice, once for grants to any operation and once for
    those to its own.
    """
    keys, end_type = list(keys), dict(grants.dtypes)["expires_at"]
    scopes = F.when(F.col("operation_id").isNull(), F.array(F.col("operation_id"))).otherwise(
        F.array(F.lit(None), F.col("operation_id"))
    )
    stacked = requests.select(
        *keys, F.explode(scopes).alias("__scope"), F.col("ts").alias("__at"), F.lit(1).alias("__order"), "id",
        F.lit(None).cast(end_type).alias("__end"),
    ).unionByName(grants.dropna(subset=keys).select(
        *keys, F.col("operation_id").alias("__scope"), F.col("granted_at").alias("__at"), F.lit(0).alias("__order"),
        F.lit(None).cast(requests.schema["id"].dataType).alias("id"), F.col("expires_at").alias("__end"),
    ))
    order = [F.col("__at"), F.col("__order"), F.col("id"), F.col("__end")]
    scanned = ordered.running(stacked, [*keys, "__scope"], order, F.col("__end"), "__until")
    until = scanned.filter(F.col("__order") == 1).groupBy("id").agg(F.max("__until").alias("__until"))
    return requests.join(until, "id", "left").withColumn(
        "has_consent", F.coalesce(F.col("__until") > F.col("ts"), F.lit(False))
    ).drop("__until")


def missing_permissions(operations: DataFrame, grants: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Declared (destination, provider) pairs of an operation without a grant in force.

    operations: operation_id, workspace_id, declares (array of structs). Grants
    are reduced to distinct keys first, so the anti join has one row per pair.
    """
    wanted = operations.filter(F.col("workspace_id").isNotNull()).select(
        "operation_id", "workspace_id", F.explode("declares").alias("d")
    ).select("operation_id", "workspace_id", "d.destination", "d.provider")
    valid = grants.filter((F.col("expires_at") > F.lit(as_of)) & (F.col("granted_at") <= F.lit(as_of))).select(
        "workspace_id", "destination", "provider", "operation_id"
    ).distinct()
    pair = ["workspace_id", "destination", "provider"]
    session_wide = valid.filter(F.col("operation_id").isNull()).drop("operation_id")
    return wanted.join(session_wide, pair, "left_anti").join(valid, [*pair, "operation_id"], "left_anti")


def grants_from_challenges(answers: DataFrame, challenges: DataFrame, operations: DataFrame) -> DataFrame:
    """Grants that answered consent challenges create, one per declared pair.

    answers: challenge_id, scope (operation or session), answered_at. A
    challenge counts once, by its first answer, and only before it expires.
    """
    first = answers.filter(F.col("scope").isin("operation", "session")).groupBy("challenge_id").agg(
        F.min(F.struct("answered_at", "scope")).alias("a")
    )
    valid = first.join(challenges, "challenge_id").filter(
        ~F.col("used") & (F.col("a.answered_at") < F.col("expires_at"))
    ).select("challenge_id", "operation_id", F.col("a.scope").alias("scope"), F.col("a.answered_at").alias("granted_at"))
    session = F.col("scope") == "session"
    return (
        valid.join(operations.select("operation_id", "workspace_id", "declares"), "operation_id")
        .select(
            "challenge_id", "workspace_id", F.when(~session, F.col("operation_id")).alias("operation_id"), "scope",
            F.explode("declares").alias("d"), "granted_at",
            F.when(session, F.col("granted_at") + F.expr(SESSION_TTL))
            .otherwise(F.col("granted_at") + F.expr(OPERATION_TTL)).alias("expires_at"),
        )
        .select("challenge_id", "workspace_id", "operation_id", "scope", "d.destination", "d.provider",
                "granted_at", "expires_at")
    )


def active_grants(grants: DataFrame, as_of: dt.datetime, revoked: DataFrame | None = None) -> DataFrame:
    """Grants in force at a time, without those of revoked workspaces."""
    rows = grants.filter((F.col("expires_at") > F.lit(as_of)) & (F.col("granted_at") <= F.lit(as_of)))
    return rows if revoked is None else rows.join(revoked.select("workspace_id"), "workspace_id", "left_anti")


def resumable(requests: DataFrame, operations: DataFrame) -> DataFrame:
    """Adds ``resumed``: the named operation matches in all six respects.

    requests: request_id, resume_id, workspace_id, kind, fingerprint, ts.
    operations: operation_id, workspace_id, kind, fingerprint, expires_at,
    completed_at. Workspaces may both be NULL.
    """
    known = operations.select(
        F.col("operation_id").alias("resume_id"), "kind", "fingerprint",
        F.col("workspace_id").alias("__ws"), "expires_at", "completed_at", F.lit(True).alias("__known"),
    )
    fits = (
        F.col("__known") & F.col("workspace_id").eqNullSafe(F.col("__ws"))
        & (F.col("expires_at") > F.col("ts")) & F.col("completed_at").isNull()
    )
    return requests.join(known, ["resume_id", "kind", "fingerprint"], "left").withColumn(
        "resumed", F.coalesce(fits, F.lit(False))
    ).select(*requests.columns, "resumed")


def fingerprint(method: Column, route: Column, body: Column, query: Column) -> Column:
    """Identity of one request; body and query are canonical JSON text."""
    return F.sha2(F.concat_ws("\n", F.upper(method), route, body, query), 256)


# ------------------------------------------------------------------ budgets and decisions


def allowed_calls(declares: DataFrame) -> DataFrame:
    """Budget per (operation, destination, provider): units times (retries + 1).

    Only the first declaration of a pair counts. declares: operation_id,
    position, destination, provider, unit_calls, retries_each.
    """
    first = declares.groupBy("operation_id", "destination", "provider").agg(
        F.min(F.struct("position", "unit_calls", "retries_each")).alias("d")
    )
    return first.select(
        "operation_id", "destination", "provider",
        (F.col("d.unit_calls") * (F.col("d.retries_each") + 1)).alias("allowed_calls"),
    )


CALL_KEY = ["operation_id", "destination", "provider"]


def with_budget(calls: DataFrame, allowed: DataFrame, eligible: Column | None = None) -> DataFrame:
    """Adds ``call_no`` and ``within_budget``; only eligible calls are counted.

    calls: id (unique), ts, operation_id, destination, provider. A pair that was
    not declared has no budget at all, nor has a call with a NULL in its key.
    """
    counts = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    for key in CALL_KEY:
        counts = counts & F.col(key).isNotNull()
    flagged = calls.withColumn("__eligible", counts)
    numbered = ordered.running(
        flagged, CALL_KEY, [F.col("ts"), F.col("id")], F.col("__eligible").cast("bigint"), "call_no", F.sum
    )
    counted = numbered.withColumn("call_no", F.when(F.col("__eligible"), F.col("call_no")))
    return (
        counted.join(allowed, CALL_KEY, "left")
        .withColumn("within_budget",
                    F.coalesce(F.col("call_no") <= F.col("allowed_calls"), F.lit(False)))
        .drop("__eligible")
    )


def decide(
    calls: DataFrame, grants: DataFrame, allowed: DataFrame,
    consent_keys: Sequence[str] = ("workspace_id", "destination", "provider"),
) -> DataFrame:
    """Outcome of every call: status and error class, by the first gate that stops it.

    calls: id, ts, workspace_id, operation_id, destination, provider, n_chars,
    is_confidential, provider_error (NULL when the provider answered). Gates:
    an open operation, payload size, consent (confidential workspaces only),
    budget, provider. A call stopped by an earlier gate spends no budget; one
    the provider fails does.
    """
    checked = cut_lineage(with_consent(calls, grants, consent_keys))
    orphan = F.col("operation_id").isNull()
    too_large = F.col("n_chars") > MAX_PAYLOAD_CHARS
    refused = F.col("is_confidential") & ~F.col("has_consent")
    budgeted = with_budget(checked, allowed, ~orphan & ~too_large & ~refused)
    error = (
        F.when(orphan, "NoActiveOperation").when(too_large, "PayloadTooLarge").when(refused, "ConsentRequired")
        .when(~F.col("within_budget"), "OperationBudgetExceeded").otherwise(F.col("provider_error"))
    )
    blocked = orphan | too_large | refused | ~F.col("within_budget")
    return budgeted.withColumn("error_class", error).withColumn(
        "status",
        F.when(blocked, "blocked").when(F.col("provider_error").isNotNull(), "attempt_failed")
        .otherwise("attempt_succeeded"),
    )


# ------------------------------------------------------------------ life of an operation

LOG = ["source", "source_id", "workspace_id", "operation_id", "module", "destination", "provider", "endpoint", "summary",
       "created_at", "status", "error_class", "n_chars"]


def opened(openings: DataFrame, operations: DataFrame) -> DataFrame:
    """Adds ``operation_id`` and ``resumed``: the operation that is named and fits (:func:`resumable`), or a new one.

    openings: opening_id, resume_id (NULL if none is named), workspace_id, kind,
    fingerprint, ts and more. A new operation has the id of its opening.
    """
    asked = openings.withColumnRenamed("opening_id", "request_id")
    return resumable(asked, operations).withColumnRenamed("request_id", "opening_id").withColumn(
        "operation_id", F.when(F.col("resumed"), F.col("resume_id").cast("string")).otherwise(F.col("opening_id").cast("string"))
    )


def missing_at_opening(openings: DataFrame, grants: DataFrame) -> DataFrame:
    """Declared pairs that a confidential opening has no grant for at its time, in their order.

    openings: as :func:`opened` returns them, with is_confidential and declares
    (array of structs). All consent is asked for here, once per opening.
    """
    pairs = openings.filter(F.col("is_confidential") & F.col("workspace_id").isNotNull()).select(
        "opening_id", "ts", "workspace_id", "operation_id", "kind", F.posexplode("declares").alias("position", "d")
    ).select("opening_id", "ts", "workspace_id", "operation_id", "kind", "position", "d.destination", "d.provider",
             F.concat_ws("-", "opening_id", "position").alias("id"))
    return with_consent(pairs, grants).filter(~F.col("has_consent")).drop("id", "has_consent")


def challenges(missing: DataFrame) -> DataFrame:
    """One challenge per opening that misses something; it waits for an answer for ten minutes."""
    return missing.groupBy(F.col("opening_id").alias("challenge_id"), "operation_id", "workspace_id", "ts").agg(
        F.count(F.lit(1)).alias("n_missing")
    ).withColumn("expires_at", F.col("ts") + F.expr(PENDING_TTL)).withColumn("used", F.lit(False)).drop("ts")


def blocked_rows(missing: DataFrame) -> DataFrame:
    """Rows for the audit log of what an opening was refused: one per missing pair, without payload."""
    return missing.select(
        F.lit("opening").alias("source"), F.col("opening_id").alias("source_id"), "workspace_id", "operation_id", F.col("kind").alias("module"),
        "destination", "provider", F.concat("provider", F.lit(NOT_CALLED)).alias("endpoint"), F.concat(F.lit(BLOCKED_SUMMARY), "kind").alias("summary"),
        F.col("ts").alias("created_at"), F.lit("blocked").alias("status"), F.lit(None).cast("string").alias("error_class"),
        F.lit(0).cast("bigint").alias("n_chars"),
    )


def append_rows(decisions: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """Rows for the audit log: one per call, stopped ones included, with the size of its payload, and one per pair an opening missed.

    decisions: as :func:`decide` returns them, with module, endpoint and summary
    (NULL where a log does not have them).
    """
    absent = {c: F.lit(None).cast("string") for c in ("module", "endpoint", "summary") if c not in decisions.columns}
    calls = decisions.withColumns({**absent, "source": F.lit("call"), "source_id": F.col("id"), "created_at": F.col("ts")}).select(*LOG)
    return calls if missing is None else calls.unionByName(blocked_rows(missing))


def operation_states(openings: DataFrame, missing: DataFrame, log: DataFrame) -> DataFrame:
    """Every operation folded from its events: openings, refusals and calls, in one shuffle.

    A last opening that missed something leaves it waiting for an answer.
    """
    def events(df: DataFrame, kind: str, at: str, **more: Column) -> DataFrame:
        return df.select("operation_id", "workspace_id", F.col(at).alias("at"), F.lit(kind).alias("event"),
                         *[more.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("opening_id", "bigint"), ("status", "string"))])

    refused = missing.select("operation_id", "workspace_id", "ts", "opening_id").distinct()
    everything = events(openings, "open", "ts", opening_id=F.col("opening_id")).unionByName(
        events(refused, "refused", "ts", opening_id=F.col("opening_id"))).unionByName(
        events(log.filter(F.col("source") == "call"), "call", "created_at", status=F.col("status")))
    last = lambda event: F.max(F.when(F.col("event") == event, F.struct("at", "opening_id")))
    return everything.filter("operation_id IS NOT NULL").groupBy("operation_id", "workspace_id").agg(
        F.count_if(F.col("event") == "open").alias("n_openings"), F.count_if(F.col("event") == "refused").alias("n_refused"),
        F.count_if(attempted()).alias("n_attempted"), F.count_if(F.col("status") == "blocked").alias("n_blocked"),
        F.when(last("open").eqNullSafe(last("refused")) & last("open").isNotNull(), "waiting").when(last("open").isNotNull(), "open")
        .otherwise("unknown").alias("state"),
    )


# ------------------------------------------------------------------ retention and migration


def purge_grants(grants: DataFrame) -> DataFrame:
    """Session grants end with the session."""
    return grants.filter(F.col("scope") != "session")


def purge_challenges(challenges: DataFrame, as_of: dt.datetime) -> DataFrame:
    return challenges.filter(~F.col("used") & (F.col("expires_at") > F.lit(as_of)))


def purge_operations(operations: DataFrame, as_of: dt.datetime) -> DataFrame:
    return operations.filter(F.col("completed_at").isNotNull() | (F.col("expires_at") > F.lit(as_of)))


def backfill_status(log: DataFrame) -> DataFrame:
    """Status of rows that only have the old consent flag."""
    unset = F.coalesce("status", F.lit("")) == ""
    return log.withColumn(
        "status",
        F.when(unset, F.when(F.col("consented"), "attempt_succeeded").otherwise("blocked")).otherwise(F.col("status")),
    )


def rename_labels(df: DataFrame, column: str) -> DataFrame:
    """Old label values: human_translated and human say more than was proven."""
    renamed = {"confidence": ("human_translated", "aligned_from_parallel"), "reference_tier": ("human", "ai")}
    old, new = renamed[column]
    return df.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def evolve(df: DataFrame, added: Mapping[str, tuple[str, object]], renamed: Mapping[str, str]) -> DataFrame:
    """Rename columns and add the missing ones with a default; safe to run again."""
    todo = {old: new for old, new in renamed.items() if old in df.columns and new not in df.columns}
    out = df.withColumnsRenamed(todo)
    return out.withColumns({
        name: F.lit(default).cast(kind) for name, (kind, default) in added.items() if name not in out.columns
    })


# ------------------------------------------------------------------ errors


def classify_error(text: Column) -> Column:
    """struct(kind, wait_seconds) of a provider's error text; the first match counts."""
    low = F.lower(text)

    def has(*parts: str, where: Column = low) -> Column:
        found = F.lit(False)
        for part in parts:
            found = found | F.contains(where, F.lit(part))
        return found

    quota = has("resource_exhausted", "quota") | has("429", where=text)
    daily = has("perday", where=F.replace(low, F.lit("_"), F.lit("")))
    delay = F.nullif(F.regexp_extract(text, RETRY_DELAY, 1), F.lit("")).try_cast("int")
    kind = (
        F.when(quota & daily, "daily_quota").when(quota, "rate_limited")
        .when(has("not_found") | has("404", where=text), "model_unavailable")
        .when(has("timeout", "deadline"), "timeout")
        .when(has("safety", "blocked", "prohibited"), "safety")
        .when(has("api key", "unauthenticated", "permission"), "auth")
        .otherwise("other")
    )
    wait = F.when(
        quota & ~daily, F.least(F.coalesce(delay, F.lit(RATE_LIMIT_WAIT)), F.lit(RATE_LIMIT_MAX_WAIT))
    )
    return F.struct(kind.alias("kind"), wait.alias("wait_seconds"))


# ------------------------------------------------------------------ storage and cache


def storage_report(recordings: DataFrame) -> DataFrame:
    """Files, bytes and missing files per workspace, per session and in total.

    recordings: workspace_id, session_id, length (NULL when the file is gone).
    The rows are summed once per session; the three groupings reuse those sums.
    """
    small = recordings.groupBy("workspace_id", "session_id").agg(
        F.count("length").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("length").isNull()).alias("n_missing"),
    )
    columns = [F.col("workspace_id"), F.col("session_id")]
    return small.groupingSets([[columns[0]], [columns[1]], []], *columns).agg(
        F.grouping_id().alias("__gid"), F.sum("n_files").alias("n_files"), F.sum("total_bytes").alias("total_bytes"),
        F.sum("n_missing").alias("n_missing"),
    ).withColumn(
        "level", F.when(F.col("__gid") == 1, "workspace").when(F.col("__gid") == 2, "session").otherwise("total")
    ).drop("__gid")


def in_scope(scope: str, target_id: int) -> Column:
    column = {"attempt": "attempt_id", "session": "session_id", "workspace": "workspace_id"}[scope]
    return (F.col(column) == target_id) & F.col("recording_path").isNotNull()


def clear_recordings(attempts: DataFrame, targets: DataFrame) -> DataFrame:
    """Attempts with the recordings of the chosen targets cleared; everything else stays.

    targets: scope (attempt, session or workspace) and target_id. Adds was_cleared.
    """
    out = attempts
    for scope in ("attempt", "session", "workspace"):
        chosen = targets.filter(F.col("scope") == scope).select(
            F.col("target_id").alias(f"{scope}_id"), F.lit(True).alias(f"__{scope}")
        ).distinct()
        out = out.join(chosen, f"{scope}_id", "left")
    hit = F.coalesce("__attempt", "__session", "__workspace", F.lit(False)) & F.col("recording_path").isNotNull()
    return out.withColumn("was_cleared", hit).withColumn(
        "recording_path", F.when(~F.col("was_cleared"), F.col("recording_path"))
    ).select(*attempts.columns, "was_cleared")


def clear_preview(cleared: DataFrame, files: DataFrame) -> DataFrame:
    """Files and bytes a clear would free per workspace. files: recording_path, length."""
    chosen = cleared.filter("was_cleared").select("attempt_id", "workspace_id")
    return chosen.join(files, "attempt_id", "left").groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes")
    )


def cache_key(voice: Column, speed: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", voice, speed, text), 256), 1, CACHE_KEY_CHARS)


def cache_report(requests: DataFrame) -> DataFrame:
    """Per workspace: requests, distinct keys, and hits (repeats within the workspace).

    requests: workspace_id, voice, speed, text.
    """
    keyed = requests.select("workspace_id", cache_key(F.col("voice"), F.col("speed"), F.col("text")).alias("key"))
    per_key = keyed.groupBy("workspace_id", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("workspace_id").agg(
        F.sum("n").alias("n_requests"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("n") - 1).alias("n_hits")
    )
