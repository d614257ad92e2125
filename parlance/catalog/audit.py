"""Audit operators on the driver tables."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import audit as au
from ..session import cut_lineage
from .registry import query

AS_OF = dt.datetime(2024, 1, 15, 12, 0, 0)
STAMP = "TIMESTAMP '2024-01-15 12:00:00'"

CONSENT = """
    ok AS (SELECT r.id, EXISTS (SELECT 1 FROM fx_grants g WHERE g.workspace_id = r.workspace_id AND g.destination = r.destination AND g.provider = r.provider
                                AND g.granted_at <= r.ts AND r.ts < g.expires_at AND (g.operation_id IS NULL OR g.operation_id = r.operation_id)) AS has_consent FROM fx_calls r)"""
ALLOWED = """
    allowed AS (SELECT operation_id, destination, provider, max(unit_calls * (retries_each + 1)) AS allowed_calls FROM fx_declares GROUP BY 1, 2, 3)"""
DECISIONS = f"""
    {CONSENT}, {ALLOWED},
    flags AS (SELECT c.*, ok.has_consent, c.operation_id IS NULL AS orphan, n_chars > 60000 AS too_large, is_confidential AND NOT has_consent AS refused
              FROM fx_calls c JOIN ok ON ok.id = c.id),
    elig AS (SELECT *, NOT orphan AND NOT too_large AND NOT refused AS eligible FROM flags),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY operation_id, destination, provider, eligible ORDER BY ts, id) AS k FROM elig),
    budgeted AS (SELECT n.*, coalesce(eligible AND k <= allowed_calls, false) AS within_budget FROM numbered n LEFT JOIN allowed a
                 ON a.operation_id = n.operation_id AND a.destination = n.destination AND a.provider = n.provider),
    decided AS (SELECT *, CASE WHEN orphan THEN 'NoActiveOperation' WHEN too_large THEN 'PayloadTooLarge' WHEN refused THEN 'ConsentRequired'
                          WHEN NOT within_budget THEN 'OperationBudgetExceeded' ELSE provider_error END AS error_class,
                       CASE WHEN orphan OR too_large OR refused OR NOT within_budget THEN 'blocked' WHEN provider_error IS NOT NULL THEN 'attempt_failed'
                            ELSE 'attempt_succeeded' END AS status FROM budgeted)"""


def allowed(t):
    return au.allowed_calls(t["fx_declares"])


def decisions(t):
    return au.decide(t["fx_calls"], t["fx_grants"], allowed(t))


def declared(t):
    """Openings declare their own provider and a second one; answers to their challenges and standing grants are in force."""
    pair = F.struct("destination", "provider")
    second = F.struct(F.lit("search").alias("destination"), F.lit("p_search").alias("provider"))
    openings = cut_lineage(au.opened(t["fx_openings"], t["fx_operations"]).withColumn("declares", F.array(pair, second)))
    answers = t.sql("""SELECT event_id * 2 AS challenge_id, CASE WHEN event_id % 3 = 0 THEN 'session' WHEN event_id % 3 = 1 THEN 'operation' ELSE 'nonsense' END AS scope,
                       CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 11 MINUTE ELSE ts + INTERVAL 2 MINUTE END AS answered_at FROM {events}""")
    confidential = openings.filter("is_confidential AND workspace_id IS NOT NULL")
    asked = confidential.select(
        F.col("opening_id").alias("challenge_id"), "operation_id", (F.col("ts") + F.expr(au.PENDING_TTL)).alias("expires_at"), F.lit(False).alias("used"))
    given = au.grants_from_challenges(answers, asked, confidential.select("operation_id", "workspace_id", "declares").dropDuplicates(["operation_id"]))
    columns = ["workspace_id", "destination", "provider", "operation_id", "granted_at", "expires_at"]
    return openings, given.select(*columns).unionByName(t["fx_grants"].select(*columns))


OPENED = """
    res AS (SELECT o.*, EXISTS (SELECT 1 FROM fx_operations p WHERE p.operation_id = o.resume_id AND p.kind = o.kind AND p.fingerprint = o.fingerprint
                   AND p.workspace_id IS NOT DISTINCT FROM o.workspace_id AND p.expires_at > o.ts AND p.completed_at IS NULL) AS resumed FROM fx_openings o),
    opn AS (SELECT *, CAST(CASE WHEN resumed THEN resume_id ELSE opening_id END AS VARCHAR) AS op FROM res),
    prs AS (SELECT opening_id, ts, workspace_id, op, kind, is_confidential, destination, provider, 0 AS position FROM opn
            UNION ALL SELECT opening_id, ts, workspace_id, op, kind, is_confidential, 'search', 'p_search', 1 FROM opn),
    ans AS (SELECT event_id * 2 AS challenge_id, CASE WHEN event_id % 3 = 0 THEN 'session' ELSE 'operation' END AS scope,
                   ts + CASE WHEN event_id % 5 = 0 THEN INTERVAL 11 MINUTE ELSE INTERVAL 2 MINUTE END AS at FROM events WHERE event_id % 3 <> 2),
    giv AS (SELECT p.workspace_id, p.destination, p.provider, CASE WHEN scope = 'operation' THEN p.op END AS operation_id, a.at AS granted_at,
                   a.at + CASE WHEN scope = 'session' THEN INTERVAL 8 HOUR ELSE INTERVAL 15 MINUTE END AS expires_at
            FROM ans a JOIN prs p ON p.opening_id = a.challenge_id AND p.is_confidential AND p.workspace_id IS NOT NULL AND a.at < p.ts + INTERVAL 10 MINUTE
            UNION ALL SELECT workspace_id, destination, provider, operation_id, granted_at, expires_at FROM fx_grants),
    mis AS (SELECT * FROM prs p WHERE is_confidential AND workspace_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM giv g WHERE g.workspace_id = p.workspace_id
            AND g.destination = p.destination AND g.provider = p.provider AND g.granted_at <= p.ts AND p.ts < g.expires_at AND (g.operation_id IS NULL OR g.operation_id = p.op)))"""
LOGGED = """
    lg AS (SELECT 'call' AS source, id AS source_id, workspace_id, operation_id, module, destination, provider, endpoint, summary, ts AS created_at, status, error_class, n_chars FROM decided
           UNION ALL SELECT 'opening', opening_id, workspace_id, op, kind, destination, provider, provider || ':(chưa gọi)', 'Bị chặn: hồ sơ mật chưa cho phép ' || kind, ts, 'blocked', NULL, 0 FROM mis)"""


@query("a1_log_rows", f"""
    WITH {DECISIONS}, {OPENED}, {LOGGED} SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at) FROM lg""")
def log_rows(t):
    """Rows of all calls, and of all pairs that openings missed."""
    openings, given = declared(t)
    rows = au.append_rows(decisions(t), au.missing_at_opening(openings, given))
    return rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("a1_challenges", f"""
    WITH {OPENED} SELECT opening_id AS challenge_id, op AS operation_id, workspace_id, count(*) AS n_missing, strftime(ts + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS expires_at
    FROM mis GROUP BY opening_id, op, workspace_id, ts""")
def opened_challenges(t):
    openings, given = declared(t)
    made = au.challenges(au.missing_at_opening(openings, given))
    return made.withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss")).drop("used")


@query("a1_operation_states", f"""
    WITH {DECISIONS}, {OPENED},
    ev AS (SELECT op AS operation_id, workspace_id, 'open' AS e, ts, opening_id, NULL AS status FROM opn
           UNION ALL SELECT DISTINCT op, workspace_id, 'refused', ts, opening_id, NULL FROM mis
           UNION ALL SELECT operation_id, workspace_id, 'call', ts, NULL, status FROM decided WHERE operation_id IS NOT NULL),
    f AS (SELECT operation_id, workspace_id, count(*) FILTER (e = 'open') AS n_openings, count(*) FILTER (e = 'refused') AS n_refused,
                 count(*) FILTER (status LIKE 'attempt%') AS n_attempted, count(*) FILTER (status = 'blocked') AS n_blocked,
                 max(strftime(ts, '%Y%m%d%H%M%S%f') || '-' || CAST(opening_id AS VARCHAR)) FILTER (e = 'open') AS last_open,
                 max(strftime(ts, '%Y%m%d%H%M%S%f') || '-' || CAST(opening_id AS VARCHAR)) FILTER (e = 'refused') AS last_refused FROM ev GROUP BY 1, 2)
    SELECT operation_id, workspace_id, n_openings, n_refused, n_attempted, n_blocked,
           CASE WHEN last_open = last_refused THEN 'waiting' WHEN n_openings > 0 THEN 'open' ELSE 'unknown' END AS state FROM f""")
def operation_states(t):
    """Openings, refusals and calls folded per operation; what only a log row shows is not carried through the scans."""
    openings, given = declared(t)
    missing = cut_lineage(au.missing_at_opening(openings, given))
    calls = t["fx_calls"].drop("module", "endpoint", "summary")
    return au.operation_states(openings, missing, au.append_rows(au.decide(calls, t["fx_grants"], allowed(t)), missing))


@query("a2_recent_log", "SELECT id, workspace_id, provider, status, n_chars FROM fx_audit ORDER BY id DESC LIMIT 300")
def recent_log(t):
    return au.recent(t["fx_audit"]).select("id", "workspace_id", "provider", "status", "n_chars")


@query("a3_summary", """
    SELECT workspace_id, count(*) FILTER (status LIKE 'attempt%') AS n_attempted, count(*) FILTER (status = 'attempt_succeeded') AS n_provider_ok,
           count(*) FILTER (status = 'blocked') AS n_blocked, count(*) FILTER (status LIKE 'attempt%' AND n_chars > 40000) AS n_oversized FROM fx_audit GROUP BY 1""")
def summary(t):
    return au.summary(t["fx_audit"])


@query("a4_by_provider", """
    WITH p AS (SELECT * FROM (VALUES ('p_llm', 'Model'), ('p_search', 'Search'), ('p_tts1', 'Voice'), ('p_tts2', 'Voice'), ('p_none', 'Unused')) x(provider, label)),
    w AS (SELECT DISTINCT workspace_id FROM fx_audit)
    SELECT w.workspace_id, p.label, count(a.id) AS n_attempted FROM w CROSS JOIN p LEFT JOIN fx_audit a
    ON a.workspace_id = w.workspace_id AND a.provider = p.provider AND a.status LIKE 'attempt%' GROUP BY 1, 2""")
def by_provider(t):
    labels = {"p_llm": "Model", "p_search": "Search", "p_tts1": "Voice", "p_tts2": "Voice", "p_none": "Unused"}
    return au.by_provider(t["fx_audit"], labels)


@query("a5_by_destination", """
    SELECT destination, count(*) AS n_rows, count(*) FILTER (status LIKE 'attempt%') AS n_attempted, count(*) FILTER (status = 'attempt_failed') AS n_failed,
           max(n_chars) AS max_chars FROM fx_audit GROUP BY 1""")
def by_destination(t):
    return au.by_destination(t["fx_audit"])


@query("a6_consent", f"WITH {CONSENT} SELECT * FROM ok")
def consent(t):
    return au.with_consent(t["fx_calls"], t["fx_grants"]).select("id", "has_consent")


def operations(t):
    """Operations declare their own provider and a second one."""
    own = F.struct("destination", "provider")
    other = F.struct(F.lit("search").alias("destination"), F.lit("p_search").alias("provider"))
    return t["fx_audit"].filter("operation_id is not null").groupBy("operation_id", "workspace_id", "destination", "provider").agg(
        F.min("created_at").alias("created_at")).select(
        "operation_id", "workspace_id", F.array(own, other).alias("declares"), "created_at", "provider")


def provider_grants(t):
    return t.sql("""SELECT g.workspace_id, g.destination, g.provider, g.operation_id, g.granted_at, g.granted_at + INTERVAL '72' HOUR AS expires_at FROM {fx_grants} g""")


OPERATIONS = """
    ops AS (SELECT operation_id, workspace_id, destination, provider, min(created_at) AS created_at FROM fx_audit GROUP BY 1, 2, 3, 4),
    pairs AS (SELECT operation_id, workspace_id, destination, provider FROM ops UNION ALL SELECT operation_id, workspace_id, 'search', 'p_search' FROM ops)"""


@query("a7_missing_permissions", f"""
    WITH {OPERATIONS}, g AS (SELECT workspace_id, destination, provider, operation_id FROM fx_grants WHERE granted_at <= {STAMP} AND granted_at + INTERVAL '72' HOUR > {STAMP})
    SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.workspace_id = p.workspace_id AND g.destination = p.destination AND g.provider = p.provider
        AND (g.operation_id IS NULL OR g.operation_id = p.operation_id))""")
def missing_permissions(t):
    return au.missing_permissions(operations(t), provider_grants(t), AS_OF)


@query("a9_call_budget", f"""
    WITH {ALLOWED}, n AS (SELECT *, row_number() OVER (PARTITION BY operation_id, destination, provider ORDER BY ts, id) AS call_no FROM fx_calls)
    SELECT n.id, CASE WHEN n.operation_id IS NOT NULL THEN call_no END AS call_no, allowed_calls, coalesce(call_no <= allowed_calls, false) AS within_budget FROM n LEFT JOIN allowed a
    ON a.operation_id = n.operation_id AND a.destination = n.destination AND a.provider = n.provider""")
def call_budget(t):
    return au.with_budget(t["fx_calls"], allowed(t)).select("id", "call_no", "allowed_calls", "within_budget")


@query("a10_decisions", f"WITH {DECISIONS} SELECT id, has_consent, within_budget, status, error_class FROM decided")
def decision_rows(t):
    return decisions(t).select("id", "has_consent", "within_budget", "status", "error_class")


@query("a8_payload_cap", """
    SELECT destination, count(*) FILTER (n_chars > 60000) AS n_too_large, count(*) FILTER (n_chars <= 60000) AS n_within FROM fx_calls GROUP BY 1""")
def payload_cap(t):
    too_large = F.col("n_chars") > au.MAX_PAYLOAD_CHARS
    return t["fx_calls"].groupBy("destination").agg(F.count_if(too_large).alias("n_too_large"), F.count_if(~too_large).alias("n_within"))


@query("a11_fingerprint", """
    SELECT event_id, sha256(upper(event_type) || chr(10) || '/run/' || CAST(user_id AS VARCHAR) || chr(10) || props || chr(10) || '{}') AS fingerprint FROM events""")
def fingerprint(t):
    route = F.concat(F.lit("/run/"), F.col("user_id").cast("string"))
    return t["events"].select("event_id", au.fingerprint(F.col("event_type"), route, F.col("props"), F.lit("{}")).alias("fingerprint"))


@query("a12_resume", """
    WITH o AS (SELECT event_id AS operation_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS workspace_id, event_type AS kind, props AS fingerprint,
                      ts + INTERVAL 15 MINUTE AS expires_at, CASE WHEN event_id % 6 = 0 THEN ts END AS completed_at FROM events),
    r AS (SELECT event_id AS request_id, event_id AS resume_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS workspace_id,
                 CASE WHEN event_id % 7 = 0 THEN 'other' ELSE event_type END AS kind, props AS fingerprint,
                 ts + CASE WHEN event_id % 4 = 0 THEN INTERVAL 20 MINUTE ELSE INTERVAL 5 MINUTE END AS ts FROM events)
    SELECT r.request_id, EXISTS (SELECT 1 FROM o WHERE o.operation_id = r.resume_id AND o.kind = r.kind AND o.fingerprint = r.fingerprint
           AND o.workspace_id IS NOT DISTINCT FROM r.workspace_id AND o.expires_at > r.ts AND o.completed_at IS NULL) AS resumed FROM r""")
def resume(t):
    known = t.sql("""SELECT event_id AS operation_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS workspace_id, event_type AS kind, props AS fingerprint,
                     ts + INTERVAL 15 MINUTE AS expires_at, CASE WHEN event_id % 6 = 0 THEN ts END AS completed_at FROM {events}""")
    asked = t.sql("""SELECT event_id AS request_id, event_id AS resume_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS workspace_id,
                     CASE WHEN event_id % 7 = 0 THEN 'other' ELSE event_type END AS kind, props AS fingerprint,
                     CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 20 MINUTE ELSE ts + INTERVAL 5 MINUTE END AS ts FROM {events}""")
    return au.resumable(asked, known).select("request_id", "resumed")


CHALLENGES = """
    ch AS (SELECT event_id AS challenge_id, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS operation_id, ts + INTERVAL 10 MINUTE AS expires_at,
                  event_id % 13 = 0 AS used FROM events),
    an AS (SELECT event_id AS challenge_id, CASE WHEN event_id % 3 = 0 THEN 'session' WHEN event_id % 3 = 1 THEN 'operation' ELSE 'nonsense' END AS scope,
                  ts + CASE WHEN event_id % 4 = 0 THEN INTERVAL 11 MINUTE ELSE INTERVAL 2 MINUTE END AS answered_at FROM events)"""


def challenges(t):
    return t.sql("""SELECT event_id AS challenge_id, CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS operation_id,
                    ts + INTERVAL 10 MINUTE AS expires_at, event_id % 13 = 0 AS used FROM {events}""")


@query("a13_grants", f"""
    WITH {OPERATIONS}, {CHALLENGES}
    SELECT ch.challenge_id, p.workspace_id, CASE WHEN scope = 'operation' THEN ch.operation_id END AS operation_id, scope, p.destination, p.provider,
           CAST(epoch_ms(answered_at + CASE WHEN scope = 'session' THEN INTERVAL 8 HOUR ELSE INTERVAL 15 MINUTE END) - epoch_ms(answered_at) AS BIGINT) AS ttl_ms
    FROM an JOIN ch USING (challenge_id) JOIN pairs p ON p.operation_id = ch.operation_id
    WHERE NOT used AND answered_at < expires_at AND scope IN ('session', 'operation')""")
def grants(t):
    answers = t.sql("""SELECT event_id AS challenge_id, CASE WHEN event_id % 3 = 0 THEN 'session' WHEN event_id % 3 = 1 THEN 'operation' ELSE 'nonsense' END AS scope,
                       CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 11 MINUTE ELSE ts + INTERVAL 2 MINUTE END AS answered_at FROM {events}""")
    made = au.grants_from_challenges(answers, challenges(t), operations(t))
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return made.withColumn("ttl_ms", millis("expires_at") - millis("granted_at")).drop("granted_at", "expires_at")


@query("a14_active_grants", f"""
    SELECT id, workspace_id FROM fx_grants WHERE granted_at <= {STAMP} AND expires_at > {STAMP}
    AND workspace_id NOT IN (SELECT n_nationkey FROM nation)""")
def active_grants(t):
    revoked = t["nation"].select(F.col("n_nationkey").cast("bigint").alias("workspace_id"))
    return au.active_grants(t["fx_grants"], AS_OF, revoked).select("id", "workspace_id")


@query("a15_retention", f"""
    WITH {CHALLENGES}, o AS (SELECT event_id, ts + INTERVAL 15 MINUTE AS expires_at, CASE WHEN event_id % 6 = 0 THEN ts END AS completed_at FROM events)
    SELECT 'grants' AS kind, count(*) AS n_left FROM fx_grants WHERE operation_id IS NOT NULL
    UNION ALL SELECT 'challenges', count(*) FROM ch WHERE NOT used AND expires_at > {STAMP}
    UNION ALL SELECT 'operations', count(*) FROM o WHERE completed_at IS NOT NULL OR expires_at > {STAMP}""")
def retention(t):
    scoped = t["fx_grants"].withColumn("scope", F.when(F.col("operation_id").isNull(), "session").otherwise("operation"))
    known = t.sql("SELECT event_id, ts + INTERVAL 15 MINUTE AS expires_at, CASE WHEN event_id % 6 = 0 THEN ts END AS completed_at FROM {events}")
    left = {"grants": au.purge_grants(scoped), "challenges": au.purge_challenges(challenges(t), AS_OF), "operations": au.purge_operations(known, AS_OF)}
    parts = [df.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(k).alias("kind"), "n_left") for k, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a16_backfill", """
    SELECT event_id, CASE WHEN event_type = 'view' THEN 'attempt_failed' WHEN user_id % 2 = 0 THEN 'attempt_succeeded' ELSE 'blocked' END AS status,
           CASE WHEN event_type = 'error' THEN 'aligned_from_parallel' ELSE event_type END AS confidence,
           CASE WHEN event_type = 'click' THEN 'ai' ELSE event_type END AS reference_tier FROM events""")
def backfill(t):
    old = t["events"].select(
        "event_id", (F.col("user_id") % 2 == 0).alias("consented"),
        F.when(F.col("event_type") == "view", "attempt_failed").when(F.col("event_type") == "click", "").alias("status"),
        F.when(F.col("event_type") == "error", "human_translated").otherwise(F.col("event_type")).alias("confidence"),
        F.when(F.col("event_type") == "click", "human").otherwise(F.col("event_type")).alias("reference_tier"))
    return au.rename_labels(au.rename_labels(au.backfill_status(old), "confidence"), "reference_tier").drop("consented")


ERROR_TEXT = """CASE event_id % 9 WHEN 0 THEN 'RESOURCE_EXHAUSTED: Requests_Per_Day' WHEN 1 THEN '429 retryDelay: "' || CAST(user_id AS {0}) || 's"'
    WHEN 2 THEN 'Quota reached' WHEN 3 THEN '404 model' WHEN 4 THEN 'Deadline passed' WHEN 5 THEN 'PROHIBITED_CONTENT' WHEN 6 THEN 'Permission denied'
    WHEN 7 THEN 'model NOT_FOUND after timeout' ELSE 'odd ' || event_type END"""


@query("a17_error_classes", f"""
    WITH e AS (SELECT event_id, user_id, {ERROR_TEXT.format('VARCHAR')} AS text FROM events)
    SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'daily_quota' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'model_unavailable' WHEN 4 THEN 'timeout'
           WHEN 5 THEN 'safety' WHEN 6 THEN 'auth' WHEN 7 THEN 'model_unavailable' ELSE 'other' END AS kind,
           CASE event_id % 9 WHEN 1 THEN least(60, user_id) WHEN 2 THEN 20 END AS wait_seconds FROM e""")
def error_classes(t):
    texts = t.sql(f"SELECT event_id, {ERROR_TEXT.format('STRING')} AS text FROM {{events}}")
    return texts.select("event_id", au.classify_error(F.col("text")).alias("c")).select("event_id", "c.kind", "c.wait_seconds")


@query("a18_storage", """
    SELECT workspace_id, session_id, count(length) AS n_files, CAST(coalesce(sum(length), 0) AS BIGINT) AS total_bytes, count(*) - count(length) AS n_missing,
           CASE WHEN GROUPING(workspace_id) = 0 THEN 'workspace' WHEN GROUPING(session_id) = 0 THEN 'session' ELSE 'total' END AS level
    FROM fx_recordings GROUP BY GROUPING SETS ((workspace_id), (session_id), ())""")
def storage(t):
    return au.storage_report(t["fx_recordings"])


def cleared(t):
    attempts = t["fx_recordings"].withColumn("recording_path", F.when(F.col("length").isNotNull(), F.concat(F.lit("r/"), F.col("attempt_id").cast("string"))))
    targets = t.sql("""SELECT 'session' AS scope, CAST(n_nationkey AS BIGINT) AS target_id FROM {nation} WHERE n_regionkey = 1
                       UNION ALL SELECT 'attempt', CAST(s_suppkey AS BIGINT) FROM {supplier}
                       UNION ALL SELECT 'workspace', CAST(r_regionkey AS BIGINT) FROM {region} WHERE r_name = (SELECT max(r_name) FROM {region})""")
    return au.clear_recordings(attempts, targets)


CLEARED = """
    x AS (SELECT *, length IS NOT NULL AND (session_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR attempt_id IN (SELECT s_suppkey FROM supplier)
          OR workspace_id IN (SELECT r_regionkey FROM region WHERE r_name = (SELECT max(r_name) FROM region))) AS was_cleared FROM fx_recordings)"""


@query("a19_cleared_recordings", f"WITH {CLEARED} SELECT attempt_id, CASE WHEN NOT was_cleared AND length IS NOT NULL THEN 'r/' || CAST(attempt_id AS VARCHAR) END AS recording_path, was_cleared FROM x")
def cleared_recordings(t):
    return cleared(t).select("attempt_id", "recording_path", "was_cleared")


@query("a19_clear_preview", f"WITH {CLEARED} SELECT workspace_id, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS total_bytes FROM x WHERE was_cleared GROUP BY 1")
def clear_preview(t):
    return au.clear_preview(cleared(t), t["fx_recordings"].select("attempt_id", "length"))


@query("a20_cache", """
    WITH k AS (SELECT workspace_id, substr(sha256(lang || '|' || CAST(n_chars % 3 AS VARCHAR) || '|' || text), 1, 32) AS key FROM fx_documents),
    n AS (SELECT workspace_id, key, count(*) AS n FROM k GROUP BY 1, 2)
    SELECT workspace_id, CAST(sum(n) AS BIGINT) AS n_requests, count(*) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS n_hits FROM n GROUP BY 1""")
def cache(t):
    requests = t["fx_documents"].select("workspace_id", F.col("lang").alias("voice"), (F.col("n_chars") % 3).cast("string").alias("speed"), "text")
    return au.cache_report(requests)


@query("a21_evolved_log", """
    SELECT event_id AS id, user_id AS workspace_id, value AS amount, '' AS provider, CAST(NULL AS VARCHAR) AS error_class FROM events""")
def evolved_log(t):
    old = t["events"].select("event_id", F.col("user_id").alias("workspace_id"), "value")
    return au.evolve(old, {"provider": ("string", ""), "error_class": ("string", None), "workspace_id": ("bigint", 0)},
                     {"event_id": "id", "value": "amount", "absent": "other"})
