"""Dashboard operators on the driver tables."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import dashboard as db
from ..operators import feedback as fb
from .registry import query
from .sqltext import mean, row_mean_tenths

A = [f"a_{c}" for c in fb.CRITERIA]

COUNTS = """
    d AS (SELECT workspace_id, count(*) AS n_all, count(*) FILTER (status = 'ready') AS n_ready, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM fx_doc_list GROUP BY 1),
    g AS (SELECT workspace_id, count(*) AS n_all, count(*) FILTER (status <> 'skipped') AS n_active, count(*) FILTER (status = 'expert_edited') AS n_expert FROM fx_glossary GROUP BY 1),
    s AS (SELECT workspace_id, count(*) AS n FROM fx_sessions GROUP BY 1),
    v AS (SELECT workspace_id, count(*) AS n FROM fx_verdicts GROUP BY 1),
    p AS (SELECT workspace_id, count(*) AS n FROM fx_profiles GROUP BY 1),
    q AS (SELECT workspace_id, count(*) AS n FROM fx_vectors GROUP BY 1),
    r AS (SELECT CAST(run_id AS BIGINT) AS workspace_id, count(*) AS n FROM fx_results GROUP BY 1)"""
KPIS = f"""
    {COUNTS},
    k AS (SELECT w.workspace_id, coalesce(d.n_ready, 0) AS n_documents, coalesce(g.n_active, 0) AS n_terms, coalesce(g.n_expert, 0) AS n_terms_expert,
                 coalesce(s.n, 0) AS n_sessions, coalesce(v.n, 0) AS n_verdicts, coalesce(p.n, 0) AS n_profiles
          FROM fx_workspaces w LEFT JOIN d USING (workspace_id) LEFT JOIN g USING (workspace_id) LEFT JOIN s USING (workspace_id)
          LEFT JOIN v USING (workspace_id) LEFT JOIN p USING (workspace_id))"""


@query("b1_pending_work", """
    WITH d AS (SELECT workspace_id, 'document' AS kind, id, row_number() OVER (PARTITION BY workspace_id ORDER BY id DESC) AS rank, status AS detail, NULL::BIGINT AS n
               FROM fx_doc_list WHERE status <> 'ready' QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY id DESC) <= 10),
    s AS (SELECT workspace_id, id, status, row_number() OVER w AS rank FROM fx_sessions WHERE status IN ('generated', 'in_progress')
          WINDOW w AS (PARTITION BY workspace_id ORDER BY created_at DESC, id DESC) QUALIFY row_number() OVER w <= 5),
    t AS (SELECT session_id, count(*) AS n FROM fx_scores GROUP BY 1),
    c AS (SELECT g.workspace_id, count(*) AS n FROM fx_conflicts c JOIN fx_glossary g ON g.id = c.glossary_id WHERE NOT resolved GROUP BY 1)
    SELECT * FROM d UNION ALL SELECT workspace_id, 'session', id, rank, status, coalesce(n, 0) FROM s LEFT JOIN t ON t.session_id = s.id
    UNION ALL SELECT workspace_id, 'conflict', NULL, 1, 'open', n FROM c""")
def pending_work(t):
    return db.pending_work(t["fx_doc_list"], t["fx_sessions"], t["fx_scores"], t["fx_conflicts"], t["fx_glossary"])


@query("b2_upcoming", """
    WITH e AS (SELECT o_orderkey AS id, o_custkey AS workspace_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders)
    SELECT workspace_id, id, strftime(day, '%Y-%m-%d') AS event_day, row_number() OVER w AS rank FROM e WHERE day >= DATE '2000-01-01'
    WINDOW w AS (PARTITION BY workspace_id ORDER BY day, id) QUALIFY row_number() OVER w <= 5""")
def upcoming(t):
    text = F.when(F.col("o_orderkey") % 50 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    events = t["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("workspace_id"), text.alias("event_date"))
    return db.upcoming(events, dt.date(2000, 1, 1)).select(
        "workspace_id", "id", F.date_format("event_day", "yyyy-MM-dd").alias("event_day"), "rank")


PROGRESS = f"""
    o AS (SELECT *, CAST(({row_mean_tenths(A)}) AS DECIMAL(6,1)) / 10 AS a_overall FROM fx_scores),
    m AS (SELECT session_id AS id, count(*) AS n_scored, {mean('a_overall')} AS overall, {', '.join(f'{mean(a)} AS {a[2:]}' for a in A)} FROM o GROUP BY 1),
    progress AS (SELECT s.id, s.workspace_id, s.difficulty, s.created_at, m.* EXCLUDE (id) FROM fx_sessions s JOIN m ON m.id = s.id)"""


def progress_rows(t):
    return db.progress(t["fx_sessions"], fb.machine_overall(t["fx_scores"]))


@query("b3_progress", f"WITH {PROGRESS} SELECT * EXCLUDE (created_at) FROM progress")
def progress(t):
    return progress_rows(t).drop("created_at")


@query("b4_progress_trend", f"""
    WITH {PROGRESS}, e AS (SELECT workspace_id, count(*) AS n_sessions, (min({{'d': created_at, 'i': id, 'o': overall}})).o AS first_overall,
                                  (max({{'d': created_at, 'i': id, 'o': overall}})).o AS last_overall FROM progress GROUP BY 1)
    SELECT *, CASE WHEN n_sessions < 2 THEN NULL WHEN CAST(last_overall * 10 AS INT) - CAST(first_overall * 10 AS INT) >= 3 THEN 'up'
              WHEN CAST(last_overall * 10 AS INT) - CAST(first_overall * 10 AS INT) <= -3 THEN 'down' ELSE 'flat' END AS trend FROM e""")
def progress_trend(t):
    return db.progress_trend(progress_rows(t))


def kpi_rows(t):
    rows = db.kpis(t["fx_workspaces"], t["fx_doc_list"], t["fx_glossary"], t["fx_sessions"], t["fx_verdicts"], t["fx_profiles"])
    return rows.join(t["fx_workspaces"].select("workspace_id"), "workspace_id", "left_semi")


@query("b6_kpis", f"WITH {KPIS} SELECT * FROM k")
def kpis(t):
    return kpi_rows(t)


@query("b7_workspace_list", f"""
    WITH {COUNTS}
    SELECT w.workspace_id, w.name, w.updated_at, coalesce(d.n_all, 0) AS n_documents, coalesce(g.n_active, 0) AS n_terms, coalesce(s.n, 0) AS n_sessions
    FROM fx_workspaces w LEFT JOIN d USING (workspace_id) LEFT JOIN g USING (workspace_id) LEFT JOIN s USING (workspace_id)""")
def workspace_list(t):
    return db.workspace_list(t["fx_workspaces"], t["fx_doc_list"], t["fx_glossary"], t["fx_sessions"])


@query("b8_delete_preview", f"""
    WITH {COUNTS}, w AS (SELECT workspace_id FROM fx_workspaces UNION SELECT workspace_id FROM d UNION SELECT workspace_id FROM g UNION SELECT workspace_id FROM s
                         UNION SELECT workspace_id FROM q UNION SELECT workspace_id FROM r)
    SELECT w.workspace_id, coalesce(d.n_all, 0) AS n_documents, coalesce(d.bytes, 0) AS bytes_documents, coalesce(g.n_all, 0) AS n_terms,
           coalesce(s.n, 0) AS n_sessions, coalesce(q.n, 0) AS n_qa, coalesce(r.n, 0) AS n_research
    FROM w LEFT JOIN d USING (workspace_id) LEFT JOIN g USING (workspace_id) LEFT JOIN s USING (workspace_id) LEFT JOIN q USING (workspace_id) LEFT JOIN r USING (workspace_id)""")
def delete_preview(t):
    runs = t["fx_results"].select(F.col("run_id").alias("workspace_id"))
    return db.delete_preview(t["fx_workspaces"], t["fx_doc_list"], t["fx_glossary"], t["fx_sessions"], t["fx_vectors"], runs)


@query("b9_next_step", f"""
    WITH {KPIS} SELECT workspace_id, CASE WHEN n_documents = 0 AND n_profiles = 0 THEN 'start' WHEN n_profiles = 0 THEN 'research'
           WHEN n_sessions = 0 THEN 'first_session' WHEN n_verdicts = 0 THEN 'first_verdict' END AS next_step FROM k""")
def next_step(t):
    return db.next_step(kpi_rows(t)).select("workspace_id", "next_step")
