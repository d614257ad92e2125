"""What a workspace shows on its first screen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as nm
from ..functions import ordered
from . import counts
from .feedback import CRITERIA

# ---- fixed values ----
PENDING_DOCUMENTS = 10
PENDING_SESSIONS = 5
UPCOMING_EVENTS = 5
OPEN_STATES = ("generated", "in_progress")
# ---- end of fixed values ----


def pending_work(
    documents: DataFrame, sessions: DataFrame, scored: DataFrame, conflicts: DataFrame, glossary: DataFrame
) -> DataFrame:
    """Unfinished documents, open sessions and open conflicts in one schema.

    documents: id, workspace_id, status. sessions: id, workspace_id, status,
    created_at. scored: session_id, one row per score. conflicts: glossary_id,
    resolved. Scores are counted only for the sessions that are shown.
    """
    docs = ordered.first_per_key(
        documents.filter(F.col("status") != "ready").select("workspace_id", "id", "status"),
        ["workspace_id"], [F.col("id").desc()], PENDING_DOCUMENTS,
    ).select("workspace_id", F.lit("document").alias("kind"), "id", "rank", F.col("status").alias("detail"),
             F.lit(None).cast("bigint").alias("n"))
    shown = ordered.first_per_key(
        sessions.filter(F.col("status").isin(*OPEN_STATES)).select("workspace_id", "id", "status", "created_at"),
        ["workspace_id"], [F.col("created_at").desc(), F.col("id").desc()], PENDING_SESSIONS,
    )
    tally = scored.select(F.col("session_id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    open_sessions = shown.join(tally, "id", "left").select(
        "workspace_id", F.lit("session").alias("kind"), "id", "rank", F.col("status").alias("detail"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    open_conflicts = (
        conflicts.filter(~F.col("resolved")).groupBy(F.col("glossary_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        .join(glossary.select("id", "workspace_id"), "id")
        .groupBy("workspace_id").agg(F.sum("n").alias("n"))
        .select("workspace_id", F.lit("conflict").alias("kind"), F.lit(None).cast("bigint").alias("id"),
                F.lit(1).alias("rank"), F.lit("open").alias("detail"), "n")
    )
    return docs.unionByName(open_sessions).unionByName(open_conflicts)


def upcoming(events: DataFrame, as_of: dt.date, limit: int = UPCOMING_EVENTS) -> DataFrame:
    """Nearest events on or after a date. events: id, workspace_id, event_date (text or date)."""
    day = F.col("event_date").try_cast("date")
    return ordered.first_per_key(
        events.withColumn("event_day", day).filter(F.col("event_day") >= F.lit(as_of)),
        ["workspace_id"], [F.col("event_day"), F.col("id")], limit,
    )


def progress(sessions: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean scores and count per scored session.

    sessions: id, workspace_id, difficulty, created_at. scores: session_id,
    a_<criterion>, a_overall. Scores are reduced to a row per session first.
    """
    means = scores.filter(F.col("a_overall").isNotNull()).groupBy(F.col("session_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_scored"),
        *[nm.mean_of(F.col(f"a_{c}"), 1).alias(c) for c in ("overall", *CRITERIA)],
    )
    return sessions.select("id", "workspace_id", "difficulty", "created_at").join(means, "id")


def progress_trend(progress_rows: DataFrame) -> DataFrame:
    """Last session against the first, by the rounded means."""
    place = F.struct("created_at", "id")
    ends = progress_rows.groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.min_by("overall", place).alias("first_overall"), F.max_by("overall", place).alias("last_overall"),
    )
    change = nm.sign_of_change(
        F.col("first_overall").cast("decimal(4,1)"), F.col("last_overall").cast("decimal(4,1)"),
        nm.TREND_BAND, inclusive=True,
    )
    return ends.withColumn("trend", F.when(F.col("n_sessions") >= 2, change))


def kpis(
    workspaces: DataFrame, documents: DataFrame, glossary: DataFrame, sessions: DataFrame, verdicts: DataFrame,
    profiles: DataFrame,
) -> DataFrame:
    """Six counts per workspace."""
    return counts.per_workspace([
        (documents, {"n_documents": F.col("status") == "ready"}),
        (glossary, {"n_terms": F.col("status") != "skipped", "n_terms_expert": F.col("status") == "expert_edited"}),
        (sessions, {"n_sessions": counts.every_row()}),
        (verdicts, {"n_verdicts": counts.every_row()}),
        (profiles, {"n_profiles": counts.every_row()}),
    ], workspaces)


def next_step(kpi_rows: DataFrame) -> DataFrame:
    """The first thing a workspace still lacks; NULL when nothing is missing."""
    missing = {c: F.col(f"n_{c}") == 0 for c in ("documents", "profiles", "sessions", "verdicts")}
    return kpi_rows.withColumn(
        "next_step",
        F.when(missing["documents"] & missing["profiles"], "start")
        .when(missing["profiles"], "research").when(missing["sessions"], "first_session")
        .when(missing["verdicts"], "first_verdict"),
    )


def workspace_list(workspaces: DataFrame, documents: DataFrame, glossary: DataFrame, sessions: DataFrame) -> DataFrame:
    """Workspaces with counts, latest change first. workspaces: workspace_id, name, updated_at."""
    table = counts.per_workspace([
        (documents, {"n_documents": counts.every_row()}),
        (glossary, {"n_terms": F.col("status") != "skipped"}),
        (sessions, {"n_sessions": counts.every_row()}),
    ])
    numbers = ("n_documents", "n_terms", "n_sessions")
    return (
        workspaces.join(table, "workspace_id", "left")
        .withColumns({n: F.coalesce(n, F.lit(0)) for n in numbers})
        .orderBy(F.col("updated_at").desc(), "workspace_id")
    )


def delete_preview(
    workspaces: DataFrame, documents: DataFrame, glossary: DataFrame, sessions: DataFrame, answers: DataFrame,
    runs: DataFrame,
) -> DataFrame:
    """What deleting a workspace would remove: five counts and the bytes of its documents."""
    return counts.per_workspace([
        (documents, {"n_documents": counts.every_row(), "bytes_documents": F.col("size_bytes")}),
        (glossary, {"n_terms": counts.every_row()}),
        (sessions, {"n_sessions": counts.every_row()}),
        (answers, {"n_qa": counts.every_row()}),
        (runs, {"n_research": counts.every_row()}),
    ], workspaces)
