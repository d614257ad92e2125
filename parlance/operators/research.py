"""Web results, sourced facts and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions import text as tx
from ..functions.arrays import unnest
from . import counts

# ---- fixed values ----
QUERY_BUDGET = 8
TITLE_CHARS = 250
SNIPPET_CHARS = 500
FEW_TERMS = 5
ROLE_LABELS = {"client": "Khách hàng", "partner": "Đối tác"}
# ---- end of fixed values ----


def plan_queries(plans: DataFrame, limit: int = QUERY_BUDGET) -> DataFrame:
    """First ``limit`` non-blank queries of each plan, numbered from 1.

    plans: run_id, queries (array of text).
    """
    trimmed = F.filter(F.transform("queries", tx.strip), lambda q: q != "")
    return unnest(plans, ["run_id"], F.slice(trimmed, 1, limit), "query", "__i").select("run_id", (F.col("__i") + 1).alias("query_no"), "query")


def query_budget(queries: DataFrame, limit: int = QUERY_BUDGET) -> DataFrame:
    """Adds ``admitted``: the first ``limit`` distinct query indexes of a run.

    queries: run_id, query_idx and anything else, e.g. the results of a query.
    The cut is one index per run, found on the distinct indexes, so the rows
    themselves are neither ranked nor grouped.
    """
    distinct = queries.select("run_id", "query_idx").distinct()
    last = (
        ordered.first_per_key(distinct, ["run_id"], [F.col("query_idx")], limit, "__n")
        .groupBy("run_id").agg(F.max("query_idx").alias("__last"))
    )
    return queries.join(last, "run_id").withColumn("admitted", F.col("query_idx") <= F.col("__last")).drop("__last")


def budget_report(queries: DataFrame, limit: int = QUERY_BUDGET) -> DataFrame:
    """Queries used and cut per run."""
    return query_budget(queries.select("run_id", "query_idx").distinct(), limit).groupBy("run_id").agg(
        F.count_if(F.col("admitted")).alias("n_used"), F.count_if(~F.col("admitted")).alias("n_cut")
    )


def clean_results(results: DataFrame) -> DataFrame:
    """Trimmed URL required; title falls back to the URL; title and snippet are cut."""
    url = tx.strip(F.coalesce("url", F.lit("")))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), url)
    return (
        results.withColumns({
            "title": F.substring(title, 1, TITLE_CHARS),
            "snippet": F.substring(tx.strip(F.coalesce("snippet", F.lit(""))), 1, SNIPPET_CHARS),
            "url": url,
        })
        .filter(F.col("url") != "")
    )


def distinct_urls(results: DataFrame) -> DataFrame:
    """One row per (run, URL): the first seen by query, then rank. Aggregated map-side."""
    others = [c for c in results.columns if c not in ("run_id", "url", "query_idx", "rank")]
    return results.groupBy("run_id", "url").agg(
        F.min(F.struct("query_idx", "rank", *others)).alias("__first")
    ).select("run_id", "url", *[F.col(f"__first.{c}").alias(c) for c in ("query_idx", "rank", *others)])


def ground_facts(facts: DataFrame, results: DataFrame) -> DataFrame:
    """Facts with the claimed URLs that the run really returned.

    facts: run_id, fact_id, claimed_urls (array), is_inference. Adds
    source_urls, has_source and shown_as_inference. A fact claims a handful of
    URLs, so regrouping by fact stays small.
    """
    claims = facts.select("run_id", "fact_id", F.posexplode("claimed_urls").alias("__i", "__url")).select(
        "run_id", "fact_id", "__i", tx.strip(F.col("__url")).alias("url")
    )
    kept = claims.join(results.select("run_id", "url").distinct(), ["run_id", "url"], "left_semi")
    urls = kept.groupBy("run_id", "fact_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__i", "url"))), lambda u: u["url"]).alias("source_urls")
    )
    return (
        facts.join(urls, ["run_id", "fact_id"], "left")
        .withColumn("source_urls", F.coalesce("source_urls", F.array().cast("array<string>")))
        .withColumn("has_source", (F.size("source_urls") > 0) & ~F.col("is_inference"))
        .withColumn("shown_as_inference", (F.size("source_urls") == 0) | F.col("is_inference"))
    )


def drop_protected(new_facts: DataFrame, profiles: DataFrame, fields: DataFrame) -> DataFrame:
    """New facts without blank values and without fields an expert edited before.

    new_facts: workspace_id, entity_id, field_key, value. The edit may sit in
    any older profile of the same entity.
    """
    edited = (
        fields.filter("is_expert_edited").select("profile_id", "field_key")
        .join(profiles.select(F.col("id").alias("profile_id"), "workspace_id", "entity_id"), "profile_id")
        .select("workspace_id", "entity_id", "field_key").distinct()
    )
    return (
        new_facts.withColumn("value", tx.strip(F.col("value").cast("string"))).filter(F.col("value") != "")
        .join(edited, ["workspace_id", "entity_id", "field_key"], "left_anti")
    )


def latest_profiles(profiles: DataFrame) -> DataFrame:
    """Newest profile per workspace and entity (largest id)."""
    others = [c for c in profiles.columns if c not in ("workspace_id", "entity_id")]
    newest = profiles.groupBy("workspace_id", "entity_id").agg(
        F.max(F.struct("id", *[c for c in others if c != "id"])).alias("__p")
    )
    return newest.select("workspace_id", "entity_id", *[F.col(f"__p.{c}").alias(c) for c in others])


def profile_view(profiles: DataFrame, fields: DataFrame, sources: DataFrame) -> DataFrame:
    """Latest profiles with fields and sources, one row per source, clients first.

    fields: id, profile_id, field_key, value, has_source, is_expert_edited.
    sources: field_id, url. Fields without a source keep a row.
    """
    shown = latest_profiles(profiles).withColumnRenamed("id", "profile_id")
    with_fields = shown.join(fields.withColumnRenamed("id", "field_id"), "profile_id", "left")
    return (
        with_fields.join(sources, "field_id", "left")
        .orderBy("workspace_id", F.when(F.col("entity_role") == "client", 0).otherwise(1), "entity_id",
                 "field_id", "url")
    )


def carried_edits(profiles: DataFrame, fields: DataFrame) -> DataFrame:
    """Edited fields that only exist on older profiles, moved to the latest profile.

    A re-run leaves edited fields out, and the latest profile hides them; this
    brings the newest edit of each field back.
    """
    history = fields.join(
        profiles.select(F.col("id").alias("profile_id"), "workspace_id", "entity_id"), "profile_id"
    )
    newest = latest_profiles(profiles).select("workspace_id", "entity_id", F.col("id").alias("latest_id"))
    edits = history.filter("is_expert_edited").groupBy("workspace_id", "entity_id", "field_key").agg(
        F.max(F.struct("profile_id", "value", "has_source")).alias("__e")
    )
    return (
        edits.join(newest, ["workspace_id", "entity_id"])
        .filter(F.col("__e.profile_id") < F.col("latest_id"))
        .select(
            F.col("latest_id").alias("profile_id"), "field_key", F.col("__e.value").alias("value"),
            F.col("__e.has_source").alias("has_source"), F.lit(True).alias("is_expert_edited"),
        )
        .join(fields.select("profile_id", "field_key"), ["profile_id", "field_key"], "left_anti")
    )


def grounded_fields(profiles: DataFrame, fields: DataFrame, carry_edited: bool = False) -> DataFrame:
    """Fields that may be used as fact: sourced or edited, on the latest profile only."""
    columns = ["profile_id", "field_key", "value", "has_source", "is_expert_edited"]
    rows = fields.select(*columns)
    if carry_edited:
        rows = rows.unionByName(carried_edits(profiles, fields).select(*columns))
    usable = rows.filter(F.col("has_source") | F.col("is_expert_edited"))
    return usable.join(
        latest_profiles(profiles).select(F.col("id").alias("profile_id"), "workspace_id", "entity_id", "entity_role"),
        "profile_id",
    )


def profile_text(grounded: DataFrame) -> DataFrame:
    """One text per entity: a heading and one line per field, in field order."""
    label = F.when(F.col("entity_role") == "client", ROLE_LABELS["client"]).otherwise(ROLE_LABELS["partner"])
    line = F.concat(F.lit("  - "), F.col("field_key").cast("string"), F.lit(": "), F.col("value").cast("string"))
    lines = F.sort_array(F.collect_list(F.struct("field_key", "value", line.alias("line"))))
    return grounded.groupBy("workspace_id", "entity_id", "entity_role").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("__lines")
    ).select(
        "workspace_id", "entity_id", "entity_role",
        F.concat(F.col("entity_id").cast("string"), F.lit(" ("), label, F.lit("):\n"), F.col("__lines"))
        .alias("profile_text"),
    )


def edit_fields(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Fields after a table of edits (field_id, seq, value); blank values are ignored."""
    last = (
        edits.withColumn("value", tx.strip(F.col("value"))).filter(F.col("value") != "")
        .groupBy("field_id").agg(F.max_by("value", "seq").alias("__value"))
    )
    return fields.join(last, "field_id", "left").select(*[
        F.coalesce("__value", "value").alias("value") if c == "value"
        else (F.col("is_expert_edited") | F.col("__value").isNotNull()).alias(c) if c == "is_expert_edited"
        else F.col(c)
        for c in fields.columns
    ])


def run_report(runs: DataFrame, queries: DataFrame, results: DataFrame, limit: int = QUERY_BUDGET) -> DataFrame:
    """Counters and status per run.

    runs: run_id, failed. queries: run_id, query_idx, query_failed. results:
    deduplicated results. No result or any trouble makes a run partial.
    """
    spent = query_budget(queries, limit).groupBy("run_id").agg(
        F.count_if(F.col("admitted")).alias("n_queries"),
        F.count_if(~F.col("admitted") | F.col("query_failed")).alias("n_notes"),
    )
    found = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_sources"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_queries", "n_notes", "n_sources")}
    return (
        runs.join(spent, "run_id", "left").join(found, "run_id", "left").withColumns(zero)
        .withColumn(
            "status",
            F.when(F.col("failed"), "error")
            .when((F.col("n_sources") == 0) | (F.col("n_notes") > 0), "partial")
            .otherwise("done"),
        )
        .select("run_id", "n_queries", "n_sources", "n_notes", "status")
    )


def run_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs per workspace."""
    return ordered.first_per_key(runs, ["workspace_id"], [F.col("created_at").desc(), F.col("id").desc()], limit)


def context_counts(
    documents: DataFrame, glossary: DataFrame, profiles: DataFrame, fields: DataFrame,
    workspaces: DataFrame | None = None,
) -> DataFrame:
    """What a script would be built from, per workspace, with the warnings as flags."""
    owned = fields.join(profiles.select(F.col("id").alias("profile_id"), "workspace_id"), "profile_id")
    ready = F.col("status") == "ready"
    table = counts.per_workspace([
        (documents, {"n_documents": ready, "n_parallel": ready & (F.col("language") == "parallel")}),
        (glossary, {
            "n_terms": F.col("status") != "skipped",
            "n_expert_terms": F.col("status") == "expert_edited",
            "n_aligned_terms": F.col("confidence") == "aligned_from_parallel",
        }),
        (profiles, {"n_profiles": counts.every_row()}),
        (owned, {
            "n_fields": counts.every_row(),
            "n_fields_unsourced": ~F.col("has_source") & ~F.col("is_expert_edited"),
        }),
    ], workspaces)
    return table.withColumns({
        "warn_no_profile": F.col("n_profiles") == 0,
        "warn_unsourced": F.col("n_fields_unsourced") > 0,
        "warn_few_terms": F.col("n_terms") < FEW_TERMS,
    })


def entities(profiles: DataFrame) -> DataFrame:
    """Distinct entities of a workspace, clients first."""
    return profiles.select("workspace_id", "entity_id", "entity_role").distinct().orderBy(
        "workspace_id", F.when(F.col("entity_role") == "client", 0).otherwise(1), "entity_id"
    )
