"""Views that give the driver tables the shapes the operators work on.

Each view is one SQL text that runs unchanged in Spark SQL and in the oracle
engine; ``{table}`` stands for a driver table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "fx_vectors": """
        SELECT vec_id AS chunk_id, CAST(label AS BIGINT) AS document_id, vec_id % 4 AS workspace_id, embedding
        FROM {embeddings}""",
    "fx_documents": """
        SELECT doc_id, CAST(substr(source, 4) AS INT) % 5 AS workspace_id, doc_id AS seq, source || '.txt' AS filename,
               text, lang, n_chars, CASE WHEN n_chars < 120 THEN 'error' ELSE 'ready' END AS status
        FROM {documents}""",
    "fx_doc_list": """
        SELECT doc_id AS id, doc_id, CAST(substr(source, 4) AS INT) % 5 AS workspace_id, source || '.txt' AS filename,
               n_chars * 7 AS size_bytes, CASE WHEN lang IN ('fr', 'es') THEN 'vi' WHEN lang = 'de' THEN 'parallel'
               ELSE 'en' END AS language, n_chars % 1000 AS created_at,
               CASE WHEN n_chars < 120 THEN 'error' WHEN n_chars % 11 = 0 THEN 'indexing' ELSE 'ready' END AS status
        FROM {documents}""",
    "fx_manifest": """
        SELECT doc_id, source, source || '-' || CAST(doc_id AS STRING) ||
               CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.PDF' WHEN 'de' THEN '.tar.gz' ELSE '' END AS filename,
               CASE WHEN n_chars < 60 THEN 0 ELSE n_chars * 5000 END AS size_bytes
        FROM {documents}""",
    "fx_turn_chunks": """
        SELECT conv_id AS doc_id, CAST(turn AS INT) AS chunk_idx, text,
               CASE WHEN role = 'user' THEN 'vi' WHEN turn % 5 = 3 THEN 'unknown' ELSE 'en' END AS lang
        FROM {conversations}""",
    "fx_candidates": """
        SELECT p_partkey AS seq, p_size % 5 AS workspace_id, p_name AS term_vi, p_type AS term_en,
               CASE WHEN p_size % 3 = 0 THEN 'aligned_from_parallel' ELSE 'machine_guess' END AS confidence,
               CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END AS pronunciation,
               CASE WHEN p_partkey % 6 = 1 THEN 'size ' || CAST(p_size AS STRING) ELSE '' END AS definition,
               CAST(p_size AS STRING) AS category,
               CASE WHEN p_partkey % 2 = 0 THEN 'document' ELSE 'web' END AS source_type, p_brand AS source_ref
        FROM {part}""",
    # a glossary that existed before: one row per (workspace, name); only names of many parts are named again
    "fx_standing": """
        SELECT min(p_partkey) AS id, p_size % 5 AS workspace_id, p_name AS term_vi,
               CASE WHEN count(*) > 6 THEN p_name ELSE p_name || ' old' END AS term_vi_norm,
               max(p_type) AS term_en, CAST(NULL AS STRING) AS pronunciation, CAST(NULL AS STRING) AS definition,
               'old' AS category,
               CASE WHEN min(p_partkey) % 4 = 1 THEN 'aligned_from_parallel' ELSE 'machine_guess' END AS confidence,
               CASE WHEN min(p_partkey) % 3 = 0 THEN 'expert_edited' ELSE 'auto' END AS status,
               'document' AS source_type, 'old' AS source_ref, count(*) AS frequency
        FROM {part} GROUP BY p_size % 5, p_name""",
    "fx_glossary": """
        SELECT p_partkey AS id, p_partkey % 7 AS workspace_id, p_name || ' ' || CAST(p_partkey AS STRING) AS term_vi,
               p_name || ' ' || CAST(p_partkey AS STRING) AS term_vi_norm, p_type || ' ' || p_name AS term_en,
               CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN ' ' END AS pronunciation,
               CASE WHEN p_size % 2 = 0 THEN 'size ' || CAST(p_size AS STRING) END AS definition,
               CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS category,
               CASE WHEN p_size % 3 = 0 THEN 'aligned_from_parallel' ELSE 'machine_guess' END AS confidence,
               CASE p_partkey % 5 WHEN 0 THEN 'expert_edited' WHEN 1 THEN 'skipped' ELSE 'auto' END AS status,
               CASE WHEN p_partkey % 2 = 0 THEN 'document' ELSE 'web' END AS source_type,
               'ref ' || CAST(p_size AS STRING) AS source_ref, p_size AS frequency
        FROM {part}""",
    "fx_conflicts": """
        SELECT o_orderkey AS id, o_custkey AS glossary_id, o_orderpriority AS proposed_term_en,
               CASE WHEN o_orderkey % 3 = 0 THEN 'note ' || o_orderpriority END AS proposed_definition,
               'order' AS source_ref, CASE WHEN o_orderkey % 2 = 0 THEN 'aligned_from_parallel' ELSE 'machine_guess'
               END AS confidence, o_orderstatus = 'F' AS resolved
        FROM {orders}""",
    "fx_term_edits": """
        SELECT l_partkey AS id, l_partkey % 7 AS workspace_id, l_orderkey * 100000 + l_suppkey * 10 + l_linenumber AS seq,
               CASE l_returnflag WHEN 'A' THEN 'update' WHEN 'R' THEN 'skip' ELSE 'create' END AS action,
               CASE WHEN l_linenumber = 1 THEN 'Renamed, ' || CAST(l_suppkey AS STRING) || '!' END AS term_vi,
               CASE WHEN l_linenumber = 2 THEN 'term ' || CAST(l_suppkey AS STRING) END AS term_en,
               CASE WHEN l_linenumber = 3 THEN 'say ' || CAST(l_suppkey AS STRING) END AS pronunciation,
               CAST(NULL AS STRING) AS definition,
               CASE WHEN l_linenumber = 4 THEN 'cat ' || CAST(l_suppkey AS STRING) END AS category
        FROM {lineitem}""",
    "fx_sessions": """
        SELECT o_orderkey AS id, o_custkey AS workspace_id, o_orderpriority AS difficulty,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'generated' END AS status,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 10 END AS overall_score,
               o_orderdate AS created_at
        FROM {orders}""",
    "fx_scores": """
        SELECT l_orderkey AS session_id, l_orderkey * 10 + l_linenumber AS attempt_id, l_linenumber AS turn_index,
               l_partkey, l_suppkey, l_shipdate AS created_at,
               CAST(l_quantity / 5 AS DECIMAL(4,1)) AS a_meaning, CAST(l_discount * 100 AS DECIMAL(4,1)) AS a_terminology,
               CAST(10 - l_tax * 100 AS DECIMAL(4,1)) AS a_completeness,
               CAST(10 - l_quantity / 10 AS DECIMAL(4,1)) AS a_expression
        FROM {lineitem}""",
    "fx_verdicts": """
        SELECT l_orderkey * 10 + l_linenumber AS attempt_id, l_orderkey AS session_id,
               l_partkey % 20 AS workspace_id, l_partkey, l_suppkey,
               (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey AS verdict_id,
               l_shipdate AS created_at, CASE l_returnflag WHEN 'A' THEN 'agree' ELSE 'adjust' END AS action,
               CAST(least(10, greatest(0, l_quantity / 5 + (l_partkey % 7 - 3) * 0.5)) AS DECIMAL(4,1)) AS e_meaning,
               CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_discount * 100 AS DECIMAL(4,1)) END AS e_terminology,
               CAST(least(10, l_tax * 100 + 2) AS DECIMAL(4,1)) AS e_completeness,
               CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(10 - l_quantity / 10 AS DECIMAL(4,1)) END AS e_expression,
               CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'reason ' || CAST(l_suppkey % 10 AS STRING) END AS note,
               CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE 'c' || CAST(l_suppkey % 8 AS STRING) END AS related_category
        FROM {lineitem}""",
    "fx_profiles": """
        SELECT o_orderkey AS id, o_custkey % 50 AS workspace_id, o_custkey AS entity_id,
               CASE WHEN o_custkey % 3 = 0 THEN 'client' ELSE 'partner' END AS entity_role, o_orderdate AS created_at
        FROM {orders}""",
    "fx_fields": """
        SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS id, l_orderkey AS profile_id,
               l_linenumber AS field_key, CAST(l_partkey AS STRING) AS value, l_returnflag = 'R' AS has_source,
               l_linestatus = 'F' AS is_expert_edited
        FROM {lineitem}""",
    "fx_audit": """
        SELECT event_id AS id, ts AS created_at, user_id AS workspace_id,
               CASE user_id % 4 WHEN 0 THEN 'p_llm' WHEN 1 THEN 'p_search' WHEN 2 THEN 'p_tts1' ELSE 'p_tts2' END AS provider,
               CASE user_id % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'search' ELSE 'tts' END AS destination,
               CAST(floor(value * 300) AS BIGINT) AS n_chars,
               CASE event_type WHEN 'error' THEN 'attempt_failed' WHEN 'signup' THEN 'blocked'
               ELSE 'attempt_succeeded' END AS status,
               CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS operation_id
        FROM {events}""",
    "fx_grants": """
        SELECT event_id AS id, user_id AS workspace_id,
               CASE WHEN event_id % 10 IN (0, 1) THEN 'llm' WHEN event_id % 10 IN (2, 3) THEN 'search' ELSE 'tts' END AS destination,
               CASE WHEN event_id % 10 IN (0, 1) THEN 'p_llm' WHEN event_id % 10 IN (2, 3) THEN 'p_search'
               WHEN event_id % 10 IN (4, 5, 6) THEN 'p_tts1' ELSE 'p_tts2' END AS provider,
               ts AS granted_at, CASE WHEN event_type = 'signup' THEN ts + INTERVAL '8' HOUR ELSE ts + INTERVAL '15' MINUTE END AS expires_at,
               CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(user_id AS STRING) || '-' ||
               CAST(CAST(ts AS DATE) AS STRING) END AS operation_id
        FROM {events}""",
    "fx_calls": """
        SELECT id, created_at AS ts, workspace_id, provider, destination, n_chars,
               CASE WHEN id % 29 = 0 THEN NULL ELSE operation_id END AS operation_id,
               workspace_id % 2 = 0 AS is_confidential,
               CASE WHEN status = 'attempt_failed' THEN 'TimeoutError' END AS provider_error,
               CASE destination WHEN 'llm' THEN 'qa' WHEN 'search' THEN 'research' ELSE 'speech' END AS module,
               provider || ':v1' AS endpoint, destination || ' ' || CAST(id AS STRING) AS summary
        FROM {fx_audit}""",
    # operations are asked for once and again some minutes later; the second time names the first
    "fx_openings": """
        SELECT event_id * 2 AS opening_id, CAST(NULL AS BIGINT) AS resume_id,
               CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id END AS workspace_id, user_id % 2 = 0 AS is_confidential,
               event_type AS kind, props AS fingerprint, ts AS ts,
               CASE user_id % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'search' ELSE 'tts' END AS destination,
               CASE user_id % 4 WHEN 0 THEN 'p_llm' WHEN 1 THEN 'p_search' WHEN 2 THEN 'p_tts1' ELSE 'p_tts2' END AS provider
        FROM {events}
        UNION ALL SELECT event_id * 2 + 1 AS opening_id, event_id * 2 AS resume_id,
               CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id END AS workspace_id, user_id % 2 = 0 AS is_confidential,
               CASE WHEN event_id % 7 = 0 THEN 'other' ELSE event_type END AS kind, props AS fingerprint, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL '20' MINUTE ELSE ts + INTERVAL '5' MINUTE END AS ts,
               CASE user_id % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'search' ELSE 'tts' END AS destination,
               CASE user_id % 4 WHEN 0 THEN 'p_llm' WHEN 1 THEN 'p_search' WHEN 2 THEN 'p_tts1' ELSE 'p_tts2' END AS provider
        FROM {events}""",
    "fx_operations": """
        SELECT event_id * 2 AS operation_id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id END AS workspace_id, event_type AS kind,
               props AS fingerprint, ts + INTERVAL '15' MINUTE AS expires_at, CASE WHEN event_id % 6 = 0 THEN ts END AS completed_at
        FROM {events}""",
    "fx_declares": """
        SELECT DISTINCT operation_id, 0 AS position, destination, provider,
               CASE WHEN workspace_id % 3 = 0 THEN 1 ELSE 2 END AS unit_calls,
               CASE WHEN workspace_id % 5 = 0 THEN 1 ELSE 0 END AS retries_each
        FROM {fx_audit} WHERE status <> 'blocked'""",
    "fx_results": """
        SELECT page_id % 5 AS run_id, page_id % 12 AS query_idx, page_id AS rank, split_part(url, '/', 3) AS url,
               CASE WHEN page_id % 6 = 0 THEN '' ELSE url END AS title, html AS snippet
        FROM {pages}""",
    "fx_turns": """
        SELECT conv_id * 1000 + turn AS turn_id, conv_id AS session_id, turn AS turn_index,
               CASE WHEN role = 'user' THEN 'vi' ELSE 'en' END AS source_lang, text AS source_text,
               CASE WHEN turn % 4 = 3 THEN ' ' ELSE text END AS reference_translation
        FROM {conversations}""",
    "fx_recordings": """
        SELECT doc_id AS attempt_id, doc_id % 40 AS session_id, CAST(substr(source, 4) AS INT) % 5 AS workspace_id,
               CASE WHEN doc_id % 10 = 0 THEN NULL ELSE n_chars END AS length
        FROM {documents}""",
    "fx_workspaces": """
        SELECT c_custkey AS workspace_id, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS updated_at FROM {customer}""",
}

_NAME = re.compile(r"\{(\w+)\}")


class Inputs:
    """Tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{name: self.table(name) for name in set(_NAME.findall(text))})

    __getitem__ = table


def with_views(sql: str) -> str:
    """The SQL with the views it uses in front, as common table expressions."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for inner in _NAME.findall(VIEWS[name]):
            if inner in VIEWS:
                visit(inner)
        needed.append(name)

    for name in re.findall(r"\bfx_\w+", sql):
        visit(name)
    views = [f"{name} AS ({_NAME.sub(lambda m: m.group(1), VIEWS[name]).strip()})" for name in needed]
    body = sql.strip()
    if not views:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(views) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body
