"""Research operators on the driver tables."""

from pyspark.sql import functions as F

from ..operators import research as rs
from .registry import query

ADMITTED = """
    q AS (SELECT DISTINCT run_id, query_idx FROM fx_results),
    n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY query_idx) AS k FROM q)"""
UNIQUE = """
    u AS (SELECT r.*, coalesce(nullif(title, ''), url) AS shown FROM fx_results r WHERE coalesce(trim(url), '') <> ''
          QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY query_idx, rank) = 1)"""


@query("q1_planned_queries", r"""
    WITH lines AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line,
                          generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
    n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS query_no FROM lines WHERE line <> '')
    SELECT doc_id AS run_id, query_no, line AS query FROM n WHERE query_no <= 8""")
def planned_queries(t):
    return rs.plan_queries(t["documents"].select(F.col("doc_id").alias("run_id"), F.split("text", "\n").alias("queries")))


@query("q2_query_budget", f"""
    WITH {ADMITTED} SELECT r.run_id, r.query_idx, r.rank, n.k <= 8 AS admitted FROM fx_results r JOIN n USING (run_id, query_idx)""")
def query_budget(t):
    return rs.query_budget(t["fx_results"]).select("run_id", "query_idx", "rank", "admitted")


@query("q2_budget_report", f"""
    WITH {ADMITTED} SELECT run_id, count(*) FILTER (k <= 8) AS n_used, count(*) FILTER (k > 8) AS n_cut FROM n GROUP BY 1""")
def budget_report(t):
    return rs.budget_report(t["fx_results"])


@query("q3_clean_results", r"""
    SELECT run_id, rank, url, substr(coalesce(nullif(title, ''), url), 1, 250) AS title,
           substr(regexp_replace(snippet, '^\s+|\s+$', '', 'g'), 1, 500) AS snippet
    FROM fx_results WHERE url <> ''""")
def clean_results(t):
    return rs.clean_results(t["fx_results"]).select("run_id", "rank", "url", "title", "snippet")


@query("q4_distinct_urls", f"WITH {UNIQUE} SELECT run_id, url, query_idx, rank, substr(shown, 1, 250) AS title FROM u")
def distinct_urls(t):
    return rs.distinct_urls(rs.clean_results(t["fx_results"])).select("run_id", "url", "query_idx", "rank", "title")


def facts(t):
    """One fact per page; it claims its own host, an invented one, and the host of the next page."""
    pages = t["pages"].select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    later = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("host").alias("next_host"))
    return pages.join(later, "page_id", "left").select(
        (F.col("page_id") % 5).alias("run_id"), F.col("page_id").alias("fact_id"),
        F.array(F.concat(F.lit(" "), "host"), F.lit("https://invented"), F.coalesce("next_host", F.lit(""))).alias("claimed_urls"),
        (F.col("page_id") % 4 == 0).alias("is_inference"))


CLAIMS = """
    p AS (SELECT page_id, split_part(url, '/', 3) AS host FROM pages),
    c AS (SELECT a.page_id % 5 AS run_id, a.page_id AS fact_id, a.page_id % 4 = 0 AS is_inference,
                 unnest([0, 1, 2]) AS k, unnest([a.host, 'https://invented', coalesce(b.host, '')]) AS url
          FROM p a LEFT JOIN p b ON b.page_id = a.page_id + 1),
    kept AS (SELECT * FROM c WHERE (run_id, url) IN (SELECT (run_id, url) FROM fx_results)),
    g AS (SELECT c.run_id, c.fact_id, max(c.is_inference) AS is_inference FROM c GROUP BY 1, 2),
    l AS (SELECT fact_id, string_agg(url, '|' ORDER BY k) AS urls FROM kept GROUP BY 1)"""


@query("q5_grounded_urls", f"WITH {CLAIMS} SELECT g.run_id, g.fact_id, coalesce(urls, '') AS source_urls FROM g LEFT JOIN l USING (fact_id)")
def grounded_urls(t):
    return rs.ground_facts(facts(t), t["fx_results"]).select("run_id", "fact_id", F.array_join("source_urls", "|").alias("source_urls"))


@query("q6_fact_flags", f"""
    WITH {CLAIMS} SELECT g.run_id, g.fact_id, urls IS NOT NULL AND NOT is_inference AS has_source,
           urls IS NULL OR is_inference AS shown_as_inference FROM g LEFT JOIN l USING (fact_id)""")
def fact_flags(t):
    return rs.ground_facts(facts(t), t["fx_results"]).select("run_id", "fact_id", "has_source", "shown_as_inference")


@query("q7_protected_fields", """
    WITH edited AS (SELECT DISTINCT p.workspace_id, p.entity_id, f.field_key FROM fx_fields f JOIN fx_profiles p ON p.id = f.profile_id WHERE f.is_expert_edited),
    new AS (SELECT p.workspace_id, p.entity_id, f.id, f.field_key, f.value FROM fx_fields f JOIN fx_profiles p ON p.id = f.profile_id WHERE NOT f.is_expert_edited)
    SELECT n.workspace_id, n.entity_id, n.id, n.field_key, n.value FROM new n
    LEFT JOIN edited e ON e.workspace_id = n.workspace_id AND e.entity_id = n.entity_id AND e.field_key = n.field_key WHERE e.field_key IS NULL""")
def protected_fields(t):
    profiles, fields = t["fx_profiles"], t["fx_fields"]
    new = fields.filter(~F.col("is_expert_edited")).select("id", "profile_id", "field_key", "value").join(
        profiles.select(F.col("id").alias("profile_id"), "workspace_id", "entity_id"), "profile_id")
    return rs.drop_protected(new, profiles, fields).select("workspace_id", "entity_id", "id", "field_key", "value")


LATEST = """
    latest AS (SELECT * FROM fx_profiles QUALIFY row_number() OVER (PARTITION BY workspace_id, entity_id ORDER BY id DESC) = 1)"""


@query("q8_latest_profiles", f"WITH {LATEST} SELECT workspace_id, entity_id, id, entity_role FROM latest")
def latest_profiles(t):
    return rs.latest_profiles(t["fx_profiles"]).select("workspace_id", "entity_id", "id", "entity_role")


@query("q9_profile_view", f"""
    WITH {LATEST}
    SELECT l.workspace_id, l.entity_id, l.id AS profile_id, f.id AS field_id, f.field_key, f.value, s.s_name AS url
    FROM latest l LEFT JOIN fx_fields f ON f.profile_id = l.id
    LEFT JOIN (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS field_id, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) s ON s.field_id = f.id""")
def profile_view(t):
    sources = t.sql("""SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS field_id, s_name AS url
                       FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey""")
    return rs.profile_view(t["fx_profiles"], t["fx_fields"], sources).select(
        "workspace_id", "entity_id", "profile_id", "field_id", "field_key", "value", "url")


GROUNDED = f"""
    {LATEST},
    grounded AS (SELECT l.workspace_id, l.entity_id, l.entity_role, f.profile_id, f.field_key, f.value
                 FROM fx_fields f JOIN latest l ON l.id = f.profile_id WHERE f.has_source OR f.is_expert_edited)"""


@query("q10_grounded_fields", f"WITH {GROUNDED} SELECT * FROM grounded")
def grounded_fields(t):
    return rs.grounded_fields(t["fx_profiles"], t["fx_fields"]).drop("has_source", "is_expert_edited")


@query("q10_profile_text", f"""
    WITH {GROUNDED}
    SELECT workspace_id, entity_id, entity_role, CAST(entity_id AS VARCHAR) || ' (' || CASE entity_role WHEN 'client' THEN 'Khách hàng' ELSE 'Đối tác' END || '):' || chr(10) ||
           string_agg('  - ' || CAST(field_key AS VARCHAR) || ': ' || value, chr(10) ORDER BY field_key, value) AS profile_text FROM grounded GROUP BY 1, 2, 3""")
def profile_text(t):
    return rs.profile_text(rs.grounded_fields(t["fx_profiles"], t["fx_fields"]))


@query("q11_field_edits", """
    WITH e AS (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS id, arg_max('edit ' || CAST(l_suppkey AS VARCHAR), l_suppkey) AS v
               FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1)
    SELECT f.id, f.field_key, coalesce(e.v, f.value) AS value, f.is_expert_edited OR e.id IS NOT NULL AS is_expert_edited
    FROM fx_fields f LEFT JOIN e ON e.id = f.id""")
def field_edits(t):
    edits = t.sql("""SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS field_id, l_suppkey AS seq,
                     CASE WHEN l_suppkey % 4 = 0 THEN ' ' ELSE ' edit ' || CAST(l_suppkey AS STRING) END AS value
                     FROM {lineitem}""")
    fields = t["fx_fields"].select(F.col("id").alias("field_id"), "field_key", "value", "is_expert_edited")
    return rs.edit_fields(fields, edits).withColumnRenamed("field_id", "id")


@query("q12_run_report", f"""
    WITH {ADMITTED}, {UNIQUE}, s AS (SELECT run_id, count(*) AS n_sources FROM u GROUP BY 1),
    f AS (SELECT run_id, query_idx, bool_or(length(snippet) < 200) AS failed FROM fx_results GROUP BY 1, 2),
    c AS (SELECT n.run_id, count(*) FILTER (k <= 8) AS n_queries, count(*) FILTER (k > 8 OR failed) AS n_notes FROM n JOIN f USING (run_id, query_idx) GROUP BY 1),
    r AS (SELECT DISTINCT o_custkey % 9 AS run_id, o_custkey % 9 = 8 AS failed FROM orders)
    SELECT r.run_id, coalesce(n_queries, 0) AS n_queries, coalesce(n_sources, 0) AS n_sources, coalesce(n_notes, 0) AS n_notes,
           CASE WHEN r.failed THEN 'error' WHEN coalesce(n_sources, 0) = 0 OR coalesce(n_notes, 0) > 0 THEN 'partial' ELSE 'done' END AS status
    FROM r LEFT JOIN c USING (run_id) LEFT JOIN s USING (run_id)""")
def run_report(t):
    runs = t["orders"].select((F.col("o_custkey") % 9).alias("run_id")).distinct().withColumn("failed", F.col("run_id") == 8)
    asked = t["fx_results"].groupBy("run_id", "query_idx").agg(F.bool_or(F.length("snippet") < 200).alias("query_failed"))
    return rs.run_report(runs, asked, rs.distinct_urls(rs.clean_results(t["fx_results"])))


@query("q12_run_history", """
    SELECT workspace_id, id, row_number() OVER w AS rank FROM fx_profiles
    WINDOW w AS (PARTITION BY workspace_id ORDER BY created_at DESC, id DESC) QUALIFY row_number() OVER w <= 20""")
def run_history(t):
    return rs.run_history(t["fx_profiles"]).select("workspace_id", "id", "rank")


@query("q13_context_counts", """
    WITH d AS (SELECT workspace_id, count(*) FILTER (status = 'ready') AS n_documents, count(*) FILTER (status = 'ready' AND language = 'parallel') AS n_parallel FROM fx_doc_list GROUP BY 1),
    g AS (SELECT workspace_id, count(*) FILTER (status <> 'skipped') AS n_terms, count(*) FILTER (status = 'expert_edited') AS n_expert_terms,
                 count(*) FILTER (confidence = 'aligned_from_parallel') AS n_aligned_terms FROM fx_glossary GROUP BY 1),
    p AS (SELECT workspace_id, count(*) AS n_profiles FROM fx_profiles GROUP BY 1),
    f AS (SELECT p.workspace_id, count(*) AS n_fields, count(*) FILTER (NOT has_source AND NOT is_expert_edited) AS n_fields_unsourced
          FROM fx_fields f JOIN fx_profiles p ON p.id = f.profile_id GROUP BY 1),
    w AS (SELECT workspace_id FROM d UNION SELECT workspace_id FROM g UNION SELECT workspace_id FROM p UNION SELECT workspace_id FROM fx_workspaces),
    a AS (SELECT w.workspace_id, coalesce(n_documents, 0) AS n_documents, coalesce(n_parallel, 0) AS n_parallel, coalesce(n_terms, 0) AS n_terms,
                 coalesce(n_expert_terms, 0) AS n_expert_terms, coalesce(n_aligned_terms, 0) AS n_aligned_terms, coalesce(n_profiles, 0) AS n_profiles,
                 coalesce(n_fields, 0) AS n_fields, coalesce(n_fields_unsourced, 0) AS n_fields_unsourced
          FROM w LEFT JOIN d USING (workspace_id) LEFT JOIN g USING (workspace_id) LEFT JOIN p USING (workspace_id) LEFT JOIN f USING (workspace_id))
    SELECT *, n_profiles = 0 AS warn_no_profile, n_fields_unsourced > 0 AS warn_unsourced, n_terms < 5 AS warn_few_terms FROM a""")
def context_counts(t):
    return rs.context_counts(t["fx_doc_list"], t["fx_glossary"], t["fx_profiles"], t["fx_fields"], t["fx_workspaces"])


@query("q13_entities", "SELECT DISTINCT workspace_id, entity_id, entity_role FROM fx_profiles")
def entities(t):
    return rs.entities(t["fx_profiles"])
