"""Glossary operators on the driver tables."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as docs
from ..operators import glossary as gl
from .registry import query
from .sqltext import squash, strip, term_key

# The fold of the candidates, written over all rows with windows.
FOLD = f"""
    rows0 AS (SELECT *, {term_key('term_vi')} AS term_key, {term_key('term_en')} AS en_key,
                     CASE WHEN confidence = 'aligned_from_parallel' THEN 2 ELSE 1 END AS rank FROM fx_candidates),
    based AS (SELECT r.*, s.id AS glossary_id, coalesce(s.status, 'auto') AS base_status, coalesce(s.frequency, 1) AS base_frequency,
                CASE WHEN s.id IS NULL THEN min(r.seq) OVER k ELSE -1 END AS base_seq,
                CASE WHEN s.id IS NULL THEN first_value(r.en_key) OVER o ELSE {term_key('s.term_en')} END AS base_en,
                CASE WHEN s.id IS NULL THEN first_value(r.rank) OVER o WHEN s.status = 'expert_edited' THEN 3
                     WHEN s.confidence = 'aligned_from_parallel' THEN 2 ELSE 1 END AS base_rank,
                s.id IS NOT NULL AS existed, s.term_vi AS s_term_vi, s.term_en AS s_term_en, s.category AS s_category,
                s.confidence AS s_confidence, s.source_type AS s_source_type, s.source_ref AS s_source_ref
              FROM rows0 r LEFT JOIN fx_standing s ON s.workspace_id = r.workspace_id AND s.term_vi_norm = r.term_key
              WINDOW k AS (PARTITION BY r.workspace_id, r.term_key), o AS (PARTITION BY r.workspace_id, r.term_key ORDER BY r.seq)),
    swapped AS (SELECT *, min(CASE WHEN base_rank = 1 AND rank = 2 AND en_key <> base_en THEN seq END) OVER (PARTITION BY workspace_id, term_key) AS swap_seq FROM based),
    swapped2 AS (SELECT *, max(CASE WHEN seq = swap_seq THEN en_key END) OVER (PARTITION BY workspace_id, term_key) AS swap_en FROM swapped),
    judged AS (SELECT *, coalesce(seq > swap_seq, false) AS after_swap,
                 CASE WHEN seq = base_seq THEN 'added' WHEN seq = swap_seq THEN 'updated'
                      WHEN en_key = CASE WHEN seq > swap_seq THEN swap_en ELSE base_en END THEN 'bumped' ELSE 'conflict' END AS outcome
               FROM swapped2)"""

CONFLICTS = """
    proposed AS (SELECT workspace_id, term_key, term_en AS proposed_term_en, min(seq) AS seq FROM judged WHERE outcome = 'conflict' GROUP BY 1, 2, 3)"""


def fold(t):
    return gl.classify_candidates(t["fx_candidates"], t["fx_standing"])


@query("t1_term_key", f"""
    SELECT p_partkey, {term_key("'  ' || p_name || ', (' || p_brand || ')  ' || p_type || '!'")} AS term_key FROM part""")
def term_keys(t):
    text = F.concat(F.lit("  "), "p_name", F.lit(", ("), "p_brand", F.lit(")  "), "p_type", F.lit("!"))
    return t["part"].select("p_partkey", tx.term_key(text).alias("term_key"))


@query("t1_text_keys", f"SELECT doc_id, sha256({term_key('text')}) AS key_hash FROM documents")
def text_keys(t):
    return t["documents"].select("doc_id", "text").select("doc_id", F.sha2(tx.term_key(F.col("text")), 256).alias("key_hash"))


@query("t2_clean_candidates", """
    SELECT p_partkey AS seq, trim(p_name) AS term_vi, CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_type END AS term_en,
           p_brand AS pronunciation, 'machine_guess' AS confidence, 'web' AS source_type
    FROM part WHERE p_size % 9 <> 0""")
def clean_candidates(t):
    raw = t["part"].select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit(" "), "p_name", F.lit("\n")).alias("term_vi"),
        F.when(F.col("p_size") % 9 == 0, "  ").otherwise(F.col("p_type")).alias("term_en"),
        F.concat("p_brand", F.lit("\t")).alias("pronunciation"))
    return gl.clean_candidates(raw, "machine_guess", "web")


TEXTS = """
    texts AS (SELECT d.doc_id, d.workspace_id, d.language, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) FILTER (c.lang = 'vi'), '') AS vi_text,
                     coalesce(string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) FILTER (c.lang = 'en'), '') AS en_text,
                     coalesce(string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx), '') AS full_text
              FROM fx_doc_list d LEFT JOIN fx_turn_chunks c ON c.doc_id = d.doc_id WHERE d.status = 'ready' GROUP BY 1, 2, 3)"""


@query("t3_source_routing", f"""
    WITH {TEXTS}
    SELECT workspace_id, doc_id, 1 AS source_rank, length(substr(vi_text, 1, 7000)) AS n_vi, length(substr(en_text, 1, 7000)) AS n_en
    FROM texts WHERE language = 'parallel' AND length(vi_text) >= 200 AND length(en_text) >= 200
    UNION ALL SELECT workspace_id, doc_id, 2, CASE WHEN language = 'vi' THEN length(substr(full_text, 1, 14000)) ELSE 0 END,
           CASE WHEN language = 'en' THEN length(substr(full_text, 1, 14000)) ELSE 0 END
    FROM texts WHERE language IN ('vi', 'en') AND length(full_text) >= 200
    UNION ALL SELECT DISTINCT run_id, run_id, 3, 0, 0 FROM fx_results""")
def source_routing(t):
    texts = docs.document_texts(t["fx_doc_list"], t["fx_turn_chunks"])
    runs = t["fx_results"].select(F.col("run_id").alias("workspace_id"), F.col("run_id").alias("doc_id")).distinct()
    return gl.route_sources(texts, runs).select(
        "workspace_id", "doc_id", "source_rank", F.length("vi_text").alias("n_vi"), F.length("en_text").alias("n_en"))


@query("t4_character_budget", """
    WITH p AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY query_idx, rank) AS position, rank, title, snippet FROM fx_results),
    r AS (SELECT run_id, position, rank, sum(length('[Nguồn ' || CAST(position AS VARCHAR) || '] ' || title || chr(10) || snippet))
          OVER (PARTITION BY run_id ORDER BY position) AS running FROM p)
    SELECT run_id, position, rank, CAST(running AS BIGINT) AS running_chars FROM r WHERE running <= 12000""")
def character_budget(t):
    from ..functions import ordered

    placed = ordered.positions(t["fx_results"], ["run_id"], [F.col("query_idx"), F.col("rank")], "position")
    return gl.within_budget(placed).select("run_id", "position", "rank", "running_chars")


@query("t5_upsert_outcomes", f"""
    WITH {FOLD} SELECT workspace_id, seq, term_key, outcome, after_swap FROM judged""")
def upsert_outcomes(t):
    return fold(t).select("workspace_id", "seq", "term_key", "outcome", "after_swap")


@query("t5_upsert_glossary", f"""
    WITH {FOLD},
    filled AS (SELECT workspace_id, term_key,
        arg_min(pronunciation, seq) FILTER (outcome = 'bumped' AND NOT after_swap AND pronunciation <> '') AS p0,
        arg_min(pronunciation, seq) FILTER (outcome = 'bumped' AND after_swap AND pronunciation <> '') AS p1,
        max(CASE WHEN outcome = 'updated' THEN pronunciation END) AS ps, max(CASE WHEN outcome = 'added' THEN pronunciation END) AS pb,
        arg_min(definition, seq) FILTER (outcome = 'bumped' AND NOT after_swap AND definition <> '') AS d0,
        arg_min(definition, seq) FILTER (outcome = 'bumped' AND after_swap AND definition <> '') AS d1,
        max(CASE WHEN outcome = 'updated' THEN definition END) AS ds, max(CASE WHEN outcome = 'added' THEN definition END) AS db,
        count(*) FILTER (outcome IN ('bumped', 'updated')) AS n_more, max(base_frequency) AS base_frequency, max(base_status) AS status,
        max(glossary_id) AS id,
        max(CASE WHEN outcome = 'updated' THEN term_en END) AS en_swap, coalesce(max(CASE WHEN outcome = 'added' THEN term_en END), max(s_term_en)) AS en_base,
        max(CASE WHEN outcome = 'updated' THEN category END) AS cat_swap, coalesce(max(CASE WHEN outcome = 'added' THEN category END), max(s_category)) AS cat_base,
        max(CASE WHEN outcome = 'updated' THEN confidence END) AS conf_swap, coalesce(max(CASE WHEN outcome = 'added' THEN confidence END), max(s_confidence)) AS conf_base,
        max(CASE WHEN outcome = 'updated' THEN source_type END) AS st_swap, coalesce(max(CASE WHEN outcome = 'added' THEN source_type END), max(s_source_type)) AS st_base,
        max(CASE WHEN outcome = 'updated' THEN source_ref END) AS sr_swap, coalesce(max(CASE WHEN outcome = 'added' THEN source_ref END), max(s_source_ref)) AS sr_base,
        coalesce(max(CASE WHEN outcome = 'added' THEN term_vi END), max(s_term_vi)) AS term_vi
      FROM judged GROUP BY 1, 2)
    SELECT id, workspace_id, term_vi, term_key AS term_vi_norm, coalesce(en_swap, en_base) AS term_en,
           coalesce(nullif(ps, ''), nullif(pb, ''), p0, p1) AS pronunciation, coalesce(nullif(ds, ''), nullif(db, ''), d0, d1) AS definition,
           coalesce(cat_swap, cat_base) AS category, coalesce(conf_swap, conf_base) AS confidence, status,
           coalesce(st_swap, st_base) AS source_type, coalesce(sr_swap, sr_base) AS source_ref, base_frequency + n_more AS frequency
    FROM filled""")
def upsert_glossary(t):
    return gl.upsert(t["fx_candidates"], t["fx_standing"]).glossary


@query("t5_upsert_stats", f"""
    WITH {FOLD}, {CONFLICTS}, c AS (SELECT workspace_id, count(*) AS n FROM proposed GROUP BY 1)
    SELECT j.workspace_id, count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'updated') AS updated,
           count(*) FILTER (outcome = 'bumped') AS bumped, coalesce(max(c.n), 0) AS conflicts,
           count(*) FILTER (outcome = 'conflict' AND base_status = 'expert_edited') AS skipped_expert
    FROM judged j LEFT JOIN c ON c.workspace_id = j.workspace_id GROUP BY 1""")
def upsert_stats(t):
    return gl.upsert(t["fx_candidates"], t["fx_standing"]).stats


@query("t6_trust_rank", """
    SELECT id, CASE WHEN status = 'expert_edited' THEN 3 WHEN confidence = 'aligned_from_parallel' THEN 2 ELSE 1 END AS trust FROM fx_glossary""")
def trust_rank(t):
    return t["fx_glossary"].select("id", gl.trust_rank(F.col("status"), F.col("confidence")).alias("trust"))


OPEN = """
    open_rows AS (SELECT DISTINCT p_size % 5 AS workspace_id, p_name AS term_key, 'ECONOMY' AS proposed_term_en FROM part)"""


@query("t7_conflict_log", f"""
    WITH {FOLD}, {CONFLICTS}, {OPEN}
    SELECT p.workspace_id, p.term_key, p.proposed_term_en, nullif(c.definition, '') AS proposed_definition, c.source_ref, c.confidence, false AS resolved
    FROM proposed p JOIN fx_candidates c ON c.seq = p.seq
    WHERE (p.workspace_id, p.term_key, p.proposed_term_en) NOT IN (SELECT (workspace_id, term_key, proposed_term_en) FROM open_rows)""")
def conflict_log(t):
    open_rows = t["part"].select(
        (F.col("p_size") % 5).alias("workspace_id"), F.col("p_name").alias("term_key"), F.lit("ECONOMY").alias("proposed_term_en")).distinct()
    return gl.new_conflicts(fold(t), open_rows).drop("glossary_id")


@query("t8_glossary_list", """
    WITH c AS (SELECT glossary_id, count(*) AS n FROM fx_conflicts WHERE NOT resolved GROUP BY 1)
    SELECT id, workspace_id, term_vi, term_en, status, confidence, frequency, coalesce(n, 0) AS n_conflicts
    FROM fx_glossary g LEFT JOIN c ON c.glossary_id = g.id WHERE status <> 'skipped'""")
def glossary_list(t):
    return gl.list_terms(t["fx_glossary"], t["fx_conflicts"]).select(
        "id", "workspace_id", "term_vi", "term_en", "status", "confidence", "frequency", "n_conflicts")


@query("t8_open_conflicts", """
    SELECT g.id, g.workspace_id, c.id AS conflict_id, c.proposed_term_en, c.confidence AS proposed_confidence
    FROM fx_glossary g JOIN fx_conflicts c ON c.glossary_id = g.id WHERE NOT resolved""")
def open_conflicts(t):
    return gl.open_conflicts_of(t["fx_glossary"], t["fx_conflicts"]).select(
        "id", "workspace_id", "conflict_id", "proposed_term_en", "proposed_confidence")


@query("t9_glossary_stats", """
    WITH a AS (SELECT workspace_id, count(*) AS total, count(*) FILTER (status = 'expert_edited') AS expert_edited,
                      count(*) FILTER (confidence = 'aligned_from_parallel') AS aligned_from_parallel,
                      count(*) FILTER (pronunciation <> '') AS with_pronunciation, count(*) FILTER (source_type = 'web') AS from_web,
                      count(*) FILTER (source_type = 'document') AS from_document FROM fx_glossary WHERE status <> 'skipped' GROUP BY 1),
    c AS (SELECT g.workspace_id, count(*) AS n FROM fx_conflicts c JOIN fx_glossary g ON g.id = c.glossary_id WHERE NOT resolved GROUP BY 1)
    SELECT a.*, coalesce(c.n, 0) AS conflicts FROM a LEFT JOIN c ON c.workspace_id = a.workspace_id""")
def glossary_stats(t):
    return gl.stats(t["fx_glossary"], t["fx_conflicts"])


@query("t10_by_category", """
    SELECT workspace_id, category, count(*) AS n FROM fx_glossary WHERE status <> 'skipped' GROUP BY 1, 2""")
def by_category(t):
    return gl.by_category(t["fx_glossary"])


MERGED = """
    m AS (SELECT id, arg_max(action, seq) AS last_action,
                 arg_max(term_vi, seq) FILTER (action = 'update' AND term_vi IS NOT NULL) AS n_vi,
                 arg_max(term_en, seq) FILTER (action = 'update' AND term_en IS NOT NULL) AS n_en,
                 arg_max(pronunciation, seq) FILTER (action = 'update' AND pronunciation IS NOT NULL) AS n_pr,
                 arg_max(category, seq) FILTER (action = 'update' AND category IS NOT NULL) AS n_cat
          FROM fx_term_edits WHERE action <> 'create' GROUP BY 1)"""


@query("t11_term_edits", f"""
    WITH {MERGED},
    e AS (SELECT g.id, workspace_id, coalesce(n_vi, term_vi) AS term_vi, CASE WHEN n_vi IS NULL THEN term_vi_norm ELSE {squash('n_vi')} END AS term_vi_norm,
                 coalesce(n_en, term_en) AS term_en, coalesce(n_pr, pronunciation) AS pronunciation, coalesce(n_cat, category) AS category,
                 CASE last_action WHEN 'skip' THEN 'skipped' WHEN 'update' THEN 'expert_edited' ELSE status END AS status, n_vi
          FROM fx_glossary g LEFT JOIN m ON m.id = g.id)
    SELECT id, workspace_id, term_vi, term_vi_norm, term_en, pronunciation, category, status,
           n_vi IS NOT NULL AND count(*) OVER (PARTITION BY workspace_id, term_vi_norm) > 1 AS key_collision FROM e""")
def term_edits(t):
    return gl.apply_edits(t["fx_glossary"], t["fx_term_edits"]).select(
        "id", "workspace_id", "term_vi", "term_vi_norm", "term_en", "pronunciation", "category", "status", "key_collision")


@query("t11_term_creates", f"""
    WITH e AS (SELECT workspace_id, seq, CASE WHEN seq % 4 = 0 THEN (SELECT min(term_vi) FROM fx_glossary) ELSE 'new ' || CAST(id AS VARCHAR) END AS term_vi
               FROM fx_term_edits WHERE action = 'create'),
    k AS (SELECT *, {squash('term_vi')} AS term_vi_norm FROM e),
    f AS (SELECT *, min(seq) OVER (PARTITION BY workspace_id, term_vi_norm) AS first_seq FROM k)
    SELECT f.workspace_id, f.seq, f.term_vi_norm, g.id IS NULL AND f.seq = first_seq AS accepted
    FROM f LEFT JOIN fx_glossary g ON g.workspace_id = f.workspace_id AND g.term_vi_norm = f.term_vi_norm""")
def term_creates(t):
    edits = t.sql("""SELECT workspace_id, seq, action, pronunciation, definition, category, 'x' AS term_en,
                     CASE WHEN seq % 4 = 0 THEN (SELECT min(term_vi) FROM {fx_glossary}) ELSE 'new ' || CAST(id AS STRING) END AS term_vi
                     FROM {fx_term_edits}""")
    return gl.create_terms(t["fx_glossary"], edits).select("workspace_id", "seq", "term_vi_norm", "accepted")


@query("t12_conflict_resolutions", """
    WITH r AS (SELECT c.*, c.id % 3 <> 0 AS accept FROM fx_conflicts c WHERE NOT resolved),
    m AS (SELECT glossary_id, arg_max(proposed_term_en, id) FILTER (accept) AS en,
                 arg_max(proposed_definition, id) FILTER (accept AND coalesce(proposed_definition, '') <> '') AS def FROM r GROUP BY 1)
    SELECT g.id, coalesce(m.en, g.term_en) AS term_en, coalesce(m.def, g.definition) AS definition,
           CASE WHEN m.glossary_id IS NOT NULL THEN 'expert_edited' ELSE g.status END AS status
    FROM fx_glossary g LEFT JOIN m ON m.glossary_id = g.id""")
def conflict_resolutions(t):
    pending = t["fx_conflicts"].filter(~F.col("resolved"))
    decisions = pending.select(F.col("id").alias("conflict_id"), (F.col("id") % 3 != 0).alias("accept"), F.col("id").alias("seq"))
    return gl.resolve_conflicts(t["fx_glossary"], t["fx_conflicts"], decisions).glossary.select("id", "term_en", "definition", "status")


@query("t13_term_threshold", """
    SELECT workspace_id, count(*) AS n_terms, count(*) FILTER (confidence = 'aligned_from_parallel') AS n_aligned, count(*) < 15 AS below_threshold
    FROM fx_glossary WHERE status <> 'skipped' GROUP BY 1""")
def term_threshold(t):
    return gl.term_threshold(t["fx_glossary"])


@query("t14_term_search", """
    SELECT id, workspace_id, term_vi, term_en FROM fx_glossary
    WHERE term_vi ILIKE '%bolt%' OR term_en ILIKE '%bolt%' OR coalesce(definition, '') ILIKE '%bolt%'""")
def term_search(t):
    return gl.find_terms(t["fx_glossary"], " BOLT ").select("id", "workspace_id", "term_vi", "term_en")


@query("t15_top_terms", """
    SELECT workspace_id, id, row_number() OVER w AS rank FROM fx_glossary WHERE status <> 'skipped'
    WINDOW w AS (PARTITION BY workspace_id ORDER BY CASE status WHEN 'expert_edited' THEN 0 ELSE 1 END,
                 CASE confidence WHEN 'aligned_from_parallel' THEN 0 ELSE 1 END, frequency DESC, id) QUALIFY row_number() OVER w <= 24""")
def top_terms(t):
    return gl.top_terms(t["fx_glossary"]).select("workspace_id", "id", "rank")


SPOKEN = f"""
    s AS (SELECT workspace_id, id, {strip('pronunciation')} AS hint, unnest([0, 1]) AS side, unnest([{strip('term_en')}, {strip('term_vi')}]) AS surface
          FROM fx_glossary WHERE status <> 'skipped' AND {strip("coalesce(pronunciation, '')")} <> ''),
    spoken AS (SELECT workspace_id, surface, hint, id AS first_id, side FROM s WHERE length(surface) >= 2 AND lower(surface) <> lower(hint)
               QUALIFY row_number() OVER (PARTITION BY workspace_id, surface ORDER BY id, side) = 1)"""


@query("t16_pronunciation_map", f"WITH {SPOKEN} SELECT * FROM spoken")
def pronunciation_map(t):
    return gl.pronunciation_map(t["fx_glossary"])


# One fold per text over the surfaces of its workspace, the longest first, on the running text.
@query("t17_apply_pronunciation", rf"""
    WITH {SPOKEN},
    rules AS (SELECT workspace_id, list({{'spoken': surface, 'applied': hint}} ORDER BY length(surface) DESC, first_id, side, surface) AS r
              FROM (SELECT * FROM spoken UNION ALL SELECT DISTINCT p_partkey % 7, substr(p_brand, 7) || ' end', 'fin', 0, 2 FROM part) m GROUP BY 1),
    texts AS (SELECT p_partkey % 7 AS workspace_id, p_partkey AS text_id, p_size % 5 <> 0 AS vi,
                     p_type || ' ' || upper(p_name) || ', ' || p_name || ' ' || CAST(p_partkey AS VARCHAR) || ' end.' AS text FROM part),
    folded AS (SELECT t.workspace_id, text_id, list_reduce(list_prepend({{'spoken': text, 'applied': ''}}, CASE WHEN vi THEN coalesce(r, []) ELSE [] END), lambda a, x:
        CASE WHEN contains(lower(a.spoken), lower(x.spoken)) AND regexp_matches(a.spoken, '(?i)\b' || regexp_escape(x.spoken) || '\b')
             THEN {{'spoken': regexp_replace(a.spoken, '(?i)\b' || regexp_escape(x.spoken) || '\b', x.applied, 'g'),
                   'applied': CASE WHEN a.applied = '' THEN '' ELSE a.applied || '|' END || x.spoken}} ELSE a END) AS f
        FROM texts t LEFT JOIN rules ON rules.workspace_id = t.workspace_id)
    SELECT workspace_id, text_id, f.spoken AS spoken, f.applied AS applied FROM folded""")
def apply_pronunciation(t):
    """Part lists as Vietnamese texts, spoken with the hints of their workspace; some surfaces span a hint and a word of the text."""
    texts = t["part"].select(
        (F.col("p_partkey") % 7).alias("workspace_id"), F.col("p_partkey").alias("text_id"),
        F.when(F.col("p_size") % 5 == 0, "en").otherwise("vi").alias("lang"),
        F.concat("p_type", F.lit(" "), F.upper("p_name"), F.lit(", "), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" end.")).alias("text"))
    across = t["part"].select(
        (F.col("p_partkey") % 7).alias("workspace_id"), F.concat(F.substring("p_brand", 7, 99), F.lit(" end")).alias("surface"),
        F.lit("fin").alias("hint"), F.lit(0).cast("bigint").alias("first_id"), F.lit(2).alias("side")).distinct()
    spoken = gl.apply_pronunciation(texts, gl.pronunciation_map(t["fx_glossary"]).unionByName(across))
    return spoken.select("workspace_id", "text_id", "spoken", F.array_join("applied", "|").alias("applied"))
