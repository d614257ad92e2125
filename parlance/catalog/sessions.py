"""Session operators on the driver tables."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import feedback as fb
from ..operators import scoring as sc
from .registry import query
from .sqltext import half_up, mean, row_mean_tenths, squash, strip, term_key

A = [f"a_{c}" for c in fb.CRITERIA]

CHECKS = r"""
    w AS (SELECT *, len(list_filter(string_split_regex(source_text, '\s+'), lambda x: x <> '')) AS n_words FROM fx_turns),
    s AS (SELECT *, CASE WHEN source_lang = 'vi' THEN (2 * n_words * 600 + 228) // 456 ELSE (2 * n_words * 600 + 158) // 316 END AS tenths FROM w),
    c AS (SELECT *, tenths < 240 AS too_short, tenths > 780 AS too_long, trim(reference_translation) = '' AS missing_reference FROM s)"""


@query("m1_speaking_time", f"WITH {CHECKS} SELECT turn_id, tenths / 10.0 AS seconds FROM c")
def speaking_time(t):
    seconds = tx.speaking_seconds(F.col("source_text"), F.col("source_lang"))
    return t["fx_turns"].select("turn_id", seconds.cast("double").alias("seconds"))


@query("m2_sentence_count", r"""
    SELECT doc_id, greatest(1, len(list_filter(string_split_regex(text, '[.!?…]+(\s|$)'), lambda p: regexp_replace(p, '\s', '', 'g') <> ''))) AS n FROM documents""")
def sentence_count(t):
    return t["documents"].select("doc_id", tx.sentence_count(F.col("text")).alias("n"))


@query("m3_turn_bounds", f"WITH {CHECKS} SELECT turn_id, too_short, too_long, missing_reference FROM c")
def turn_bounds(t):
    return sc.turn_checks(t["fx_turns"]).select("turn_id", "too_short", "too_long", "missing_reference")


@query("m4_problem_turns", f"""
    WITH {CHECKS}
    SELECT session_id, turn_index + 1 AS turn_no, 'too_short' AS problem FROM c WHERE too_short
    UNION ALL SELECT session_id, turn_index + 1, 'too_long' FROM c WHERE too_long
    UNION ALL SELECT session_id, turn_index + 1, 'missing_reference' FROM c WHERE missing_reference""")
def problem_turns(t):
    return sc.problem_turns(t["fx_turns"])


def turn_names(t):
    """Names used in a turn: the two-word part names made of the order lines of that session."""
    return t.sql("""SELECT l_orderkey AS session_id, l_partkey % 7 AS workspace_id, l_linenumber AS turn_index,
                    array(concat(p_name, ' ', CAST(p_partkey AS STRING)), 'unknown term',
                          concat(upper(p_name), ', ', CAST(p_partkey AS STRING), '!')) AS names
                    FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""")


NAMED = f"""
    names AS (SELECT l_orderkey AS session_id, l_partkey % 7 AS workspace_id, l_linenumber AS turn_index, unnest([0, 1, 2]) AS position,
                     unnest([p_name || ' ' || CAST(p_partkey AS VARCHAR), 'unknown term', upper(p_name) || ', ' || CAST(p_partkey AS VARCHAR) || '!']) AS name
              FROM lineitem JOIN part ON p_partkey = l_partkey),
    matched AS (SELECT n.session_id, n.workspace_id, n.turn_index, n.position, g.id AS glossary_id FROM names n
                JOIN fx_glossary g ON g.workspace_id = n.workspace_id AND g.term_vi_norm = {term_key('n.name')})"""


@query("m4_script_report", f"""
    WITH {CHECKS}, k AS (SELECT session_id, count(*) AS n_turns, count(*) FILTER (source_lang = 'vi') AS n_vi, count(*) FILTER (source_lang = 'en') AS n_en,
        count(*) FILTER (too_short) AS n_too_short, count(*) FILTER (too_long) AS n_too_long, count(*) FILTER (missing_reference) AS n_missing_reference FROM c GROUP BY 1),
    {NAMED}, u AS (SELECT session_id, count(DISTINCT glossary_id) AS n_terms FROM matched GROUP BY 1),
    r AS (SELECT k.*, 6 AS expected, abs(n_turns - 6) > 1 AS wrong_count, n_vi = 0 OR n_en = 0 AS one_direction, coalesce(n_terms, 0) AS n_terms,
                 greatest(2, CAST(floor(n_turns * 0.75) AS INT)) AS required_terms FROM k LEFT JOIN u ON u.session_id = k.session_id)
    SELECT *, n_terms < required_terms AS too_few_terms,
           CAST(wrong_count AS INT) + CAST(one_direction AS INT) + CAST(n_too_short > 0 AS INT) + CAST(n_too_long > 0 AS INT)
           + CAST(n_missing_reference > 0 AS INT) + CAST(n_terms < required_terms AS INT) AS n_problems FROM r""")
def script_report(t):
    turns = t["fx_turns"]
    expected = turns.select("session_id").distinct().withColumn("expected", F.lit(6))
    used = sc.distinct_terms(sc.matched_terms(turn_names(t), t["fx_glossary"]))
    return sc.script_report(turns, expected, used)


@query("m5_verbatim", f"""
    WITH b AS (SELECT item_id, text, {squash('text')} AS norm FROM benchmark), d AS (SELECT doc_id, {squash('text')} AS norm FROM documents),
    h AS (SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM b JOIN d ON contains(d.norm, b.norm) WHERE b.norm <> '' GROUP BY 1)
    SELECT b.item_id AS candidate_id, h.n IS NOT NULL AS is_verbatim, coalesce(h.n, 0) AS n_documents, first_doc AS first_doc_id
    FROM b LEFT JOIN h ON h.item_id = b.item_id""")
def verbatim(t):
    candidates = t["benchmark"].select(F.col("item_id").alias("candidate_id"), "text")
    found = sc.verbatim(candidates, t["documents"].select("doc_id", "text"))
    return found.drop("text")


@query("m6_first_parallel", """
    WITH f AS (SELECT workspace_id, min(doc_id) AS doc_id FROM fx_doc_list WHERE status = 'ready' AND language = 'parallel' GROUP BY 1),
    x AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) FILTER (lang = 'vi') AS vi, string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) FILTER (lang = 'en') AS en
          FROM fx_turn_chunks GROUP BY 1)
    SELECT workspace_id, f.doc_id, length(vi) AS n_vi, length(en) AS n_en FROM f JOIN x ON x.doc_id = f.doc_id WHERE vi IS NOT NULL AND en IS NOT NULL""")
def first_parallel(t):
    from ..operators import documents as docs

    texts = docs.document_texts(t["fx_doc_list"], t["fx_turn_chunks"])
    return sc.first_parallel_document(t["fx_doc_list"], texts).select(
        "workspace_id", "doc_id", F.length("vi_text").alias("n_vi"), F.length("en_text").alias("n_en"))


@query("m7_reference_tier", f"""
    WITH b AS (SELECT item_id, length(text) % 2 = 0 AS claimed, {squash('text')} AS norm FROM benchmark), d AS (SELECT {squash('text')} AS norm FROM documents)
    SELECT item_id, CASE WHEN claimed AND norm <> '' AND EXISTS (SELECT 1 FROM d WHERE contains(d.norm, b.norm)) THEN 'verbatim_parallel' ELSE 'ai' END AS tier FROM b""")
def reference_tier(t):
    candidates = t["benchmark"].select(F.col("item_id").alias("candidate_id"), "text")
    found = sc.verbatim(candidates, t["documents"].select("doc_id", "text"))
    tier = sc.reference_tier(F.length("text") % 2 == 0, F.col("is_verbatim"))
    return found.select(F.col("candidate_id").alias("item_id"), tier.alias("tier"))


@query("m8_matched_terms", f"WITH {NAMED} SELECT * FROM matched")
def matched_terms(t):
    return sc.matched_terms(turn_names(t), t["fx_glossary"])


@query("m9_session_list", """
    SELECT workspace_id, id, row_number() OVER w AS rank FROM fx_sessions
    WINDOW w AS (PARTITION BY workspace_id ORDER BY created_at DESC, id DESC) QUALIFY row_number() OVER w <= 5""")
def session_list(t):
    return sc.list_sessions(t["fx_sessions"], 5).select("workspace_id", "id", "rank")


@query("m10_latest_attempts", """
    WITH t AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS turn_id, l_orderkey AS session_id FROM lineitem),
    a AS (SELECT l_orderkey * 10 + l_linenumber AS attempt_id, l_partkey, l_suppkey, CAST(l_quantity / 5 AS DECIMAL(4,1)) AS a_meaning
          FROM lineitem WHERE l_linestatus = 'F'
          QUALIFY row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1)
    SELECT t.turn_id, t.session_id, a.l_partkey, a.l_suppkey, CAST(a.a_meaning AS DOUBLE) AS a_meaning FROM t LEFT JOIN a ON a.attempt_id = t.turn_id""")
def latest_attempts(t):
    turns = t["lineitem"].select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("turn_id"), F.col("l_orderkey").alias("session_id")).distinct()
    attempts = t.sql("""SELECT l_orderkey * 10 + l_linenumber AS turn_id, l_shipdate AS created_at, l_partkey, l_suppkey,
                        CAST(l_quantity / 5 AS DECIMAL(4,1)) AS a_meaning FROM {lineitem} WHERE l_linestatus = 'F'""")
    return sc.latest_attempts(turns, attempts, ["created_at", "l_partkey", "l_suppkey"]).select(
        "turn_id", "session_id", "l_partkey", "l_suppkey", F.col("a_meaning").cast("double").alias("a_meaning"))


@query("m11_session_state", """
    WITH a AS (SELECT l_orderkey AS session_id, min(l_shipdate) AS started_at, max(l_shipdate) AS last_at, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS id, strftime(started_at, '%Y-%m-%d') AS started_day, coalesce(n, 0) AS n_attempts,
           CASE WHEN o_orderstatus = 'F' AND (last_at IS NULL OR o_orderdate + INTERVAL 60 DAY >= last_at) THEN 'completed'
                WHEN last_at IS NOT NULL THEN 'in_progress' ELSE 'generated' END AS status
    FROM orders LEFT JOIN a ON a.session_id = o_orderkey""")
def session_state(t):
    sessions = t["orders"].select(F.col("o_orderkey").alias("session_id"))
    attempts = t["fx_verdicts"].select("session_id", "created_at")
    completions = t["orders"].filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("session_id"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("completed_at"))
    return sc.session_state(sessions, attempts, completions).select(
        F.col("session_id").alias("id"), F.date_format("started_at", "yyyy-MM-dd").alias("started_day"), "n_attempts", "status")


@query("m12_effective_transcript", f"""
    WITH e AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN '' WHEN n_chars % 3 = 1 THEN '  ' || source ELSE NULL END AS edited,
                      CASE WHEN n_chars % 2 = 0 THEN text END AS raw FROM documents)
    SELECT doc_id, sha256(nullif({strip("coalesce(nullif(edited, ''), raw, '')")}, '')) AS transcript_hash,
           nullif({strip("coalesce(nullif(edited, ''), raw, '')")}, '') IS NOT NULL AS scorable FROM e""")
def effective_transcript(t):
    edited = F.when(F.col("n_chars") % 3 == 0, "").when(F.col("n_chars") % 3 == 1, F.concat(F.lit("  "), "source"))
    raw = F.when(F.col("n_chars") % 2 == 0, F.col("text"))
    return t["documents"].select("doc_id", sc.effective_transcript(edited, raw).alias("x")).select(
        "doc_id", F.sha2("x", 256).alias("transcript_hash"), F.col("x").isNotNull().alias("scorable"))


PINNED = r"""
    pinned AS (SELECT d.doc_id AS attempt_id, split_part(b.text, ' ', 2) AS term_vi, split_part(b.text, ' ', 1) AS term_en,
                      CASE WHEN d.lang = 'en' THEN 'en' ELSE 'vi' END AS target_lang, d.text AS user_translation
               FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
    given AS (SELECT doc_id AS attempt_id, split_part(text, ' ', 3) AS term_vi, 'given' AS expected, 'x' AS used, n_chars % 2 = 0 AS correct
              FROM documents
              UNION ALL SELECT d.doc_id, split_part(b.text, ' ', 2), 'given', 'y', d.n_chars % 3 = 0 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40
              WHERE d.n_chars % 2 = 1 AND split_part(d.text, ' ', 3) <> split_part(b.text, ' ', 2))"""


def pinned(t):
    return t.sql("""SELECT d.doc_id AS attempt_id, split_part(b.text, ' ', 2) AS term_vi, split_part(b.text, ' ', 1) AS term_en,
                    CASE WHEN d.lang = 'en' THEN 'en' ELSE 'vi' END AS target_lang, d.text AS user_translation
                    FROM {documents} d JOIN {benchmark} b ON b.item_id = d.doc_id % 40""")


def given(t):
    return t.sql("""SELECT doc_id AS attempt_id, split_part(text, ' ', 3) AS term_vi, 'given' AS expected, 'x' AS used, n_chars % 2 = 0 AS correct
                    FROM {documents}
                    UNION ALL SELECT d.doc_id, split_part(b.text, ' ', 2), 'given', 'y', d.n_chars % 3 = 0 FROM {documents} d JOIN {benchmark} b ON b.item_id = d.doc_id % 40
                    WHERE d.n_chars % 2 = 1 AND split_part(d.text, ' ', 3) <> split_part(b.text, ' ', 2)""")


LOOSE = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')"


@query("m13_loose_containment", f"""
    WITH {PINNED} SELECT attempt_id, contains({LOOSE.format('user_translation')}, {strip(LOOSE.format('term_en'))}) AS has_en,
           contains({LOOSE.format('user_translation')}, {strip(LOOSE.format('term_vi'))}) AS has_vi FROM pinned""")
def loose_containment(t):
    text = F.col("user_translation")
    return pinned(t).select("attempt_id", tx.contains_loosely(text, F.col("term_en")).alias("has_en"),
                            tx.contains_loosely(text, F.col("term_vi")).alias("has_vi"))


@query("m14_turn_terms", """
    SELECT DISTINCT l_orderkey * 10 + l_linenumber AS turn_id, g.id AS glossary_id, g.term_en, g.status
    FROM lineitem JOIN fx_glossary g ON g.id IN (l_partkey, l_partkey + 1) WHERE l_returnflag <> 'N'""")
def turn_terms(t):
    turns = t.sql("""SELECT l_orderkey * 10 + l_linenumber AS turn_id,
                     CASE WHEN l_returnflag = 'N' THEN '[broken' ELSE concat('[', l_partkey, ',', l_partkey + 1, ',', l_partkey, ']') END AS terms_used
                     FROM {lineitem}""")
    return sc.turn_terms(turns, t["fx_glossary"]).select("turn_id", "glossary_id", "term_en", "status").distinct()


OVERRIDE = f"""
    {PINNED},
    really AS (SELECT attempt_id, term_vi, CASE WHEN target_lang = 'en' THEN term_en ELSE term_vi END AS should,
                      contains({LOOSE.format('user_translation')}, {strip(LOOSE.format("CASE WHEN target_lang = 'en' THEN term_en ELSE term_vi END"))}) AS really_used FROM pinned),
    merged AS (SELECT coalesce(g.attempt_id, r.attempt_id) AS attempt_id, coalesce(g.term_vi, r.term_vi) AS term_vi, coalesce(g.expected, r.should) AS expected,
                      CASE WHEN g.attempt_id IS NOT NULL THEN g.used WHEN really_used THEN should ELSE '' END AS used,
                      coalesce(really_used, g.correct) AS correct, r.attempt_id IS NOT NULL AS pinned,
                      coalesce(r.attempt_id IS NOT NULL AND g.correct <> really_used, false) AS overridden, g.attempt_id IS NULL AS added
               FROM given g FULL JOIN really r ON r.attempt_id = g.attempt_id AND r.term_vi = g.term_vi)"""


@query("m15_pinned_override", f"WITH {OVERRIDE} SELECT * FROM merged")
def pinned_override(t):
    return sc.override_pinned(given(t), pinned(t))


def raw_scores(t):
    return t["documents"].select(
        F.col("doc_id").alias("attempt_id"), (F.col("n_chars") % 137 / 10 - 1).alias("score_meaning"),
        (F.col("n_chars") % 111 / 10).alias("score_terminology"), (F.col("n_chars") % 90 / 10).alias("score_completeness"),
        (F.col("n_chars") % 250 / 20).alias("score_expression"))


CLAMPED = """
    tenths AS (SELECT doc_id AS attempt_id, least(100, greatest(0, n_chars % 137 - 10)) AS m, least(100, n_chars % 111) AS t, n_chars % 90 AS c,
                      least(100, (n_chars % 250 + 1) // 2) AS e FROM documents)"""


@query("m16_clamped_scores", f"WITH {CLAMPED} SELECT attempt_id, m / 10.0 AS meaning, t / 10.0 AS terminology, c / 10.0 AS completeness, e / 10.0 AS expression FROM tenths")
def clamped_scores(t):
    from ..functions.numbers import clamp_score

    return raw_scores(t).select("attempt_id", *[clamp_score(F.col(f"score_{c}")).cast("double").alias(c) for c in fb.CRITERIA])


@query("m17_final_scores", f"""
    WITH {OVERRIDE}, {CLAMPED}, w AS (SELECT attempt_id, count(*) FILTER (NOT correct) AS n_wrong FROM merged WHERE pinned GROUP BY 1),
    l AS (SELECT x.*, coalesce(n_wrong, 0) AS n_wrong, CASE WHEN n_wrong > 0 THEN least(t, greatest(0, 100 - 25 * n_wrong)) ELSE t END AS lim
          FROM tenths x LEFT JOIN w ON w.attempt_id = x.attempt_id)
    SELECT attempt_id, n_wrong, lim / 10.0 AS score_terminology, lim < t AS was_limited, ((m + lim + c + e) * 2 + 4) // 8 / 10.0 AS score_overall FROM l""")
def final_scores(t):
    return sc.final_scores(raw_scores(t), sc.override_pinned(given(t), pinned(t))).select(
        "attempt_id", "n_wrong", F.col("score_terminology").cast("double").alias("score_terminology"), "was_limited",
        F.col("score_overall").cast("double").alias("score_overall"))


@query("m18_overall", f"SELECT session_id, attempt_id, l_partkey, l_suppkey, ({row_mean_tenths(A)}) / 10.0 AS overall FROM fx_scores")
def overall(t):
    return fb.machine_overall(t["fx_scores"]).select(
        "session_id", "attempt_id", "l_partkey", "l_suppkey", F.col("a_overall").cast("double").alias("overall"))


REPORT = f"""
    o AS (SELECT *, ({row_mean_tenths(A)}) AS tenths FROM fx_scores),
    r AS (SELECT session_id, count(DISTINCT turn_index) AS n_turns, count(*) AS n_scored, {', '.join(f'{mean(a)} AS mean_{a[2:]}' for a in A)},
                 {half_up('CAST(sum(tenths) AS BIGINT)', 'count(tenths)', 1)} AS overall FROM o GROUP BY 1)"""


def report(t):
    scores = fb.machine_overall(t["fx_scores"]).withColumnRenamed("attempt_id", "turn_id")
    return sc.session_report(scores.select("session_id", "turn_id", "turn_index"), scores)


@query("m19_session_report", f"WITH {REPORT} SELECT * FROM r")
def session_report(t):
    return report(t)


@query("m19_write_back", f"WITH {REPORT} SELECT id, coalesce(r.overall, s.overall_score) AS overall_score FROM fx_sessions s LEFT JOIN r ON r.session_id = s.id")
def write_back(t):
    return sc.write_back_overall(t["fx_sessions"], report(t)).select("id", "overall_score")


def _verdict_json(t):
    """Scores with JSON verdicts: the part of the line, its brand, a blank name; some texts are broken."""
    rows = t["lineitem"].join(t["part"], F.col("p_partkey") == F.col("l_partkey"))
    term = F.struct(F.col("p_name").alias("term_vi"), F.col("p_type").alias("expected_en"), (F.col("l_tax") > 0.04).alias("correct"))
    brand = F.struct(F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("term_vi"), F.concat(F.lit("b"), "l_linenumber").alias("expected_en"),
                     F.lit(None).cast("boolean").alias("correct"))
    blank = F.struct(F.lit(" ").alias("term_vi"), F.lit(None).cast("string").alias("expected_en"), F.lit(False).alias("correct"))
    payload = F.to_json(F.struct(F.array(term, brand, blank).alias("terms"), F.array().cast("array<string>").alias("missing")))
    return rows.select(
        F.col("l_orderkey").alias("session_id"), (F.col("l_suppkey") % 10).alias("workspace_id"),
        (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        F.when(F.col("l_suppkey") % 11 == 0, "not json").when(F.col("l_suppkey") % 11 != 1, payload).alias("term_verdicts"))


WRONG = """
    x AS (SELECT l_orderkey AS session_id, l_suppkey % 10 AS workspace_id, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS seq,
                 p_name, p_type, p_brand, l_linenumber, l_tax > 0.04 AS ok FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 11 > 1),
    wrong AS (SELECT session_id, workspace_id, seq, 0 AS pos, p_name AS term, p_type AS expected FROM x WHERE NOT ok
              UNION ALL SELECT session_id, workspace_id, seq, 1, ' ' || p_brand || ' ', 'b' || CAST(l_linenumber AS VARCHAR) FROM x
              UNION ALL SELECT session_id, workspace_id, seq, 2, ' ', NULL FROM x)"""


@query("m20_terms_to_review", f"""
    WITH {WRONG} SELECT session_id, term AS term_vi, count(*) AS wrong_times, (min({{'s': seq, 'p': pos, 'e': expected}})).e AS expected FROM wrong GROUP BY 1, 2""")
def terms_to_review(t):
    return sc.wrong_terms(_verdict_json(t), ["session_id"])


@query("b5_top_wrong_terms", f"""
    WITH {WRONG}, g AS (SELECT workspace_id, trim(term) AS term_vi, count(*) AS wrong_times, (min({{'s': seq, 'p': pos, 'e': expected}})).e AS expected
                        FROM wrong WHERE trim(term) <> '' GROUP BY 1, 2)
    SELECT *, row_number() OVER w AS rank FROM g WINDOW w AS (PARTITION BY workspace_id ORDER BY wrong_times DESC, term_vi) QUALIFY row_number() OVER w <= 12""")
def top_wrong_terms(t):
    return sc.top_wrong_terms(_verdict_json(t))


def model_outputs(t):
    plain = F.to_json(F.struct(F.col("doc_id").alias("answer_id"), "lang", F.when(F.col("n_chars") % 5 != 0, F.col("n_chars")).alias("score")))
    fenced = F.concat(F.lit("```json\n"), plain, F.lit("\n```"))
    raw = F.when(F.col("n_chars") % 4 == 0, fenced).when(F.col("n_chars") % 4 == 1, F.lit("I cannot answer")).otherwise(plain)
    return t["documents"].select(F.col("doc_id").alias("output_id"), raw.alias("raw"))


@query("m21_repaired_output", """
    SELECT doc_id AS output_id, n_chars % 4 <> 1 AND n_chars % 5 <> 0 AS valid, CASE WHEN n_chars % 4 <> 1 AND n_chars % 5 <> 0 THEN lang END AS lang,
           CASE WHEN n_chars % 4 <> 1 AND n_chars % 5 <> 0 THEN n_chars END AS score FROM documents""")
def repaired_output(t):
    valid, rejected = sc.repair_output(model_outputs(t), "answer_id bigint, lang string, score bigint", ["answer_id", "score"])
    return valid.select("output_id", F.lit(True).alias("valid"), "parsed.lang", "parsed.score").unionByName(
        rejected.select("output_id", F.lit(False).alias("valid"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("bigint").alias("score")))


@query("m22_history_summary", """
    SELECT workspace_id, count(*) AS n_sessions, count(overall_score) AS n_scored, max(overall_score) AS best_score,
           count(*) FILTER (status = 'in_progress') AS n_in_progress FROM fx_sessions GROUP BY 1""")
def history_summary(t):
    return sc.history_summary(t["fx_sessions"])
