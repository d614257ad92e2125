"""Feedback operators on the driver tables."""

from pyspark.sql import functions as F

from ..operators import feedback as fb
from .registry import query
from .sqltext import half_up, row_mean_tenths

A = [f"a_{c}" for c in fb.CRITERIA]
E = [f"e_{c}" for c in fb.CRITERIA]

# every verdict with every score of its attempt; values in tenths
PAIRS = f"""
    v AS (SELECT *, ({row_mean_tenths(E)}) AS e_tenths FROM fx_verdicts),
    s AS (SELECT *, ({row_mean_tenths(A)}) AS a_tenths FROM fx_scores),
    pairs AS (SELECT v.*, s.a_tenths, {', '.join(f's.{a}' for a in A)} FROM v JOIN s ON s.attempt_id = v.attempt_id)"""
GAPS = " UNION ALL ".join(
    f"SELECT workspace_id, {i} AS no, '{c}' AS criterion, CAST((e_{c} - a_{c}) * 10 AS BIGINT) AS g FROM pairs" for i, c in enumerate(fb.CRITERIA))
GAPS = f"gaps AS ({GAPS})"


def pairs(t):
    return fb.compared(fb.expert_overall(t["fx_verdicts"]), fb.machine_overall(t["fx_scores"]))


@query("f1_attempt_context", """
    SELECT s.attempt_id, s.l_partkey, s.l_suppkey, o.id AS session_id, o.workspace_id FROM fx_scores s JOIN fx_sessions o ON o.id = s.session_id""")
def attempt_context(t):
    scores = t["fx_scores"].withColumn("turn_id", F.col("attempt_id"))
    turns = scores.select("turn_id", "session_id").distinct()
    return fb.attempt_context(scores.select("attempt_id", "turn_id", "l_partkey", "l_suppkey"), turns, t["fx_sessions"]).select(
        "attempt_id", "l_partkey", "l_suppkey", "session_id", "workspace_id")


@query("f2_dominant_category", """
    WITH d AS (SELECT DISTINCT l_orderkey AS turn_id, l_partkey AS glossary_id FROM lineitem),
    n AS (SELECT turn_id, category, count(*) AS n_terms FROM d JOIN fx_glossary g ON g.id = d.glossary_id WHERE category IS NOT NULL GROUP BY 1, 2)
    SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY n_terms DESC, category) = 1""")
def dominant_category(t):
    terms = t["lineitem"].select(F.col("l_orderkey").alias("turn_id"), F.col("l_partkey").alias("glossary_id"))
    return fb.dominant_category(terms, t["fx_glossary"])


@query("f3_expert_overall", f"SELECT verdict_id, ({row_mean_tenths(E)}) / 10.0 AS e_overall FROM fx_verdicts")
def expert_overall(t):
    return fb.expert_overall(t["fx_verdicts"]).select("verdict_id", F.col("e_overall").cast("double").alias("e_overall"))


@query("f4_latest_score", f"""
    SELECT attempt_id, l_partkey, l_suppkey, ({row_mean_tenths(A)}) / 10.0 AS a_overall FROM fx_scores
    QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY created_at DESC, l_partkey DESC, l_suppkey DESC) = 1""")
def latest_score(t):
    return fb.latest_score(fb.machine_overall(t["fx_scores"]), ["created_at", "l_partkey", "l_suppkey"]).select(
        "attempt_id", "l_partkey", "l_suppkey", F.col("a_overall").cast("double").alias("a_overall"))


@query("f5_contradictions", f"""
    WITH sc AS (SELECT attempt_id, created_at AS scored_at, l_partkey AS s_part, l_suppkey AS s_supp, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE ({row_mean_tenths(A)}) END AS a_tenths FROM fx_scores),
    l AS (SELECT attempt_id, a_tenths FROM sc QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY scored_at DESC, s_part DESC, s_supp DESC) = 1),
    r AS (SELECT *, ({row_mean_tenths(E)}) AS e_tenths FROM fx_verdicts WHERE trim(coalesce(note, '')) <> '' AND ({row_mean_tenths(E)}) IS NOT NULL),
    n AS (SELECT r.*, e_tenths - a_tenths AS dir FROM r JOIN l ON l.attempt_id = r.attempt_id WHERE abs(e_tenths - a_tenths) >= 10),
    o AS (SELECT r.*, e_tenths - a_tenths AS dir, scored_at, s_part, s_supp FROM r JOIN sc ON sc.attempt_id = r.attempt_id),
    p AS (SELECT n.workspace_id, n.verdict_id, n.dir AS new_dir, o.verdict_id AS old_verdict_id, o.dir AS old_dir,
                 row_number() OVER (PARTITION BY n.verdict_id ORDER BY o.created_at DESC, o.verdict_id DESC, scored_at DESC, s_part DESC, s_supp DESC) AS k
          FROM n JOIN o ON o.workspace_id = n.workspace_id AND (n.related_category IS NULL OR o.related_category = n.related_category)
               AND (o.created_at, o.verdict_id) < (n.created_at, n.verdict_id))
    SELECT workspace_id, verdict_id, old_verdict_id, old_dir / 10.0 AS old_gap, CASE WHEN old_dir > 0 THEN 'raised' ELSE 'lowered' END AS old_direction
    FROM p WHERE k <= 8 AND old_dir * new_dir < 0 AND abs(old_dir) >= 10""")
def contradictions(t):
    """Every score of an attempt counts among the eight, also one without an overall; a verdict asks with the newest."""
    scored = fb.machine_overall(t["fx_scores"]).select(
        "attempt_id", F.col("created_at").alias("scored_at"), F.col("l_partkey").alias("s_part"), F.col("l_suppkey").alias("s_supp"),
        F.when(F.col("l_suppkey") % 6 != 0, F.col("a_overall")).alias("a_overall"))
    given = fb.expert_overall(t["fx_verdicts"]).filter("e_overall IS NOT NULL").select(
        "workspace_id", "verdict_id", "attempt_id", "created_at", "note", F.col("related_category").alias("category"), "e_overall")
    rows = given.join(scored, "attempt_id").withColumn("direction", F.col("e_overall") - F.col("a_overall"))
    return fb.contradictions(rows, ["created_at"], ["scored_at", "s_part", "s_supp"])


@query("f6_pinned_translations", """
    WITH p AS (SELECT session_id AS turn_id, arg_max(note, verdict_id) AS pin FROM fx_verdicts WHERE trim(note) <> '' GROUP BY 1)
    SELECT o_orderkey AS turn_id, coalesce(pin, o_orderpriority) AS reference_translation, CASE WHEN pin IS NULL THEN 'ai' ELSE 'expert_pinned' END AS reference_tier
    FROM orders LEFT JOIN p ON p.turn_id = o_orderkey""")
def pinned_translations(t):
    turns = t["orders"].select(F.col("o_orderkey").alias("turn_id"), F.col("o_orderpriority").alias("reference_translation"), F.lit("ai").alias("reference_tier"))
    pins = t["fx_verdicts"].select(F.col("session_id").alias("turn_id"), "verdict_id", F.concat(F.lit(" "), "note").alias("pinned_translation"))
    return fb.pin_translations(turns, pins)


WANTED = """
    wanted AS (SELECT DISTINCT workspace_id, related_category AS category FROM fx_verdicts),
    ranked AS (SELECT w.workspace_id, w.category, p.verdict_id, p.note, p.related_category, p.e_tenths, p.a_tenths, p.score_no,
                 row_number() OVER (PARTITION BY w.workspace_id, w.category ORDER BY CASE WHEN p.related_category = w.category THEN 0 ELSE 1 END,
                                    p.created_at DESC, p.verdict_id DESC, p.score_no) AS rank
               FROM wanted w JOIN (SELECT *, row_number() OVER (PARTITION BY verdict_id ORDER BY a_tenths) AS score_no FROM pairs) p
               ON p.workspace_id = w.workspace_id WHERE trim(p.note) <> ''),
    chosen AS (SELECT * FROM ranked WHERE rank <= 12)"""


def relevant(t):
    """Newest first; re-scored attempts repeat a verdict, lower machine score first."""
    order = [F.col("created_at").desc(), F.col("verdict_id").desc(), F.col("a_overall")]
    wanted = t["fx_verdicts"].select("workspace_id", F.col("related_category").alias("category")).distinct()
    return fb.relevant_verdicts(pairs(t), wanted, order)


@query("f7_relevant_verdicts", f"WITH {PAIRS}, {WANTED} SELECT workspace_id, category, rank, verdict_id, note, a_tenths / 10.0 AS a_overall FROM chosen")
def relevant_verdicts(t):
    return relevant(t).select("workspace_id", "category", "rank", "verdict_id", "note", F.col("a_overall").cast("double").alias("a_overall"))


@query("f8_calibration_text", f"""
    WITH {PAIRS}, {WANTED},
    lines AS (SELECT workspace_id, category, rank, '- ' || CASE WHEN related_category IS NULL THEN '' ELSE '[' || related_category || '] ' END || trim(note) ||
              CASE WHEN e_tenths - a_tenths >= 5 THEN ' (lần đó bạn chấm CAO hơn AI ' || CAST(CAST((e_tenths - a_tenths) / 10.0 AS DECIMAL(4,1)) AS VARCHAR) || ' điểm)'
                   WHEN e_tenths - a_tenths <= -5 THEN ' (lần đó bạn chấm THẤP hơn AI ' || CAST(CAST((a_tenths - e_tenths) / 10.0 AS DECIMAL(4,1)) AS VARCHAR) || ' điểm)' ELSE '' END AS line FROM chosen)
    SELECT workspace_id, category, string_agg(line, chr(10) ORDER BY rank) AS calibration_text FROM lines GROUP BY 1, 2""")
def calibration_text(t):
    return fb.calibration_text(relevant(t))


@query("f9_divergence", f"""
    WITH {PAIRS}, {GAPS}
    SELECT workspace_id, criterion, count(g) AS n, {half_up('CAST(coalesce(sum(g), 0) AS BIGINT)', 'count(g)', 2)} AS mean_gap,
           {half_up('CAST(coalesce(sum(abs(g)), 0) AS BIGINT)', 'count(g)', 2)} AS mean_abs_gap, count(*) FILTER (abs(g) >= 5) AS times_adjusted
    FROM gaps GROUP BY 1, 2""")
def divergence(t):
    return fb.divergence(pairs(t))


@query("f10_timeline", f"""
    WITH {PAIRS}
    SELECT workspace_id, session_id, attempt_id, strftime(created_at, '%Y-%m-%d') AS day, action,
           {', '.join(f'CAST(e_{c} - a_{c} AS DOUBLE) AS gap_{c}' for c in fb.CRITERIA)}, a_tenths / 10.0 AS machine_overall, e_tenths / 10.0 AS expert_overall FROM pairs""")
def timeline(t):
    return fb.timeline(pairs(t)).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")).drop("created_at")


@query("f11_gap_trend", f"""
    WITH {PAIRS},
    o AS (SELECT workspace_id, abs(e_tenths - a_tenths) AS g, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at, verdict_id, a_tenths) AS k,
                 count(*) OVER (PARTITION BY workspace_id) AS n FROM pairs WHERE e_tenths IS NOT NULL AND a_tenths IS NOT NULL),
    h AS (SELECT workspace_id, max(n) AS n, CAST(sum(g) FILTER (k <= n // 2) AS BIGINT) AS s1, count(*) FILTER (k <= n // 2) AS n1,
                 CAST(sum(g) FILTER (k > n // 2) AS BIGINT) AS s2, count(*) FILTER (k > n // 2) AS n2 FROM o GROUP BY 1)
    SELECT workspace_id, n, CASE WHEN n >= 4 THEN {half_up('s1', 'n1', 1)} END AS early, CASE WHEN n >= 4 THEN {half_up('s2', 'n2', 1)} END AS late,
           CASE WHEN n < 4 THEN NULL WHEN s2 * n1 < s1 * n2 - 3 * n1 * n2 THEN 'narrowing' WHEN s2 * n1 > s1 * n2 + 3 * n1 * n2 THEN 'widening' ELSE 'flat' END AS trend FROM h""")
def gap_trend(t):
    order = [F.col("created_at"), F.col("verdict_id"), F.col("a_overall")]
    return fb.gap_trend(pairs(t), order)


@query("f12_heaviest_criterion", f"""
    WITH {PAIRS}, {GAPS}, totals AS (SELECT workspace_id, no, criterion, CAST(sum(abs(g)) AS BIGINT) AS total, count(*) FILTER (abs(g) >= 5) AS times_adjusted,
           {half_up('CAST(coalesce(sum(g), 0) AS BIGINT)', 'count(g)', 2)} AS mean_gap FROM gaps GROUP BY 1, 2, 3)
    SELECT workspace_id, criterion, total / 10.0 AS total_abs_gap, times_adjusted, mean_gap FROM totals WHERE total > 0
    QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY total DESC, no) = 1""")
def heaviest_criterion(t):
    return fb.heaviest_criterion(pairs(t))


@query("f13_verdict_counts", f"""
    WITH {PAIRS}, a AS (SELECT workspace_id, count(*) AS n_verdicts, count(*) FILTER (action = 'agree') AS n_agree FROM fx_verdicts GROUP BY 1),
    c AS (SELECT workspace_id, count(*) AS n_compared FROM pairs GROUP BY 1)
    SELECT a.workspace_id, n_verdicts, n_agree, coalesce(n_compared, 0) AS n_compared FROM a LEFT JOIN c ON c.workspace_id = a.workspace_id""")
def verdict_counts(t):
    return fb.verdict_counts(t["fx_verdicts"], pairs(t))


@query("f14_reset_calibration", """
    WITH w AS (SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS workspace_id FROM nation)
    SELECT v.workspace_id, verdict_id, CASE WHEN w.workspace_id IS NOT NULL AND trim(note) <> '' THEN NULL ELSE note END AS note,
           w.workspace_id IS NOT NULL AND trim(note) <> '' AS was_reset FROM fx_verdicts v LEFT JOIN w ON w.workspace_id = v.workspace_id""")
def reset_calibration(t):
    chosen = t["nation"].select(F.col("n_regionkey").cast("bigint").alias("workspace_id"))
    return fb.reset_calibration(t["fx_verdicts"], chosen).select("workspace_id", "verdict_id", "note", "was_reset")


@query("f15_verdict_history", f"""
    WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY created_at, l_partkey, l_suppkey) AS score_no FROM s),
    j AS (SELECT v.workspace_id, v.verdict_id, v.created_at, n.score_no, n.a_tenths / 10.0 AS a_overall, v.session_id FROM v LEFT JOIN n ON n.attempt_id = v.attempt_id)
    SELECT workspace_id, verdict_id, score_no, a_overall, session_id, row_number() OVER w AS rank FROM j
    WINDOW w AS (PARTITION BY workspace_id ORDER BY created_at DESC, verdict_id DESC, score_no) QUALIFY row_number() OVER w <= 100""")
def verdict_history(t):
    from ..functions import ordered

    scores = ordered.positions(
        fb.machine_overall(t["fx_scores"]), ["attempt_id"], [F.col("created_at"), F.col("l_partkey"), F.col("l_suppkey")], "score_no")
    turns = t["fx_scores"].select("attempt_id", "session_id").distinct()
    order = [F.col("created_at").desc(), F.col("verdict_id").desc()]
    shown = fb.verdict_history(t["fx_verdicts"].drop("session_id"), scores, turns, order)
    return shown.select("workspace_id", "verdict_id", "score_no", F.col("a_overall").cast("double").alias("a_overall"), "session_id", "rank")
