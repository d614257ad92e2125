"""Snippets for oracle SQL, written independently of the Spark expressions."""

from __future__ import annotations


def squash(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def term_key(x: str) -> str:
    return squash(f"nfc_normalize({x})")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def half_up(tenths: str, n: str, digits: int) -> str:
    """tenths / (10 n) rounded half away from zero to some digits, in whole numbers."""
    m = 10 ** (digits - 1)
    return (
        f"CASE WHEN ({n}) = 0 THEN NULL ELSE CAST(sign({tenths}) * ((2 * abs({tenths}) * {m} + ({n})) // (2 * ({n}))) "
        f"AS DOUBLE) / {10 ** digits}.0 END"
    )


def mean(column: str, digits: int = 1) -> str:
    return half_up(f"CAST(coalesce(sum(CAST({column} * 10 AS BIGINT)), 0) AS BIGINT)", f"count({column})", digits)


def row_mean_tenths(columns: list[str]) -> str:
    total = " + ".join(f"coalesce(CAST({c} * 10 AS BIGINT), 0)" for c in columns)
    n = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in columns)
    return f"CASE WHEN ({n}) = 0 THEN NULL ELSE (2 * ({total}) + ({n})) // (2 * ({n})) END"


VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
ENGLISH = "'the','and','of','to','is','that','for','with','by','it','this','are','from','have'"

# blocks: (doc_id, workspace_id, i (1-based, after dropping blanks), t (text))
BLOCKS = rf"""
    raw AS (SELECT doc_id, workspace_id, unnest(string_split_regex(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), '\n+')) AS p,
                   generate_subscripts(string_split_regex(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), '\n+'), 1) AS k
            FROM fx_documents),
    blocks AS (SELECT doc_id, workspace_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, {strip('p')} AS t
               FROM raw WHERE {strip('p')} <> '')"""

LANGS = rf"""
    counted AS (SELECT *, lower(t) AS low,
                  length(regexp_replace(lower(t), '[^\p{{L}}]', '', 'g')) AS letters,
                  length(regexp_replace(lower(t), '[^{VIETNAMESE}]', '', 'g')) AS marked,
                  list_filter(string_split_regex(lower(t), '[^\p{{L}}]+'), lambda w: w <> '') AS tokens FROM blocks),
    labelled AS (SELECT doc_id, workspace_id, i, t,
                   CASE WHEN length(t) < 25 THEN 'unknown' WHEN letters = 0 THEN 'unknown'
                        WHEN marked >= 0.012 * letters THEN 'vi'
                        WHEN len(list_filter(tokens, lambda w: w IN ({ENGLISH}))) >= 0.05 * len(tokens) THEN 'en'
                        ELSE 'unknown' END AS lang FROM counted)"""

SPLITS = """
    known AS (SELECT doc_id, i, lang, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS cut,
                     count(*) OVER (PARTITION BY doc_id) AS n FROM labelled WHERE lang <> 'unknown'),
    sides AS (SELECT *, sum(CASE WHEN lang = 'vi' THEN 1 ELSE 0 END) OVER w AS lv,
                     sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) OVER w AS le,
                     sum(CASE WHEN lang = 'vi' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS tv,
                     sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS te
              FROM known WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    cuts AS (SELECT doc_id, i - 1 AS split_index, n, greatest(lv + te - le, le + tv - lv) AS correct, cut
             FROM sides WHERE cut >= 1 AND n >= 4),
    best AS (SELECT doc_id, split_index, CAST(correct AS DOUBLE) / n AS purity FROM cuts
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY correct DESC, cut) = 1)"""

CLASSES = """
    shares AS (SELECT doc_id, CAST(sum(CASE WHEN lang = 'vi' THEN length(t) ELSE 0 END) AS BIGINT) AS vc,
                      CAST(sum(CASE WHEN lang = 'en' THEN length(t) ELSE 0 END) AS BIGINT) AS ec
               FROM labelled GROUP BY doc_id),
    classes AS (SELECT d.doc_id, coalesce(CAST(vc AS DOUBLE) / nullif(vc + ec, 0), 0.0) AS vi_share,
                       coalesce(CAST(ec AS DOUBLE) / nullif(vc + ec, 0), 0.0) AS en_share,
                       coalesce(vc + ec, 0) AS total, split_index, coalesce(purity, 0.0) AS purity
                FROM fx_documents d LEFT JOIN shares s ON s.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id),
    classified AS (SELECT *, vi_share >= 0.25 AND en_share >= 0.25 AS both_sides,
                      CASE WHEN total = 0 THEN 'unknown'
                           WHEN vi_share < 0.25 OR en_share < 0.25 THEN CASE WHEN vi_share >= en_share THEN 'vi' ELSE 'en' END
                           WHEN split_index IS NOT NULL AND purity >= 0.8 THEN 'parallel' ELSE 'mixed' END AS language
                   FROM classes)"""
