"""Document operators on the driver tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import unnest
from ..operators import chunking
from ..operators import documents as docs
from ..plans import flows
from .registry import query
from .sqltext import BLOCKS, CLASSES, LANGS, SPLITS

SEPARATOR = r"\n+"      # the fixture texts have no blank lines


def blocks_of(t):
    rows = t["fx_documents"].select("doc_id", "workspace_id", "text")
    return docs.with_blocks(rows, SEPARATOR)


@query("d1_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(t):
    return t["documents"].select("doc_id", docs.content_hash(F.col("text")).alias("content_hash"))


@query("d2_duplicates", """
    WITH hashed AS (SELECT *, sha256(text) AS h FROM fx_documents),
    first AS (SELECT workspace_id, h, min(seq) AS seq, arg_min(filename, seq) AS filename FROM hashed WHERE status = 'ready' GROUP BY 1, 2)
    SELECT d.seq, d.workspace_id, CASE WHEN d.seq > f.seq THEN 'duplicate' ELSE d.status END AS upload_status,
           CASE WHEN d.seq > f.seq THEN f.filename END AS duplicate_of
    FROM hashed d LEFT JOIN first f ON f.workspace_id = d.workspace_id AND f.h = d.h""")
def duplicates(t):
    items = t["fx_documents"].withColumn("content_hash", docs.content_hash(F.col("text"))).drop("text")
    return docs.mark_duplicates(items).select("seq", "workspace_id", "upload_status", "duplicate_of")


@query("d3_stored_names", """
    WITH f AS (SELECT seq, workspace_id, CASE WHEN seq % 50 = 7 THEN replace(filename, '.txt', ' (' || CAST(seq % 9 AS VARCHAR) || ').txt') ELSE filename END AS filename FROM fx_documents),
    n AS (SELECT seq, workspace_id, replace(replace(filename, 'src', 'src_'), '.txt', '') AS name, row_number() OVER (PARTITION BY workspace_id, filename ORDER BY seq) AS k FROM f),
    free AS (SELECT workspace_id, name, k, row_number() OVER (PARTITION BY workspace_id, name ORDER BY k) + 1 AS turn
             FROM (SELECT DISTINCT workspace_id, name FROM n) x, (SELECT unnest(range(2, (SELECT max(k) FROM n) + 12)) AS k) r
             WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.workspace_id = x.workspace_id AND n.name = x.name || ' (' || CAST(r.k AS VARCHAR) || ')'))
    SELECT seq, n.workspace_id, CASE WHEN n.k = 1 THEN n.name || '.txt' ELSE n.name || ' (' || CAST(free.k AS VARCHAR) || ').txt' END AS stored_name
    FROM n LEFT JOIN free ON free.workspace_id = n.workspace_id AND free.name = n.name AND free.turn = n.k""")
def stored_names(t):
    own = F.regexp_replace("filename", F.lit(r"\.txt$"), F.concat(F.lit(" ("), (F.col("seq") % 9).cast("string"), F.lit(").txt")))
    names = F.when(F.col("seq") % 50 == 7, own).otherwise(F.col("filename"))
    uploads = t["fx_documents"].select("seq", "workspace_id", F.regexp_replace(names, "src", "src:").alias("filename"))
    return docs.stored_names(uploads).select("seq", "workspace_id", "stored_name")


@query("d7_block_language", f"""
    WITH {BLOCKS}, {LANGS}
    SELECT doc_id, i - 1 AS block_idx, lang FROM labelled""")
def block_language(t):
    return unnest(docs.label_blocks(blocks_of(t)), ["doc_id"], F.col("block_langs"), "lang", "block_idx")


@query("d8_document_language", f"""
    WITH {BLOCKS}, {LANGS}, {SPLITS}, {CLASSES}
    SELECT doc_id, language, round(vi_share, 6) AS vi_share, round(en_share, 6) AS en_share,
           CASE WHEN language = 'parallel' THEN split_index END AS split_index,
           CASE WHEN both_sides THEN round(purity, 6) ELSE 0.0 END AS split_purity FROM classified""")
def document_language(t):
    return docs.classify(blocks_of(t)).select(
        "doc_id", "language", F.round("vi_share", 6).alias("vi_share"), F.round("en_share", 6).alias("en_share"),
        "split_index", F.round("split_purity", 6).alias("split_purity"))


@query("d9_best_split", f"""
    WITH {BLOCKS}, {LANGS}, {SPLITS}
    SELECT d.doc_id, split_index, round(coalesce(purity, 0.0), 6) AS purity
    FROM fx_documents d LEFT JOIN best b ON b.doc_id = d.doc_id""")
def best_split(t):
    split = docs.best_split(F.col("block_langs"))
    return docs.label_blocks(blocks_of(t)).select("doc_id", split.alias("s")).select(
        "doc_id", "s.split_index",
        F.round(F.coalesce(F.col("s.correct") / F.nullif(F.col("s.known"), F.lit(0)), F.lit(0.0)), 6).alias("purity"))


@query("d10_parallel_texts", f"""
    WITH {BLOCKS}, {LANGS}, {SPLITS}, {CLASSES},
    texts AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (lang = 'vi') AS vi,
                     string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (lang = 'en') AS en FROM labelled GROUP BY 1)
    SELECT c.doc_id, CASE WHEN language = 'parallel' THEN vi ELSE '' END AS vi_text,
           CASE WHEN language = 'parallel' THEN en ELSE '' END AS en_text FROM classified c LEFT JOIN texts s ON s.doc_id = c.doc_id""")
def parallel_texts(t):
    return docs.parallel_texts(docs.classify(blocks_of(t))).select("doc_id", "vi_text", "en_text")


@query("d11_sentences", r"""
    WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?…])\s+([A-ZĐÀ-Ỹ0-9“"(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents)
    SELECT doc_id, len(parts) AS n_sentences, list_max(list_transform(parts, lambda p: length(p))) AS longest FROM s""")
def sentence_stats(t):
    parts = tx.sentences(F.col("text"))
    return t["documents"].select("doc_id", "text").select(
        "doc_id", F.size(parts).alias("n_sentences"), F.array_max(F.transform(parts, F.length)).alias("longest"))


# Pieces by a walk over sentences, then chunks by a walk over pieces, one step per piece; both independent of the cut table.
PIECES = rf"""{BLOCKS}, sentences AS (
        SELECT doc_id, i, CASE WHEN length(t) <= {chunking.CHUNK_CHARS} THEN [t]
                    ELSE string_split(regexp_replace(t, '([.!?…])\s+([A-ZĐÀ-Ỹ0-9“"(])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS parts
        FROM blocks),
    atoms AS (
        SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, i ORDER BY s, o) AS k, substr(parts[s], o * {chunking.CHUNK_CHARS} + 1, {chunking.CHUNK_CHARS}) AS atom
        FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS s FROM sentences) x, LATERAL (SELECT unnest(range(0, greatest(1, (length(parts[s]) + {chunking.CHUNK_CHARS} - 1) // {chunking.CHUNK_CHARS}))) AS o) y),
    fill AS (
        SELECT doc_id, i, k, atom AS line, 0 AS n FROM atoms WHERE k = 1
        UNION ALL
        SELECT doc_id, i, k, CASE WHEN fits THEN longer ELSE atom END, n + CASE WHEN fits THEN 0 ELSE 1 END
        FROM (SELECT f.doc_id, f.i, a.k, f.n, a.atom, trim(f.line || ' ' || a.atom) AS longer, length(trim(f.line || ' ' || a.atom)) <= {chunking.CHUNK_CHARS} AS fits
              FROM fill f JOIN atoms a ON a.doc_id = f.doc_id AND a.i = f.i AND a.k = f.k + 1) s),
    pieces AS (
        SELECT doc_id, i, n, arg_max(line, k) AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY i, n) AS p FROM fill GROUP BY doc_id, i, n)"""


CHUNKS = f"""
    WITH RECURSIVE {PIECES}, {LANGS}, last AS (SELECT doc_id, max(i) - 1 AS top FROM blocks GROUP BY 1),
    marked AS (SELECT p.doc_id, p.p, p.piece, p.i - 1 AS i, l.lang FROM pieces p JOIN labelled l ON l.doc_id = p.doc_id AND l.i = p.i),
    walk AS (
        SELECT doc_id, p, 0 AS c, piece AS joined, length(piece) AS used, i AS start, i AS first_loc, i AS last_loc, lang AS held,
               CAST(lang = 'vi' AS INT) AS vi, CAST(lang = 'en' AS INT) AS en FROM marked WHERE p = 1
        UNION ALL
        SELECT doc_id, p, c + CAST(cut AS INT), CASE WHEN cut THEN tail ELSE joined END || chr(10) || chr(10) || piece,
               CASE WHEN cut THEN length(tail) ELSE used END + length(piece), CASE WHEN cut THEN i ELSE start END,
               CASE WHEN cut THEN last_loc ELSE first_loc END, i, lang,
               CASE WHEN cut THEN CAST(held = 'vi' AS INT) ELSE vi END + CAST(lang = 'vi' AS INT),
               CASE WHEN cut THEN CAST(held = 'en' AS INT) ELSE en END + CAST(lang = 'en' AS INT)
        FROM (SELECT w.doc_id, m.p, c, joined, used, start, first_loc, last_loc, held, vi, en, m.piece, m.i, m.lang,
                     used + length(m.piece) > {chunking.CHUNK_CHARS} AS cut, right(joined, {chunking.OVERLAP_CHARS}) AS tail
              FROM walk w JOIN marked m ON m.doc_id = w.doc_id AND m.p = w.p + 1) s),
    closed AS (
        SELECT doc_id, c, max(p) AS p, arg_max(joined, p) AS joined, arg_max(vi, p) AS vi, arg_max(en, p) AS en, min(start) AS block_start,
               min(first_loc) AS first_loc, max(last_loc) AS last_loc FROM walk GROUP BY 1, 2)
    SELECT c.doc_id, d.workspace_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY c) - 1 AS INT) AS chunk_idx, trim(joined, ' ' || chr(10) || chr(9) || chr(13)) AS text,
           CASE WHEN first_loc = last_loc THEN 'đoạn ' || CAST(first_loc + 1 AS VARCHAR)
                ELSE 'đoạn ' || CAST(first_loc + 1 AS VARCHAR) || '–' || CAST(last_loc + 1 AS VARCHAR) END AS locator,
           CASE WHEN vi + en = 0 THEN 'unknown' WHEN vi >= en THEN 'vi' ELSE 'en' END AS lang, CAST(block_start AS INT) AS block_start,
           CAST(coalesce(m.i, l.top) AS INT) AS block_end
    FROM closed c JOIN fx_documents d ON d.doc_id = c.doc_id JOIN last l ON l.doc_id = c.doc_id
    LEFT JOIN marked m ON m.doc_id = c.doc_id AND m.p = c.p + 1 WHERE trim(joined, ' ' || chr(10) || chr(9) || chr(13)) <> ''"""


@query("d13_chunks", CHUNKS)
def chunks(t):
    return chunking.chunk_documents(docs.label_blocks(blocks_of(t)))


@query("d12_block_pieces", f"""
    WITH RECURSIVE {PIECES}
    SELECT doc_id, i - 1 AS block, count(*) AS n_pieces, max(length(piece)) AS longest, sum(length(piece)) AS chars FROM pieces GROUP BY 1, 2""")
def block_pieces(t):
    return chunking.split_blocks(blocks_of(t)).groupBy("doc_id", "block").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.max(F.length("piece")).alias("longest"), F.sum(F.length("piece")).alias("chars"))


@query("d12_chunk_sizes", f"""
    SELECT workspace_id, lang, count(*) AS n_chunks, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM ({CHUNKS}) c GROUP BY 1, 2""")
def chunk_sizes(t):
    rows = flows.ingest(t["fx_documents"].select("doc_id", "workspace_id", "filename", "text"), SEPARATOR).chunks
    return rows.groupBy("workspace_id", "lang").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max(F.length("text")).alias("longest"),
        F.sum(F.length("text")).alias("chars"))


@query("d14_locator_ranges", f"""
    WITH {BLOCKS}, e AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM blocks GROUP BY 1)
    SELECT doc_id, CASE WHEN a = b THEN 'đoạn 1' ELSE 'đoạn 1–' || CAST(b AS VARCHAR) END AS same_unit,
           'trang 1 → đoạn ' || CAST(b AS VARCHAR) AS two_units FROM e""")
def locator_ranges(t):
    last = F.concat(F.lit("đoạn "), F.size("blocks").cast("string"))
    return blocks_of(t).filter(F.size("blocks") > 0).select(
        "doc_id", chunking.locator_range(F.lit("đoạn 1"), last).alias("same_unit"),
        chunking.locator_range(F.lit("trang 1"), last).alias("two_units"))


@query("d15_document_texts", """
    WITH g AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) FILTER (lang = 'vi') AS vi,
                      string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) FILTER (lang = 'en') AS en,
                      string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) AS whole FROM fx_turn_chunks GROUP BY 1)
    SELECT d.doc_id, d.workspace_id, d.language, coalesce(vi, '') AS vi_text, coalesce(en, '') AS en_text, coalesce(whole, '') AS full_text
    FROM fx_doc_list d LEFT JOIN g ON g.doc_id = d.doc_id WHERE d.status = 'ready'""")
def document_texts(t):
    return docs.document_texts(t["fx_doc_list"], t["fx_turn_chunks"]).drop("filename")


@query("d16_document_list", """
    SELECT workspace_id, id, status, language, row_number() OVER (ORDER BY workspace_id, created_at DESC, id DESC) * 0 AS zero
    FROM fx_doc_list""")
def document_list(t):
    return docs.newest_first(t["fx_doc_list"]).select("workspace_id", "id", "status", "language", F.lit(0).cast("bigint").alias("zero"))


@query("d17_chunk_preview", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS preview_no,
                      count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM fx_turn_chunks)
    SELECT doc_id, chunk_idx, lang, preview_no, n_chunks, length(text) AS n_chars FROM r WHERE preview_no <= 3""")
def chunk_preview(t):
    return docs.preview(t["fx_turn_chunks"], 3).select(
        "doc_id", "chunk_idx", "lang", "preview_no", "n_chunks", F.length("text").alias("n_chars"))


@query("d18_language_override", """
    SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'en' WHEN l.quality = 1 THEN 'vi' ELSE d.language END AS language,
           CASE WHEN l.quality IS NULL THEN 'auto' ELSE 'manual' END AS language_source
    FROM fx_doc_list d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def language_override(t):
    manual = t["labels"].select("doc_id", F.when(F.col("quality") == 0, "en").otherwise("vi").alias("language"))
    return docs.override_language(t["fx_doc_list"], manual).select("doc_id", "language", "language_source")


@query("d19_ingest_statistics", f"""
    WITH {BLOCKS}, {LANGS}, {SPLITS}, {CLASSES}, c AS (SELECT doc_id, count(*) AS n FROM fx_turn_chunks GROUP BY 1),
    z AS (SELECT doc_id, sum(length(t)) AS chars FROM blocks GROUP BY 1)
    SELECT d.doc_id, d.workspace_id, CASE WHEN n > 0 THEN 'ready' ELSE 'error' END AS status,
           CASE WHEN n > 0 THEN coalesce(k.language, 'unknown') ELSE 'unknown' END AS language, CASE WHEN coalesce(chars, 0) < 120 THEN 'low' ELSE 'ok' END AS extraction_quality,
           CASE WHEN n > 0 THEN 'plain' END AS extractor, CAST(CASE WHEN n > 0 THEN coalesce(chars, 0) ELSE 0 END AS BIGINT) AS n_chars,
           coalesce(n, 0) AS n_chunks
    FROM fx_documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN classified k ON k.doc_id = d.doc_id""")
def ingest_statistics(t):
    """Labels, blocks and quality as the ingest computes them; the chunks are the turns of conversations."""
    rows = docs.reject_low_text(docs.classify(blocks_of(t))).withColumn("extraction_quality", F.when(F.col("is_low_text"), "low").otherwise("ok"))
    return docs.ingest_statistics(rows, t["fx_turn_chunks"])


#: Every table of the cascade as (id, parent id) over the given tables.
FAMILY = {
    "workspaces": ("c_custkey", None, "customer"),
    "engagements": ("o_orderkey", "o_custkey", "orders"),
    "documents": ("doc_id", "doc_id % 1000", "documents"),
    "document_chunks": ("conv_id * 1000 + turn", "conv_id", "conversations"),
    "vectors": ("vec_id", "vec_id % 700", "embeddings"),
    "qa_history": ("event_id", "user_id", "events"),
    "research_runs": ("page_id", "page_id % 1000", "pages"),
    "profiles": ("o_orderkey", "o_custkey", "orders"),
    "profile_fields": ("l_orderkey * 10 + l_linenumber", "l_orderkey", "lineitem"),
    "profile_sources": ("l_orderkey * 100 + l_linenumber", "l_orderkey * 10 + l_linenumber", "lineitem"),
    "glossary": ("p_partkey", "p_partkey % 1000", "part"),
    "glossary_conflicts": ("l_orderkey * 10 + l_linenumber", "l_partkey", "lineitem"),
    "mock_sessions": ("o_orderkey", "o_custkey", "orders"),
    "mock_turns": ("l_orderkey * 10 + l_linenumber", "l_orderkey", "lineitem"),
    "turn_attempts": ("l_orderkey * 100 + l_linenumber", "l_orderkey * 10 + l_linenumber", "lineitem"),
    "scores": ("l_orderkey * 1000 + l_suppkey", "l_orderkey * 100 + l_linenumber", "lineitem"),
    "expert_verdicts": ("l_orderkey * 1000 + l_partkey", "l_orderkey * 100 + l_linenumber", "lineitem"),
}


def family(t):
    tables = {}
    for name, (key, parent, source) in FAMILY.items():
        columns = [F.expr(f"CAST({key} AS BIGINT)").alias("id")]
        if parent:
            columns.append(F.expr(f"CAST({parent} AS BIGINT)").alias(docs.FOREIGN_KEYS[name][0]))
        tables[name] = t[source].select(*columns)
    return tables


def cascade_oracle(root: str, gone: str) -> str:
    """Which ids go, table by table, and what is left of each."""
    parts, told, lost = [f"g_{root} AS ({gone})"], [], {root}
    for name, (key, parent, source) in FAMILY.items():
        owner = docs.FOREIGN_KEYS.get(name, (None, None))[1]
        rows = f"SELECT CAST({key} AS BIGINT) AS id, CAST({parent or 'NULL'} AS BIGINT) AS parent FROM {source}"
        if name == root:
            left = f"SELECT id FROM ({rows}) x WHERE id NOT IN (SELECT id FROM g_{root})"
        elif owner in lost:
            lost.add(name)
            parts.append(f"g_{name} AS (SELECT DISTINCT id FROM ({rows}) x WHERE parent IN (SELECT id FROM g_{owner}))")
            left = f"SELECT id FROM ({rows}) x WHERE parent NOT IN (SELECT id FROM g_{owner})"
        else:
            left = f"SELECT id FROM ({rows}) x"
        told.append(f"SELECT '{name}' AS table_name, count(*) AS n, CAST(coalesce(sum(id), 0) AS BIGINT) AS id_sum FROM ({left}) y")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(told)}"


def left_of(t, root, deleted):
    left = docs.cascade_delete(family(t), root, deleted)
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum")).select(F.lit(name).alias("table_name"), "n", "id_sum")
             for name, df in {**{n: df for n, df in family(t).items() if n not in left}, **left}.items()]
    return reduce(DataFrame.unionByName, parts)


@query("d20_workspace_cascade", cascade_oracle("workspaces", "SELECT c_custkey AS id FROM customer WHERE c_nationkey < 8"))
def workspace_cascade(t):
    """All sixteen foreign keys under workspaces: what is left when the customers of some nations go."""
    return left_of(t, "workspaces", t["customer"].filter("c_nationkey < 8").select(F.col("c_custkey").cast("bigint")))


@query("d20_document_cascade", cascade_oracle("documents", "SELECT doc_id AS id FROM documents WHERE lang = 'fr'"))
def document_cascade(t):
    return left_of(t, "documents", t["documents"].filter("lang = 'fr'").select("doc_id"))


@query("d20_cascade_delete", """
    WITH gone AS (SELECT id FROM fx_sessions WHERE status = 'generated'),
    s AS (SELECT 'mock_sessions' AS table_name, count(*) AS n FROM fx_sessions WHERE id NOT IN (SELECT id FROM gone)),
    a AS (SELECT 'turn_attempts' AS table_name, count(*) AS n FROM fx_scores WHERE session_id NOT IN (SELECT id FROM gone)),
    v AS (SELECT 'expert_verdicts' AS table_name, count(*) AS n FROM fx_verdicts WHERE attempt_id NOT IN
          (SELECT attempt_id FROM fx_scores WHERE session_id IN (SELECT id FROM gone)))
    SELECT * FROM s UNION ALL SELECT * FROM a UNION ALL SELECT * FROM v""")
def cascade_delete(t):
    sessions = t["fx_sessions"]
    left = docs.cascade_delete(
        {"mock_sessions": sessions, "turn_attempts": t["fx_scores"], "expert_verdicts": t["fx_verdicts"]},
        "mock_sessions", sessions.filter(F.col("status") == "generated").select("id"),
        {"turn_attempts": ("session_id", "mock_sessions"), "expert_verdicts": ("attempt_id", "turn_attempts")},
        {"turn_attempts": "attempt_id"},
    )
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
