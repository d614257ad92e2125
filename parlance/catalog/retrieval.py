"""Retrieval operators; every vector is also a question to its own workspace."""

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import retrieval as rt
from .registry import query

HITS = """
    pairs AS (SELECT q.chunk_id AS query_id, c.chunk_id, c.document_id,
                     round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) + 0.0 AS distance
              FROM fx_vectors q JOIN fx_vectors c ON c.workspace_id = q.workspace_id),
    pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM pairs
             QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= {pool})"""
ROBIN = """
    deep AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY distance, chunk_id) AS depth,
                    min(distance) OVER (PARTITION BY query_id, document_id) AS best FROM pool),
    turns AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, best, document_id) AS turn FROM deep),
    hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank, chunk_id,
                    document_id, distance FROM turns WHERE turn <= 10)"""
POOL = HITS.format(pool=40)


def questions(t):
    return t["fx_vectors"].select(F.col("chunk_id").alias("query_id"), "workspace_id", "embedding")


def hits(t):
    return rt.search(questions(t), t["fx_vectors"])


def names(t):
    """File names of the documents the vectors belong to."""
    return t["fx_documents"].select(F.col("doc_id").alias("document_id"), "filename")


def bodies(t):
    """Chunk text and place: page n is the text of vector n, where it exists."""
    return t["pages"].select(
        F.col("page_id").alias("chunk_id"), F.col("html").alias("text"),
        F.concat(F.lit("trang "), F.col("page_id").cast("string")).alias("locator"))


BODIES = """
    bodies AS (SELECT page_id AS chunk_id, html AS text, 'trang ' || CAST(page_id AS VARCHAR) AS locator FROM pages),
    found AS (SELECT h.*, b.text, b.locator, d.filename FROM hits h JOIN bodies b ON b.chunk_id = h.chunk_id
              JOIN fx_documents d ON d.doc_id = h.document_id)"""


@query("r1_unit_vectors", """
    SELECT chunk_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length_before,
           1.0 AS length_after FROM fx_vectors""")
def unit_vectors(t):
    rows = t["fx_vectors"].withColumn("unit", vectors.unit(F.col("embedding")))
    return rows.select("chunk_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length_before"),
                       F.round(vectors.norm(F.col("unit")), 6).alias("length_after"))


@query("r2_vector_upsert", """
    WITH w AS (SELECT chunk_id * 10 + document_id AS version, document_id * 4 + workspace_id AS chunk_id, document_id, workspace_id FROM fx_vectors)
    SELECT chunk_id, version, document_id, workspace_id FROM w QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC) = 1""")
def vector_upsert(t):
    rows = t["fx_vectors"].select(
        (F.col("document_id") * 4 + F.col("workspace_id")).alias("chunk_id"),
        (F.col("chunk_id") * 10 + F.col("document_id")).alias("version"), "document_id", "workspace_id")
    half = F.col("version") % 2 == 0
    return rt.upsert_vectors(rows.filter(half), rows.filter(~half))


@query("r3_nearest", f"WITH {HITS.format(pool=10)} SELECT query_id, rank, chunk_id, document_id, distance FROM pool")
def nearest(t):
    return rt.nearest(questions(t), t["fx_vectors"], 10).select("query_id", "rank", "chunk_id", "document_id", "distance")


@query("r3_nearest_by_pass", """
    WITH pairs AS (SELECT q.chunk_id AS query_id, c.chunk_id, c.document_id,
                     round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) + 0.0 AS distance
              FROM fx_vectors q JOIN fx_vectors c ON c.workspace_id = q.workspace_id WHERE q.chunk_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank, chunk_id, document_id, distance
    FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 10""")
def nearest_by_pass(t):
    """Every fiftieth vector asks, against all vectors."""
    asked = t["fx_vectors"].filter(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), "workspace_id", "embedding")
    return rt.nearest_by_pass(asked, t["fx_vectors"], 10).select("query_id", "rank", "chunk_id", "document_id", "distance")


@query("r3_nearest_in_scope", """
    WITH pairs AS (SELECT q.chunk_id AS query_id, c.chunk_id, c.document_id,
                     round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) + 0.0 AS distance
              FROM fx_vectors q JOIN fx_vectors c ON c.workspace_id = q.workspace_id
              AND (q.chunk_id % 3 = 0 OR c.document_id IN (q.document_id, (q.document_id + 1) % 10)))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank, chunk_id, document_id, distance
    FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 5""")
def nearest_in_scope(t):
    own = F.col("document_id")
    scope = F.when(F.col("chunk_id") % 3 != 0, F.array(own, (own + 1) % 10))
    asked = t["fx_vectors"].select(F.col("chunk_id").alias("query_id"), "workspace_id", "embedding", scope.alias("scope"))
    return rt.nearest(asked, t["fx_vectors"], 5).select("query_id", "rank", "chunk_id", "document_id", "distance")


@query("r4_pool", f"WITH {POOL} SELECT query_id, count(*) AS n_pool, max(distance) AS worst FROM pool GROUP BY 1")
def pool(t):
    rows = rt.nearest(questions(t), t["fx_vectors"], rt.pool_size(10))
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pool"), F.max("distance").alias("worst"))


@query("r5_round_robin", f"WITH {POOL}, {ROBIN} SELECT * FROM hits")
def round_robin(t):
    return hits(t)


@query("r6_hit_chunks", f"WITH {POOL}, {ROBIN}, {BODIES} SELECT query_id, rank, chunk_id, document_id, filename, locator, length(text) AS n_chars FROM found")
def hit_chunks(t):
    return rt.hit_chunks(hits(t), bodies(t), names(t)).select(
        "query_id", "rank", "chunk_id", "document_id", "filename", "locator", F.length("text").alias("n_chars"))


@query("r7_context", f"""
    WITH {POOL}, {ROBIN}, {BODIES}
    SELECT query_id, sha256(string_agg('[Đoạn ' || CAST(rank AS VARCHAR) || '] (tệp: ' || filename || ' · ' || locator || ')' || chr(10) || text,
           chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_hash, count(*) AS n_context FROM found GROUP BY 1""")
def context(t):
    rows = rt.context_blocks(hits(t), bodies(t), names(t))
    return rows.select("query_id", F.sha2("context", 256).alias("context_hash"), "n_context")


@query("r8_context_quality", f"""
    WITH {POOL}, {ROBIN}, b AS (SELECT query_id, min(distance) AS best_distance FROM hits WHERE chunk_id <> query_id GROUP BY 1)
    SELECT v.chunk_id AS query_id, best_distance, CASE WHEN best_distance IS NULL THEN 'not_found'
           WHEN best_distance > 0.75 THEN 'weak' ELSE 'ok' END AS context_state
    FROM fx_vectors v LEFT JOIN b ON b.query_id = v.chunk_id""")
def context_quality(t):
    others = hits(t).filter(F.col("chunk_id") != F.col("query_id"))
    return rt.context_quality(questions(t), others)


def answers(t):
    """Model answers: some cite three numbers, some a number out of range, some nothing."""
    used = (
        F.when(F.col("chunk_id") % 4 == 0, F.array(F.lit(2), F.lit(99), F.lit(1)))
        .when(F.col("chunk_id") % 4 == 1, F.array(F.lit(3), F.lit(3)))
        .otherwise(F.array(F.lit(77)))
    )
    return t["fx_vectors"].select(
        F.col("chunk_id").alias("query_id"), (F.col("chunk_id") % 5 != 0).alias("found"), used.alias("used_context_ids"),
        F.when(F.col("document_id") < 5, "high").otherwise("low").alias("confidence"),
        (F.col("document_id") % 2 == 0).alias("is_inferential"),
        F.when(F.col("chunk_id") % 3 == 0, "  ").when(F.col("chunk_id") % 3 == 1, " maybe ").alias("inference"),
        "workspace_id", F.col("chunk_id").alias("id"), F.col("document_id").alias("created_at"))


CITED = """
    used AS (SELECT chunk_id AS query_id, unnest(CASE WHEN chunk_id % 4 = 0 THEN [2, 99, 1] WHEN chunk_id % 4 = 1 THEN [3, 3] ELSE [77] END) AS context_id,
                    unnest(CASE WHEN chunk_id % 4 = 0 THEN [0, 1, 2] WHEN chunk_id % 4 = 1 THEN [0, 1] ELSE [0] END) AS position FROM fx_vectors),
    cited AS (SELECT u.query_id, u.position, u.context_id, f.chunk_id, f.document_id, f.filename, f.locator,
                     CASE WHEN length(f.text) > 400 THEN substr(f.text, 1, 400) || '…' ELSE f.text END AS snippet, false AS is_fallback
              FROM used u JOIN found f ON f.query_id = u.query_id AND f.rank = u.context_id),
    fallback AS (SELECT query_id, 0 AS position, rank AS context_id, chunk_id, document_id, filename, locator,
                        CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS snippet, true AS is_fallback
                 FROM found WHERE query_id % 5 <> 0 AND query_id NOT IN (SELECT query_id FROM cited)
                 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1)"""


@query("r9_citations", f"WITH {POOL}, {ROBIN}, {BODIES}, {CITED} SELECT * FROM cited")
def citations(t):
    return rt.resolve_citations(answers(t), hits(t), bodies(t), names(t)).filter(~F.col("is_fallback"))


@query("r10_citation_fallback", f"WITH {POOL}, {ROBIN}, {BODIES}, {CITED} SELECT * FROM cited UNION ALL SELECT * FROM fallback")
def citation_fallback(t):
    """What the hits show is written once; the citations and the fallback read it."""
    return rt.resolve_citations(answers(t), hits(t), bodies(t), names(t))


@query("r11_answer_state", """
    SELECT chunk_id AS query_id, CASE WHEN chunk_id % 5 = 0 THEN 'not_found' WHEN document_id < 5 THEN 'high' ELSE 'low' END AS confidence,
           document_id % 2 = 0 AND chunk_id % 3 <> 1 AS inference_missing, CASE WHEN chunk_id % 3 = 1 THEN 'maybe' END AS inference_part FROM fx_vectors""")
def answer_state(t):
    return rt.answer_state(answers(t))


@query("r12_history", """
    SELECT workspace_id, chunk_id AS id, row_number() OVER w AS rank FROM fx_vectors
    WINDOW w AS (PARTITION BY workspace_id ORDER BY document_id DESC, chunk_id DESC) QUALIFY row_number() OVER w <= 20""")
def history(t):
    return rt.history(answers(t), 20).select("workspace_id", "id", "rank")


@query("r13_vector_counts", "SELECT workspace_id, count(*) AS n_vectors FROM fx_vectors GROUP BY ROLLUP (workspace_id)")
def vector_counts(t):
    return rt.vector_counts(t["fx_vectors"])


@query("r14_approximate_recall")
def approximate_recall(t):
    exact = rt.nearest(questions(t), t["fx_vectors"], 10)
    found = rt.nearest_approximate(questions(t), t["fx_vectors"], 10, dimensions=64)
    return rt.recall(exact, found)
