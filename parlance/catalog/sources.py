"""Sources and sinks on the driver tables."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as docs
from ..operators import glossary as gl
from ..session import run_dir
from ..sources import files, sinks, tables
from .registry import query
from .sqltext import BLOCKS, strip


def wanted_workspaces(t):
    """Those of the nations of one region."""
    return t["nation"].filter(F.col("n_regionkey") == 1).select((F.col("n_nationkey") % 5).cast("int").alias("workspace_id"))


@query("s1_document_scan", """
    SELECT workspace_id, status, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM fx_documents
    WHERE workspace_id IN (SELECT n_nationkey % 5 FROM nation WHERE n_regionkey = 1) GROUP BY 1, 2""")
def document_scan(t):
    """All documents laid out by workspace, then those of the wanted ones, from their folders alone."""
    path = run_dir(t.spark, "documents")
    tables.write_by_workspace(t["fx_documents"], path)
    rows = tables.scan(t.spark, path, wanted_workspaces(t), ["workspace_id", "status", "n_chars"])
    return rows.groupBy("workspace_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("s2_file_admission", """
    WITH named AS (SELECT *, CASE WHEN filename LIKE '%.txt' THEN '.txt' WHEN filename LIKE '%.PDF' THEN '.pdf'
                   WHEN filename LIKE '%.gz' THEN '.gz' ELSE '' END AS ext FROM fx_manifest),
    judged AS (SELECT *, CASE WHEN ext NOT IN ('.pdf', '.docx', '.doc', '.txt', '.md') THEN 'unsupported_extension'
               WHEN size_bytes = 0 THEN 'empty_file' WHEN size_bytes > 26214400 THEN 'too_large' END AS reason FROM named)
    SELECT doc_id, filename, size_bytes, ext, CASE WHEN reason IS NULL THEN 'admitted' ELSE 'error' END AS status, reason
    FROM judged""")
def file_admission(t):
    return files.admit(t["fx_manifest"]).drop("source")


@query("s3_batch_counts", """
    SELECT workspace_id, count(*) AS n_total, CAST(sum(CASE WHEN status = 'ready' THEN 1 ELSE 0 END) AS BIGINT) AS n_ready,
           CAST(sum(CASE WHEN status = 'ready' THEN 0 ELSE 1 END) AS BIGINT) AS n_failed
    FROM fx_documents GROUP BY 1""")
def batch_counts(t):
    return files.batch_counts(t["fx_documents"], "workspace_id")


@query("s4_paragraphs", f"""
    WITH {BLOCKS}
    SELECT doc_id, workspace_id, i - 1 AS block_idx, 'đoạn ' || CAST(i AS VARCHAR) AS locator, t AS text FROM blocks""")
def paragraphs(t):
    rows = t["fx_documents"].select("doc_id", "workspace_id", "text")
    return files.paragraph_rows(rows, r"\n+")


@query("s5_table_rows", """
    SELECT c_custkey, array_to_string(list_filter([trim(c_name), trim(CASE WHEN c_nationkey % 3 = 0 THEN '  ' ELSE c_mktsegment END),
           CAST(c_nationkey AS VARCHAR)], lambda x: x <> ''), ' | ') AS line FROM customer""")
def table_rows(t):
    middle = F.when(F.col("c_nationkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment"))
    cells = F.array("c_name", middle, F.col("c_nationkey").cast("string"))
    return t["customer"].select("c_custkey", files.row_text(cells).alias("line"))


@query("s6_vector_scan", """
    SELECT document_id, workspace_id, count(*) AS n_vectors FROM fx_vectors
    WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND workspace_id IN (SELECT n_nationkey % 5 FROM nation WHERE n_regionkey = 1) GROUP BY 1, 2""")
def vector_scan(t):
    path = run_dir(t.spark, "vectors")
    tables.write_by_workspace(t["fx_vectors"], path)
    wanted = t["labels"].filter(F.col("quality") == 1).select(F.col("doc_id").alias("document_id"))
    rows = tables.scan_vectors(t.spark, path, wanted_workspaces(t), wanted)
    return rows.groupBy("document_id", "workspace_id").agg(F.count(F.lit(1)).alias("n_vectors"))


@query("s7_json_read", """
    SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events""")
def json_read(t):
    return t["events"].select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1)).alias("k"))


@query("s8_json_write", """
    SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source}) AS VARCHAR) AS payload FROM documents""")
def json_write(t):
    return t["documents"].select("doc_id", sinks.json_column("doc_id", "lang", "source").alias("payload"))


@query("s9_glossary_export", """
    SELECT workspace_id, term_vi, term_en, coalesce(pronunciation, '') AS pronunciation,
           coalesce(definition, '') AS definition, coalesce(category, '') AS category,
           CASE confidence WHEN 'aligned_from_parallel' THEN 'ghép từ tài liệu song ngữ' ELSE 'máy suy đoán' END AS confidence,
           CASE status WHEN 'auto' THEN 'tự nhận' ELSE 'chuyên gia sửa' END AS status, source_type, source_ref, frequency
    FROM fx_glossary WHERE status <> 'skipped'""")
def glossary_export(t):
    return gl.export_rows(t["fx_glossary"])


@query("s10_repeated_append", """
    SELECT id, workspace_id, n_chars, status, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch_id, 'audit' AS source FROM fx_audit""")
def repeated_append(t):
    """The log in two batches, of which one is written twice, as after a failure."""
    path = run_dir(t.spark, "log")
    rows = t["fx_audit"].select("id", "workspace_id", "n_chars", "status")
    for batch, rest in (("even", 0), ("odd", 1), ("even", 0)):
        sinks.append_batch(rows.filter(F.col("id") % 2 == rest), path, batch, "audit")
    return t.spark.read.parquet(path).drop("row_hash")


@query("s11_audit_export", """
    SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, workspace_id, provider, destination, status, n_chars, operation_id FROM fx_audit""")
def audit_export(t):
    """The whole log, newest first, as CSV files that are read back with their schema."""
    path = run_dir(t.spark, "export")
    rows = t["fx_audit"].select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "workspace_id",
                                "provider", "destination", "status", "n_chars", "operation_id")
    sinks.export_ordered(rows, path, F.col("id").desc())
    return sinks.import_csv(t.spark, path, rows.schema)


@query("d4_normalised_text", rf"""
    SELECT doc_id, length(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g'))) AS n_chars,
           sha256(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g'))) AS text_hash FROM documents""")
def normalised_text(t):
    text = tx.normalise_text(F.col("text"))
    return t["documents"].select("doc_id", "text").select("doc_id", text.alias("text")).select(
        "doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@query("d5_plausible_lines", rf"""
    WITH lines AS (SELECT doc_id, {strip("unnest(string_split(text, chr(10)))")} AS line FROM documents)
    SELECT doc_id, count(*) AS n_lines,
           CAST(sum(CASE WHEN length(line) >= 12 AND length(regexp_replace(line, '[^\x20-\x7EÀ-ɏḀ-ỿ\s]', '', 'g')) >= 0.85 * length(line)
               THEN 1 ELSE 0 END) AS BIGINT) AS n_plausible
    FROM lines GROUP BY 1""")
def plausible_lines(t):
    lines = F.split("text", "\n")
    return t["documents"].select("doc_id", "text").select(
        "doc_id", F.size(lines).alias("n_lines"),
        F.size(F.filter(lines, tx.is_plausible_line)).alias("n_plausible"))


@query("d6_low_text", f"""
    WITH {BLOCKS}
    SELECT d.doc_id, CAST(coalesce(sum(length(t)), 0) AS BIGINT) AS block_chars, coalesce(sum(length(t)), 0) < 120 AS is_low_text
    FROM fx_documents d LEFT JOIN blocks b ON b.doc_id = d.doc_id GROUP BY 1""")
def low_text(t):
    rows = docs.with_blocks(t["fx_documents"].select("doc_id", "text"), r"\n+")
    return docs.reject_low_text(rows).select("doc_id", "block_chars", "is_low_text")
