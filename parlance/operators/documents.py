"""Ingestion: hashes, duplicates, language labels, statistics, deletes.

A document is one row, and its blocks are an array column. Labels, best split
and parallel texts are therefore computed where the row is: no shuffle, and a
corpus dominated by one source or one workspace spreads like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions import text as tx
from ..sources import files

# ---- fixed values ----
MIN_SIDE_SHARE = 0.25
MIN_SPLIT_PURITY = 0.80
MIN_KNOWN_BLOCKS = 4
LOW_TEXT_CHARS = 120
PARAGRAPH_JOIN = "\n\n"
# ---- end of fixed values ----


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def mark_duplicates(items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``upload_status`` and ``duplicate_of``.

    items: workspace_id, seq, filename, content_hash, status (``ready`` or
    ``error``: the outcome if it is not a duplicate). existing: workspace_id,
    filename, content_hash of documents that are ready already. Within a
    workspace the first ready holder of a hash wins; what comes later is a
    duplicate of it. The winner per hash is found with a partial aggregation,
    so a much-copied text is reduced before it is shuffled.
    """
    ready = items.filter(F.col("status") == "ready").select(
        "workspace_id", "content_hash", F.col("seq").cast("bigint").alias("seq"), "filename"
    )
    if existing is not None:
        ready = ready.unionByName(
            existing.select("workspace_id", "content_hash", F.lit(-1).cast("bigint").alias("seq"), "filename")
        )
    first = ready.groupBy("workspace_id", "content_hash").agg(
        F.min(F.struct("seq", "filename")).alias("first")
    )
    later = F.col("first").isNotNull() & (F.col("seq") > F.col("first.seq"))
    return items.join(first, ["workspace_id", "content_hash"], "left").select(
        *[F.col(c) for c in items.columns],
        F.when(later, "duplicate").otherwise(F.col("status")).alias("upload_status"),
        F.when(later, F.col("first.filename")).alias("duplicate_of"),
    ).drop("first")


def stored_names(uploads: DataFrame) -> DataFrame:
    """Safe stored name per upload, no two alike in a workspace.

    uploads: workspace_id, seq, filename. The first of a name keeps it; later ones
    get ``" (n)"`` with the next number from 2 on that no upload brought itself.
    """
    named = uploads.withColumn("safe_name", files.safe_filename(F.col("filename")))
    numbered = ordered.positions(named, ["workspace_id", "safe_name"], [F.col("seq")], "name_no")
    suffix = F.regexp_extract("safe_name", r"[^.](\.[^.]+)$", 1)
    stem = F.expr("substring(safe_name, 1, length(safe_name) - length(__suffix))")
    own = r"^(.*) \((\d{1,9})\)(\.[^.]+)?$"
    taken = (
        named.filter(F.rlike("safe_name", F.lit(own)))
        .select("workspace_id", F.regexp_replace("safe_name", own, "$1$3").alias("safe_name"),
                F.regexp_extract("safe_name", own, 2).cast("bigint").alias("__k"))
        .filter("__k > 1").groupBy("workspace_id", "safe_name").agg(F.sort_array(F.collect_set("__k")).alias("__taken"))
    )
    number = F.aggregate(
        F.coalesce("__taken", F.array().cast("array<bigint>")), F.col("name_no").cast("bigint"),
        lambda n, k: F.when(k <= n, n + 1).otherwise(n),
    )
    return (
        numbered.join(taken, ["workspace_id", "safe_name"], "left").withColumn("__suffix", suffix)
        .withColumn(
            "stored_name",
            F.when(F.col("name_no") == 1, F.col("safe_name")).otherwise(
                F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), F.col("__suffix"))
            ),
        )
        .select(*named.columns, "stored_name")
    )


# ------------------------------------------------------------------ blocks and languages


def with_blocks(documents: DataFrame, separator: str = files.PARAGRAPH_BREAK) -> DataFrame:
    """Adds ``blocks`` (paragraph texts in order) to rows with a ``text`` column."""
    return documents.withColumn("text", tx.normalise_text(F.col("text"))).withColumn(
        "blocks", files.paragraphs(F.col("text"), separator)
    )


def gather_blocks(block_rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, block_idx, text) to one ``blocks`` array per document.

    A document is bounded by the file size limit, so its blocks fit a row.
    """
    pairs = F.sort_array(F.collect_list(F.struct("block_idx", "text")))
    return block_rows.groupBy(*keys).agg(F.transform(pairs, lambda b: b["text"]).alias("blocks"))


def total_length(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0).cast("bigint"), lambda n, t: n + F.length(t))


def reject_low_text(documents: DataFrame, limit: int = LOW_TEXT_CHARS) -> DataFrame:
    """Adds ``block_chars`` and ``is_low_text`` (too little text to be a text file)."""
    return documents.withColumn("block_chars", total_length(F.col("blocks"))).withColumn(
        "is_low_text", F.col("block_chars") < limit
    )


def label_blocks(documents: DataFrame, **detector) -> DataFrame:
    """Adds ``block_langs``, aligned with ``blocks``."""
    return documents.withColumn("block_langs", tx.block_languages(F.col("blocks"), **detector))


def best_split(langs: Column) -> Column:
    """Cut of the known blocks that makes both halves purest.

    Returns struct(split_index, correct, known). Counts on the left are carried
    along and the right side follows from the totals, so one pass is enough.
    The lowest of equally good cuts wins.
    """
    indexed = F.transform(langs, lambda lang, i: F.struct(i.alias("idx"), lang.alias("lang")))
    known = F.filter(indexed, lambda b: b["lang"].isin("vi", "en"))
    n_vi = F.size(F.filter(langs, lambda x: x == "vi"))
    n_en = F.size(F.filter(langs, lambda x: x == "en"))
    # The totals are part of the running state: inside the step they would be counted per block.
    start = F.struct(
        n_vi.alias("all_vi"), n_en.alias("all_en"), F.lit(0).alias("vi"), F.lit(0).alias("en"),
        F.lit(0).alias("correct"), F.lit(None).cast("int").alias("cut"),
    )

    def step(acc: Column, block: Column) -> Column:
        score = F.greatest(acc["vi"] + acc["all_en"] - acc["en"], acc["en"] + acc["all_vi"] - acc["vi"])
        better = (acc["vi"] + acc["en"] > 0) & (score > acc["correct"])
        return F.struct(
            acc["all_vi"].alias("all_vi"), acc["all_en"].alias("all_en"),
            (acc["vi"] + (block["lang"] == "vi").cast("int")).alias("vi"),
            (acc["en"] + (block["lang"] == "en").cast("int")).alias("en"),
            F.when(better, score).otherwise(acc["correct"]).alias("correct"),
            F.when(better, block["idx"]).otherwise(acc["cut"]).alias("cut"),
        )

    def finish(acc: Column) -> Column:
        n = acc["all_vi"] + acc["all_en"]
        return F.struct(
            F.when(n >= MIN_KNOWN_BLOCKS, acc["cut"]).alias("split_index"),
            F.when(n >= MIN_KNOWN_BLOCKS, acc["correct"]).otherwise(0).alias("correct"),
            n.alias("known"),
        )

    return F.aggregate(known, start, step, finish)


def _chars_of(lang: str) -> Column:
    chosen = F.filter(
        F.arrays_zip(F.col("blocks").alias("text"), F.col("block_langs").alias("lang")),
        lambda b: b["lang"] == lang,
    )
    return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda n, b: n + F.length(b["text"]))


def classify(documents: DataFrame, **detector) -> DataFrame:
    """Document label: vi, en, parallel, mixed or unknown, with shares and split.

    Needs ``blocks``; adds block_langs, language, vi_share, en_share,
    split_index and split_purity.
    """
    labelled = (
        label_blocks(documents, **detector)
        .withColumn("__vi", _chars_of("vi"))
        .withColumn("__en", _chars_of("en"))
        .withColumn("__split", best_split(F.col("block_langs")))
    )
    total = F.nullif(F.col("__vi") + F.col("__en"), F.lit(0))
    vi, en = F.col("vi_share"), F.col("en_share")
    both = (vi >= MIN_SIDE_SHARE) & (en >= MIN_SIDE_SHARE)
    purity = F.when(F.col("__split.known") >= MIN_KNOWN_BLOCKS,
                    F.col("__split.correct") / F.col("__split.known")).otherwise(0.0)
    parallel = both & F.col("__split.split_index").isNotNull() & (purity >= MIN_SPLIT_PURITY)
    return (
        labelled.withColumn("vi_share", F.coalesce(F.col("__vi") / total, F.lit(0.0)))
        .withColumn("en_share", F.coalesce(F.col("__en") / total, F.lit(0.0)))
        .withColumn(
            "language",
            F.when(total.isNull(), "unknown")
            .when(~both, F.when(vi >= en, "vi").otherwise("en"))
            .when(parallel, "parallel")
            .otherwise("mixed"),
        )
        .withColumn("split_index", F.when(parallel, F.col("__split.split_index")))
        .withColumn("split_purity", F.when(both, purity).otherwise(0.0))
        .drop("__vi", "__en", "__split")
    )


def joined_by_language(texts: Column, langs: Column, lang: str | None) -> Column:
    """Texts of one language (or all) in order, separated by a blank line."""
    if lang is None:
        return F.array_join(texts, PARAGRAPH_JOIN)
    pairs = F.filter(F.arrays_zip(texts.alias("text"), langs.alias("lang")), lambda b: b["lang"] == lang)
    return F.array_join(F.transform(pairs, lambda b: b["text"]), PARAGRAPH_JOIN)


def parallel_texts(classified: DataFrame) -> DataFrame:
    """``vi_text`` and ``en_text`` of parallel documents, empty for the others."""
    is_parallel = F.col("language") == "parallel"

    def side(lang: str) -> Column:
        return F.when(
            is_parallel, joined_by_language(F.col("blocks"), F.col("block_langs"), lang)
        ).otherwise("").alias(f"{lang}_text")

    return classified.withColumns({"vi_text": side("vi"), "en_text": side("en")})


def document_texts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts of the ready documents rebuilt from their chunks, per language and whole.

    documents: doc_id, workspace_id, filename, language, status.
    chunks: doc_id, chunk_idx, text, lang. One document's chunks make one row.
    """
    ready = documents.filter(F.col("status") == "ready").select(
        "doc_id", "workspace_id", "filename", "language"
    )
    ordered_chunks = F.sort_array(F.collect_list(F.struct("chunk_idx", "text", "lang")))
    gathered = chunks.groupBy("doc_id").agg(ordered_chunks.alias("__chunks"))
    texts, langs = F.col("__chunks.text"), F.col("__chunks.lang")
    return (
        ready.join(gathered, "doc_id", "left")
        .select(
            "doc_id", "workspace_id", "filename", "language",
            *[
                F.coalesce(joined_by_language(texts, langs, lang), F.lit("")).alias(name)
                for name, lang in (("vi_text", "vi"), ("en_text", "en"), ("full_text", None))
            ],
        )
    )


# ------------------------------------------------------------------ lists and statistics


def newest_first(documents: DataFrame) -> DataFrame:
    """All documents, per workspace newest first (a range sort, no window)."""
    return documents.orderBy(F.col("workspace_id"), F.col("created_at").desc(), F.col("id").desc())


def preview(chunks: DataFrame, max_chunks: int = 5) -> DataFrame:
    """First chunks of every document with the number of chunks it has."""
    totals = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    head = ordered.first_per_key(chunks, ["doc_id"], [F.col("chunk_idx")], max_chunks, "preview_no")
    return head.join(totals, "doc_id")


def override_language(documents: DataFrame, overrides: DataFrame) -> DataFrame:
    """A language set by hand wins over the automatic one. overrides: doc_id, language."""
    manual = overrides.select("doc_id", F.col("language").alias("__manual"))
    return (
        documents.join(manual, "doc_id", "left")
        .withColumn("language_source", F.when(F.col("__manual").isNull(), "auto").otherwise("manual"))
        .withColumn("language", F.coalesce("__manual", "language"))
        .drop("__manual")
    )


def ingest_statistics(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """What ingestion writes back: status, character and chunk counts.

    documents: doc_id, workspace_id, language, blocks and extraction_quality (all
    "ok" without it). A document without chunks
    has failed and shows no language and no characters.
    """
    counted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    ok = F.col("n_chunks") > 0
    return (
        documents.join(counted, "doc_id", "left")
        .withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
        .select(
            "doc_id", "workspace_id",
            F.when(ok, "ready").otherwise("error").alias("status"),
            F.when(ok, F.col("language")).otherwise("unknown").alias("language"),
            (F.col("extraction_quality") if "extraction_quality" in documents.columns else F.lit("ok")).alias("extraction_quality"),
            F.when(ok, "plain").alias("extractor"),
            F.when(ok, total_length(F.col("blocks"))).otherwise(0).alias("n_chars"),
            "n_chunks",
        )
    )


# ------------------------------------------------------------------ deletes

# child table -> (its foreign key, parent table); parents come first
FOREIGN_KEYS: dict[str, tuple[str, str]] = {
    "engagements": ("workspace_id", "workspaces"),
    "documents": ("workspace_id", "workspaces"),
    "document_chunks": ("document_id", "documents"),
    "vectors": ("document_id", "documents"),
    "qa_history": ("workspace_id", "workspaces"),
    "research_runs": ("workspace_id", "workspaces"),
    "profiles": ("workspace_id", "workspaces"),
    "profile_fields": ("profile_id", "profiles"),
    "profile_sources": ("profile_field_id", "profile_fields"),
    "glossary": ("workspace_id", "workspaces"),
    "glossary_conflicts": ("glossary_id", "glossary"),
    "mock_sessions": ("workspace_id", "workspaces"),
    "mock_turns": ("session_id", "mock_sessions"),
    "turn_attempts": ("turn_id", "mock_turns"),
    "scores": ("attempt_id", "turn_attempts"),
    "expert_verdicts": ("attempt_id", "turn_attempts"),
}


def cascade_delete(
    tables: Mapping[str, DataFrame],
    root: str,
    deleted_ids: DataFrame,
    foreign_keys: Mapping[str, tuple[str, str]] = FOREIGN_KEYS,
    id_columns: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Tables left after deleting the ``root`` rows whose id is in ``deleted_ids``.

    Each child loses the rows whose parent goes (``left_anti``); the ids that go
    are passed on to its own children. ``deleted_ids`` has one column.
    """
    ids = dict(id_columns or {})
    gone = {root: deleted_ids.toDF("__gone").distinct()}
    left: dict[str, DataFrame] = {}
    order: Sequence[str] = [root, *[t for t in foreign_keys if t != root]]
    for name in order:
        if name not in tables:
            continue
        table = tables[name]
        key = ids.get(name, "id")
        if name == root:
            left[name] = table.join(gone[root], table[key] == F.col("__gone"), "left_anti")
            continue
        column, parent = foreign_keys[name]
        if parent not in gone:
            left[name] = table
            continue
        left[name] = table.join(gone[parent], table[column] == F.col("__gone"), "left_anti")
        if key in table.columns:
            gone[name] = table.join(gone[parent], table[column] == F.col("__gone"), "left_semi").select(
                F.col(key).alias("__gone")
            ).distinct()
    return left
