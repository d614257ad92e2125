"""Bilingual glossary: candidates, trust-ranked upsert, edits, reports, pronunciation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ordered
from ..functions import text as tx
from ..functions.sided import in_front
from . import counts

# ---- fixed values ----
TRUST = {"expert_edited": 3, "aligned_from_parallel": 2, "machine_guess": 1}
MIN_TEXT_FOR_TERMS = 200
MAX_TEXT_CHARS = 14_000
MAX_WEB_CHARS = 12_000
MIN_GLOSSARY_TERMS = 15
PROMPT_TERMS = 24
CONFIDENCE_LABELS = {
    "aligned_from_parallel": "ghép từ tài liệu song ngữ",
    "machine_guess": "máy suy đoán",
}
STATUS_LABELS = {"auto": "tự nhận", "expert_edited": "chuyên gia sửa", "skipped": "bỏ qua"}
EXPORT_HEADER = {
    "term_vi": "Thuật ngữ (VI)",
    "term_en": "Thuật ngữ (EN)",
    "pronunciation": "Cách đọc",
    "definition": "Định nghĩa",
    "category": "Phân loại",
    "confidence": "Độ tin",
    "status": "Trạng thái",
    "source_type": "Loại nguồn",
    "source_ref": "Nguồn",
    "frequency": "Tần suất",
}
EXPERT_SOURCE_REF = "chuyên gia nhập"
# ---- end of fixed values ----

CANDIDATE_FIELDS = (
    "term_vi", "term_en", "pronunciation", "definition", "category", "confidence", "source_type", "source_ref",
)


def active() -> Column:
    """Terms in use: everything not skipped."""
    return F.col("status") != "skipped"


def trust_rank(status: Column, confidence: Column) -> Column:
    return (
        F.when(status == "expert_edited", TRUST["expert_edited"])
        .when(confidence == "aligned_from_parallel", TRUST["aligned_from_parallel"])
        .otherwise(TRUST["machine_guess"])
    )


def standing_order() -> list[Column]:
    """Expert rows first, then aligned ones, then by frequency."""
    return [
        F.when(F.col("status") == "expert_edited", 0).otherwise(1),
        F.when(F.col("confidence") == "aligned_from_parallel", 0).otherwise(1),
        F.col("frequency").desc(),
    ]


# ------------------------------------------------------------------ candidates


def clean_candidates(raw: DataFrame, confidence: str, source_type: str) -> DataFrame:
    """Trimmed candidates; a row without one of its two sides is dropped."""
    texts = [c for c in ("term_vi", "term_en", "pronunciation", "definition", "category") if c in raw.columns]
    return (
        raw.withColumns({c: tx.strip(F.col(c)) for c in texts})
        .filter((F.col("term_vi") != "") & (F.col("term_en") != ""))
        .withColumns({"confidence": F.lit(confidence), "source_type": F.lit(source_type)})
    )


def route_sources(document_texts: DataFrame, web_runs: DataFrame) -> DataFrame:
    """What terms are extracted from, in the order the results are merged.

    Parallel documents with enough text on both sides come first, then
    documents in one language, then the web results of a workspace.
    document_texts: see ``documents.document_texts``. web_runs: workspace_id,
    doc_id (the run) for workspaces that have web results.
    """
    side = MAX_TEXT_CHARS // 2
    parallel = document_texts.filter(
        (F.col("language") == "parallel")
        & (F.length("vi_text") >= MIN_TEXT_FOR_TERMS)
        & (F.length("en_text") >= MIN_TEXT_FOR_TERMS)
    ).select(
        "workspace_id", "doc_id", F.lit(1).alias("source_rank"),
        F.substring("vi_text", 1, side).alias("vi_text"), F.substring("en_text", 1, side).alias("en_text"),
    )
    single = document_texts.filter(
        F.col("language").isin("vi", "en") & (F.length("full_text") >= MIN_TEXT_FOR_TERMS)
    ).select(
        "workspace_id", "doc_id", F.lit(2).alias("source_rank"),
        *[
            F.when(F.col("language") == lang, F.substring("full_text", 1, MAX_TEXT_CHARS))
            .otherwise("").alias(f"{lang}_text")
            for lang in ("vi", "en")
        ],
    )
    web = web_runs.select(
        "workspace_id", "doc_id", F.lit(3).alias("source_rank"),
        F.lit("").alias("vi_text"), F.lit("").alias("en_text"),
    )
    return parallel.unionByName(single).unionByName(web)


def within_budget(results: DataFrame, budget: int = MAX_WEB_CHARS) -> DataFrame:
    """Leading web results of a run whose blocks fit the character budget.

    results: run_id, position (1-based, in order), title, snippet. Reading stops
    at the first block that would overflow; running sums only grow, so that is
    the same as keeping the rows whose running sum fits. A null title or snippet
    is the empty text. No block is shorter than its frame, hence only a bounded number of leading rows can ever fit:
    they are picked first (pruned before the shuffle) and summed afterwards.
    """
    block = F.concat(
        F.lit("[Nguồn "), F.col("position").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"),
        F.coalesce("snippet", F.lit("")),
    )
    shortest = len("[Nguồn 1] \n")
    head = ordered.first_per_key(results, ["run_id"], [F.col("position")], budget // shortest + 1, "__n")
    running = Window.partitionBy("run_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return (
        head.withColumn("block", block)
        .withColumn("running_chars", F.sum(F.length("block")).over(running))
        .filter(F.col("running_chars") <= budget)
        .drop("__n")
    )


# ------------------------------------------------------------------ upsert


class Upsert(NamedTuple):
    glossary: DataFrame
    conflicts: DataFrame
    stats: DataFrame


def _nonempty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def classify_candidates(candidates: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Every candidate with its outcome: added, bumped, updated or conflict.

    Candidates of a workspace arrive in ``seq`` order. A candidate has rank 1
    or 2, so the translation of a term is replaced at most once: by the first
    rank-2 candidate that translates it otherwise, if the term stood at rank 1.
    Knowing the row a term starts from (``base``) and that one ``swap``, every
    candidate is judged on its own. Base and swap come from candidates reduced
    to one row per translation, so a term proposed a million times is small
    before it is shuffled, and the only join of raw rows has one row per term on
    its other side.
    """
    rows = (
        candidates.select("workspace_id", "seq", *CANDIDATE_FIELDS)
        .withColumn("term_key", tx.term_key(F.col("term_vi")))
        .withColumn("en_key", tx.term_key(F.col("term_en")))
        .withColumn("rank", trust_rank(F.lit("auto"), F.col("confidence")))
        .filter(F.col("term_key") != "")
    )
    key = ["workspace_id", "term_key"]
    fields = ["seq", "en_key", "rank", *CANDIDATE_FIELDS]
    translations = rows.groupBy(*key, "en_key", "rank").agg(F.min(F.struct(*fields)).alias("first"))

    start = translations.groupBy(*key).agg(F.min("first").alias("__first"))
    if glossary is not None:
        standing = glossary.select(
            "workspace_id",
            F.col("term_vi_norm").alias("term_key"),
            F.struct(
                F.lit(-1).cast("bigint").alias("seq"),
                tx.term_key(F.col("term_en")).alias("en_key"),
                trust_rank(F.col("status"), F.col("confidence")).alias("rank"),
                *[F.col(c) for c in CANDIDATE_FIELDS],
            ).alias("__standing"),
            F.col("frequency").cast("bigint").alias("base_frequency"),
            F.col("status").alias("base_status"),
            F.col("id").alias("glossary_id"),
        )
        start = start.join(standing, key, "left")
        base = F.coalesce("__standing", "__first")
    else:
        start = start.withColumns({
            "base_frequency": F.lit(None).cast("bigint"), "base_status": F.lit(None).cast("string"),
            "glossary_id": F.lit(None).cast("bigint"),
        })
        base = F.col("__first")
    start = start.select(
        *key, base.alias("base"), F.coalesce("base_frequency", F.lit(1)).alias("base_frequency"),
        F.coalesce("base_status", F.lit("auto")).alias("base_status"), "glossary_id",
    )
    swaps = (
        translations.filter(F.col("rank") == 2).join(start.filter(F.col("base.rank") == 1), key)
        .filter(F.col("en_key") != F.col("base.en_key"))
        .groupBy(*key).agg(F.min("first").alias("swap"))
    )
    summary = start.join(swaps, key, "left")

    swapped = F.col("swap").isNotNull() & (F.col("seq") > F.col("swap.seq"))
    current = F.when(swapped, F.col("swap.en_key")).otherwise(F.col("base.en_key"))
    outcome = (
        F.when(F.col("seq") == F.col("base.seq"), "added")
        .when(F.col("swap").isNotNull() & (F.col("seq") == F.col("swap.seq")), "updated")
        .when(F.col("en_key") == current, "bumped")
        .otherwise("conflict")
    )
    return rows.join(summary, key).withColumn("outcome", outcome).withColumn("after_swap", swapped)


def upsert(
    candidates: DataFrame, glossary: DataFrame | None = None, open_conflicts: DataFrame | None = None
) -> Upsert:
    """New state of the touched terms, new conflict rows, and counts per workspace.

    open_conflicts: workspace_id, term_key, proposed_term_en of unresolved rows.
    """
    judged = classify_candidates(candidates, glossary)
    key = ["workspace_id", "term_key"]
    bumped = F.col("outcome") == "bumped"

    def filler(field: str, after: bool) -> Column:
        usable = bumped & (F.col("after_swap") == after) & (F.coalesce(F.col(field), F.lit("")) != "")
        return F.min(F.when(usable, F.struct(F.col("seq"), F.col(field).alias("value"))))

    merged = judged.groupBy(*key).agg(
        F.first("base").alias("base"), F.first("swap").alias("swap"),
        F.first("base_frequency").alias("base_frequency"), F.first("base_status").alias("status"),
        F.first("glossary_id").alias("id"),
        F.count_if(F.col("outcome").isin("bumped", "updated")).alias("n_more"),
        *[
            filler(field, after).alias(f"__{field}_{int(after)}")
            for field in ("pronunciation", "definition") for after in (False, True)
        ],
    )

    def filled(field: str) -> Column:
        return F.coalesce(
            _nonempty(F.col(f"swap.{field}")), _nonempty(F.col(f"base.{field}")),
            F.col(f"__{field}_0.value"), F.col(f"__{field}_1.value"),
        )

    def from_swap(field: str) -> Column:
        return F.when(F.col("swap").isNotNull(), F.col(f"swap.{field}")).otherwise(F.col(f"base.{field}"))

    new_state = merged.select(
        "id", "workspace_id", F.col("base.term_vi").alias("term_vi"), F.col("term_key").alias("term_vi_norm"),
        from_swap("term_en").alias("term_en"), filled("pronunciation").alias("pronunciation"),
        filled("definition").alias("definition"),
        *[from_swap(f).alias(f) for f in ("category", "confidence")], "status",
        *[from_swap(f).alias(f) for f in ("source_type", "source_ref")],
        (F.col("base_frequency") + F.col("n_more")).alias("frequency"),
    )
    conflicts = new_conflicts(judged, open_conflicts)
    totals = judged.groupBy("workspace_id").agg(
        F.count_if(F.col("outcome") == "added").alias("added"),
        F.count_if(F.col("outcome") == "updated").alias("updated"),
        F.count_if(bumped).alias("bumped"),
        F.count_if((F.col("outcome") == "conflict") & (F.col("base_status") == "expert_edited"))
        .alias("skipped_expert"),
    )
    logged = conflicts.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("__n"))
    stats = totals.join(logged, "workspace_id", "left").select(
        "workspace_id", "added", "updated", "bumped", F.coalesce("__n", F.lit(0)).alias("conflicts"),
        "skipped_expert",
    )
    return Upsert(new_state, conflicts, stats)


def new_conflicts(judged: DataFrame, open_conflicts: DataFrame | None = None) -> DataFrame:
    """One conflict row per (term, exact proposed text), unless one is open already."""
    first = F.min(F.struct("seq", "definition", "source_ref", "confidence"))
    rows = (
        judged.filter(F.col("outcome") == "conflict")
        .groupBy("workspace_id", "term_key", F.col("term_en").alias("proposed_term_en"))
        .agg(first.alias("__first"), F.first("glossary_id").alias("glossary_id"))
    )
    if open_conflicts is not None:
        rows = rows.join(
            open_conflicts.select("workspace_id", "term_key", "proposed_term_en"),
            ["workspace_id", "term_key", "proposed_term_en"], "left_anti",
        )
    return rows.select(
        "workspace_id", "term_key", "glossary_id", "proposed_term_en",
        _nonempty(F.col("__first.definition")).alias("proposed_definition"),
        "__first.source_ref", "__first.confidence", F.lit(False).alias("resolved"),
    )


def merge_state(glossary: DataFrame, changed: DataFrame) -> DataFrame:
    """The whole glossary with the changed rows in place of their old versions."""
    key = ["workspace_id", "term_vi_norm"]
    untouched = glossary.join(changed.select(*key), key, "left_anti")
    return untouched.select(*changed.columns).unionByName(changed)


# ------------------------------------------------------------------ edits


def apply_edits(glossary: DataFrame, edits: DataFrame) -> DataFrame:
    """Glossary after a table of ``update`` and ``skip`` edits, with ``key_collision``.

    edits: id, seq, action, and the optional new values term_vi, term_en,
    pronunciation, definition, category. The last non-null value of a field
    counts; the last action sets the status. A changed key that another term of
    the workspace holds is reported, not merged.
    """
    fields = ["term_vi", "term_en", "pronunciation", "definition", "category"]
    updates = F.col("action") == "update"
    merged = edits.filter(F.col("action").isin("update", "skip")).groupBy("id").agg(
        F.max_by("action", "seq").alias("__action"),
        *[
            F.max(F.when(updates & F.col(f).isNotNull(), F.struct("seq", F.col(f).alias("value"))))
            .alias(f"__{f}")
            for f in fields
        ],
    )
    edited = glossary.join(merged, "id", "left").withColumns(
        {f: F.coalesce(F.col(f"__{f}.value"), F.col(f)) for f in fields}
    ).withColumn(
        "status",
        F.when(F.col("__action") == "skip", "skipped").when(F.col("__action") == "update", "expert_edited")
        .otherwise(F.col("status")),
    ).withColumn(
        "term_vi_norm",
        F.when(F.col("__term_vi").isNotNull(), tx.term_key(F.col("term_vi"))).otherwise(F.col("term_vi_norm")),
    )
    holders = edited.groupBy("workspace_id", "term_vi_norm").agg(F.count(F.lit(1)).alias("__holders"))
    return (
        edited.join(holders, ["workspace_id", "term_vi_norm"])
        .withColumn("key_collision", F.col("__term_vi").isNotNull() & (F.col("__holders") > 1))
        .select(*glossary.columns, "key_collision")
    )


def create_terms(glossary: DataFrame, edits: DataFrame) -> DataFrame:
    """New expert terms with ``accepted``; a key that exists, or came earlier in the batch, is refused.

    edits: workspace_id, seq, action, term_vi, term_en, pronunciation, definition, category.
    """
    key = ["workspace_id", "term_vi_norm"]
    wanted = edits.filter(F.col("action") == "create").withColumn("term_vi_norm", tx.term_key(F.col("term_vi")))
    first = wanted.groupBy(*key).agg(F.min("seq").alias("__first"))
    taken = glossary.select(*key, F.lit(True).alias("__taken"))
    return (
        wanted.join(first, key).join(taken, key, "left")
        .select(
            "workspace_id", "seq", "term_vi_norm",
            tx.strip(F.col("term_vi")).alias("term_vi"), tx.strip(F.col("term_en")).alias("term_en"),
            "pronunciation", "definition", "category",
            F.lit("aligned_from_parallel").alias("confidence"), F.lit("expert_edited").alias("status"),
            F.lit("expert").alias("source_type"), F.lit(EXPERT_SOURCE_REF).alias("source_ref"),
            F.lit(1).cast("bigint").alias("frequency"),
            (F.col("__taken").isNull() & (F.col("seq") == F.col("__first"))).alias("accepted"),
        )
    )


def resolve_conflicts(glossary: DataFrame, conflicts: DataFrame, resolutions: DataFrame) -> Upsert:
    """Glossary and conflicts after a table of decisions (conflict_id, accept, seq).

    Accepting takes the proposed translation and, if there is one, its
    definition. Either way the row becomes the expert's, and the conflict closes.
    """
    decided = conflicts.join(
        resolutions.select(F.col("conflict_id").alias("id"), "accept", "seq"), "id"
    )
    accepted = F.col("accept")
    per_term = decided.groupBy(F.col("glossary_id").alias("id")).agg(
        F.max(F.when(accepted, F.struct("seq", F.col("proposed_term_en").alias("value")))).alias("__en"),
        F.max(F.when(accepted & (F.coalesce("proposed_definition", F.lit("")) != ""),
                     F.struct("seq", F.col("proposed_definition").alias("value")))).alias("__def"),
        F.lit(True).alias("__decided"),
    )
    settled = glossary.join(per_term, "id", "left").withColumns({
        "term_en": F.coalesce(F.col("__en.value"), F.col("term_en")),
        "definition": F.coalesce(F.col("__def.value"), F.col("definition")),
        "status": F.when(F.col("__decided"), "expert_edited").otherwise(F.col("status")),
    }).select(*glossary.columns)
    closed = resolutions.select(F.col("conflict_id").alias("id"), F.lit(True).alias("__closed")).distinct()
    left = conflicts.join(closed, "id", "left").withColumn(
        "resolved", F.coalesce("__closed", "resolved")
    ).select(*conflicts.columns)
    done = decided.join(glossary.select(F.col("id").alias("glossary_id"), "workspace_id"), "glossary_id")
    stats = done.groupBy("workspace_id").agg(
        F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("kept")
    )
    return Upsert(settled, left, stats)


# ------------------------------------------------------------------ lists and reports


def open_conflicts_of(glossary: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Unresolved conflicts with their term; flat, one row per conflict."""
    open_rows = conflicts.filter(~F.col("resolved")).select(
        F.col("id").alias("conflict_id"), F.col("glossary_id").alias("id"), "proposed_term_en",
        F.col("confidence").alias("proposed_confidence"),
    )
    return glossary.join(open_rows, "id")


def list_terms(
    glossary: DataFrame, conflicts: DataFrame, include_skipped: bool = False, category: str | None = None
) -> DataFrame:
    """The glossary in reading order, each term with its open conflicts.

    Conflicts are counted before the join; their rows are in :func:`open_conflicts_of`.
    """
    rows = glossary if include_skipped else glossary.filter(active())
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    pending = conflicts.filter(~F.col("resolved")).groupBy(F.col("glossary_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_conflicts")
    )
    return (
        rows.join(pending, "id", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))
        .orderBy("workspace_id", *standing_order(), tx.ascii_fold(F.col("term_vi")), "id")
    )


def stats(glossary: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Counts per workspace; conflicts are counted for skipped terms as well."""
    has_sound = F.coalesce("pronunciation", F.lit("")) != ""
    open_rows = conflicts.filter(~F.col("resolved")).join(
        glossary.select(F.col("id").alias("glossary_id"), "workspace_id"), "glossary_id"
    )
    return counts.per_workspace([
        (glossary.filter(active()), {
            "total": counts.every_row(),
            "expert_edited": F.col("status") == "expert_edited",
            "aligned_from_parallel": F.col("confidence") == "aligned_from_parallel",
            "with_pronunciation": has_sound,
            "from_web": F.col("source_type") == "web",
            "from_document": F.col("source_type") == "document",
        }),
        (open_rows, {"conflicts": counts.every_row()}),
    ])


def by_category(glossary: DataFrame) -> DataFrame:
    return (
        glossary.filter(active()).groupBy("workspace_id", "category").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("workspace_id", F.col("n").desc(), "category")
    )


def term_threshold(glossary: DataFrame, minimum: int = MIN_GLOSSARY_TERMS) -> DataFrame:
    """Active and aligned terms per workspace, and whether there are too few."""
    return (
        glossary.filter(active()).groupBy("workspace_id").agg(
            F.count(F.lit(1)).alias("n_terms"),
            F.count_if(F.col("confidence") == "aligned_from_parallel").alias("n_aligned"),
        )
        .withColumn("below_threshold", F.col("n_terms") < minimum)
    )


def find_terms(glossary: DataFrame, query: str = "", category: str = "") -> DataFrame:
    """Category equality and a case-insensitive part of either side or the definition."""
    wanted = query.strip().lower()
    rows = glossary.filter(F.col("category") == category) if category else glossary
    if not wanted:
        return rows
    hit = [
        F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(wanted)) for c in ("term_vi", "term_en", "definition")
    ]
    return rows.filter(hit[0] | hit[1] | hit[2])


def top_terms(glossary: DataFrame, limit: int = PROMPT_TERMS) -> DataFrame:
    """The terms of a workspace that matter most, ``id`` as last key."""
    return ordered.first_per_key(
        glossary.filter(active()), ["workspace_id"], [*standing_order(), F.col("id")], limit
    )


def export_rows(glossary: DataFrame) -> DataFrame:
    """Rows of the CSV export: display labels, NULL as empty text, by category and term."""

    def label(column: str, labels: dict[str, str]) -> Column:
        known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        return F.coalesce(F.try_element_at(known, F.col(column)), F.col(column))

    values = {
        "confidence": label("confidence", CONFIDENCE_LABELS),
        "status": label("status", STATUS_LABELS),
        **{c: F.coalesce(c, F.lit("")) for c in ("pronunciation", "definition", "category", "source_type",
                                                  "source_ref")},
    }
    return (
        glossary.filter(active())
        .orderBy("workspace_id", F.col("category").asc_nulls_first(), tx.ascii_fold(F.col("term_vi")), "id")
        .select("workspace_id", *[values.get(c, F.col(c)).alias(c) for c in EXPORT_HEADER])
    )


def export_table(glossary: DataFrame) -> DataFrame:
    """:func:`export_rows` under the header shown to the reader."""
    return export_rows(glossary).withColumnsRenamed(EXPORT_HEADER)


# ------------------------------------------------------------------ pronunciation


def pronunciation_map(glossary: DataFrame) -> DataFrame:
    """Written form to spoken hint: (workspace_id, surface, hint, first_id, side).

    Both sides of a term are surfaces, the English one first. Of several terms
    with the same surface the lowest id wins.
    """
    sides = F.array(
        F.struct(F.lit(0).alias("side"), tx.strip(F.coalesce("term_en", F.lit(""))).alias("surface")),
        F.struct(F.lit(1).alias("side"), tx.strip(F.coalesce("term_vi", F.lit(""))).alias("surface")),
    )
    spoken = (
        glossary.filter(active() & ~tx.blank(F.col("pronunciation")))
        .select("workspace_id", "id", tx.strip(F.col("pronunciation")).alias("hint"), F.explode(sides).alias("s"))
        .select("workspace_id", "id", "hint", "s.side", "s.surface")
        .filter((F.length("surface") >= 2) & (F.lower("surface") != F.lower("hint")))
    )
    return spoken.groupBy("workspace_id", "surface").agg(F.min(F.struct("id", "side", "hint")).alias("f")).select(
        "workspace_id", "surface", F.col("f.hint").alias("hint"), F.col("f.id").alias("first_id"),
        F.col("f.side").alias("side"),
    )


def apply_pronunciation(texts: DataFrame, mapping: DataFrame, splits: int = 32) -> DataFrame:
    """Texts with every known surface replaced by its hint: ``spoken`` and ``applied``.

    texts: workspace_id, text_id, lang, text. Only Vietnamese texts change.
    Longer surfaces go first, matches are whole words and ignore case.

    The surfaces of a workspace stream into the tasks in front of its texts and
    become a trie of words there; each text is walked through it, rewritten, and
    walked again, so that a hint can bring another surface's word. A workspace's
    texts are dealt over ``splits`` tasks.
    """
    vi = F.col("lang").eqNullSafe("vi")
    order = [F.col(f"__side.{c}") for c in ("first_id", "side", "surface")]
    stream = in_front(texts.filter(vi), mapping.select("workspace_id", "surface", "hint", "first_id", "side"), "workspace_id", "text_id",
                      [-F.length("__side.surface"), *order], splits)
    result = T.StructType([T.StructField("row", texts.schema), T.StructField("spoken", T.StringType()), T.StructField("applied", T.ArrayType(T.StringType()))])
    place = texts.columns.index("text")

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces, held = Surfaces(), None
        for batch in batches:
            sides, rows, out = batch.column(2), batch.column(3), []
            kept = rows.is_valid().to_numpy(zero_copy_only=False)
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            spoken_texts = rows.field(place).to_pylist()
            for at, (key, side) in enumerate(zip(keys, sides.to_pylist())):
                if key != held:
                    surfaces, held = Surfaces(), key
                if kept[at]:
                    out.append(surfaces.applied_to(spoken_texts[at]))
                else:
                    surfaces.add(side["surface"], side["hint"])
            yield pa.RecordBatch.from_arrays(
                [rows.filter(pa.array(kept)), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.string()))],
                names=["row", "spoken", "applied"])

    replaced = stream.mapInArrow(speak, result).select("row.*", "spoken", "applied")
    rest = texts.filter(~vi).select(*texts.columns, F.col("text").alias("spoken"), F.array().cast("array<string>").alias("applied"))
    return replaced.unionByName(rest)


_TOKENS = re.compile(r"\w+|\W")


def _folded(token: str) -> str:
    """Equal for all tokens that are equal without case (and for a few that are not)."""
    return token.replace("İ", "i").replace("ı", "i").casefold()


class Surfaces:
    """A trie over the tokens of surfaces, in the order in which they are replaced."""

    def __init__(self):
        self.root: dict = {}
        self.rules: list[tuple[str, re.Pattern, str]] = []

    def add(self, surface: str, hint: str) -> None:
        """The next surface. Where two are equal without case, both have their turn."""
        node = self.root
        for token in _TOKENS.findall(surface):
            node = node.setdefault(_folded(token), {})
        # No token is empty, so "" is free for the numbers of the rules that end here.
        node.setdefault("", []).append(len(self.rules))
        self.rules.append((surface, re.compile(rf"(?<!\w){re.escape(surface)}(?!\w)", re.IGNORECASE), hint))

    def _present(self, text: str, after: int) -> list[int]:
        """Numbers above ``after`` of the surfaces that may stand in the text, ascending."""
        tokens = [_folded(t) for t in _TOKENS.findall(text)]
        found = set()
        for start in range(len(tokens)):
            node, at = self.root, start
            while at < len(tokens) and (node := node.get(tokens[at])) is not None:
                found.update(n for n in node.get("", ()) if n > after)
                at += 1
        return sorted(found)

    def applied_to(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with all surfaces replaced, each once and in turn, and those that were."""
        applied, last = [], -1
        while text:
            for number in self._present(text, last):
                last = number
                surface, pattern, hint = self.rules[number]
                if pattern.search(text):
                    text = pattern.sub(lambda _: hint, text)
                    applied.append(surface)
                    break       # the hint may have brought another
            else:
                break
        return text, applied
