"""Practice sessions: script checks, verbatim proof, score post-processing, reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as nm
from ..functions import ordered
from ..functions import text as tx
from ..functions.arrays import unnest
from ..functions.sided import on_first_row
from .feedback import CRITERIA

# ---- fixed values ----
MIN_TERMS_RATIO = 0.75
TURN_MIN_SECONDS = 30
TURN_MAX_SECONDS = 60
TOLERANCE_LOW = 0.8
TOLERANCE_HIGH = 1.3
CEILING_STEP = 2.5
FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
# ---- end of fixed values ----

#: Bytes of different candidates that one automaton holds at most.
BLOCK_BYTES = 32 << 20


def duration_bounds() -> tuple[int, int]:
    """Accepted speaking time of a turn, in whole seconds."""
    return round(TURN_MIN_SECONDS * TOLERANCE_LOW), round(TURN_MAX_SECONDS * TOLERANCE_HIGH)


# ------------------------------------------------------------------ scripts


def turn_checks(turns: DataFrame) -> DataFrame:
    """Per turn: estimated seconds and whether it is too short, too long or lacks a reference.

    turns: session_id, turn_index, source_lang, source_text, reference_translation.
    """
    seconds = tx.speaking_seconds(F.col("source_text"), F.col("source_lang"))
    return turns.withColumn("seconds", seconds).withColumns({
        "too_short": F.col("seconds") < F.lit(TURN_MIN_SECONDS * TOLERANCE_LOW).cast("decimal(6,1)"),
        "too_long": F.col("seconds") > F.lit(TURN_MAX_SECONDS * TOLERANCE_HIGH).cast("decimal(6,1)"),
        "missing_reference": tx.blank(F.col("reference_translation")),
    })


def problem_turns(turns: DataFrame) -> DataFrame:
    """The turns a script check names, one row per (turn, problem); numbers start at 1."""
    kinds = ("too_short", "too_long", "missing_reference")
    found = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]))
    return turn_checks(turns).select(
        "session_id", (F.col("turn_index") + 1).alias("turn_no"), F.explode(found).alias("problem")
    )


def script_report(turns: DataFrame, expected_turns: DataFrame, used_terms: DataFrame | None = None) -> DataFrame:
    """Quality check of every script in one pass of sums.

    expected_turns: session_id, expected. used_terms: session_id, n_terms (see
    :func:`distinct_terms`); without it the glossary is empty and not checked.
    """
    per_session = turn_checks(turns).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("source_lang") == "vi").alias("n_vi"),
        F.count_if(F.col("source_lang") == "en").alias("n_en"),
        F.count_if("too_short").alias("n_too_short"),
        F.count_if("too_long").alias("n_too_long"),
        F.count_if("missing_reference").alias("n_missing_reference"),
    )
    report = per_session.join(expected_turns, "session_id").withColumns({
        "wrong_count": F.abs(F.col("n_turns") - F.col("expected")) > 1,
        "one_direction": (F.col("n_vi") == 0) | (F.col("n_en") == 0),
    })
    required = F.greatest(F.lit(2), F.floor(F.col("n_turns") * F.lit(MIN_TERMS_RATIO)).cast("int"))
    if used_terms is None:
        report = report.withColumns({"n_terms": F.lit(0), "too_few_terms": F.lit(False)})
    else:
        report = (
            report.join(used_terms, "session_id", "left")
            .withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
            .withColumn("too_few_terms", F.col("n_terms") < required)
        )
    flags = [
        F.col("wrong_count"), F.col("one_direction"), F.col("n_too_short") > 0, F.col("n_too_long") > 0,
        F.col("n_missing_reference") > 0, F.col("too_few_terms"),
    ]
    problems = reduce(lambda a, b: a + b, [f.cast("int") for f in flags])
    return report.withColumn("required_terms", required).withColumn("n_problems", problems)


def matched_terms(turn_terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """Term names of a turn to glossary ids; unknown names are dropped, order and repeats kept.

    turn_terms: session_id, workspace_id, turn_index, names (array).
    """
    names = turn_terms.select(
        "session_id", "workspace_id", "turn_index", F.posexplode("names").alias("position", "name")
    ).withColumn("term_vi_norm", tx.term_key(F.col("name")))
    return names.join(
        glossary.select("workspace_id", "term_vi_norm", F.col("id").alias("glossary_id")),
        ["workspace_id", "term_vi_norm"],
    ).select("session_id", "workspace_id", "turn_index", "position", "glossary_id")


def distinct_terms(matched: DataFrame) -> DataFrame:
    return matched.select("session_id", "glossary_id").distinct().groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_terms")
    )


# ------------------------------------------------------------------ verbatim proof


def verbatim(candidates: DataFrame, documents: DataFrame, keys: Sequence[str] = (), blocks: int = 1) -> DataFrame:
    """Which candidates occur word for word in some document with the same ``keys``.

    candidates: candidate_id, text and keys. documents: doc_id, text and keys.
    Adds is_verbatim, n_documents and first_doc_id. Both texts are compared
    without case and punctuation; a candidate may start or end inside a word,
    an empty one never matches.

    The different candidates become one automaton per block, which finds all of
    them in one scan of a text; documents are neither shuffled nor paired with
    candidates, and a task keeps two numbers per candidate. A block is broadcast
    and holds BLOCK_BYTES of candidates at most; with more of them ``blocks``
    must grow (the query stops otherwise), and each block scans the documents.
    """
    keys = list(keys)
    known = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    prepared = candidates.withColumn("__norm", tx.squash(F.col("text")))
    distinct = prepared.filter(F.col("__norm") != "").dropna(subset=keys).groupBy(*keys, "__norm").agg(F.min("candidate_id").alias("__cid"))
    texts = documents.select(known.alias("__key"), "doc_id", tx.squash(F.col("text")).alias("__doc"))
    id_types = [candidates.schema["candidate_id"].dataType, documents.schema["doc_id"].dataType]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("__cid", "__n", "__first"), (id_types[0], T.LongType(), id_types[1]))])
    small = F.sum(F.octet_length("__norm")) <= BLOCK_BYTES
    parts = []
    for block in range(blocks):
        mine = distinct.filter(F.pmod(F.xxhash64("__norm"), F.lit(blocks)) == block) if blocks > 1 else distinct
        patterns = F.collect_list(F.struct(known.alias("key"), F.col("__norm").alias("norm"), F.col("__cid").alias("cid")))
        single = mine.agg(F.when(small, patterns).otherwise(F.raise_error(F.lit("candidates of a block exceed its bytes: raise blocks"))).alias("__patterns"))
        parts.append(on_first_row(texts, single).mapInArrow(_occurrences, schema))
    proven = reduce(DataFrame.unionByName, parts).groupBy("__cid").agg(F.sum("__n").alias("__n"), F.min("__first").alias("__first"))
    found = distinct.join(proven, "__cid").select(*keys, "__norm", "__n", "__first")
    return prepared.join(found, [*keys, "__norm"], "left").withColumns({
        "is_verbatim": F.col("__n").isNotNull(),
        "n_documents": F.coalesce("__n", F.lit(0)),
        "first_doc_id": F.col("__first"),
    }).select(*candidates.columns, "is_verbatim", "n_documents", "first_doc_id")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(candidate, documents that hold it, least of them) of a partition whose first row brings the candidates."""
    import ahocorasick

    automaton, owners, found = ahocorasick.Automaton(), [], {}
    for batch in batches:
        if batch.num_rows and batch.column(3)[0].is_valid:
            places = {}
            for pattern in batch.column(3)[0].as_py():
                if pattern["norm"] not in places:
                    places[pattern["norm"]] = len(owners)
                    automaton.add_word(pattern["norm"], len(owners))
                    owners.append({})
                owners[places[pattern["norm"]]][pattern["key"]] = pattern["cid"]
            if owners:
                automaton.make_automaton()
        if not owners:
            continue
        for key, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for place in {place for _, place in automaton.iter(text or "")}:
                if key in owners[place]:
                    n, first = found.get(owners[place][key], (0, None))
                    found[owners[place][key]] = n + 1, doc if first is None or (doc is not None and doc < first) else first
    if found:
        kinds = [batch.column(3).type.value_type.field("cid").type, pa.int64(), batch.column(1).type]
        columns = [list(found), [n for n, _ in found.values()], [first for _, first in found.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["__cid", "__n", "__first"])


def first_parallel_document(documents: DataFrame, document_texts: DataFrame) -> DataFrame:
    """Lowest ready parallel document per workspace, if both of its texts exist."""
    first = documents.filter((F.col("status") == "ready") & (F.col("language") == "parallel")).groupBy(
        "workspace_id"
    ).agg(F.min("doc_id").alias("doc_id"))
    texts = document_texts.select("doc_id", "vi_text", "en_text")
    return first.join(texts, "doc_id").filter((F.col("vi_text") != "") & (F.col("en_text") != ""))


def reference_tier(claimed: Column, verified: Column) -> Column:
    return F.when(claimed & F.coalesce(verified, F.lit(False)), "verbatim_parallel").otherwise("ai")


# ------------------------------------------------------------------ sessions and attempts


def list_sessions(sessions: DataFrame, limit: int = 30) -> DataFrame:
    return ordered.first_per_key(
        sessions, ["workspace_id"], [F.col("created_at").desc(), F.col("id").desc()], limit
    )


def latest_attempts(turns: DataFrame, attempts: DataFrame, order: list[str]) -> DataFrame:
    """Every turn with its newest attempt and score, turns without one kept.

    ``order`` are the attempt columns that decide which one is newest.
    """
    others = [c for c in attempts.columns if c != "turn_id" and c not in order]
    newest = attempts.groupBy("turn_id").agg(F.max(F.struct(*order, *others)).alias("__a"))
    return turns.join(newest, "turn_id", "left").select(
        *turns.columns, *[F.col(f"__a.{c}").alias(c) for c in [*order, *others]]
    )


def session_state(sessions: DataFrame, attempts: DataFrame, completions: DataFrame) -> DataFrame:
    """Status and stamps derived from appended attempts and completion events.

    attempts: session_id, created_at. completions: session_id, completed_at. An
    attempt after a completion reopens the session.
    """
    tried = attempts.groupBy("session_id").agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("__last"),
        F.count(F.lit(1)).alias("n_attempts"),
    )
    done = completions.groupBy("session_id").agg(F.max("completed_at").alias("completed_at"))
    return (
        sessions.join(tried, "session_id", "left").join(done, "session_id", "left")
        .withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)))
        .withColumn(
            "status",
            F.when(F.col("completed_at").isNotNull()
                   & (F.col("__last").isNull() | (F.col("completed_at") >= F.col("__last"))), "completed")
            .when(F.col("__last").isNotNull(), "in_progress")
            .otherwise("generated"),
        )
        .drop("__last")
    )


def effective_transcript(edited: Column, raw: Column) -> Column:
    """The edited text if there is one, else the raw text; NULL when nothing can be scored."""
    chosen = F.coalesce(F.nullif(edited, F.lit("")), raw, F.lit(""))
    return F.nullif(tx.strip(chosen), F.lit(""))


def turn_terms(turns: DataFrame, glossary: DataFrame) -> DataFrame:
    """Glossary rows of the ids in a turn's JSON list; a broken list counts as empty.

    turns: turn_id, terms_used (JSON text).
    """
    ids = F.coalesce(F.from_json("terms_used", "array<bigint>"), F.array().cast("array<bigint>"))
    listed = turns.select("turn_id", F.explode(F.array_distinct(ids)).alias("glossary_id"))
    return listed.join(glossary.withColumnRenamed("id", "glossary_id"), "glossary_id")


# ------------------------------------------------------------------ scores


def override_pinned(verdicts: DataFrame, pinned: DataFrame) -> DataFrame:
    """Verdicts in which real use decides about terms the expert pinned.

    verdicts: attempt_id, term_vi, expected, used, correct. pinned: attempt_id,
    term_vi, term_en, target_lang, user_translation. Missing verdicts are added,
    changed ones are flagged ``overridden``.
    """
    expected = F.when(F.col("target_lang") == "en", F.col("term_en")).otherwise(F.col("term_vi"))
    checked = pinned.select(
        "attempt_id", "term_vi", expected.alias("__expected"),
        tx.contains_loosely(F.col("user_translation"), expected).alias("__really_used"),
        F.lit(True).alias("__pinned"),
    )
    merged = verdicts.withColumn("__given", F.lit(True)).join(checked, ["attempt_id", "term_vi"], "full")
    is_pinned, given = F.col("__pinned").isNotNull(), F.col("__given").isNotNull()
    correct = F.coalesce(F.col("correct"), F.lit(False))
    return merged.select(
        "attempt_id", "term_vi",
        F.when(given, F.col("expected")).otherwise(F.col("__expected")).alias("expected"),
        F.when(given, F.col("used")).when(F.col("__really_used"), F.col("__expected")).otherwise("").alias("used"),
        F.when(is_pinned, F.col("__really_used")).otherwise(correct).alias("correct"),
        is_pinned.alias("pinned"),
        (is_pinned & given & (correct != F.col("__really_used"))).alias("overridden"),
        (~given).alias("added"),
    )


def final_scores(raw: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Clamped scores, the terminology ceiling, and the overall mean.

    raw: attempt_id, score_<criterion>. verdicts: result of :func:`override_pinned`.
    """
    wrong = verdicts.filter("pinned").groupBy("attempt_id").agg(F.count_if(~F.col("correct")).alias("n_wrong"))
    ceiling = F.greatest(F.lit(0), F.lit(10) - F.lit(CEILING_STEP).cast("decimal(2,1)") * F.col("n_wrong"))
    clamped = raw.join(wrong, "attempt_id", "left").withColumn("n_wrong", F.coalesce("n_wrong", F.lit(0))).withColumns(
        {f"score_{c}": nm.clamp_score(F.col(f"score_{c}")) for c in CRITERIA}
    )
    limited = F.when(F.col("n_wrong") > 0, F.least(F.col("score_terminology"), ceiling.cast(nm.SCORE))).otherwise(
        F.col("score_terminology")
    )
    return (
        clamped.withColumn("was_limited", limited < F.col("score_terminology"))
        .withColumn("score_terminology", limited)
        .withColumn("score_overall", nm.row_mean([F.col(f"score_{c}") for c in CRITERIA]))
    )


def session_report(turns: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per session: turns, scored attempts, mean per criterion and overall.

    turns: session_id, turn_id. attempts: turn_id, a_<criterion>,
    a_overall (all attempts with all scores). Sums are taken per turn first, so
    a session with most of the turns is reduced before it meets in one place. The
    turns of a session have different indexes, so counting turns counts them.
    """
    scored = attempts.filter(F.col("a_overall").isNotNull())
    names = [*CRITERIA, "overall"]
    per_turn = scored.groupBy("turn_id").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(nm.tenths(F.col(f"a_{c}"))).alias(f"__s_{c}") for c in names],
        *[F.count(f"a_{c}").alias(f"__c_{c}") for c in CRITERIA],
    ).withColumn("__c_overall", F.col("__n"))

    def mean(c: str) -> Column:
        return nm.rounded_mean(F.sum(f"__s_{c}"), F.sum(f"__c_{c}"), 1)

    listed = turns.select("session_id", "turn_id").distinct()
    return listed.join(per_turn, "turn_id", "left").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n_scored"),
        *[mean(c).alias(f"mean_{c}") for c in CRITERIA], mean("overall").alias("overall"),
    )


def write_back_overall(sessions: DataFrame, report: DataFrame) -> DataFrame:
    """Session rows with the overall score of the report; unscored ones keep theirs."""
    new = report.select(F.col("session_id").alias("id"), F.col("overall").alias("__overall"))
    return sessions.join(new, "id", "left").withColumn(
        "overall_score", F.coalesce("__overall", "overall_score")
    ).select(*sessions.columns)


VERDICTS_JSON = "struct<terms:array<struct<term_vi:string,expected_en:string,used_by_expert:string,correct:boolean>>,missing:array<string>>"


def wrong_terms(scores: DataFrame, keys: Sequence[str], skip_blank: bool = False) -> DataFrame:
    """Terms translated wrongly: times and the first expected translation, per ``keys``.

    scores: keys, seq (order), term_verdicts (JSON text). Text that is no JSON
    gives no terms. A missing ``correct`` counts as wrong. Partial sums carry
    the count, and ``min_by`` the first expected form.
    """
    terms = F.from_json("term_verdicts", VERDICTS_JSON)["terms"]
    given = scores.filter(F.col("term_verdicts").isNotNull())
    rows = unnest(given, [*keys, "seq"], terms, "v", "pos").filter(
        ~F.coalesce(F.col("v.correct"), F.lit(False))
    ).select(*keys, "seq", "pos", F.coalesce("v.term_vi", F.lit("")).alias("term_vi"), "v.expected_en")
    if skip_blank:
        rows = rows.withColumn("term_vi", tx.strip(F.col("term_vi"))).filter(F.col("term_vi") != "")
    return rows.groupBy(*keys, "term_vi").agg(
        F.count(F.lit(1)).alias("wrong_times"),
        F.min_by("expected_en", F.struct("seq", "pos")).alias("expected"),
    )


def top_wrong_terms(scores: DataFrame, key: str = "workspace_id", limit: int = 12) -> DataFrame:
    """The terms of a workspace to review first."""
    return ordered.first_per_key(
        wrong_terms(scores, [key], skip_blank=True), [key], [F.col("wrong_times").desc(), F.col("term_vi")], limit
    )


def history_summary(sessions: DataFrame) -> DataFrame:
    """Per workspace: sessions, scored ones, best overall score, sessions in progress."""
    return sessions.groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.count("overall_score").alias("n_scored"),
        F.max("overall_score").alias("best_score"),
        F.count_if(F.col("status") == "in_progress").alias("n_in_progress"),
    )


# ------------------------------------------------------------------ model output


def strip_fence(text: Column) -> Column:
    """Text inside a Markdown code fence, or the trimmed text without one."""
    return F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(tx.strip(text))


def repair_output(
    outputs: DataFrame, schema: T.StructType | str, required: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Model output split into (valid, rejected).

    outputs: output_id, raw. Valid rows carry ``parsed``. Broken JSON comes back
    as a struct of NULLs, so the required fields are tested, not the struct. An
    explicit null is the same as a missing field.
    """
    parsed = outputs.withColumn("parsed", F.from_json(strip_fence(F.col("raw")), schema))
    complete = reduce(lambda a, b: a & b, [F.col(f"parsed.{f}").isNotNull() for f in required], F.lit(True))
    valid = F.coalesce(F.col("parsed").isNotNull() & complete, F.lit(False))
    return parsed.filter(valid), parsed.filter(~valid).drop("parsed")
