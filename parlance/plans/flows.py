"""The three main flows: ingest, cited answers, research to glossary, and the first screen."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, documents, feedback, research, retrieval
from ..operators import glossary as gl
from ..session import cut_lineage
from ..sources import files


class Ingested(NamedTuple):
    documents: DataFrame
    chunks: DataFrame


def ingest(uploads: DataFrame, separator: str = files.PARAGRAPH_BREAK, **detector) -> Ingested:
    """Text to labelled documents and chunks. uploads: doc_id, workspace_id, filename, text.

    Re-indexing is the same call on the stored texts.
    """
    classified = documents.classify(documents.with_blocks(uploads, separator), **detector)
    return Ingested(classified, chunking.chunk_documents(classified))


class Answers(NamedTuple):
    hits: DataFrame
    context: DataFrame
    citations: DataFrame
    state: DataFrame


def cited_answers(
    questions: DataFrame, vectors: DataFrame, chunks: DataFrame, names: DataFrame, model_answers: DataFrame,
    k: int = retrieval.TOP_K,
) -> Answers:
    """Search, context, and citations for a table of questions.

    The hits feed three results; they are k rows per question, so they are
    written once (checkpoint) instead of being searched again.
    """
    hits = cut_lineage(retrieval.search(questions, vectors, k))
    return Answers(
        hits,
        retrieval.context_blocks(hits, chunks, names),
        retrieval.resolve_citations(model_answers, hits, chunks, names),
        retrieval.answer_state(model_answers),
    )


class Research(NamedTuple):
    results: DataFrame
    facts: DataFrame
    glossary: gl.Upsert


def research_run(
    results: DataFrame, facts: DataFrame, profiles: DataFrame, fields: DataFrame, candidates: DataFrame,
    glossary: DataFrame | None = None, open_conflicts: DataFrame | None = None,
) -> Research:
    """Admitted, deduplicated results; grounded facts without protected fields; merged terms."""
    admitted = research.query_budget(results).filter("admitted").drop("admitted")
    unique = research.distinct_urls(research.clean_results(admitted))
    grounded = research.ground_facts(facts, unique)
    return Research(
        unique, research.drop_protected(grounded, profiles, fields),
        gl.upsert(candidates, glossary, open_conflicts),
    )


class Divergence(NamedTuple):
    summary: DataFrame
    trend: DataFrame
    heaviest: DataFrame
    counts: DataFrame


def divergence_report(verdicts: DataFrame, scores: DataFrame, bucket: str = "month") -> Divergence:
    """How far machine and expert are apart, per workspace. Verdicts and scores are joined once."""
    pairs = feedback.compared(feedback.expert_overall(verdicts), feedback.machine_overall(scores))
    return Divergence(
        feedback.divergence(pairs),
        feedback.gap_trend(pairs, [F.col("created_at"), F.col("attempt_id")], F.date_trunc(bucket, F.col("created_at"))),
        feedback.heaviest_criterion(pairs),
        feedback.verdict_counts(verdicts, pairs),
    )
