"""Side tables in tasks: automata, tries and question blocks, against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import sided
from parlance.operators import glossary, retrieval, scoring

from .test_plans import plan


def test_first_rows_carry_the_single_row(spark):
    rows = spark.range(100).repartition(7)
    got = sided.on_first_row(rows, spark.createDataFrame([([1, 2],)], "held array<int>"))
    by = {}
    for r in got.select(F.spark_partition_id().alias("p"), "id", "held").collect():
        by.setdefault(r.p, []).append(r.held)
    assert sum(map(len, by.values())) == 100
    assert all(held[0] == [1, 2] and not any(held[1:]) for held in by.values())


def test_ten_thousand_words_in_one_scan(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(10_000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60)).upper() + ".") for i in range(50)] + [(50, None), (51, "")]
    candidates = [(i, w) for i, w in enumerate(words)] + [(20_000, "W17 "), (20_001, "absent"), (20_002, "")]
    c, d = spark.createDataFrame(candidates, "candidate_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")
    for blocks in (1, 3):
        found = scoring.verbatim(c, d, blocks=blocks)
        assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)
        got = {r.candidate_id: (r.n_documents, r.first_doc_id) for r in found.collect()}
        texts = [(i, (t or "").lower().rstrip(".")) for i, t in docs]
        for i in [*range(0, 10_000, 97), 20_000, 20_001, 20_002]:
            word = dict(candidates)[i].strip().lower()
            hits = [k for k, t in texts if word and word in t]
            assert got[i] == (len(hits), min(hits, default=None)), i


def test_candidates_meet_only_documents_with_their_keys(spark):
    c = spark.createDataFrame([(1, 1, "alpha"), (2, 2, "alpha"), (3, None, "alpha")], "candidate_id bigint, workspace_id bigint, text string")
    d = spark.createDataFrame([(1, 1, "an alpha"), (2, 1, "alpha, too"), (3, 3, "alpha"), (4, None, "alpha")], "doc_id bigint, workspace_id bigint, text string")
    got = {r.candidate_id: (r.is_verbatim, r.n_documents) for r in scoring.verbatim(c, d, ["workspace_id"]).collect()}
    assert got == {1: (True, 2), 2: (False, 0), 3: (False, 0)}


def test_a_block_that_is_too_large_stops(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 10)
    c = spark.createDataFrame([(1, "a longer candidate")], "candidate_id bigint, text string")
    with pytest.raises(Exception, match="raise blocks"):
        scoring.verbatim(c, spark.createDataFrame([(1, "x")], "doc_id bigint, text string")).collect()


def spoken(text, rules):
    """The rule as written: every surface in turn, on the running text."""
    applied = []
    for surface, hint in rules:
        pattern = re.compile(rf"(?<!\w){re.escape(surface)}(?!\w)", re.IGNORECASE)
        if pattern.search(text):
            text = pattern.sub(lambda _: hint, text)
            applied.append(surface)
    return text, applied


@pytest.mark.parametrize("seed", range(3))
def test_spoken_texts_are_those_of_all_surfaces_in_turn(spark, seed):
    rng = random.Random(seed)
    parts = ["ODA", "oda", "Latter-Day", "(LDSC)", "a", "b", "Ünited", "đê", "A-b", "x.y", "straße", "İz", "Saint", "Charities"]
    surfaces = {(ws, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))) for ws in (1, 2) for _ in range(30)}
    mapping = [(ws, s, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 3))), i, i % 2) for i, (ws, s) in enumerate(sorted(surfaces))]
    texts = [(rng.choice([1, 2, 3, None]), i, rng.choice(["vi", "vi", "en"]), "".join(rng.choice(parts) + rng.choice([" ", " ", ", ", "-"]) for _ in range(rng.randrange(0, 14))))
             for i in range(80)] + [(1, 80, "vi", None)]
    got = {r.text_id: (r.spoken, r.applied) for r in glossary.apply_pronunciation(
        spark.createDataFrame(texts, "workspace_id bigint, text_id bigint, lang string, text string"),
        spark.createDataFrame(mapping, "workspace_id bigint, surface string, hint string, first_id bigint, side int"), splits=3).collect()}
    assert len(got) == len(texts)
    for ws, i, lang, text in texts:
        rules = [(s, h) for w, s, h, first, side in sorted(mapping, key=lambda m: (-len(m[1]), m[3], m[4], m[1])) if w == ws]
        assert got[i] == (spoken(text, rules) if lang == "vi" and text is not None else (text, [])), (i, text)


def test_chunks_are_not_shuffled_by_a_pass(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, i % 7, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, workspace_id bigint, document_id bigint, embedding array<double>")
    own = F.col("document_id")
    asked = chunks.filter(F.col("chunk_id") % 5 == 0).select(
        F.col("chunk_id").alias("query_id"), "workspace_id", "embedding", F.when(F.col("chunk_id") % 10 == 0, F.array(own, own + 1)).alias("scope"))
    cells = sorted(map(tuple, retrieval.nearest(asked, chunks, 7).select("query_id", "rank", "chunk_id", "document_id", "distance").collect()))
    for blocks in (1, 3):
        found = retrieval.nearest_by_pass(asked, chunks, 7, blocks).select("query_id", "rank", "chunk_id", "document_id", "distance")
        assert sorted(map(tuple, found.collect())) == cells
        exchanges = [line for line in plan(found, "simple").splitlines() if "Exchange" in line and "Broadcast" not in line]
        assert all("embedding" not in line for line in exchanges)
