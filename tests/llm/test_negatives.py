"""Subset-sum scores against inner products; mined rows against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import negatives
from parlance.llm.negatives import bit_planes, hard_negatives, scores, subset_sums

SCHEMA = "vec_id long, embedding array<float>, label int, id string, rank string, vector string"


@pytest.mark.parametrize("dims, largest", [(64, 150), (5, 3), (17, 10**6), (8, 1), (1, 0), (0, 1), (64, 1 << 25)])
def test_scores_are_inner_products(dims, largest):
    rng = np.random.default_rng(dims)
    anchors, vectors = rng.integers(-largest, largest + 1, (7, dims)), rng.integers(-largest, largest + 1, (29, dims))
    assert (scores(subset_sums(anchors), bit_planes(vectors)) == vectors @ anchors.T).all()


def slow(rows):
    fit = []
    for vec, emb, label, *_ in rows:
        if vec is None or label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        fit.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in emb]))
    for anchor, own, a in fit:
        if anchor % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a, c)), vec, label) for vec, label, c in fit if vec != anchor]
        # a row of the anchor's own id is no other row, but one with another label is of another label
        others = scored + [(-sum(x * y for x, y in zip(a, c)), vec, label) for vec, label, c in fit if vec == anchor and label != own]
        for p, positive, _ in sorted(s for s in scored if s[2] == own)[:5]:
            fitting = sorted(s for s in others if s[2] != own and 50 * -p <= 100 * -s[0] <= 95 * -p)
            for rank, (n, negative, _) in enumerate(fitting[:3], 1):
                yield anchor, positive, rank, negative, -p, -n


def table(seed, n, dims=12):
    rng = random.Random(seed)
    few = [[rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        vector = list(rng.choice(few)) if rng.random() < 0.5 else [rng.uniform(-1, 1) for _ in range(dims)]
        odd = rng.random()
        if odd < 0.02:
            vector = None
        elif odd < 0.06:
            vector[3] = rng.choice([None, math.nan, math.inf, -math.inf])
        elif odd < 0.08:
            vector = vector[: rng.randrange(dims)]
        rows.append((i if odd < 0.99 else None, vector, None if 0.1 < odd < 0.12 else 0 if rng.random() < 0.33 else rng.randrange(10), "x", "y", "z"))
    return rows + rows[50:52] + [(50, few[0], 3, None, None, None)]


def moved_label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("seed, anchors", [(1, 4096), (2, 4)])
def test_mined_rows_are_those_of_brute_force(llm, monkeypatch, seed, anchors):
    monkeypatch.setattr(negatives, "TABLES", 3)
    rows = table(seed, 420)
    vectors = llm.createDataFrame(rows, SCHEMA).repartition(5)
    got = hard_negatives(vectors, F.col("id") % 50 == 0, label=moved_label(), anchors=anchors).collect()
    assert sorted(map(tuple, got)) == sorted(slow(rows))
    assert len(got) > 20


def test_no_rows_and_no_anchors(llm):
    none = llm.createDataFrame([], SCHEMA)
    assert hard_negatives(none, F.col("id") % 50 == 0).collect() == []
    rows = llm.createDataFrame([(1, [1.0], 0, "", "", ""), (50, None, 0, "", "", "")], SCHEMA)
    assert hard_negatives(rows, F.col("id") % 50 == 0).collect() == []


def test_huge_components_are_held(llm):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [1e30, -3e38], 2), (3, [3e38, -1e5], 2)]
    got = hard_negatives(llm.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("id") % 50 == 0).collect()
    assert all(0 < r.negative_score < r.positive_score < negatives.LARGEST for r in got)
