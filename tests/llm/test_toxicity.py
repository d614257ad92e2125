"""Votes, the label model on made votes, and held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import catalog
from parlance.llm.common import fold
from parlance.llm.toxicity import estimated, features_of, fitted, linear, scored, standard, without_toxic, words_of


def test_votes_and_features():
    voters = standard(["blarg", "blargo*", "zonk"])
    vote = lambda text: voters.votes(text, words_of(text), features_of(words_of(text)))
    assert vote("") == vote("a nice day") == 0
    assert vote("You IDIOT!") & 1 and vote("you are such an idiot") >> len(voters.lexicons) + 3 & 1
    assert vote("blarg zonk") >> len(voters.lexicons) + len(voters.patterns) & 1
    assert bin(vote("zonk")).count("1") == 1 and voters.number <= 62
    assert features_of({"abcdef", "abcdxy", "abc"}) == {"abcdef", "abcdxy", "abc", "abcd*"}


def test_label_model_finds_rates_and_discounts_copies(llm):
    rng = np.random.default_rng(7)
    truth = rng.random(6000) < 0.2
    rates = [(0.02, 0.6), (0.05, 0.5), (0.01, 0.4), (0.1, 0.7)]
    fires = [rng.random(6000) < np.where(truth, hi, lo) for lo, hi in rates]
    fires.append(fires[0])
    votes = sum(f.astype(int) << i for i, f in enumerate(fires))
    seen = np.where(rng.random(6000) < 0.3, truth.astype(int), -1)
    rows = llm.createDataFrame([(int(v), int(s)) for v, s in zip(votes, seen)], "votes long, seen long").groupBy("votes", "seen").agg(F.count("*").alias("n"))
    model = estimated(rows, 5)
    assert abs(model.prior - 0.2) < 0.05
    for i, (lo, hi) in enumerate(rates):
        assert abs(model.rates[0, i] - lo) < 0.05 and abs(model.rates[1, i] - hi) < 0.12
    assert model.discounts[0] < 0.65 and model.discounts[4] < 0.65 and model.discounts[2] > 0.75


def test_linear_fits_soft_labels():
    rng = np.random.default_rng(3)
    x = (rng.random((4000, 3)) < 0.5).astype(float)
    p = 1 / (1 + np.exp(-(-1 + 2 * x[:, 0] - 3 * x[:, 1])))
    assert np.allclose(linear(x, p, 0.01), [-1, 2, -3, 0], atol=0.05)


def test_held_out_accuracy(llm):
    folder = "/root/testdata/sf0.1"
    docs, labels = (llm.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    got = catalog.queries()["op5_toxicity"](llm, folder).join(labels, "doc_id").select("held_out", "score", "predicted", "toxic").toPandas()
    held = got[got.held_out]
    assert len(got) == labels.count() and 0 <= got.score.min() and got.score.max() <= 1
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.01


def test_odd_input(llm, odd, nothing):
    labels = llm.createDataFrame([(1, 1, 0), (2, 0, None), (2, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    learn = fold(F.col("doc_id"), 5) != 0
    for known in (labels, labels.limit(0)):
        model = fitted(odd, known, learn)
        rows = scored(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
        assert model.score("you idiot, you stupid worthless moron") > model.score("a fine day")
    assert scored(nothing, fitted(nothing, labels, learn)).collect() == []
    assert without_toxic(odd, labels.limit(0), learn).columns == odd.columns
