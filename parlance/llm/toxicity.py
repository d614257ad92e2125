"""Toxicity by weak supervision.

Many voters look at a text: lexicons of several kinds and languages, patterns of
address and threat, and lexicons of words and word stems that a bounded sample of
labelled texts puts forward. A generative label model treats what a text really is as hidden; from the
votes on all texts, and the noisy labels where there are any, it estimates each
voter's rate of firing on either side, then the correlations of voters given the
side, by which it discounts voters that say the same. Its posteriors are the
training labels of a linear classifier over words, stems and votes, which gives the scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, written

LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled rows that the classifier is fitted on, about; words and stems that it knows; learned lexicons.
SAMPLE, WORDS, LEARNED = 20_000, 480, 36
#: Lengths of stems, and the mark of a stem that two or more different words of a text have.
STEMS, STEM = (4, 5, 6), "*"

# Short lexicons of general abuse.
LEXICONS = {
    "people_en": "idiot moron imbecile fool loser jerk clown freak creep scumbag dimwit halfwit nitwit dumbass retard psycho weirdo pig rat vermin coward liar",
    "contempt_en": "stupid dumb pathetic worthless disgusting useless ridiculous despicable vile hideous repulsive brainless clueless filthy ugly",
    "waste_en": "scum trash garbage filth crap rubbish",
    "profanity_en": "fuck fucking fucker shit shitty bullshit bitch bastard asshole dick cunt whore slut piss damn",
    "abuse_de": "idiot trottel dummkopf arschloch scheiße scheisse abschaum versager schlampe wichser hurensohn depp blödmann widerlich erbärmlich",
    "abuse_fr": "idiot imbécile connard connasse salaud salope crétin débile merde ordure pathétique dégoûtant minable abruti",
    "abuse_es": "idiota imbécil estúpido estúpida gilipollas cabrón mierda puta basura escoria asqueroso patético inútil perdedor payaso",
}
PATTERNS = {
    "told_off": (("shut", "hell", "lost", "screw", "drop"), r"\b(shut (the \w+ )?up|go to hell|get lost|screw you|drop dead)\b"),
    "death_wish": (("kill", "die", "dead", "hurt"), r"\b(kill (your|them|him|her)\w*|(hope|wish) (you|they) die|you (should|deserve to) die|(will|gonna) (hurt|kill) (you|them))\b"),
    "hatred": (("hate", "despise", "loathe"), r"\b(hate|despise|loathe) (you|them|these|those|all)\b"),
    "addressed": (("you", "your"), r"\byou(r|'re| are)? (\w+ ){0,2}(idiot|moron|stupid|dumb|pathetic|worthless|disgusting|loser|trash|scum|clown|fool)s?\b"),
}


def words_of(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """The words, and the stems that two or more of them share."""
    stems: Counter = Counter()
    for length in STEMS:
        stems.update(word[:length] for word in words if len(word) > length)
    return words.union(stem + STEM for stem, n in stems.items() if n > 1)


@dataclass(frozen=True)
class Voters:
    """All voters of a run; a vote is a bit of a number."""

    lexicons: tuple[frozenset[str], ...]
    learned: dict[str, int]
    patterns: tuple[tuple[frozenset[str], re.Pattern], ...] = field(default_factory=lambda: tuple(
        (frozenset(words), re.compile(pattern)) for words, pattern in PATTERNS.values()))

    @property
    def number(self) -> int:
        return len(self.lexicons) + len(self.patterns) + 2 + max(self.learned.values(), default=-1) + 1

    def votes(self, text: str, words: set[str], features: set[str]) -> int:
        """Bits: lexicons, patterns, two and three or more different words of any lexicon, learned lexicons."""
        bits = at = 0
        hits: set[str] = set()
        for lexicon in self.lexicons:
            found = words & lexicon
            hits |= found
            bits |= bool(found) << at
            at += 1
        lowered = None
        for needs, pattern in self.patterns:
            if not words.isdisjoint(needs):
                lowered = lowered or " ".join(text.lower().split())
                bits |= (pattern.search(lowered) is not None) << at
            at += 1
        learned = features & self.learned.keys()
        hits |= learned & words
        bits |= (len(hits) >= 2) << at | (len(hits) >= 3) << at + 1
        at += 2
        for feature in learned:
            bits |= 1 << at + self.learned[feature]
        return bits


def standard(telling: list[str]) -> Voters:
    """The fixed voters, and lexicons of telling features that begin alike; the most telling come first."""
    groups: dict[str, int] = {}
    learned = {}
    for feature in telling:
        if len(groups) < LEARNED:
            groups.setdefault(feature[:3], len(groups))
        if feature[:3] in groups:
            learned[feature] = groups[feature[:3]]
    return Voters(tuple(frozenset(words.split()) for words in LEXICONS.values()), learned)


@dataclass
class LabelModel:
    """Chance of class 1, rates of firing per class, discounts of voters, and the noise of labels."""

    prior: float
    rates: np.ndarray
    discounts: np.ndarray
    labels: np.ndarray

    def logit(self, fires: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Posterior log odds; ``seen`` is 1, 0, or -1 where there is no label."""
        on, off = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        out = math.log(self.prior / (1 - self.prior)) + fires @ (self.discounts * (on - off)) + (self.discounts * off).sum()
        out = out + np.where(seen == 1, math.log(self.labels[1] / self.labels[0]), 0.0)
        return out + np.where(seen == 0, math.log((1 - self.labels[1]) / (1 - self.labels[0])), 0.0)


def fires_of(votes: np.ndarray, number: int) -> np.ndarray:
    return (votes[:, None] >> np.arange(number) & 1).astype("float64")


def _sums(patterns: DataFrame, model: LabelModel) -> tuple[np.ndarray, ...]:
    """Totals over all vote patterns, per class: texts, labels seen, labels 1, and firings of two voters (of one: the diagonal)."""
    m = len(model.discounts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3 + m * m))
        for batch in batches:
            votes, seen, n = (batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in range(3))
            fires = fires_of(votes, m)
            p = 1 / (1 + np.exp(-np.clip(model.logit(fires, seen), -500, 500)))
            for side, weight in enumerate((n * (1 - p), n * p)):
                firsts = [weight.sum(), (weight * (seen >= 0)).sum(), (weight * (seen == 1)).sum()]
                total[side] += np.concatenate([firsts, (fires.T * weight @ fires).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "n"])

    rows = patterns.select("votes", "seen", "n").mapInArrow(add, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(2 * (3 + m * m))
    for row in rows:
        total[row["at"]] = row.n
    total = total.reshape(2, -1)
    return total[:, 0], total[:, 1], total[:, 2], total[:, 3:].reshape(2, m, m)


def estimated(patterns: DataFrame, number: int, steps: int = 8) -> LabelModel:
    """The label model of all vote patterns (votes, seen, n), by expectation maximisation.

    Each step is one pass that brings a few numbers per pair of voters to the
    driver. It gives new rates, and correlations of the voters within a class: a
    voter's say in the next step is divided by one plus its positive correlations.
    """
    model = LabelModel(0.1, np.vstack([np.full(number, 0.01), np.full(number, 0.3)]), np.ones(number), np.array([0.03, 0.9]))
    for _ in range(steps):
        texts, seen, ones, both = _sums(patterns, model)
        if not texts.sum():
            return model
        fired = np.stack([np.diag(side) for side in both])
        rates = (fired + np.array([[0.01], [0.3]]) * 2) / (texts[:, None] + 2)
        # A voter speaks for class 1: it fires there at least as often.
        rates[1] = np.maximum(rates[1], rates[0])
        labels = (ones + np.array([0.03, 0.9]) * 10) / (seen + 10)
        together = np.zeros((number, number))
        for side in (0, 1):
            mean = fired[side] / max(texts[side], 1e-9)
            spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
            correlation = (both[side] / max(texts[side], 1e-9) - np.outer(mean, mean)) / np.outer(spread, spread)
            together = np.maximum(together, np.where(np.outer(fired[side], fired[side]) > 0, correlation, 0.0))
        np.fill_diagonal(together, 0.0)
        model = LabelModel(
            float(np.clip(texts[1] / texts.sum(), 1e-4, 0.5)), np.clip(rates, 1e-6, 1 - 1e-6),
            1 / (1 + np.clip(together, 0, 1).sum(axis=1)), np.clip(labels, 1e-3, 1 - 1e-3),
        )
    return model


def linear(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the intercept first, by Newton steps with a ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge * weights
        curve = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        weights += move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return weights


@dataclass(frozen=True)
class Classifier:
    """A linear score over the presence of words and stems and over votes."""

    voters: Voters
    words: dict[str, float]
    votes: tuple[float, ...]
    base: float

    def score(self, text: str | None) -> float:
        text = text or ""
        words = words_of(text)
        features = features_of(words)
        bits = self.voters.votes(text, words, features)
        value = self.base + sum(w for i, w in enumerate(self.votes) if bits >> i & 1) + sum(sorted(self.words[known] for known in features & self.words.keys()))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, value))))


def telling_features(sample: DataFrame, most: int, least_texts: int = 4, least_share: float = 0.7) -> list[tuple[str, float]]:
    """Words and stems that occur almost only in texts of label 1, by their log likelihood ratio."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda one: list(features_of(words_of(one))))

    sums = sample.agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).first()
    ones, zeros = sums.ones or 0.0, sums.n - (sums.ones or 0.0)
    if not ones or not zeros:
        return []
    a, b, n = F.col("a"), F.col("n") - F.col("a"), F.col("n")
    ratio = 2 * (a * F.log(a * (ones + zeros) / (n * ones)) + F.when(b > 0, b * F.log(b * (ones + zeros) / (n * zeros))).otherwise(0.0))
    ranked = (
        sample.select("label", F.explode(split("text")).alias("feature")).groupBy("feature")
        .agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n"))
        .filter((n >= least_texts) & (a >= least_share * n) & (a / n > ones / (ones + zeros)))
        .select("feature", ratio.alias("ratio")).orderBy(F.desc("ratio"), "feature").limit(most)
    )
    return [(row.feature, row.ratio) for row in ranked.collect()]


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", key: str = "doc_id", text: str = "text",
           sample: int = SAMPLE) -> Classifier:
    """A classifier from all texts and from those labels that ``learn``, a condition on the key column, admits.

    The votes and the label model cover all rows of ``docs``; words are chosen and
    the classifier is fitted on about ``sample`` labelled rows. Without labels the
    lexicons and patterns vote alone, and the classifier is the label model itself.
    """
    known = labels.filter(learn)
    rows = written(labelled_sample(docs, known, label, sample, 5, key, text))
    words = telling_features(rows, WORDS)
    voters = standard([feature for feature, ratio in words if ratio > 20])

    @F.pandas_udf("long")
    def vote(texts: pd.Series) -> pd.Series:
        def of(text: str) -> int:
            found = words_of(text)
            return voters.votes(text, found, features_of(found))

        return texts.map(of).astype("int64")

    truth = known.select(F.col(key).alias("__id"), F.col(label).cast("double").alias("__label")).filter("__id IS NOT NULL AND __label IS NOT NULL")
    truth = truth.groupBy("__id").agg(F.max("__label").alias("__label"))
    votes = docs.select(F.col(key).alias("__id"), vote.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))).alias("votes"))
    patterns = written(
        votes.join(truth, "__id", "left").groupBy("votes", F.coalesce((F.col("__label") > 0.5).cast("long"), F.lit(-1)).alias("seen"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    model = estimated(patterns, voters.number)

    place = {word: i for i, (word, _) in enumerate(words)}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def present(texts: pd.Series) -> pd.Series:
        return texts.map(lambda one: [place[known] for known in features_of(words_of(one)) & place.keys()])

    got = rows.select("key", "label", vote("text").alias("votes"), present("text").alias("present")).collect()
    got.sort(key=lambda r: str(r.key))
    fires = fires_of(np.array([r.votes for r in got], "int64"), voters.number)
    if not len(got) or len({r.label > 0.5 for r in got}) < 2:
        say = model.discounts * (np.log(model.rates[1] / model.rates[0]) - np.log((1 - model.rates[1]) / (1 - model.rates[0])))
        base = math.log(model.prior / (1 - model.prior)) + float((model.discounts * np.log((1 - model.rates[1]) / (1 - model.rates[0]))).sum())
        return Classifier(voters, {}, tuple(say.tolist()), base)
    posterior = 1 / (1 + np.exp(-np.clip(model.logit(fires, np.array([int(r.label > 0.5) for r in got])), -500, 500)))
    x = np.zeros((len(got), len(words)))
    for i, row in enumerate(got):
        x[i, row.present] = 1.0
    weights = linear(np.hstack([fires, x]), posterior).tolist()
    m = voters.number
    return Classifier(voters, {word: w for (word, _), w in zip(words, weights[m + 1 :])}, tuple(weights[1 : m + 1]), weights[0])


def scored(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on); a null text scores like an empty one."""

    @F.pandas_udf("double")
    def look(texts: pd.Series) -> pd.Series:
        return texts.map(classifier.score).astype("float64")

    return (
        docs.withColumn("score", look.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def without_toxic(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", **options) -> DataFrame:
    """The documents that are not predicted toxic, as they are."""
    classifier = fitted(docs, labels, learn, text=text, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return scored(rows, classifier).filter("predicted = 0").select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])
