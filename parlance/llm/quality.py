"""Quality rules: measures of whole texts, and a line sequence labelling.

A linear-chain conditional random field marks each line with a word as content or
boilerplate. Its unary features are shares and flags of the line, its transitions
tie neighbouring lines. It is fitted on a bounded sample of labelled documents. The
marks of their lines are hidden: a label only says on which side most lines of the
document are, so a good document may have a menu, and a bad one a sentence. Viterbi decoding gives the most likely sequence of marks, and the share of words
on content lines decides whether a document stays.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, labelled_sample

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Documents that the field is fitted on, about; those of more lines are used in windows of LINES.
SAMPLE, LINES = 2_000, 60
#: Share of the lines that is on the side of the document's label, at least.
LEAST = 0.6
FEATURES = ("always", "words", "symbols", "capitals", "exclaims", "bars", "digits", "long_words", "closed", "repeated", "short", "capital_start", "echoes", "many_symbols", "many_bars", "many_capitals", "many_echoes")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CLOSING = (".", "!", "?", "…", '"', "”", "»", ":", ")")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a run of ``window`` words found twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers = np.fromiter(map(hash, words), "int64", len(words)).view("uint64")
    seen = np.zeros(n, "uint64")
    for j in range(window):
        seen = seen * _STEP + numbers[j : j + n]
    order = np.argsort(seen, kind="stable")
    same = seen[order][1:] == seen[order][:-1]
    if not same.any():
        return 0
    alike = np.zeros(n, bool)
    alike[order[1:][same]] = alike[order[:-1][same]] = True
    places = np.flatnonzero(alike).tolist()
    runs = Counter(tuple(words[p : p + window]) for p in places)  # the runs themselves decide, not their numbers
    border = np.zeros(len(words) + 1, "int64")
    for p in places:
        if runs[tuple(words[p : p + window])] > 1:
            border[p] += 1
            border[p + window] -= 1
    return int((np.cumsum(border)[:-1] > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()
    seen: set[str] = set()
    lines = doubles = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            seen.add(line)
    doubles = lines - len(seen)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), doubles, repeated_words(words)
    )


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES for each line with a word, and the words of each line."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        chars = sum(map(len, words))
        symbols, bars = min(sum(map(line.count, "#*$%&<>")) / n, 3.0), min(line.count("|") / n, 1.0)
        capitals, echoes = sum(map(str.isupper, words)) / n, sum(map(eq, words, words[1:])) / n
        rows.append((
            1.0, min(math.log1p(n), 6.0) / 3, symbols, capitals, min(line.count("!") / n, 2.0), bars, sum(map(str.isdigit, words)) / n,
            min(max(chars / n - 9, 0.0), 10.0) / 5, float(words[-1].endswith(_CLOSING)), float(line in seen), float(n < 4), float(line.lstrip()[:1].isupper()),
            echoes, float(symbols > 0.3), float(bars > 0.15), float(capitals > 0.5), float(echoes > 0.3),
        ))
        seen.add(line)
        sizes.append(n)
    return np.array(rows, "float64").reshape(-1, len(FEATURES)), np.array(sizes, "int64")


@dataclass(frozen=True)
class Field:
    """Weights of the field: ``content`` per feature (boilerplate has 0), ``moves`` from mark to mark."""

    content: tuple[float, ...]
    moves: tuple[tuple[float, float], tuple[float, float]]

    def marks(self, rows: np.ndarray) -> np.ndarray:
        """The most likely sequence: 1 content, 0 boilerplate."""
        gain = (rows @ np.array(self.content)).tolist()
        if not gain:
            return np.zeros(0, "int64")
        (stay0, to1), (to0, stay1) = self.moves
        bad, good, back = 0.0, gain[0], []
        for one in gain[1:]:
            from_bad, from_good = bad + to1 > good + stay1, bad + stay0 >= good + to0
            bad, good = (bad + stay0 if from_good else good + to0), (bad + to1 if from_bad else good + stay1) + one
            back.append((0 if from_good else 1, 0 if from_bad else 1))
        mark = int(good > bad)
        out = [mark]
        for pair in reversed(back):
            mark = pair[mark]
            out.append(mark)
        return np.array(out[::-1])

    def content_share(self, text: str) -> float:
        rows, sizes = line_features(text)
        return float(sizes[self.marks(rows) == 1].sum() / sizes.sum()) if len(sizes) else 0.0


#: Used where there are no labels of both kinds: symbols, capitals, bars and repeated lines speak against a line.
PLAIN = Field((1.5, 0.5, -6.0, -4.0, -3.0, -4.0, -2.0, -1.0, 0.7, -1.5, -0.3, 0.3, -4.0, -2.0, -2.0, -1.0, -2.0), ((0.7, -0.7), (-0.7, 0.7)))


class _Lines:
    """Documents as sequences of line features, padded to the longest; all run forward and backward together, in log space."""

    def __init__(self, texts: list[np.ndarray]):
        length = max(map(len, texts))
        self.x = np.zeros((len(texts), length, len(FEATURES)))
        self.there = np.zeros((len(texts), length), bool)
        for i, rows in enumerate(texts):
            self.x[i, : len(rows)], self.there[i, : len(rows)] = rows, True

    def chances(self, weights: np.ndarray, leaning: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Chance of content per line, and expected moves (document, from, to); ``leaning`` adds to content in a document."""
        length = self.there.shape[1]
        unary = np.zeros((*self.there.shape, 2))
        unary[..., 1] = self.x @ weights[: len(FEATURES)] + np.reshape(leaning, (-1, 1))
        moves = weights[len(FEATURES) :].reshape(2, 2)
        ahead, after = np.zeros_like(unary), np.zeros_like(unary)
        ahead[:, 0] = unary[:, 0]
        for t in range(1, length):
            new = _logsum(ahead[:, t - 1, :, None] + moves, 1) + unary[:, t]
            ahead[:, t] = np.where(self.there[:, t, None], new, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = _logsum((after[:, t + 1] + unary[:, t + 1])[:, None, :] + moves, 2)
            after[:, t] = np.where(self.there[:, t + 1, None], new, 0.0)
        total = _logsum(ahead[:, -1], 1)
        chance = np.exp(np.minimum(ahead[..., 1] + after[..., 1] - total[:, None], 0.0)) * self.there
        joint = ahead[:, :-1, :, None] + moves + (after + unary)[:, 1:, None, :] - total[:, None, None, None]
        return chance, (np.exp(np.minimum(joint, 0.0)) * self.there[:, 1:, None, None]).sum(axis=1)

    def share(self, chance: np.ndarray) -> np.ndarray:
        return chance.sum(axis=1) / self.there.sum(axis=1)


def _climbed(lines: _Lines, weights: np.ndarray, wanted: np.ndarray, wanted_moves: np.ndarray | None, steps: int, rate: float, decay: float) -> np.ndarray:
    """Gradient steps (Adam) to weights that expect the ``wanted`` features and moves; without those moves the lines are independent."""
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n = lines.there.sum()
    for step in range(1, steps + 1):
        if wanted_moves is None:
            chance = lines.there / (1 + np.exp(-(lines.x @ weights[: len(FEATURES)])))
            moved = np.zeros(4)
        else:
            chance, joint = lines.chances(weights)
            moved = (wanted_moves - joint.sum(axis=0)).ravel()
        slope = np.concatenate([wanted - np.einsum("it,itf->f", chance, lines.x), moved]) / n - decay * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def _given_labels(lines: _Lines, weights: np.ndarray, good: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Chances and moves nearest to the field's, of which a share of ``least`` or more agrees with the label of the document."""
    side = np.where(good, 1.0, -1.0)
    low, high = np.zeros(len(good)), np.full(len(good), 32.0)
    for _ in range(10):
        lean = (low + high) / 2
        share = lines.share(lines.chances(weights, side * lean)[0])
        enough = np.where(good, share, 1 - share) >= least
        low, high = np.where(enough, low, lean), np.where(enough, lean, high)
    free = lines.share(lines.chances(weights)[0])
    return lines.chances(weights, side * np.where(np.where(good, free, 1 - free) >= least, 0.0, high))


def fit(texts: list[np.ndarray], good: list[bool], rounds: int = 4, steps: int = 50, rate: float = 0.1, decay: float = 1e-4,
        least: float = LEAST) -> Field:
    """A field for line marks that are hidden: a document's label only says on which side most of its lines are.

    Expectation maximisation: it starts from independent lines that carry their
    document's label. Each round takes, by forward and backward sums, the chances
    of marks under the field, leaning as far towards the label as a share of
    ``least`` asks for and no further (posterior regularisation), and climbs to
    the field that expects them.
    """
    if len(set(good)) < 2:
        return PLAIN
    lines, y = _Lines(texts), np.array(good, bool)
    weights = _climbed(lines, np.zeros(len(FEATURES) + 4), np.einsum("it,itf->f", lines.there & y[:, None], lines.x), None, 4 * steps, rate, decay)
    for _ in range(rounds):
        chance, joint = _given_labels(lines, weights, y, least)
        weights = _climbed(lines, weights, np.einsum("it,itf->f", chance, lines.x), joint.sum(axis=0), steps, rate / 2, decay)
    w = weights.tolist()
    return Field(tuple(w[: len(FEATURES)]), ((w[-4], w[-3]), (w[-2], w[-1])))


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis)
    return top + np.log(np.exp(values - np.expand_dims(top, axis)).sum(axis=axis))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Field:
    """The field for labels of whole documents; about ``sample`` documents come to the driver as numbers, in windows of LINES lines.

    Of two labels that contradict the larger counts. Without both kinds of labels the field is PLAIN.
    """
    rows = labelled_sample(docs, labels, label, sample, 9, key, text)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def numbers(texts: pd.Series) -> pd.Series:
        found = (line_features(one)[0] for one in texts)
        return pd.Series([[one[at : at + LINES].ravel() for at in range(0, len(one), LINES)] for one in found])

    got = rows.select("key", "label", F.posexplode(numbers("text")).alias("window", "x")).collect()
    got.sort(key=lambda r: (str(r.key), r.window))
    return fit([np.array(r.x).reshape(-1, len(FEATURES)) for r in got], [r.label > 0.5 for r in got])


def judged(docs: DataFrame, field: Field, text: str = "text", least_words: int = 20, most_repeated: int = 30, least_content: float = 0.5) -> DataFrame:
    """``docs`` with the measures, base_failed, content_share and kept.

    A text of fewer than ``least_words`` words, or with more than ``most_repeated``
    per cent of its words in repeated runs of eight, fails whatever the field says;
    a null or empty text has no words and fails. Lines without a word are no lines here.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    result = T.StructType([*(T.StructField(name, T.LongType()) for name in names), T.StructField("content_share", T.DoubleType())])

    @F.pandas_udf(result)
    def look(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*measures(one), field.content_share(one)) for one in texts], columns=[*names, "content_share"])

    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    return (
        docs.withColumn("__look", look.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))
        .withColumns({name: F.col(f"__look.{name}") for name in [*names, "content_share"]}).drop("__look")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= least_content))
    )


def only_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that are kept, as they are."""
    field = fitted(docs, labels, key=key, text=text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return judged(rows, field).filter("kept").select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])
