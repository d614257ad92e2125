"""Language of a text, word first, with backoff to shorter and shorter character runs.

Counts per language come from labelled documents: words, and runs of one to five
characters of words with a border sign on each side. A known word adds its log
frequency in each language. An unseen word is scored by its longest known runs: if
none of five characters is known, by those of four, and so on down to one.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chance, dealt, written

LONGEST = 5
#: Documents per language that are counted, about.
SAMPLE = 20_000
UNKNOWN = "und"
#: Words that a task counts or cuts before it hands them on, and scores that a worker keeps.
WORDS, SCORES = 200_000, 4_000_000


@cache
def letters(last: int) -> re.Pattern:
    """A letter and the letters and marks that follow it, by their Unicode categories; no number, also if it looks like a letter."""
    kinds = [unicodedata.category(chr(code))[0] for code in range(last + 1)]

    def ranges(wanted: str) -> str:
        found, start = [], None
        for code, kind in enumerate([*kinds, ""]):
            if kind and kind in wanted:
                start = code if start is None else start
            elif start is not None:
                found.append(f"\\U{start:08x}-\\U{code - 1:08x}")
                start = None
        return "".join(found)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def words_of(text: str) -> list[str]:
    text = text.lower()
    # A class of the first plane alone is one table lookup per sign.
    plain = text.isascii() or 2 * len(text) == len(text.encode("utf-16-le", "surrogatepass"))
    return letters(0xFFFF if plain else sys.maxunicode).findall(text)


def runs(word: str, length: int) -> list[str]:
    """Character runs of a bordered word; of a word that is shorter, the whole."""
    bordered = f"^{word}$"
    return [bordered[i : i + length] for i in range(max(1, len(bordered) - length + 1))]


def run_counts(words: list[str], times: np.ndarray, length: int) -> tuple[list[str], np.ndarray]:
    """Different runs of words and how often they occur, each word as often as ``times`` says."""
    text = "".join([f"^{word}$" for word in words])
    sizes = np.fromiter((len(word) + 2 for word in words), "int64", len(words))
    signs, codes = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32"), return_inverse=True)
    short = np.flatnonzero(sizes < length)
    if len(signs) ** length >= 1 << 63:
        short = np.arange(len(words))       # too many signs to write a run as one number
    found: Counter = Counter()
    for at in short.tolist():
        for run in runs(words[at], length):
            found[run] += int(times[at])
    grams, sums = list(found), np.fromiter(found.values(), "int64", len(found))
    if len(short) < len(words) and len(codes) >= length:
        word = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)[word]
        n = len(codes) - length + 1
        whole = np.zeros(n, "int64")
        for place in range(length):
            whole = whole * len(signs) + codes[place : place + n]
        at = np.flatnonzero(np.arange(n) + length <= ends[:n])
        _, first, group = np.unique(whole[at], return_index=True, return_inverse=True)
        grams += [text[i : i + length] for i in at[first].tolist()]
        sums = np.concatenate([sums, np.bincount(group, times[word[at]]).astype("int64")])
    return grams, sums


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, length, gram, n) of a sample (lang, text); length 0 stands for whole words.

    Words are counted first; the runs of each different word are then taken once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > WORDS:
                yield from told(words)
                words = {}
        yield from told(words)

    def told(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in words.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())],
                                             names=["lang", "word", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for lang, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                words, times = held.setdefault(lang, ([], []))
                words.append(word)
                times.append(n)
            if sum(len(words) for words, _ in held.values()) > WORDS:
                yield from runs_of(held)
                held = {}
        yield from runs_of(held)

    def runs_of(held: dict[str, tuple[list, list]]) -> Iterator[pa.RecordBatch]:
        for lang, (words, times) in held.items():
            for length in range(1, LONGEST + 1):
                grams, sums = run_counts(words, np.array(times, "int64"), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array([length] * len(grams), pa.int32()), pa.array(grams, pa.string()), pa.array(sums)],
                    names=["lang", "length", "gram", "n"])

    words = written(
        sample.select("lang", F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    grams = dealt(words, words.count(), WORDS).mapInArrow(cut, "lang string, length int, gram string, n long").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))
    return grams.unionByName(words.select("lang", F.lit(0).alias("length"), F.col("word").alias("gram"), "n"))


def hashed(grams: Iterable[str]) -> np.ndarray:
    """XXH64 (seed 42) as signed numbers, as Spark's function has it."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(gram.encode("utf-8", "surrogatepass"), 42) for gram in grams), "uint64").view("int64")


class Table:
    """Log frequencies of the strings of one length, a few numbers per string and language that has it.

    A string is its 64-bit hash. A language without it has ``base``; ``more`` is
    what the others have above that.
    """

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, languages: int):
        order = np.lexsort((langs, keys))
        keys, self.langs, counts = keys[order], langs[order].astype("int32"), counts[order].astype("float64")
        self.keys, self.starts = np.unique(keys, return_index=True)
        self.ends = np.append(self.starts, len(keys))[1:]
        whole = np.bincount(self.langs, counts, languages)
        self.base = np.log(0.5 / (whole + 0.5 * len(self.keys) + 1e-9))
        self.more = np.log((counts + 0.5) / 0.5)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 for what is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, out: np.ndarray, rows: np.ndarray, at: np.ndarray, share: np.ndarray) -> None:
        """Adds ``share`` of what known strings have to rows of ``out``."""
        sizes = self.ends[at] - self.starts[at]
        place = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        np.add.at(out, (np.repeat(rows, sizes), self.langs[place]), np.repeat(share, sizes) * self.more[place])


class LanguageModel:
    """Tables of whole words (0) and of runs by length, and the prior of the languages."""

    def __init__(self, languages: list[str], documents: list[int], grams: dict[str, np.ndarray]):
        """grams: columns length, key (hash), lang (number of the language) and n."""
        self.languages = languages
        self.prior = np.log(np.array(documents, "float64") / max(sum(documents), 1)) if languages else np.zeros(0)
        parts = [grams["length"] == length for length in range(LONGEST + 1)]
        self.tables = [Table(grams["key"][part], grams["lang"][part], grams["n"][part], len(languages)) for part in parts]

    @classmethod
    def of(cls, languages: list[str], documents: list[int], rows: list[tuple[str, int, str, int]]) -> LanguageModel:
        """From rows (lang, length, gram, n)."""
        place = {lang: i for i, lang in enumerate(languages)}
        return cls(languages, documents, {
            "length": np.array([r[1] for r in rows], "int64"), "key": hashed(r[2] for r in rows), "lang": np.array([place[r[0]] for r in rows], "int64"),
            "n": np.array([r[3] for r in rows], "int64")})

    def scores(self, words: list[str]) -> np.ndarray:
        """Log frequency (word, language): of the word, or the mean of its longest known runs; zero if nothing is known."""
        out = np.zeros((len(words), len(self.languages)))
        at = self.tables[0].find(hashed(words))
        known = np.flatnonzero(at >= 0)
        out[known] = self.tables[0].base
        self.tables[0].add(out, known, at[known], np.ones(len(known)))
        left = np.flatnonzero(at < 0)
        for length in range(LONGEST, 0, -1):
            if not len(left):
                break
            cut = [runs(words[i], length) for i in left.tolist()]
            of = np.repeat(np.arange(len(left)), [len(c) for c in cut])
            at = self.tables[length].find(hashed(run for c in cut for run in c))
            met = np.bincount(of[at >= 0], minlength=len(left))
            out[left[met > 0]] = self.tables[length].base
            self.tables[length].add(out, left[of[at >= 0]], at[at >= 0], 1 / met[of[at >= 0]])
            left = left[met == 0]
        return out


class Predictor:
    """Languages of texts; words that were seen before keep their scores, in bounded memory."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.places: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; ties go to the first in order of name."""
        words = [words_of(text or "") for text in texts]
        languages = self.model.languages
        if not languages:
            return [UNKNOWN] * len(words), np.zeros(len(words))
        new = list({word for some in words for word in some if word not in self.places})
        if (len(self.places) + len(new)) * len(languages) > SCORES:
            self.places = {}
            new = list({word for some in words for word in some})
        start = len(self.places)
        self.places.update(zip(new, range(start, start + len(new))))
        if len(self.places) > len(self.rows):
            # Twice what is needed, so that few batches copy what is there.
            self.rows = np.concatenate([self.rows[:start], np.zeros((2 * len(self.places) - start, len(languages)))])
        self.rows[start : start + len(new)] = self.model.scores(new)
        names, scores = [], np.zeros(len(words))
        for at, some in enumerate(words):
            if not some:
                names.append(UNKNOWN)
                continue
            total = self.model.prior + self.rows[list(map(self.places.__getitem__, some))].sum(axis=0)
            best = int(np.argmax(np.round(total, 9)))       # equal up to the order of sums
            names.append(languages[best])
            scores[at] = 1.0 / np.exp(total - total[best]).sum()
        return names, scores


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", where: Column | None = None,
           sample: int = SAMPLE) -> LanguageModel:
    """A model from the rows with a language, of which ``where`` admits those that may be learned from.

    About ``sample`` documents per language are counted, chosen by a hash of the
    id; all of their words and runs are known, whatever the language. So the model
    has as many strings as that sample, and a number for each language that has
    the string; it is the only thing that comes to the driver.
    """
    known = docs.filter(where) if where is not None else docs
    known = known.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = sorted((r.lang, r.docs) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).collect())
    numbers = docs.sparkSession.createDataFrame([(lang, n, i) for i, (lang, n) in enumerate(sizes)], "lang string, docs long, number int")
    chosen = known.join(numbers, "lang").filter(chance(F.col("id"), 10) * F.col("docs") < F.lit(sample))
    counts = gram_counts(chosen).join(numbers, "lang").select(
        F.col("length").cast("int"), F.xxhash64("gram").alias("key"), F.col("number").alias("lang"), F.col("n").cast("long"))
    found = written(counts).toArrow()
    grams = {name: found.column(name).to_numpy() for name in ("length", "key", "lang", "n")}
    return LanguageModel([lang for lang, _ in sizes], [n for _, n in sizes], grams)


def predicted(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    A null text, or one without a letter, is ``und`` with score 0; so is every text
    if nothing was learned. A text of which no character is known gets the commonest language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for texts in batches:
            names, scores = predictor.predict(texts)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return (
        docs.withColumn("__look", look.asNondeterministic()(F.col(text)))
        .withColumns({"lang_pred": F.col("__look.lang_pred"), "score": F.col("__look.score")}).drop("__look")
    )
