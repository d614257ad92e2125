"""Benchmark decontamination by word windows.

The windows of the benchmark are few (items times their words); they are counted
first and go to the tasks as a hash set, in as many blocks of bounded size as they
need. Every document is scanned once per block: its words become 64-bit numbers,
a rolling sum over them is looked up in the set, and each hit is verified word by
word before it counts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo

#: Windows in one broadcast block: about 200 bytes each in a task.
BLOCK = 250_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and everything beyond ASCII, as UTF-8."""
    return WORD.findall((text or "").encode().lower())


def number_of(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def rolling(numbers: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` words; equal runs have equal numbers."""
    n = len(numbers) - width + 1
    out = np.zeros(max(n, 0), "uint64")
    for j in range(width if n > 0 else 0):
        out = out * _STEP + numbers[j : j + n]
    return out


class Windows:
    """One block of benchmark windows; finds them in lists of words."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list]]):
        self.number = Memo(number_of)
        self.items: dict[tuple[bytes, ...], list] = dict(windows)
        by_width = defaultdict(set)
        for window in self.items:
            by_width[len(window)].add(int(rolling(self._numbers(window), len(window))[0]))
        self.known = {width: np.array(sorted(found), "uint64") for width, found in by_width.items()}

    def _numbers(self, words) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), "uint64", len(words))

    def find(self, words: list[bytes]) -> list[tuple[int, int, tuple[bytes, ...]]]:
        """Start, end and window of every verified occurrence."""
        numbers, found = self._numbers(words), []
        for width, known in self.known.items():
            seen = rolling(numbers, width)
            at = np.searchsorted(known, seen)
            at[at == len(known)] = 0
            for start in np.flatnonzero(known[at] == seen).tolist():
                window = tuple(words[start : start + width])
                if window in self.items:
                    found.append((start, start + width, window))
        return found


def item_windows(items: DataFrame, width: int = 13, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, window): each run of ``width`` words of an item; a shorter item is one window, an empty one none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, windows = [], []
            for row, one in enumerate(batch.column(1).to_pylist()):
                words = words_of(one)
                for start in range(max(1, len(words) - width + 1) if words else 0):
                    rows.append(row)
                    windows.append(b" ".join(words[start : start + width]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(windows, pa.binary())], names=["item", "window"])

    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("window", T.BinaryType())])
    return items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), text).mapInArrow(cut, schema).distinct()


def _blocks(items: DataFrame, width: int, key: str, text: str, size: int) -> Iterator[list]:
    """The windows with their items, in blocks of about ``size`` window and item pairs."""
    windows = item_windows(items, width, key, text)
    blocks = max(1, ceil(windows.count() / size))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    for block in range(blocks):
        grouped = defaultdict(list)
        for item, window, _ in dealt.filter(F.col("block") == block).collect():
            grouped[tuple(bytes(window).split(b" "))].append(item)
        yield sorted(grouped.items())


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 13, block: int = BLOCK,
         text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, hits (sorted, disjoint word ranges: from, to), items (sorted item ids as strings).

    A document word inside any occurrence of a window is hit. Null and empty texts
    have no words. Nothing but the windows of one block is broadcast; a benchmark of
    more windows than ``block`` is scanned in several blocks whose hits are joined
    row by row. Items without a word are no window; equal windows of several items
    count for each.
    """
    context, columns = docs.sparkSession.sparkContext, docs.columns
    result = T.StructType([
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    out, names = docs.drop("n_words", "hits", "items"), []
    for number, windows in enumerate(_blocks(benchmark, width, item_key, item_text, block)):
        look, name = _looker(context.broadcast(windows), f"{number}-{os.urandom(8).hex()}", result), f"__scan_{number}"
        out, names = out.withColumn(name, look.asNondeterministic()(F.col(text))), [*names, name]
    first = names[0]
    hits, items = F.col(f"{first}.hits"), F.col(f"{first}.items")
    if len(names) > 1:
        hits = _merged(F.sort_array(F.flatten(F.array(*[F.col(f"{name}.hits") for name in names]))))
        items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{name}.items") for name in names]))))
    kept = [F.col(f"`{c}`") for c in columns if c not in ("n_words", "hits", "items")]
    return out.select(*kept, F.col(f"{first}.n_words").alias("n_words"), hits.alias("hits"), items.alias("items"))


#: The windows that this Python worker holds, by block.
_LOADED: dict[str, Windows] = {}


def _looker(shared, block: str, result: T.StructType):
    @F.pandas_udf(result)
    def look(texts: pd.Series) -> pd.DataFrame:
        if block not in _LOADED:
            _LOADED.clear()
            _LOADED[block] = Windows(shared.value)
        finder, rows = _LOADED[block], []
        for one in texts:
            words = words_of(one)
            found = finder.find(words)
            items = sorted({item for _, _, window in found for item in finder.items[window]})
            rows.append((len(words), _union([(start, end) for start, end, _ in found]), items))
        return pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return look


def _union(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _merged(ranges):
    """Sorted ranges, those that overlap or touch joined."""
    empty = F.array().cast("array<array<bigint>>")

    def add(done, one):
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(one[0] <= last[1], F.lit(False))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(last[0], F.greatest(last[1], one[1]))))
        return F.when(joins, joined).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(ranges, empty, add)


def judged(scanned: DataFrame) -> DataFrame:
    """A scan with n_hit, n_items, items_sha256 and contaminated (a twentieth of the words, at least one)."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, one: total + one[1] - one[0])
    return (
        scanned.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, as they are: whole documents are removed."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    renamed = docs.select(F.struct(*keep).alias("row"), F.col(options.pop("text", "text")).alias("text"))
    clean = judged(scan(renamed, benchmark, **options)).filter("NOT contaminated")
    return clean.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents; from the first to the last character of every hit run of words the text is cut out."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for one, ranges in zip(texts, hits):
            if one is not None and len(ranges):
                data = one.encode()
                places = [(m.start(), m.end()) for m in WORD.finditer(data.lower())]
                for start, end in reversed([tuple(r) for r in ranges]):
                    data = data[: places[start][0]] + data[places[end - 1][1] :]
                one = data.decode()
            out.append(one)
        return pd.Series(out, dtype=object)

    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).alias("text"))
    found = scan(rows, benchmark, **options)
    return found.withColumn("cut", cut("text", "hits")).select(
        [(F.col("cut") if c == text else F.col(f"row.`{c}`")).alias(c) for c in columns]
    )
