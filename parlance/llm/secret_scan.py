"""Secrets in texts: trigram queries of rules over an inverted index, then the rules themselves.

From the syntax tree of each rule's pattern follows a Boolean query of trigrams that
every text with a match must hold: the trigrams of a literal run are all needed, of
alternatives one. An inverted index of a block of texts has a posting list for each
trigram that some query names; intersections and unions of postings leave the
candidates, and only those are searched. A rule without a trigram that must occur
scans all texts.

Index and queries are in lower case, so they admit what any case would match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, reduce
from hashlib import sha256
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# re.sre_parse under its present name: the standard library's own syntax trees.
from re import _constants as syntax
from re import _parser as parser

#: Alternatives that a run of literals may have, and members of a class that are spelled out.
RUNS, MEMBERS = 64, 4
SLICE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches count if ``group`` has ``least`` characters or more; the others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end, in code points, of leftmost matches that do not overlap."""
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# ---- fixed values ----
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),      # the runs of [0-9a-f]+ with 32 and more
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("login_url", r"://[^/\s:@]{1,255}:[^/\s:@]{1,255}@"),
)
# ---- end of fixed values ----


# ------------------------------------------------------------------ queries

Query = tuple | str | None      # ("and" | "or", queries), a trigram, or None: every text


def _all_of(parts: Sequence[Query]) -> Query:
    known = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not known else known[0] if len(known) == 1 else ("and", tuple(known))


def _one_of(parts: Sequence[Query]) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    known = list(dict.fromkeys(parts))
    return known[0] if len(known) == 1 else ("or", tuple(known))


def _needed(runs: set[str]) -> Query:
    """Trigrams of literal runs, of which one must occur."""
    def trigrams(run: str) -> list[str]:
        return [run[i : i + 3] for i in range(len(run) - 2)]

    sets = sorted({frozenset(trigrams(run)): run for run in sorted(runs)}.items(), key=lambda x: (len(x[0]), x[1]))
    # What asks for more than another alternative adds nothing.
    least = [run for at, (own, run) in enumerate(sets) if not any(other <= own for other, _ in sets[:at])]
    return _one_of([_all_of(trigrams(run)) for run in least])


def _folds_widely(flags: int) -> bool:
    """Whether case is ignored beyond ASCII, where a letter can stand for one that is no ASCII letter."""
    return bool(flags & re.IGNORECASE) and not flags & re.ASCII


def _spelled(node) -> set[str] | None:
    """The strings that a node matches, in lower case, if they are few and ASCII; else None."""
    op, value = node
    if op is syntax.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if op is syntax.IN:
        found = set()
        for kind, member in value:
            if kind is syntax.LITERAL and member < 128:
                found.add(chr(member).lower())
            elif kind is syntax.RANGE and member[1] < 128 and member[1] - member[0] < MEMBERS:
                found |= {chr(c).lower() for c in range(member[0], member[1] + 1)}
            else:
                return None
        return found if len(found) <= MEMBERS else None
    if op is syntax.SUBPATTERN:
        return None if _folds_widely(value[1]) else _strings(value[-1])
    if op is syntax.BRANCH:
        parts = [_strings(branch) for branch in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT, syntax.POSSESSIVE_REPEAT) and value[1] <= 4:
        once = _strings(value[2])
        if once is not None:
            return {"".join(p) for n in range(value[0], value[1] + 1) for p in product(once, repeat=n)}
    if op in (syntax.AT, syntax.ASSERT, syntax.ASSERT_NOT):
        return {""}     # no width; what it asks for is not used
    return None


def _strings(nodes) -> set[str] | None:
    """The strings that a sequence of nodes matches, if they are few."""
    found = {""}
    for node in nodes:
        part = _spelled(node)
        if part is None or len(found) * len(part) > RUNS:
            return None
        found = {a + b for a in found for b in part}
    return found


def _of_nodes(nodes) -> Query:
    """What a sequence of nodes needs: literal runs as long as they are spelled out, and the needs of the rest."""
    needs: list[Query] = []
    runs = {""}
    for node in nodes:
        part = _spelled(node)
        if part is not None and len(runs) * len(part) <= RUNS:
            runs = {a + b for a in runs for b in part}
            continue
        op, value = node
        if op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT, syntax.POSSESSIVE_REPEAT) and value[0] >= 1:
            first = _strings(value[2])
            if first is not None and len(runs) * len(first) <= RUNS:
                runs = {a + b for a in runs for b in first}     # once for certain, then anything
            else:
                needs.append(_of_nodes(value[2]))
        elif op is syntax.ATOMIC_GROUP:
            needs.append(_of_nodes(value))
        elif op is syntax.SUBPATTERN and not _folds_widely(value[1]):
            needs.append(_of_nodes(value[-1]))
        elif op is syntax.BRANCH:
            needs.append(_one_of([_of_nodes(branch) for branch in value[1]]))
        needs.append(_needed(runs))
        runs = set(part) if part is not None else {""}
    needs.append(_needed(runs))
    return _all_of(needs)


@cache
def trigram_query(pattern: str) -> Query:
    """The Boolean query of trigrams that every text with a match of the pattern satisfies; None if there is none."""
    tree = parser.parse(pattern)
    return None if _folds_widely(tree.state.flags) else _of_nodes(tree)


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams_of(part) for part in query[1]])


# ------------------------------------------------------------------ index


@cache
def _lookup(trigrams: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Lower case of bytes, and for every three bytes the number of the trigram, from 1; 0 if no query has it."""
    lower = np.arange(256, dtype="uint32")
    lower[65:91] += 32
    table = np.zeros(1 << 24, "uint8" if len(trigrams) < 256 else "uint16")
    for number, (a, b, c) in enumerate((t.encode() for t in trigrams), 1):
        table[a << 16 | b << 8 | c] = number
    return lower, table


class Index:
    """Posting lists of a block of texts (UTF-8, end to end, with their offsets) for some trigrams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, trigrams: tuple[str, ...]):
        lower, table = _lookup(trigrams)
        self.size = len(offsets) - 1
        found = []
        for start in range(0, len(data), SLICE):
            part = lower[data[start : start + SLICE + 2]]
            if len(part) < 3:
                break
            numbers = table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(numbers)
            text = np.searchsorted(offsets, at + start, "right") - 1
            inside = at + start + 3 <= offsets[text + 1]
            found.append(np.unique(numbers[at[inside]].astype("int64") * self.size + text[inside]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, "int64")
        ends = np.searchsorted(pairs, np.arange(1, len(trigrams) + 2) * max(self.size, 1))
        self.postings = {t: pairs[ends[i] : ends[i + 1]] - (i + 1) * self.size for i, t in enumerate(trigrams)}

    def candidates(self, query: Query) -> np.ndarray:
        """Numbers of the texts that satisfy a query, ascending."""
        if query is None:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        parts = sorted((self.candidates(part) for part in query[1]), key=len)
        if query[0] == "or":
            return reduce(np.union1d, parts)
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), parts)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, "int64")[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, "uint8") if data is not None and data.size else np.zeros(0, "uint8")
    return held[places[0] : places[-1]], places - places[0]


# ------------------------------------------------------------------ operator


def found_in(column: pa.Array, rules: Sequence[Rule]) -> list[list[tuple[int, int, int]]]:
    """(start, number of the rule, end) of every span, per text, in order."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    trigrams = tuple(sorted(set().union(*[trigrams_of(q) for q in queries])))
    index = Index(*_texts(column), trigrams)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    for number, (rule, query) in enumerate(zip(rules, queries)):
        candidates = index.candidates(query)
        for row, text in zip(candidates.tolist(), column.take(pa.array(candidates, pa.int64())).to_pylist()):
            spans[row] += [(start, number, end) for start, end in rule.spans(text or "")]
    return [sorted(s) for s in spans]


def scanned(docs: DataFrame, rules: Sequence[Rule] = BASE + ADDED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, found): the spans of each whole text by start, then by the order of ``rules``.

    ``found`` is an array of (kind, start, end, value): places in code points, end
    exclusive. Every row gives a row, also repeated ones; a null text is empty and
    holds nothing, a null key stays. Other columns are not read. No text is cut: a
    very long one is indexed in slices that overlap by two bytes. Spans of
    different rules may overlap, those of one rule do not.
    """
    kind = docs.schema[key].dataType
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
    rules = tuple(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans, row in zip(found_in(batch.column(1), rules), range(batch.num_rows)):
                held = batch.column(1)[row].as_py() if spans else ""
                rows.append([{"kind": rules[n].kind, "start": a, "end": b, "value": held[a:b]} for a, n, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], names=["key", "found"])

    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                      T.StructField("end", T.LongType()), T.StructField("value", T.StringType())]))
    out = docs.select(key, text).mapInArrow(scan, T.StructType([T.StructField("key", kind), T.StructField("found", spans)]))
    return out.withColumnRenamed("key", key)


def redacted(text: str, spans: Sequence[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced by a mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(value: str) -> str:
    return sha256(value.encode()).hexdigest()
