"""Likelihood of texts over a subword lattice.

A text is its words and one end. The strings of an existing subword vocabulary are
the edges of a lattice over each word: pieces with a word mark begin it, pieces
without continue it, and what no piece covers is spelled in bytes. Every
segmentation counts; a forward recursion in log space sums the products of the
pieces' weights. The ranks that come with the vocabulary as scores give the first
weights; the expected piece counts over the lattices of all different rare words of
the training texts, times the words' counts, give the final ones.

Pieces alone spell frequent words too dearly. So the lattice of a frequent training
word has one more edge, for the word as a whole, with a weight from its counts.
All weights depend on a hidden class of the text, for a corpus is a mixture of
languages and kinds; one recursion over a batch of words serves all classes, as their
lattices have the same edges. The probability of a text
is the sum over classes and over all segmentations, so those of all texts add up to
one at most. Classes are estimated on all training texts, from the words that the
vocabulary holds whole, so that no pass has to choose telling words first.

For comparison there is a base score from smoothed word counts. The commonest words
go to the tasks as a dictionary of bounded size, which is only a cache: each text
hands over its other words, which are joined with the table of counts and weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, dealt, slices, written

MARK = "▁"
#: Words seen so often have an edge of their own; words seen once stand for the unseen.
OFTEN = 2
#: Words with counts and weights in every task, at most; the other words are joined.
FREQUENT = 300_000
#: Hidden classes, the words that tell them apart, and steps of their estimation at most.
CLASSES, TELLING, STEPS = 8, 1_000, 25
#: The estimation ends when the sum of changes of belonging shares stays below this share of the texts.
SETTLED = 0.002
SMOOTHING = 0.1
#: Probabilities in batches of words are scaled by this (base e) per character; words that are too long for that.
SCALE, LONG, BATCH_OF_WORDS = 2.5, 100, 2_000
#: Texts, or rows of a text, that a task works on at once, and about so many bytes.
BATCH_OF_TEXTS, BATCH_BYTES = 1_024, 4 << 20
#: Different words that a task walks through lattices.
EACH = 25_000
#: So many words of the whole corpus count in a class beside its own.
SHARED = 1_000.0
TEN = math.log(10)
_GAP = re.compile(r"[ \t-\r]")


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, in parts of about a million characters: A-Z in lower case, cut at ASCII white space."""
    for part in slices(text or "", _GAP):
        yield part.encode().lower().split()


def bag_of(text: str | None, only: dict[bytes, int] | None = None) -> Counter:
    """The words of a whole text, or those among ``only``, and how often it has them."""
    found: Counter = Counter()
    for words in words_of(text):
        found.update(words if only is None else filter(only.__contains__, words))
    return found


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and word of all words of a batch of texts, in their order; the rule of :func:`words_of`."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, rows = split.flatten(), np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    filled = pc.greater(pc.binary_length(words), 0)
    return rows[filled.to_numpy(zero_copy_only=False)], words.filter(filled)


def listed(rows: np.ndarray, number: int, values: pa.Array) -> pa.Array:
    """A list for each of ``number`` rows; ``rows`` ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(number + 1)), pa.int32()), values)


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ``rows``, which ascend, and the sums of their values; a row's sum does not depend on the others."""
    heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, "int64")
    return rows[heads], np.add.reduceat(values, heads, axis=0) if len(rows) else values


@dataclass
class Lattice:
    """Log weights (base e) of beginning pieces, continuing pieces and bytes, and of a word's end."""

    first: dict[str, float]
    rest: dict[str, float]
    bytes: list[float]
    stop: float
    words: Memo = field(init=False, repr=False)

    def __post_init__(self):
        self.words = Memo(self.word, limit=40_000)

    @cached_property
    def begin(self) -> dict[str, float | None]:
        return with_prefixes(self.first)

    @cached_property
    def more(self) -> dict[str, float | None]:
        return with_prefixes(self.rest)

    def spelled(self, character: str) -> float:
        return sum(self.bytes[b] for b in character.encode())

    def word(self, word: str) -> float:
        """Log probability of a word over all segmentations into pieces, by the forward recursion."""
        string, more, log1p, exp = MARK + word, self.more, math.log1p, math.exp
        n = len(string)
        ahead: list[float | None] = [None] * (n + 1)
        for end in range(1, n + 1):
            log = self.begin.get(string[:end], _NO)
            if log is _NO:
                break
            ahead[end] = log
        for start in range(1, n):
            before, end = ahead[start], start + 1
            if before is None:
                continue
            log = more.get(string[start], _NO)
            if log is _NO or log is None:
                way, old = before + self.spelled(string[start]), ahead[end]
                ahead[end] = way if old is None else old + log1p(exp(way - old)) if old > way else way + log1p(exp(old - way))
            while log is not _NO:
                if log is not None:
                    way, old = before + log, ahead[end]
                    ahead[end] = way if old is None else old + log1p(exp(way - old)) if old > way else way + log1p(exp(old - way))
                if end == n:
                    break
                end += 1
                log = more.get(string[start:end], _NO)
        return ahead[n] + self.stop

    def edges(self, string: str) -> list[list[tuple[int, str | None, float]]]:
        """For each position of a marked word the pieces that end there: (start, piece or None for bytes, log)."""
        n, more = len(string), self.more
        out: list[list] = [[] for _ in range(n + 1)]
        for end in range(1, n + 1):
            log = self.begin.get(string[:end], _NO)
            if log is _NO:
                break
            if log is not None:
                out[end].append((0, string[:end], log))
        for start in range(1, n):
            end, piece = start + 1, string[start]
            log = more.get(piece, _NO)
            if log is _NO or log is None:
                out[end].append((start, None, self.spelled(piece)))
            while log is not _NO:
                if log is not None:
                    out[end].append((start, piece, log))
                if end == n:
                    break
                end += 1
                piece = string[start:end]
                log = more.get(piece, _NO)
        return out

    def expect(self, word: str, weight: float, total: "Expected") -> None:
        """Adds the expected counts of the pieces of a word, as often as it counts."""
        string, log1p, exp = MARK + word, math.log1p, math.exp
        edges, ahead = self.edges(string), [0.0]
        for here in edges[1:]:
            sum_log = None
            for start, _, log in here:
                if (before := ahead[start]) is not None:
                    way = before + log
                    sum_log = way if sum_log is None else sum_log + log1p(exp(way - sum_log)) if sum_log > way else way + log1p(exp(sum_log - way))
            ahead.append(sum_log)
        # From the end back, the share of all segmentations that pass a position.
        passing = [0.0] * len(string) + [1.0]
        for end in range(len(string), 0, -1):
            if passing[end] < 1e-12:
                continue
            for start, piece, log in edges[end]:
                if ahead[start] is None:
                    continue
                share = passing[end] * exp(ahead[start] + log - ahead[end])
                passing[start] += share
                if piece is None:
                    for b in string[end - 1].encode():
                        total.bytes[b] += weight * share
                else:
                    side = total.rest if start else total.first
                    side[piece] = side.get(piece, 0.0) + weight * share
        total.words += weight


#: Stands for strings that begin no piece.
_NO = object()


def with_prefixes(logs: dict[str, float]) -> dict[str, float | None]:
    """The pieces, and their beginnings that are no pieces, with None."""
    out: dict[str, float | None] = {}
    for piece, log in logs.items():
        for end in range(1, len(piece)):
            out.setdefault(piece[:end], None)
        out[piece] = log
    return out


@dataclass
class Expected:
    first: dict[str, float] = field(default_factory=dict)
    rest: dict[str, float] = field(default_factory=dict)
    bytes: list[float] = field(default_factory=lambda: [0.0] * 256)
    words: float = 0.0

    def plus(self, other: "Expected", times: float) -> "Expected":
        """These counts and a multiple of others."""
        both = lambda a, b: {p: a.get(p, 0.0) + times * n for p, n in b.items()} | {p: n for p, n in a.items() if p not in b}
        return Expected(both(self.first, other.first), both(self.rest, other.rest), [a + times * b for a, b in zip(self.bytes, other.bytes)], self.words + times * other.words)

    def lattice(self, first: list[str], rest: list[str]) -> Lattice:
        """Smoothed relative frequencies."""
        begun = self.words + SMOOTHING * len(first)
        more = sum(self.rest.values()) + sum(self.bytes)
        total = more + SMOOTHING * (len(rest) + 256)
        stop = (self.words + 1) / (self.words + more + 2)
        log = lambda n: math.log((1 - stop) * (n + SMOOTHING) / total)
        return Lattice(
            {piece: math.log((self.first.get(piece, 0.0) + SMOOTHING) / begun) for piece in first},
            {piece: log(self.rest.get(piece, 0.0)) for piece in rest}, [log(n) for n in self.bytes], math.log(stop),
        )


class Trie:
    """Pieces as one table of steps from node to node, for many places of many words at once.

    A step from a node by a character is at the node's base plus the character's code;
    it exists if the node owns that place. Node 0 is the root.
    """

    #: Code of the mark that begins a word (a mark inside of one is a character like others), and of unknown characters.
    BEGIN, NONE = 1, 0

    def __init__(self, first: list[str], rest: list[str]):
        characters = sorted({c for p in first for c in p[1:]} | {c for p in rest for c in p})
        self.codes = np.zeros(0x110000, "int32")
        self.codes[[ord(c) for c in characters]] = np.arange(2, len(characters) + 2)
        code = {c: i for i, c in enumerate(characters, 2)}
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for row, piece in enumerate([*first, *rest]):
            steps = [code[c] for c in piece] if row >= len(first) else [self.BEGIN, *(code[c] for c in piece[1:])]
            node = 0
            for step in steps:
                if step not in children[node]:
                    children[node][step] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][step]
            ends[node] = row
        #: The row of the piece that ends in a node, or -1.
        self.rows = np.array(ends)
        width, size = len(characters) + 2, 4 * len(children)
        self.base, self.owner, self.next = np.zeros(len(children), "int64"), np.full(size + width, -1, "int32"), np.zeros(size + width, "int32")
        taken, base = bytearray(size + width), 0
        for node in sorted(range(len(children)), key=lambda i: -len(children[i])):
            steps = list(children[node])
            while any(taken[base + step] for step in steps):
                base = (base + 1) % size
            self.base[node] = base
            for step, child in children[node].items():
                taken[base + step] = 1
                self.owner[base + step], self.next[base + step] = node, child

    def step(self, nodes: np.ndarray | int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which steps exist, and where those lead."""
        at = self.base[nodes] + codes
        there = np.flatnonzero(self.owner[at] == nodes)
        return there, self.next[at[there]]


#: Places of row, start, word and end in an edge's number: 24, 8, 16 and 8 bits, for batches of words that are not LONG.
_START, _WORD, _END = 24, 32, 48


class Lattices:
    """Lattices of several classes with the same pieces, for batches of words: arrays (.., class) instead of loops.

    Probabilities are scaled by SCALE per character, so that they stay in range;
    longer words than LONG go through the lattices one by one.
    """

    def __init__(self, parts: list[tuple]):
        self.each = [Lattice(*part) for part in parts]
        self.first, self.rest = list(self.each[0].first), list(self.each[0].rest)
        logs = [[one.first[p] for p in self.first] + [one.rest[p] for p in self.rest] for one in self.each]
        sizes = np.array([len(p) for p in self.first] + [len(p) for p in self.rest])
        self.weights = np.exp(np.array(logs).T + sizes[:, None] * SCALE)
        self.trie = Trie(self.first, self.rest)
        #: Rows of characters that no piece covers; they are spelled in bytes.
        self.spelled: dict[str, int] = {}
        self.stop = np.array([one.stop for one in self.each])

    def rows_of(self, characters: np.ndarray) -> np.ndarray:
        """Rows of characters (code points) that are spelled in bytes."""
        different, places = np.unique(characters, return_inverse=True)
        signs = [chr(c) for c in different.tolist()]
        if new := [c for c in signs if c not in self.spelled]:
            self.spelled.update((c, len(self.weights) + i) for i, c in enumerate(new))
            self.weights = np.vstack([self.weights, np.exp(np.array([[one.spelled(c) for one in self.each] for c in new]) + SCALE)])
        return np.array([self.spelled[c] for c in signs], "int64")[places]

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and row of all edges, by end and then by word; an edge is one number until all are there."""
        trie, sizes = self.trie, np.array([len(word) + 1 for word in words])
        signs = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), "uint32")
        of, last = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
        starts = np.arange(len(signs)) - (last - sizes[of])
        codes = trie.codes[signs]
        codes[starts == 0] = trie.BEGIN
        own = of << _WORD | starts << _START
        # All places at once, one character further in each round.
        places, nodes = trie.step(0, codes)
        covered, out, size = starts == 0, [], 1
        while len(places):
            rows = trie.rows[nodes]
            here = np.flatnonzero(rows >= 0)
            if size == 1:
                covered[places[here]] = True
            out.append((starts[places[here]] + size) << _END | own[places[here]] | rows[here])
            inside = np.flatnonzero(places + size < last[places])
            places, nodes = places[inside], nodes[inside]
            there, nodes_on = trie.step(nodes, codes[places + size])
            places, nodes, size = places[there], nodes_on, size + 1
        bare = np.flatnonzero(~covered)
        if len(bare):
            out.append((starts[bare] + 1) << _END | own[bare] | self.rows_of(signs[bare]))
        packed = np.sort(np.concatenate(out))
        return (packed >> _WORD) & 0xFFFF, (packed >> _START) & 0xFF, packed >> _END, packed & ((1 << _START) - 1)

    def ahead(self, words: list[str], edges: tuple) -> np.ndarray:
        """Scaled sums over all segmentations up to a position: (position, word, class)."""
        of, starts, ends, rows = edges
        sums = np.zeros((max(map(len, words)) + 2, len(words), len(self.each)))
        sums[0] = 1.0
        borders = np.searchsorted(ends, np.arange(1, len(sums) + 1))
        for end in range(1, len(sums)):
            part = slice(borders[end - 1], borders[end])
            if part.start < part.stop:
                ways = sums[starts[part], of[part]] * self.weights[rows[part]]
                heads = np.flatnonzero(np.r_[True, of[part][1:] != of[part][:-1]])
                sums[end, of[part][heads]] = np.add.reduceat(ways, heads, axis=0)
        return sums

    def logs(self, words: list[str]) -> np.ndarray:
        """Log probability (word, class) over all segmentations."""
        out = np.zeros((len(words), len(self.each)))
        short = [at for at, word in enumerate(words) if len(word) <= LONG]
        for at, word in enumerate(words):
            if len(word) > LONG:
                out[at] = [one.word(word) for one in self.each]
        if short:
            own = [words[at] for at in short]
            sizes = np.array([len(word) + 1 for word in own])
            sums = self.ahead(own, self.edges(own))
            whole = sums[sizes, np.arange(len(own))]
            with np.errstate(divide="ignore"):
                out[short] = np.log(whole) - sizes[:, None] * SCALE + self.stop
            # Words of many characters that no piece covers leave the range.
            for at in np.flatnonzero((whole <= 0).any(axis=1)).tolist():
                out[short[at]] = [one.word(own[at]) for one in self.each]
        return out

    def expect(self, words: list[str], weights: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Adds the expected counts of rows (row, class) for words that count ``weights`` (word, class) times; returns the counts."""
        edges = self.edges(words)
        if len(totals) < len(self.weights):
            totals = np.vstack([totals, np.zeros((len(self.weights) - len(totals), totals.shape[1]))])
        sums = self.ahead(words, edges)
        of, starts, ends, rows = edges
        passing = np.zeros_like(sums)
        passing[[len(word) + 1 for word in words], np.arange(len(words))] = weights
        borders = np.searchsorted(ends, np.arange(1, len(sums) + 1))
        for end in range(len(sums) - 1, 0, -1):
            part = slice(borders[end - 1], borders[end])
            if part.start < part.stop:
                with np.errstate(invalid="ignore", divide="ignore"):
                    share = passing[end, of[part]] * np.where(sums[end, of[part]] > 0, 1 / sums[end, of[part]], 0.0) * sums[starts[part], of[part]] * self.weights[rows[part]]
                np.add.at(passing.reshape(-1, passing.shape[2]), starts[part] * len(words) + of[part], share)
                np.add.at(totals, rows[part], share)
        return totals

    def told(self, totals: np.ndarray, words: np.ndarray) -> list["Expected"]:
        """Counts of rows as expected counts per class, for so many words."""
        n, out = len(self.first), []
        for k in range(len(self.each)):
            one = Expected({p: c for p, c in zip(self.first, totals[:n, k].tolist()) if c}, {p: c for p, c in zip(self.rest, totals[n:, k].tolist()) if c})
            for character, row in self.spelled.items():
                for b in character.encode():
                    one.bytes[b] += float(totals[row, k])
            one.words = float(words[k])
            out.append(one)
        return out


def vocabulary(model: bytes) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, best first, without control signs and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return sorted(((sp.id_to_piece(i), sp.get_score(i)) for i in plain), key=lambda p: (-p[1], p[0]))


def from_scores(pieces: list[tuple[str, float]]) -> Lattice:
    """First weights: a piece's falls as one over its rank by score; a byte's is that of the last rank."""
    known = {piece for piece, _ in pieces}
    ranked = [*pieces, *([(MARK, -math.inf)] if MARK not in known else [])]
    weight = {piece: 1.0 / (rank + 10) for rank, (piece, _) in enumerate(ranked)}
    least = 1.0 / (len(ranked) + 10)
    first = {piece: w for piece, w in weight.items() if piece.startswith(MARK) and MARK not in piece[1:]}
    rest = {piece: w for piece, w in weight.items() if MARK not in piece}
    begun, more = sum(first.values()), 2 * (sum(rest.values()) + 256 * least)
    return Lattice({p: math.log(w / begun) for p, w in first.items()}, {p: math.log(w / more) for p, w in rest.items()}, [math.log(least / more)] * 256, math.log(0.5))


def telling_words(pieces: list[tuple[str, float]], number: int = TELLING) -> dict[bytes, int]:
    """The best pieces that are a whole word in lower case, with their place."""
    words = [piece[1:] for piece, _ in pieces if piece.startswith(MARK) and len(piece) > 1 and MARK not in piece[1:]]
    return {word.encode(): place for place, word in enumerate([word for word in words if word == word.lower()][:number])}


@dataclass
class Classes:
    """Hidden classes of texts: log shares, and log frequencies of the telling words (word, class)."""

    words: dict[bytes, int]
    shares: np.ndarray
    logs: np.ndarray

    def kinds(self, rows: np.ndarray, words: pa.Array, number: int) -> np.ndarray:
        """:meth:`likeliest` for a batch of ``number`` texts."""
        scores = np.tile(self.shares, (number, 1))
        rows, places, times = told_rows(rows, words, self.words)
        if len(rows):
            own, sums = summed(rows, times[:, None] * self.logs[places])
            scores[own] += sums
        return np.argmax(scores, axis=1)

    def likeliest(self, words: Counter) -> int:
        at, times = told_in(words, self.words)
        return int(np.argmax(self.shares + np.array(times, "float64") @ self.logs[at])) if at else int(np.argmax(self.shares))


def told_in(words: Counter, telling: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Places of the telling words of a text, ascending, and how often it has them."""
    rows = sorted((telling[word], times) for word, times in words.items() if word in telling)
    return [at for at, _ in rows], [times for _, times in rows]


def estimated(telling: dict[bytes, int], number: int, steps: int, sums: Callable, best: Callable) -> Classes:
    """A mixture of word distributions by expectation maximisation over all texts.

    Texts are rows of counts of the telling words. ``sums(f)`` adds up the array f(rows)
    over all texts, None without texts; ``best(f)`` is the row for which f(rows) is largest.
    """
    shape = lambda x: np.sqrt(x / x.sum(axis=1, keepdims=True))
    whole = sums(lambda x: np.concatenate([[len(x)], x.sum(axis=0), shape(x).sum(axis=0)]))
    if whole is None:
        return Classes({}, np.zeros(1), np.zeros((0, 1)))
    n, width = int(round(whole[0])), len(telling)
    overall, mean = whole[1 : width + 1] / whole[1 : width + 1].sum(), whole[width + 1 :] / n
    # Starts: the text nearest to the mean, then the text farthest from all starts so far.
    starts = shape(best(lambda x: shape(x) @ mean)[None, :])
    while len(starts) < min(number, n):
        starts = np.vstack([starts, shape(best(lambda x, at=starts: -(shape(x) @ at.T).max(axis=1))[None, :])])
    k = len(starts)
    belongs = before = lambda x: np.eye(k)[np.argmax(shape(x) @ starts.T, axis=1)]
    for step in range(steps):
        def gather(x: np.ndarray, of=belongs, old=before) -> np.ndarray:
            share = of(x)
            return np.concatenate([[np.abs(share - old(x)).sum() / 2], share.sum(axis=0), (share.T @ x).ravel()])

        found = sums(gather)
        shares = np.log((found[1 : k + 1] + 1) / (n + k))
        rows = found[k + 1 :].reshape(k, width) + 50 * overall
        logs = np.log(rows / rows.sum(axis=1, keepdims=True) + 1e-12)
        if step and found[0] < SETTLED * n:
            break
        before = belongs

        def belongs(x: np.ndarray, logs=logs, shares=shares) -> np.ndarray:
            score = x @ logs.T + shares
            out = np.exp(score - score.max(axis=1, keepdims=True))
            return out / out.sum(axis=1, keepdims=True)

    return Classes(telling, shares, logs.T.copy())


def told_rows(rows: np.ndarray, words: pa.Array, telling: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and times of the telling words of a batch, by row and then by place."""
    width, places = max(len(telling), 1), np.array(list(telling.values()), "int64")
    found = pc.fill_null(pc.index_in(words, value_set=pa.array([word.decode() for word in telling], pa.string())), -1).to_numpy()
    met = np.flatnonzero(found >= 0)
    keys, times = np.unique(rows[met] * width + (places[found[met]] if len(met) else 0), return_counts=True)
    return keys // width, keys % width, times


def dense(rows: list[tuple[list[int], list[int]]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for row, (places, counts) in enumerate(rows):
        x[row, places] = counts
    return x


def found_classes(texts: list[Counter], telling: dict[bytes, int], number: int = CLASSES, steps: int = STEPS) -> Classes:
    """The classes of texts in memory."""
    x = dense([row for row in (told_in(one, telling) for one in texts) if row[0]], len(telling))
    return estimated(telling, number, steps, lambda f: f(x) if len(x) else None, lambda f: x[int(np.argmax(f(x)))])


def classes_of(texts: DataFrame, telling: dict[bytes, int], number: int = CLASSES, steps: int = STEPS) -> Classes:
    """The classes of the texts of the only column, all of which count in every step.

    Only sums and the texts to start from, as counts of telling words, come to the driver.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BATCH_OF_TEXTS):
            rows, places, times = told_rows(*tokens_of(batch.column(0)), telling)
            _, rows = np.unique(rows, return_inverse=True)
            number = int(rows[-1]) + 1 if len(rows) else 0
            yield pa.RecordBatch.from_arrays([listed(rows, number, pa.array(places, pa.int32())), listed(rows, number, pa.array(times, pa.int64()))], names=["at", "times"])

    told = written(texts.mapInArrow(tell, "at array<int>, times array<long>"))

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        at, times = batch.column(0), batch.column(1)
        x = np.zeros((batch.num_rows, len(telling)))
        x[np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = times.flatten().to_numpy()
        return x

    def sums(f: Callable) -> np.ndarray | None:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    here = f(rows_of(batch))
                    total = here if total is None else total + here
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "value"])

        rows = told.mapInArrow(add, "i long, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
        return np.array([r.value for r in sorted(rows)]) if rows else None

    def best(f: Callable) -> np.ndarray:
        """Among equals the text with most words, and the first by its counts."""

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = None
            for batch in batches:
                if batch.num_rows:
                    x = rows_of(batch)
                    score, n = np.round(f(x), 9), x.sum(axis=1)
                    for i in np.flatnonzero(score == score.max()):
                        here = (-float(score[i]), -float(n[i]), batch.column(0)[int(i)].as_py(), batch.column(1)[int(i)].as_py())
                        top = here if top is None else min(top, here)
            if top is not None:
                yield pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(top, (pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["score", "n", "at", "times"])

        row = told.mapInArrow(least, "score double, n double, at array<int>, times array<long>").orderBy("score", "n", "at", "times").first()
        return dense([(row.at, row.times)], len(telling))[0]

    return estimated(telling, number, steps, sums, best)


def word_counts(texts: DataFrame, classes: Classes) -> tuple[DataFrame, DataFrame]:
    """(word, n, per_class) of the only column, and (class, texts); tasks count their own before anything is shuffled."""
    number = len(classes.shares)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ended = np.zeros(number, "int64")

        def together(most: int) -> Iterator[pa.RecordBatch]:
            """Adds up what is held, and hands it over if it is more than ``most`` rows."""
            if sum(map(len, held)) > most:
                sums = pa.concat_tables(held).group_by(["word", "k"]).aggregate([("n", "sum")]).select(["word", "k", "n_sum"]).rename_columns(["word", "k", "n"])
                held[:] = [sums]
                if len(sums) > most // 2:
                    held.clear()
                    yield from sums.combine_chunks().to_batches(max_chunksize=100_000)

        for batch in gathered(batches, BATCH_OF_TEXTS):
            rows, words = tokens_of(batch.column(0))
            kinds = classes.kinds(rows, words, batch.num_rows)
            ended += np.bincount(kinds, minlength=number)
            encoded = words.dictionary_encode()
            found, times = np.unique(encoded.indices.to_numpy().astype("int64") * number + kinds[rows], return_counts=True)
            held.append(pa.table([encoded.dictionary.take(pa.array(found // number)), pa.array(found % number, pa.int32()), pa.array(times, pa.int64())], names=["word", "k", "n"]))
            yield from together(2_000_000)
        yield from together(0)
        yield pa.RecordBatch.from_arrays([pa.nulls(number, pa.string()), pa.array(range(number), pa.int32()), pa.array(ended)], names=["word", "k", "n"])

    columns = [f"n{k}" for k in range(number)]
    counted = texts.mapInArrow(count, "word string, k int, n long")
    sums = written(counted.groupBy("word").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(columns)]))
    per_class = F.array(*columns)
    words = sums.filter("word IS NOT NULL").select("word", F.expr("+".join(columns)).alias("n"), per_class.alias("per_class"))
    return words, sums.filter("word IS NULL").select(per_class.alias("texts"))


def expected_counts(counts: DataFrame, lattice: Lattice, number: int) -> list[Expected]:
    """Expected piece counts per class over the words of a table; tasks sum up before anything is shuffled."""
    shared = counts.sparkSession.sparkContext.broadcast([(lattice.first, lattice.rest, lattice.bytes, lattice.stop)])

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All classes start from the same weights, so a word of one class needs one column.
        here, totals = _lattices(shared.value), [Expected() for _ in range(number)]
        by_class: dict[int, list[tuple[str, float]]] = {}
        sums: dict[int, np.ndarray] = {}
        seen = np.zeros(number)

        def add(k: int) -> None:
            words, weights = zip(*by_class.pop(k))
            sums[k] = here.expect(list(words), np.array(weights)[:, None], sums.get(k, np.zeros((len(here.weights), 1))))
            seen[k] += sum(weights)

        for batch in batches:
            for word, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, weight in enumerate(weights):
                    if weight and len(word) > LONG:
                        here.each[0].expect(word, weight, totals[k])
                    elif weight:
                        by_class.setdefault(k, []).append((word, weight))
                        if len(by_class[k]) >= BATCH_OF_WORDS:
                            add(k)
        for k in list(by_class):
            add(k)
        for k, total in sums.items():
            rows_of = np.vstack([total, np.zeros((len(here.weights) - len(total), 1))])
            totals[k] = totals[k].plus(here.told(rows_of, seen[k : k + 1])[0], 1.0)
        rows = [(k, "words", "", total.words) for k, total in enumerate(totals)]
        for k, total in enumerate(totals):
            rows += [(k, "first", p, n) for p, n in total.first.items()] + [(k, "rest", p, n) for p, n in total.rest.items()]
            rows += [(k, "byte", str(b), n) for b, n in enumerate(total.bytes) if n]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["k", "side", "piece", "n"])

    out = [Expected() for _ in range(number)]
    parts = counts.select("word", "per_class").mapInArrow(expect, "k long, side string, piece string, n double")
    for k, side, piece, n in parts.groupBy("k", "side", "piece").agg(F.sum("n")).collect():
        if side == "words":
            out[k].words += n
        elif side == "byte":
            out[k].bytes[int(piece)] = n
        else:
            getattr(out[k], side)[piece] = n
    return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``rows`` or BATCH_BYTES, or somewhat more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(one.num_rows for one in held) >= rows or sum(one.nbytes for one in held) >= BATCH_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if any(one.num_rows for one in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def matrix(rows: np.ndarray) -> pa.Array:
    """The rows of an array as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def cut_of(counts: DataFrame, most: int) -> int:
    """The least count, OFTEN or more, that leaves ``most`` words at most."""
    taken, steps = 0, counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()
    for n, words in sorted(((r.n, r.words) for r in steps), reverse=True):
        taken += words
        if taken > most:
            return max(n + 1, OFTEN)
    return OFTEN


@dataclass
class TextModel:
    """What the tasks need: the commonest words with counts and log10 weights per class, and the lattices of words without an edge."""

    place: dict[bytes, int]
    counts: np.ndarray
    logs: np.ndarray
    lattices: list[tuple]
    #: Per class, log10 of the chance that a word has no edge of its own.
    rare: np.ndarray
    #: Per class, log10 of its share and of a text's end.
    start: np.ndarray


def text_model(counts: DataFrame, texts: np.ndarray, pieces: list[tuple[str, float]], most: int, steps: int) -> tuple[TextModel, DataFrame]:
    """The model of a count table, and (word, n, logs) of the words it does not hold; logs is null without an edge."""
    k = len(texts)
    rare_words, start = counts.filter(F.col("n") < OFTEN), from_scores(pieces)
    sums = lambda name: [F.coalesce(F.sum(F.col(name)[i]), F.lit(0)) for i in range(k)]
    often = F.col("n") >= OFTEN
    parts = {r.often: r for r in counts.groupBy(often.alias("often")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.array(*sums("per_class")).alias("sums")).collect()}
    of = lambda side: np.array(parts[side].sums if side in parts else [0] * k, "float64")
    rare_sum, often_sum = of(False), of(True)
    n_often, n_rare = (parts[side].words if side in parts else 0 for side in (True, False))
    rare_words = dealt(rare_words, n_rare, EACH)
    first, rest = list(start.first), list(start.rest)
    lattices = [start] * k
    for _ in range(steps):
        expected = expected_counts(rare_words, start, k)
        together = Expected()
        for one in expected:
            together = together.plus(one, 1.0)
        if not together.words:
            break
        start = together.lattice(first, rest)
        lattices = [one.plus(together, SHARED / together.words).lattice(first, rest) for one in expected]
    # One place more for what was never seen, so that it has some chance even in a closed corpus.
    whole = often_sum + rare_sum + texts + 2
    rare, end = (rare_sum + 1) / whole, (texts + 1) / whole
    everything = float(max(parts[True].n if True in parts else 0, 1))
    parts_of = [(one.first, one.rest, one.bytes, one.stop) for one in lattices]
    shared = counts.sparkSession.sparkContext.broadcast(parts_of)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = _lattices(shared.value)
        for batch in gathered(batches, BATCH_OF_WORDS):
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype("float64")
            by_class = batch.column(2).flatten().to_numpy().reshape(-1, k).astype("float64")
            weight = (by_class + SHARED * (n / everything)[:, None]) / (often_sum + SHARED)
            in_pieces = np.exp(here.logs(words)) * rare
            logs = np.log10((1 - rare - end) * weight + in_pieces)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), matrix(logs)], names=["word", "n", "logs"])

    weighed = written(dealt(counts.filter(often), n_often, EACH).mapInArrow(weigh, "word string, n long, logs array<double>"))
    cut = cut_of(counts, most)
    top = weighed.filter(F.col("n") >= cut).toArrow().sort_by("word")
    others = weighed.filter(F.col("n") < cut).unionByName(counts.filter(~often).select("word", "n", F.lit(None).cast("array<double>").alias("logs")))
    model = TextModel(
        {word.encode(): i for i, word in enumerate(top.column("word").to_pylist())}, top.column("n").to_numpy().astype("int64"),
        top.column("logs").combine_chunks().flatten().to_numpy().reshape(-1, k), parts_of, np.log10(rare),
        np.log10((texts + 1) / (texts.sum() + k)) + np.log10(end),
    )
    return model, others


def scored(docs: DataFrame, learn: Column, model_path: str, key: str = "doc_id", text: str = "text",
           most: int = FREQUENT, steps: int = 1) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    The rows that ``learn`` marks are learned from. A text is its words and one end;
    a null or empty text is the end alone. n_known counts tokens seen in training;
    base_score sums log10 of the add-one smoothed frequencies of words and end, with
    one more place for all unseen words; score is log10 of the probability of the
    text, summed over classes and segmentations. With nothing to learn from, all words are spelled by
    the vocabulary's own weights. Classes and all counts
    cover all texts.
    """
    with open(model_path, "rb") as file:
        pieces = vocabulary(file.read())
    training = docs.filter(learn)
    n_training = training.count()
    learned = training.select(F.coalesce(F.col(text), F.lit("")))
    classes = classes_of(learned, telling_words(pieces))
    counts, ended = word_counts(learned, classes)
    texts = np.array((ended.first() or [[0] * len(classes.shares)])[0], "float64")
    model, table = text_model(counts, texts, pieces, most, steps)
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = (sums.n or 0) + n_training, sums.v + (n_training > 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    log_all, base_end, k = math.log10(tokens + types + 1), math.log10(n_training + 1), len(texts)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        place, gains = model.place, np.log10(model.counts + 1.0)
        row_id = TaskContext.get().partitionId() << 40
        for batch in gathered(batches, BATCH_OF_TEXTS):
            number = batch.num_rows
            rows, tokens_in = tokens_of(batch.column(1))
            encoded = tokens_in.dictionary_encode()
            ids, words = encoded.indices.to_numpy().astype("int64"), encoded.dictionary
            at = np.array([place.get(word, -1) for word in words.cast(pa.binary()).to_pylist()], "int64")[ids]
            held = at >= 0
            of, at = rows[held], at[held]
            known = int(n_training > 0) + np.bincount(of, minlength=number)
            base = base_end + np.bincount(of, weights=gains[at], minlength=number)
            sums = np.tile(model.start, (number, 1))
            own, more = summed(of, model.logs[at])
            sums[own] += more
            rest, times = np.unique(rows[~held] * max(len(words), 1) + ids[~held], return_counts=True)
            rest, of = words.take(pa.array(rest % max(len(words), 1))), rest // max(len(words), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(row_id + np.arange(number)), pa.array(1 + np.bincount(rows, minlength=number)), pa.array(known), pa.array(base),
                 matrix(sums), listed(of, number, rest), listed(of, number, pa.array(times))],
                names=[key, "__row", "n_tokens", "__known", "__base", "__sums", "__words", "__times"],
            )
            row_id += number

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words without an edge, by the lattices, and the sum over classes."""
        model = shared.value
        spelled = _spelled_by(model)
        for batch in gathered(batches, BATCH_OF_TEXTS):
            sums, words, times, edged, more = batch.columns[4:9]
            per_class = sums.flatten().to_numpy().reshape(-1, k).copy()
            per_class[more.is_valid().to_numpy(zero_copy_only=False)] += more.flatten().to_numpy().reshape(-1, k)
            rows_of = lambda lists: np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            encoded = pa.concat_arrays([words.flatten(), edged.flatten()]).dictionary_encode()
            different, rows = len(encoded.dictionary), rows_of(words)
            ids = encoded.indices.to_numpy().astype("int64")
            left = ~np.isin(rows * different + ids[: len(rows)], rows_of(edged) * different + ids[len(rows) :])
            needed, at = np.unique(ids[: len(rows)][left], return_inverse=True)
            if len(needed):
                logs = spelled.of(encoded.dictionary.take(pa.array(needed)).to_pylist()) / TEN + model.rare
                own, sums = summed(rows[left], times.flatten().to_numpy()[left][:, None] * logs[at])
                per_class[own] += sums
            top = per_class.max(axis=1)
            scores = top + np.log10(np.power(10.0, per_class - top[:, None]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.float64())], names=[key, "n_tokens", "n_known", "__gained", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = written(docs.select(key, F.col(text).alias("__text")).mapInArrow(
        look, f"`{key}` {kind}, __row long, n_tokens long, __known long, __base double, __sums array<double>, __words array<string>, __times array<long>"
    ))
    others = rows.select("__row", F.inline(F.arrays_zip(F.col("__words").alias("word"), F.col("__times").alias("times"))))
    found = (
        others.join(table, "word").groupBy("__row").agg(
            F.sum("times").alias("__more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("__gain"),
            F.array(*[F.coalesce(F.sum(F.col("times") * F.col("logs")[i]), F.lit(0.0)) for i in range(k)]).alias("__logs"),
            F.collect_list(F.when(F.col("logs").isNotNull(), F.col("word"))).alias("__edged"),
        )
    )
    joined = rows.join(found, "__row", "left").select(
        key, "n_tokens", (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"),
        (F.col("__base") + F.coalesce("__gain", F.lit(0.0))).alias("__gained"), "__sums", "__words", "__times", "__edged", "__logs",
    )
    return joined.mapInArrow(finish, f"`{key}` {kind}, n_tokens long, n_known long, __gained double, score double").select(
        key, "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("__gained") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), "score",
    )


class Spelled:
    """Log probabilities of words per class; the words of the last batches keep theirs, in bounded memory."""

    def __init__(self, parts: list[tuple]):
        self.lattices = Lattices(parts)
        self.known: dict[str, np.ndarray] = {}

    def of(self, words: list[str]) -> np.ndarray:
        """Log probabilities (word, class)."""
        if len(self.known) > 100_000:
            self.known = {}
        new = sorted(set(words).difference(self.known))
        for start in range(0, len(new), BATCH_OF_WORDS):
            part = new[start : start + BATCH_OF_WORDS]
            self.known.update((word, log) for word, log in zip(part, self.lattices.logs(part)))
        return np.array([self.known[word] for word in words])


#: The last parts and their lattices in a worker; the parts are kept, so that no others can be taken for them.
_LATTICES: list[tuple[list[tuple], Lattices]] = []


def _lattices(parts: list[tuple]) -> Lattices:
    """The lattices of broadcast parts, built once per worker."""
    if not _LATTICES or _LATTICES[0][0] is not parts:
        _LATTICES[:] = [(parts, Lattices(parts))]
    return _LATTICES[0][1]


#: The last model and its lattices; the model is kept, so that no other can be taken for it.
_SPELLED: list[tuple[TextModel, Spelled]] = []


def _spelled_by(model: TextModel) -> Spelled:
    """The lattices of a broadcast model, once per worker, so that what they keep serves several tasks."""
    if not _SPELLED or _SPELLED[0][0] is not model:
        _SPELLED[:] = [(model, Spelled(model.lattices))]
    return _SPELLED[0][1]
