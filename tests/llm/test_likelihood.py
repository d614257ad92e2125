"""Lattice sums against all segmentations, base scores against counts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.llm import catalog, likelihood
from parlance.llm.common import fold
from parlance.llm.likelihood import MARK, OFTEN, SHARED, TEN, Expected, Lattice, Lattices, classes_of, found_classes, from_scores, scored, telling_words, vocabulary, word_counts, words_of

PATH = catalog.tokenizer("piece_bpe_32k.model")


def segmentations(string, lattice, start=0):
    """All ways to cover a string from ``start``, as lists of (piece or None for bytes, log)."""
    if start == len(string):
        yield []
        return
    side = lattice.rest if start else lattice.first
    for end in range(start + 1, len(string) + 1):
        if string[start:end] in side:
            for more in segmentations(string, lattice, end):
                yield [(string[start:end], side[string[start:end]]), *more]
    if start and string[start] not in lattice.rest:
        for more in segmentations(string, lattice, start + 1):
            yield [(None, sum(lattice.bytes[b] for b in string[start].encode())), *more]


@pytest.fixture(scope="module")
def lattice():
    return from_scores(vocabulary(open(PATH, "rb").read()))


def test_forward_recursion_sums_all_segmentations(lattice):
    for word in ["a", "the", "thndha", "überaß", "日本x", "🙂a", "▁", "9.5%", "q" * 12]:
        ways = [sum(log for _, log in way) for way in segmentations(MARK + word, lattice)]
        assert math.isclose(lattice.word(word), math.log(sum(map(math.exp, ways))) + lattice.stop, rel_tol=1e-9)


def test_expected_counts_are_those_of_all_segmentations(lattice):
    for word in ["thndha", "überaß", "日x"]:
        ways = [(math.exp(sum(log for _, log in way)), way) for way in segmentations(MARK + word, lattice)]
        total, want = sum(p for p, _ in ways), Counter()
        for p, way in ways:
            for at, (piece, _) in enumerate(way):
                want["first" if at == 0 else "rest", piece] += 3 * p / total
        got = Expected()
        lattice.expect(word, 3, got)
        assert got.words == 3
        for side, counts in (("first", got.first), ("rest", got.rest)):
            for piece, n in counts.items():
                assert math.isclose(n, want[side, piece], rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(sum(got.first.values()), 3.0, rel_tol=1e-9)


def test_batches_of_words_are_single_words(lattice):
    """Several classes at once, spelled signs, long words; sums and expected counts."""
    words = ["a", "the", "thndha", "überaß", "日本x", "🙂a", "▁", "9.5%", "q" * 12, "x" * 100, "ab" * 400, "the"]
    rng = random.Random(4)
    other = Expected({p: rng.random() for p in lattice.first}, {p: rng.random() for p in lattice.rest}, [rng.random() for _ in range(256)], 50.0).lattice(list(lattice.first), list(lattice.rest))
    both = Lattices([(one.first, one.rest, one.bytes, one.stop) for one in (lattice, other)])
    assert np.allclose(both.logs(words), [[lattice.word(w), other.word(w)] for w in words], rtol=1e-9)
    short, weights = [w for w in words if len(w) <= 100], np.array([[i % 3, 1.0] for i in range(11)])
    found = both.told(both.expect(short, weights, np.zeros((len(both.weights), 2))), weights.sum(axis=0))
    for k, one in enumerate((lattice, other)):
        want = Expected()
        for word, weight in zip(short, weights[:, k]):
            one.expect(word, weight, want)
        assert math.isclose(found[k].words, want.words) and np.allclose(found[k].bytes, want.bytes, atol=1e-8)
        for got, plain in ((found[k].first, want.first), (found[k].rest, want.rest)):
            assert all(math.isclose(got.get(p, 0.0), plain.get(p, 0.0), rel_tol=1e-6, abs_tol=1e-9) for p in {*got, *plain})


def test_words_out_of_range_and_marks_inside(lattice):
    """Many characters that no piece covers leave the range of scaled sums; a mark inside of a word begins no piece."""
    words = ["\U0001f980" * 60, "a" + MARK + "the", MARK * 3, "the", "\U0001f980the"]
    part = (lattice.first, lattice.rest, lattice.bytes, lattice.stop)
    got = Lattices([part, part]).logs(words)
    assert np.isfinite(got).all() and np.allclose(got, [[lattice.word(w)] * 2 for w in words], rtol=1e-9)


def test_batches_of_texts_are_single_texts():
    """Words, telling words and classes of a batch; white space is that of ASCII alone."""
    texts = ["The OF\x0band  the", None, "", "  \t", "x\x1cy\u00a0z\u2003É É", "der die\r\nund der", "the of and " * 50]
    rows, words = likelihood.tokens_of(pa.array(texts))
    bags = [Counter() for _ in texts]
    for row, word in zip(rows.tolist(), words.to_pylist()):
        bags[row][word.encode()] += 1
    assert bags == [likelihood.bag_of(text) for text in texts]
    telling = places("the of and der die und")
    want = [(i, *pair) for i, bag in enumerate(bags) for pair in zip(*likelihood.told_in(bag, telling))]
    assert list(zip(*(x.tolist() for x in likelihood.told_rows(rows, words, telling)))) == want
    classes = found_classes(bags, telling, number=2)
    assert classes.kinds(rows, words, len(texts)).tolist() == [classes.likeliest(bag) for bag in bags]
    parts = [(dict(a=0.0), dict(b=0.0), [0.0] * 256, 0.0)]
    assert likelihood._lattices(parts) is likelihood._lattices(parts)


def test_weights_are_a_distribution(lattice):
    assert math.isclose(sum(map(math.exp, lattice.first.values())), 1.0, rel_tol=1e-9)
    assert math.isclose(sum(map(math.exp, lattice.rest.values())) + sum(map(math.exp, lattice.bytes)) + math.exp(lattice.stop), 1.0, rel_tol=1e-9)
    counts = Expected({"▁a": 3.0}, {"b": 2.0}, [0.0] * 256, 3.0)
    learned = counts.lattice(list(lattice.first), list(lattice.rest))
    assert math.isclose(sum(map(math.exp, learned.first.values())), 1.0, rel_tol=1e-6)
    assert math.isclose(sum(map(math.exp, learned.rest.values())) + sum(map(math.exp, learned.bytes)) + math.exp(learned.stop), 1.0, rel_tol=1e-6)
    tiny = Lattice({MARK: 0.0}, {"a": math.log(0.25)}, [math.log(0.25 / 256)] * 256, math.log(0.5))
    assert math.isclose(sum(math.exp(tiny.word("a" * n)) for n in range(60)), 0.5 / 0.75, rel_tol=1e-9)


def places(words):
    return {word.encode(): place for place, word in enumerate(words.split())}


def test_classes_separate_languages():
    rng = random.Random(1)
    texts = [Counter(rng.choices([b"der", b"die", b"und"] if i % 2 else [b"the", b"of", b"and"], k=30)) for i in range(80)]
    classes = found_classes(texts, places("der die und the of and"), number=2)
    found = [classes.likeliest(t) for t in texts]
    assert len(set(found[::2])) == len(set(found[1::2])) == 1 and found[0] != found[1]
    assert len(found_classes([], places("a")).shares) == 1
    assert {"the", "of", "and"} <= {w.decode() for w in telling_words(vocabulary(open(PATH, "rb").read()))}


def slow_base(rows, learn):
    counts, n_docs = Counter(), 0
    for key, text in rows:
        if learn(key):
            n_docs += 1
            for words in words_of(text):
                counts.update(words)
    total, types = sum(counts.values()) + n_docs, len(counts) + (n_docs > 0)
    for key, text in rows:
        words = [w for part in words_of(text) for w in part]
        known = [*(counts[w] for w in words), n_docs]
        yield str(key), len(known), sum(c > 0 for c in known), total, sum(math.log10((c + 1) / (total + types + 1)) for c in known)


@pytest.mark.parametrize("most", [300_000, 50])
def test_base_scores_are_those_of_counts(llm, small, odd, most):
    from zlib import crc32

    for docs in (small, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = sorted(slow_base(rows, lambda key: crc32(("" if key is None else str(key)).encode()) % 7 != 2))
        got = sorted(scored(docs, fold(F.col("doc_id"), 7) != 2, PATH, most=most).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score))
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert (str(g.doc_id), g.n_tokens, g.n_known, g.train_tokens) == w[:4] and math.isclose(g.base_score, w[4], rel_tol=1e-9)
            assert math.isfinite(g.score) and g.score < 0


def test_nothing_to_learn_from_and_empty_tables(llm, odd, nothing):
    rows = scored(odd, F.lit(False), PATH).collect()
    assert len(rows) == odd.count() and all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)
    assert scored(nothing, F.lit(True), PATH).collect() == []


def test_better_than_word_counts_on_held_out_documents(llm):
    got = catalog.queries()["op7_likelihood"](llm, "/root/testdata/sf0.1").filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()
    assert np.isfinite(got.score).all()


def test_words_beyond_the_dictionary_keep_their_edge(llm, small, odd):
    """The dictionary is a cache: its size changes no score."""
    for docs in (small, odd):
        docs = docs.select("doc_id", "text").withColumn("doc_id", F.xxhash64("doc_id", "text"))
        whole, cached = (sorted((r.doc_id, r.n_known, r.score) for r in scored(docs, fold(F.col("doc_id"), 7) != 2, PATH, most=most).collect()) for most in (300_000, 50))
        assert [r[:2] for r in whole] == [r[:2] for r in cached]
        assert np.allclose([r[2] for r in whole], [r[2] for r in cached], rtol=1e-9)


def test_classes_over_all_texts_and_all_parts(llm):
    """A kind of 8 texts in 6,000 has a class, and a very long text has the class of its whole."""
    one, two = ["the of and to"] * 5_992, ["der die und zu"] * 8
    docs = llm.createDataFrame([(t,) for t in one + two], "text string").repartition(3)
    classes = classes_of(docs, places("the of and to der die und zu"), number=2)
    kinds = [classes.likeliest(Counter(t.encode().split())) for t in ("the of and to", "der die und zu")]
    assert kinds[0] != kinds[1]
    long = llm.createDataFrame([("the of " * 10 + " " * (1 << 20) + " " + "der die und zu " * 1_000,)], "text string")
    counts, ended = word_counts(long, classes)
    assert ended.first().texts[kinds[1]] == 1 and {r.word: r.per_class[kinds[1]] for r in counts.collect()}["der"] == 1_000


def slow_scores(rows, learn, classes, steps=1):
    """log10 probabilities of texts by the rule as written: sums over classes, words one by one."""
    pieces = vocabulary(open(PATH, "rb").read())
    start = from_scores(pieces)
    k = len(classes.shares)
    bags = {i: Counter(w.decode() for part in words_of(text) for w in part) for i, (_, text) in enumerate(rows)}
    per = [Counter() for _ in range(k)]
    texts = np.zeros(k)
    for i, (key, _) in enumerate(rows):
        if learn(key):
            kind = classes.likeliest(Counter({w.encode(): n for w, n in bags[i].items()}))
            per[kind].update(bags[i])
            texts[kind] += 1
    total = sum(per, Counter())
    expected = [Expected() for _ in range(k)]
    for one, found in zip(per, expected):
        for word, n in one.items():
            if total[word] < OFTEN:
                start.expect(word, n, found)
    together = Expected()
    for found in expected:
        together = together.plus(found, 1.0)
    lattices = [found.plus(together, SHARED / together.words).lattice(list(start.first), list(start.rest)) for found in expected]
    often = np.array([sum(n for w, n in one.items() if total[w] >= OFTEN) for one in per], float)
    once = np.array([sum(n for w, n in one.items() if total[w] < OFTEN) for one in per], float)
    whole = often + once + texts + 2
    rare, end = (once + 1) / whole, (texts + 1) / whole
    everything = max(sum(n for n in total.values() if n >= OFTEN), 1)
    for i, (key, _) in enumerate(rows):
        logs = np.log10((texts + 1) / (texts.sum() + k)) + np.log10(end)
        for word, n in bags[i].items():
            spelled = np.array([one.word(word) for one in lattices])
            if total[word] >= OFTEN:
                weight = (np.array([one[word] for one in per]) + SHARED * total[word] / everything) / (often + SHARED)
                logs = logs + n * np.log10((1 - rare - end) * weight + np.exp(spelled) * rare)
            else:
                logs = logs + n * (spelled / TEN + np.log10(rare))
        yield str(key), float(logs.max() + np.log10((10 ** (logs - logs.max())).sum()))


def test_scores_of_whole_documents_are_those_of_the_rule(llm, small):
    """Also for repeated rows, and whatever the files are."""
    from zlib import crc32

    docs = small.select("doc_id", "text").limit(60)
    docs = docs.unionByName(docs.limit(3)).unionByName(llm.createDataFrame([(1001, None), (1002, ""), (1003, "q" * 3000)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learn = lambda key: crc32(str(key).encode()) % 7 != 2
    telling = telling_words(vocabulary(open(PATH, "rb").read()))
    classes = found_classes([Counter(w for part in words_of(text) for w in part) for key, text in rows if learn(key)], telling)
    want = sorted(slow_scores(rows, learn, classes))
    for layout in (1, 7):
        frame = llm.createDataFrame(rows, "doc_id long, text string").repartition(layout)
        got = sorted((str(r.doc_id), r.score) for r in scored(frame, fold(F.col("doc_id"), 7) != 2, PATH).collect())
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-7)
