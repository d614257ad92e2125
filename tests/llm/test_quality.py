"""Measures against brute force; the field against all sequences and on held-out documents."""

import itertools
import random
import re

import numpy as np

from parlance.llm import catalog
from parlance.llm.quality import FEATURES, PLAIN, Field, fit, fitted, judged, line_features, measures, only_good

SEPARATORS = " \t\n\x0b\x0c\r"


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + j for i, run in enumerate(runs) if runs.count(run) > 1 for j in range(8)}
    lines, seen, doubles = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubles, len(hit)


def test_measures_are_those_of_brute_force(odd_rows):
    rng = random.Random(4)
    texts = [row[1] or "" for row in odd_rows if len(row[1] or "") < 5_000]
    texts += [rng.choice(["\n", " ", "\t"]).join(rng.choice("abc#|é") for _ in range(rng.randrange(60))) for _ in range(200)]
    for text in texts:
        assert measures(text) == slow(text), text
    assert measures("a b c d e f g h " * 2) == (16, 16, 0, 0, 16)


def test_decoding_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        rows = rng.normal(size=(rng.integers(1, 7), len(FEATURES)))
        field = Field(tuple(rng.normal(size=len(FEATURES))), tuple(map(tuple, rng.normal(size=(2, 2)))))

        def worth(marks):
            return sum(rows[i] @ np.array(field.content) for i, m in enumerate(marks) if m) + sum(field.moves[a][b] for a, b in zip(marks, marks[1:]))

        best = max(itertools.product((0, 1), repeat=len(rows)), key=worth)
        assert tuple(field.marks(rows)) == best
    assert len(PLAIN.content) == len(FEATURES) and PLAIN.content_share("") == 0.0


def test_fit_separates_kinds_of_lines():
    rng = np.random.default_rng(2)
    texts, good = [], []
    for i in range(60):
        rows = rng.normal(size=(rng.integers(1, 9), len(FEATURES)))
        rows[:, 3] += 4 * (i % 2) - 2
        texts.append(rows)
        good.append(i % 2 == 0)
    field = fit(texts, good)
    right = [field.marks(rows).mean() > 0.5 for rows in texts]
    assert np.mean(np.array(right) == np.array(good)) > 0.95
    assert fit(texts, [True] * 60) == PLAIN


def test_hidden_marks_of_mixed_documents():
    """Labels are those of most lines; the lines that differ get the other mark all the same."""
    rng = np.random.default_rng(5)
    texts, good, truth = [], [], []
    for i in range(120):
        kinds = np.repeat([i % 2, 1 - i % 2], [rng.integers(3, 9), rng.integers(0, 3)])
        rows = rng.normal(size=(len(kinds), len(FEATURES)))
        rows[:, 0], rows[:, 3] = 1.0, rows[:, 3] + 3 - 6 * kinds
        texts.append(rows)
        truth.append(kinds)
        good.append(i % 2 == 1)
    field = fit(texts, good)
    marks = [field.marks(rows) for rows in texts]
    assert np.mean(np.concatenate(marks) == np.concatenate(truth)) > 0.95
    assert np.mean([0 < m.mean() < 1 for m, k in zip(marks, truth) if 0 < k.mean() < 1]) > 0.8


def test_bad_blocks_in_front_of_good_documents(llm):
    """On the given tables: the block is boilerplate, the document behind it content."""
    labels = {r.doc_id: r.quality for r in llm.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in labels and r.text}
    field = fitted(docs, llm.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rng = random.Random(1)
    lines = lambda text: len(line_features(text)[0])
    good = [t for d, t in sorted(texts.items()) if labels[d] and lines(t) > 4]
    bad = [t.rstrip() for d, t in sorted(texts.items()) if not labels[d] and lines(t) > 2]
    right = 0
    for text in good[:200]:
        block = rng.choice(bad)
        marks = field.marks(line_features(f"{block}\n{text}")[0])
        right += marks[: lines(block)].mean() < 0.5 < marks[lines(block) :].mean()
    assert right > 0.6 * len(good[:200])


def test_long_documents_are_fitted_in_windows(llm):
    """Labels that contradict, a label table with clashing columns, documents of many lines."""
    rows = [(i, "\n".join((["A fine sentence stands here."] if i % 2 else ["# | # | !!"]) * 200)) for i in range(20)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    labels = llm.createDataFrame([(i, i % 2, "x") for i in range(20)] + [(1, 0, "y")], "doc_id long, quality int, text string")
    field = fitted(docs, labels)
    assert field != PLAIN and field.content_share(rows[1][1]) == 1.0 and field.content_share(rows[0][1]) == 0.0


def test_documents(llm, odd, nothing, small):
    labels = llm.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = fitted(docs, labels)
    rows = judged(docs, field).join(labels, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.93
    for r in rows[:100]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept <= (not r.base_failed)
    out = judged(odd, PLAIN)
    assert out.count() == odd.count() and not out.filter("text IS NULL AND kept").count()
    assert judged(nothing, field).collect() == []
    kept = only_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert only_good(nothing, labels).collect() == []
    assert catalog.queries()["op9_quality_rules"](llm, "/root/testdata/sf0.001").count() == small.count()
