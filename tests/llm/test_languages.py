"""Backoff on small tables, held-out accuracy, odd input."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import catalog, languages
from parlance.llm.languages import LONGEST, LanguageModel, Predictor, fitted, gram_counts, hashed, predicted, runs, words_of


def test_runs_and_counts(llm):
    assert runs("ab", 2) == ["^a", "ab", "b$"] and runs("a", 5) == ["^a$"]
    got = {(r.lang, r.length, r.gram): r.n for r in gram_counts(llm.createDataFrame([("x", "Ab ab, 1 ab_"), ("y", None)], "lang string, text string")).collect()}
    assert got["x", 0, "ab"] == 3 and got["x", 2, "^a"] == 3 and not any(k[0] == "y" for k in got)


def log_of(model, length, gram):
    """Log frequencies of a known string, by the table."""
    table = model.tables[length]
    at = table.find(hashed([gram]))
    assert at[0] >= 0
    out = table.base.copy()[None]
    table.add(out, np.array([0]), at, np.ones(1))
    return out[0]


def predict(model, text):
    names, scores = Predictor(model).predict([text])
    return names[0], scores[0]


def test_words_first_then_shorter_and_shorter_runs():
    rows = [("a", 0, "dog", 9), ("b", 0, "dog", 1), ("b", 5, "^dogs", 4), ("a", 3, "^zz", 5), ("b", 1, "q", 7)]
    model = LanguageModel.of(["a", "b"], [1, 1], rows)
    score = lambda word: model.scores([word])[0]
    assert predict(model, "dog")[0] == "a"
    assert np.allclose(score("dog"), np.log([9.5 / 9.5, 1.5 / 1.5])) and np.allclose(score("dog"), log_of(model, 0, "dog"))
    assert np.allclose(score("dogs"), log_of(model, 5, "^dogs")) and predict(model, "dogs")[0] == "b"
    assert np.allclose(score("zzy"), log_of(model, 3, "^zz")) and predict(model, "zzy")[0] == "a"
    assert predict(model, "wqw")[0] == "b" and not score("ümü").any()
    assert predict(model, "ümü") == ("a", 0.5)
    assert predict(model, "12 !") == predict(model, None) == predict(LanguageModel.of([], [], []), "dog") == ("und", 0.0)


def slow_scores(rows, languages, word):
    """The rule as written, string by string."""
    for length in (0, *range(LONGEST, 0, -1)):
        part = [r for r in rows if r[1] == length]
        strings = {r[2] for r in part}
        whole = {lang: sum(r[3] for r in part if r[0] == lang) for lang in languages}
        known = [g for g in ([word] if length == 0 else runs(word, length)) if g in strings]
        if known:
            return np.mean([[np.log((sum(r[3] for r in part if r[0] == lang and r[2] == g) + 0.5) / (whole[lang] + 0.5 * len(strings))) for lang in languages]
                            for g in known], axis=0)
    return np.zeros(len(languages))


def test_scores_are_those_of_the_rule(llm, monkeypatch):
    """Counts, tables and back-off against loops; also with the memory for scores used up all the time."""
    rng = random.Random(2)
    texts = [(rng.choice("xyz"), " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(8))) for _ in range(40)]
    rows = [tuple(r) for r in gram_counts(llm.createDataFrame(texts, "lang string, text string")).select("lang", "length", "gram", "n").collect()]
    plain = Counter()
    for lang, text in texts:
        for word in text.split():
            plain[lang, 0, word] += 1
            plain.update((lang, length, run) for length in range(1, LONGEST + 1) for run in runs(word, length))
    assert {r[:3]: r[3] for r in rows} == dict(plain)
    model = LanguageModel.of(["x", "y", "z"], [3, 2, 1], rows)
    words = [*{w for _, t in texts for w in t.split()}][:60] + ["bade", "qqabc", "éé", "zzz", "ed"]
    assert np.allclose(model.scores(words), [slow_scores(rows, ["x", "y", "z"], w) for w in words])
    held = Predictor(model).predict([t for _, t in texts])
    monkeypatch.setattr(languages, "SCORES", 30)
    tight, one = Predictor(model), [Predictor(model).predict([t]) for _, t in texts]
    assert [tight.predict([t])[0][0] for _, t in texts] == held[0] == [o[0][0] for o in one] and np.allclose(held[1], [o[1][0] for o in one])


def test_runs_of_many_signs_are_counted():
    words = ["".join(chr(0x4E00 + 97 * i + j) for j in range(3)) for i in range(4000)] + ["ab", "ab"]
    grams, sums = languages.run_counts(words, np.array([1] * 4000 + [2, 3]), 5)
    assert dict(zip(grams, sums.tolist())) == Counter(g for w, n in zip(words, [1] * 4000 + [2, 3]) for g in runs(w, 5) * n)


def test_letters_by_category():
    assert words_of("½ ² ① Ⅷ \u0301 _ 7") == []
    assert words_of("a² नमस्ते e\u0301te") == ["a", "नमस्ते", "e\u0301te"]
    assert words_of("\U00010400b ½\U0001d7d8") == ["\U00010428b"]
    assert predict(LanguageModel.of(["a"], [1], [("a", 0, "dog", 9)]), "½ ② 7") == ("und", 0.0)


def test_held_out_accuracy(llm):
    folder = "/root/testdata/sf0.01"
    got = catalog.queries()["op10_language"](llm, folder).join(llm.read.parquet(f"{folder}/documents.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang_pred == held.lang).mean() > 0.99 and got.score.between(0, 1).all()


@pytest.mark.parametrize("sample", [20_000, 3])
def test_odd_input(odd, nothing, sample):
    out = predicted(odd.withColumn("score", F.lit("clash")), fitted(odd, sample=sample)).collect()
    assert len(out) == odd.count() and {r.lang_pred for r in out} <= {"en", "und"}
    for r in out:
        assert (r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in r.text or ""))
    assert {r.lang_pred for r in predicted(odd, fitted(nothing)).collect()} == {"und"}
    assert predicted(nothing, fitted(odd)).collect() == []


def test_a_string_counts_in_all_languages(llm):
    """A rare word of a large language is not only that of a small one that has it once."""
    rows = [(i, "aa bb cc aa bb cc" + (" tail" if i < 5 else ""), "large") for i in range(10)]
    docs = llm.createDataFrame([*rows, (99, "tail xx", "small")], "doc_id long, text string, lang string")
    model = fitted(docs)
    assert len(model.tables[0].keys) == 5
    assert np.allclose(np.exp(log_of(model, 0, "tail")), [5.5 / (65 + 2.5), 1.5 / (2 + 2.5)])


def test_a_language_of_6_000_documents_is_counted_whole(llm):
    words = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    docs = llm.range(6_000).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"))
    assert len(fitted(docs).tables[0].keys) == 6_000
