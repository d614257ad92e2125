"""Benchmark windows against a scan of every window at every place."""

import hashlib
import random
import re

import pytest

from parlance.llm.decontaminate import judged, scan, without_contaminated, without_spans


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(text, items, width=13):
    mine, hit, seen = words(text), set(), set()
    for item, other in items:
        other = words(other)
        for start in range(max(1, len(other) - width + 1) if other else 0):
            window = other[start : start + width]
            for at in range(len(mine) - len(window) + 1):
                if mine[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    seen.add(str(item))
    return len(mine), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), 20 * len(hit) >= len(mine) and bool(hit)


@pytest.fixture(scope="module")
def case(llm):
    rng = random.Random(3)
    vocabulary = ["the", "of", "Été", "42", "x", "y", "日本"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 12, 13, 20, 40])))) for i in range(12)]
    items += [(99, None), (5, items[4][1]), (None, items[6][1]), (12, "unter wegs")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(80)))) for i in range(40)]
    for i, item in enumerate(items):
        filler = " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(400)))
        docs.append((100 + i, f"{filler} -- {(item[1] or '').upper() if i % 2 else item[1]}; {filler}"))
    docs += [(500, None), (501, ""), (502, "!!! ???"), (None, docs[45][1]), (145, docs[45][1])]
    return items, docs, llm.createDataFrame(items, "item_id long, text string"), llm.createDataFrame([(*d, "clash", "x") for d in docs], "doc_id long, text string, hits string, n_words string")


@pytest.mark.parametrize("block", [100_000, 40])
def test_hits_are_those_of_brute_force(case, block):
    items, docs, benchmark, frame = case
    got = judged(scan(frame, benchmark, block=block)).collect()
    pairs = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    items = [("" if i is None else i, t) for i, t in items]
    assert pairs == sorted((str(d), *slow(t, items)) for d, t in docs)


def test_documents_and_spans_are_removed(case, small, llm):
    items, docs, benchmark, frame = case
    bad = {(r.doc_id, r.text) for r in judged(scan(frame, benchmark)).filter("contaminated").collect()}
    kept = without_contaminated(frame, benchmark)
    assert kept.columns == frame.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in frame.collect() if (r.doc_id, r.text) not in bad)
    cut = without_spans(frame, benchmark)
    assert cut.columns == frame.columns and cut.count() == frame.count()
    one = llm.createDataFrame([(1, "Keep this. " + "a b c d e f g h i j k l m n; and this")], "doc_id long, text string")
    item = llm.createDataFrame([(1, "A B C D E F G H I J K L M N")], "item_id long, text string")
    assert without_spans(one, item).first().text == "Keep this. ; and this"


def test_empty_tables(case, nothing):
    _, docs, benchmark, frame = case
    assert scan(nothing, benchmark).collect() == []
    assert judged(scan(frame, benchmark.limit(0))).filter("n_hit > 0").count() == 0
