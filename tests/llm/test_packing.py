"""Pieces against the tokenizer on whole texts; sequences against capacity and bounds."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parlance.llm import catalog
from parlance.llm.packing import WordEncoder, best_fit_decreasing, least_bins, pack, pack_documents, pieces

PATH = catalog.tokenizer("word_bpe_49k.json")


def slow_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for number, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            yield str(doc), number, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_are_those_of_the_tokenizer(odd, small, capacity):
    for docs in (odd, small):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = pieces(docs, PATH, capacity, with_ids=True).collect()
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got) == sorted(slow_pieces(rows, capacity))


def test_letters_with_punctuation_tails():
    """Every letter up to the last plain one, lower and upper case, with several tails."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    with open(PATH, "rb") as file:
        words = WordEncoder(file.read(), 1)
    for code in range(0x21, 0x250):
        for tail in (".", "!!!.", "),", "-", '"', "?!x"):
            text = chr(code) + tail
            assert np.frombuffer(words.encode(text), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def full_check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_sequences_hold_all_pieces(odd, small, nothing):
    for docs in (odd, small):
        packed = pack_documents(docs, PATH).collect()
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(p[:5] for p in slow_pieces(rows, 4096))
        bound = least_bins(np.array([r.length for r in packed]), 4096)
        assert full_check(packed, 4096) <= bound + 1
    assert pack_documents(nothing, PATH).collect() == []


def test_exchange_brings_tasks_close_to_the_bound(llm):
    rng = random.Random(9)
    lengths = [rng.choice([rng.randrange(1, 101), rng.randrange(30, 45), 34, 51]) for _ in range(3000)]
    items = llm.createDataFrame([(i, n, "clash") for i, n in enumerate(lengths)], "doc_id long, length long, sequence_id string")
    once = full_check(pack(items, 100, per_task=300, rounds=0).collect(), 100)
    more = full_check(rows := pack(items, 100, per_task=300).collect(), 100)
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert least_bins(np.array(lengths), 100) <= more <= once


def test_bound_and_fit():
    rng = random.Random(2)
    assert least_bins(np.array([], "int64"), 10) == 0
    assert least_bins(np.array([6, 6, 6]), 10) == 3 and least_bins(np.array([4, 4, 4, 4, 4]), 10) == 3
    for _ in range(200):
        items = np.array([rng.randrange(1, 13) for _ in range(rng.randrange(1, 9))])
        bins, offsets, load = best_fit_decreasing(items, 12)
        assert load.max() <= 12 and load.sum() == items.sum()
        assert least_bins(items, 12) <= fewest(sorted(items.tolist(), reverse=True), 12) <= len(load)


def fewest(items, capacity):
    best = [len(items)]

    def place(at, loads):
        if len(loads) >= best[0]:
            return
        if at == len(items):
            best[0] = len(loads)
            return
        for i in range(len(loads)):
            if loads[i] + items[at] <= capacity:
                place(at + 1, [*loads[:i], loads[i] + items[at], *loads[i + 1 :]])
        place(at + 1, [*loads, items[at]])

    place(0, [])
    return best[0]
