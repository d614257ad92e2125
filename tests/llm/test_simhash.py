"""Fingerprints, links and components against brute force."""

import random

import pytest
import xxhash

from parlance.llm.simhash import blanks, components, fingerprint, links, near_copies, one_of_each, ring, signed


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(run, seed=42).intdigest() for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(marks, distance=2):
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for a in marks:
        for b in marks:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {m: find(m) for m in marks}


def planted(seed, hot):
    """Groups of fingerprints a few bits apart, one of them large, chains and loners."""
    rng, out = random.Random(seed), set()
    for size in (hot, 5, 9, 2, 2, 30):
        base = rng.getrandbits(64)
        for _ in range(size):
            mark = base
            for _ in range(rng.randrange(4)):
                mark ^= 1 << rng.randrange(64)
            out.add(signed(mark))
            if rng.random() < 0.3:
                base = mark
    return sorted(out | {signed(rng.getrandbits(64)) for _ in range(40)} | {0, -1, 1, 3})


@pytest.mark.parametrize("paired,segments", [(128, 5), (3, 5), (3, 7), (1, 3)])
def test_components_lose_no_link(llm, paired, segments):
    marks = planted(paired + segments, 150)
    frame = llm.createDataFrame([(m,) for m in marks], "bits long")
    edges = links(frame, segments=segments, paired=paired)
    for a, b in edges.collect():
        assert a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    found = dict(components(edges).collect())
    assert {m: found.get(m, m) for m in marks} == slow_components(marks)


def test_every_difference_of_two_bits_is_in_a_blank():
    masks = ring(5)
    assert sum(bin(m).count("1") for m in masks) == 64 and len({b for m in masks for b in range(64) if m >> b & 1}) == 64
    covers = [blanks(start, 2, masks) for start in range(5)]
    rng = random.Random(1)
    for _ in range(300):
        difference = 1 << rng.randrange(64) | 1 << rng.randrange(64)
        assert any(difference & ~cover == 0 for file in covers for cover in file)


def test_fingerprints(odd_rows):
    for row in odd_rows:
        if row[1] is None or len(row[1]) < 20_000:
            assert fingerprint(row[1]) == slow_fingerprint(row[1])
    long = " ".join(map(str, range(3000)))
    assert fingerprint(long, part=64) == slow_fingerprint(long)


def test_long_chain_of_links(llm):
    marks, edges = list(range(400)), [(i, i + 1) for i in range(399)]
    assert set(components(llm.createDataFrame(edges, "a long, b long")).collect()) == {(m, 0) for m in marks}


def test_near_copies_on_documents(small, odd, nothing):
    for docs in (small, odd):
        rows = docs.select("doc_id", "text").collect()
        marks = [signed(fingerprint(r.text)) for r in rows]
        root = slow_components(sorted(set(marks)))
        least = {}
        for r, m in zip(rows, marks):
            if r.doc_id is not None:
                least[root[m]] = min(least.get(root[m], r.doc_id), r.doc_id)
        want = sorted((str(r.doc_id), f"{m & (1 << 64) - 1:016x}", least.get(root[m])) for r, m in zip(rows, marks))
        assert sorted((str(a), b, c) for a, b, c in near_copies(docs).collect()) == want
    assert near_copies(nothing).collect() == []


def test_one_of_each_group_stays(llm, odd, small):
    kept = one_of_each(small)
    assert kept.columns == small.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in near_copies(small).collect()}
    assert kept.count() == len({r.component_id for r in near_copies(small).collect()})
    rows = one_of_each(odd).collect()
    assert len([r for r in rows if not (r.text or "").split()]) == 1
    twice = llm.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "x y z w"), (None, "x y z w"), (8, "A B c d")], "doc_id long, text string")
    assert sorted(map(str, one_of_each(twice).collect())) == sorted(map(str, [*twice.limit(1).collect(), *twice.filter("doc_id is null").limit(1).collect()]))
