"""Manifests against a plain tree, level by level."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def levels(nodes):
    """All levels of a tree of three."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def steps(tree, at):
    for level in tree[:-1]:
        start = at - at % 3
        yield "".join(level[start:at]), "".join(level[at + 1 : start + 3])
        at //= 3


def slow(rows, tamper):
    """Per row: doc_id, leaf, subroot, root, proof, folded root, verified."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((leaf(row, row[4]), leaf(row, tamper(row)), row[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
        trees[name] = levels([x[0] for x in groups[name]])
    top = levels([trees[name][-1][0] for name in names])
    for number, name in enumerate(names):
        for at, (own, seen, doc) in enumerate(groups[name]):
            path = [*steps(trees[name], at), *steps(top, number)]
            node = seen
            for left, right in path:
                node = h(left, node, right)
            yield doc, own, trees[name][-1][0], top[-1][0], h(*[a + b for a, b in path]), node, node == top[-1][0]


def tampered(row):
    text = row[4]
    return text.replace("\n", "") if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else text


def table(seed, n):
    rng = random.Random(seed)
    sources = ["hot"] * 5 + ["a", "é", "", "zz", None] if seed else ["only"]
    rows = [(i if rng.random() < 0.97 else None, rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([None, 1, 20_000]),
             rng.choice([None, "", "one\ntwo", "\n\n", f"text {i}", "ü" * 50_000])) for i in range(n)]
    return rows + rows[:3]      # repeated rows


@pytest.mark.parametrize("seed, n, depth", [(0, 0, 2), (0, 1, 6), (0, 9, 2), (1, 40, 1), (2, 200, 2), (3, 200, 6)])
def test_manifest_is_the_plain_tree(llm, seed, n, depth):
    rows = table(seed, n) if n else []
    docs = llm.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, hash string")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle.manifest(docs, tampered=text, depth=depth).collect()
    flat = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got]
    assert sorted(map(str, flat)) == sorted(map(str, slow(rows, tampered)))
    for r in got:
        node = r.leaf
        for step in r.path:
            node = h(step.left, node, step.right)
        assert node == r.root


def test_without_tampering_all_is_verified(small, llm):
    rows = merkle.manifest(small).select("verified", "root").distinct().collect()
    assert len(rows) == 1 and rows[0].verified


def test_any_change_of_a_row_shows(llm):
    docs = llm.createDataFrame([(i, "s", "en", 3, "abc") for i in range(10)], "doc_id long, source string, lang string, n_chars long, text string")
    changed = F.when(F.col("doc_id") == 4, F.lit("abd")).otherwise(F.col("text"))
    assert [r.doc_id for r in merkle.manifest(docs, tampered=changed).collect() if not r.verified] == [4]
