"""Trigram queries, the index, and spans against a full scan with the rules as written."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import catalog
from parlance.llm.secret_scan import ADDED, BASE, Rule, found_in, redacted, scanned, trigram_query, trigrams_of

WRITTEN = {
    "assign": (re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32),
}
WRITTEN |= {rule.kind: (re.compile(rule.pattern), 0, 0) for rule in ADDED}
KINDS = list(WRITTEN)


def slow(text):
    found = []
    for kind, (pattern, group, least) in WRITTEN.items():
        found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found)


def texts():
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "toKen", "API_KEY", "apikey", "paſſword", "toKen", " : ", "=", "='", '"', "'", "   ", "abcdefgh", "x1/y.z=-", "AKIA",
             "ABCDEFGH1234", "AKIAAKIA", "0123456789abcdef", "deadbeef" * 4, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-12345-abcde",
             "AIza" + "x" * 35, "://user:pw@host", "ü", "日本", "\n", " ", "é" * 3, "\x00"]
    out = [None, "", " ", "token", "secret=token: abcdefgh1234", "AKIA" + "A" * 100_000, "a" * 300_000, "token=" + "a" * 200_000, "token" * 20_000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]


def test_spans_are_those_of_a_full_scan():
    column = pa.array(texts())
    for part in (column, column.slice(7, 300), column.slice(0, 0)):
        assert found_in(part, BASE + ADDED) == [slow(t) for t in part.to_pylist()]


@pytest.mark.parametrize("pattern, query", [
    ("abc+d", "abc"), ("a.b", None), ("x*abc", "abc"), ("(abc|de)f", ("or", ("def", ("and", ("abc", "bcf"))))), ("ab[cd]", ("or", ("abc", "abd"))),
    ("(foo|bar)+baz", ("and", (("or", ("bar", "foo")), "baz"))), ("[0-9a-f]{32,}", None), ("a{3}b", ("and", ("aaa", "aab"))), ("(?i)ABC", None),
    ("(?ai:ABC)", "abc"), ("abcx?", "abc"), ("(abc|d*)", None), ("^abc$", "abc"), ("abc(?=def)", "abc"),
])
def test_queries(pattern, query):
    assert trigram_query(pattern) == query


def test_every_match_satisfies_its_query():
    """Random patterns over few letters: a text with a match must be a candidate."""
    rng = random.Random(11)

    def make(depth):
        if depth == 0:
            return rng.choice(["a", "b", "c", "ab", "[ab]", ".", "abc", "[a-c]", "É"])
        a, b = make(depth - 1), make(depth - 1)
        return rng.choice([a + b, f"(?:{a}|{b})", f"(?:{a})?{b}", f"(?:{a})+{b}", f"{a}(?:{b})*", f"(?:{a}){{2}}", f"({a}){b}"])

    for _ in range(300):
        pattern = make(3)
        strings = ["".join(rng.choice("aabbcABÉ ") for _ in range(rng.randrange(0, 14))) for _ in range(40)]
        rule = Rule("x", pattern)
        got = found_in(pa.array(strings), [rule])
        assert [bool(g) for g in got] == [bool([m for m in re.finditer(pattern, s)]) for s in strings], pattern


def test_index_asks_only_for_trigrams_of_rules():
    assert trigrams_of(trigram_query(BASE[1].pattern)) == {"aki", "kia"}
    assert trigram_query(BASE[2].pattern) is None       # scans all texts


def test_rows_stay(odd, nothing):
    rows = scanned(odd.withColumn("found", F.lit("clash"))).collect()
    assert len(rows) == odd.count() and scanned(nothing).collect() == []


def test_values_and_redaction(llm):
    docs = llm.createDataFrame([(1, "é token = abcdefgh9 AKIAABCDEFGH1234 end"), (1, "nothing"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.found for r in scanned(docs).collect() if r.found}
    assert [(f.kind, f.start, f.value) for f in got[1]] == [("assign", 2, "token = abcdefgh9"), ("access", 20, "AKIAABCDEFGH1234")]
    assert redacted("é token = abcdefgh9 AKIAABCDEFGH1234 end", [(f.start, f.end) for f in got[1]]) == "é [SECRET] [SECRET] end"


def test_query_on_given_table(llm, small):
    got = {r.doc_id: r for r in catalog.queries()["op13_secret_scan"](llm, "/root/testdata/sf0.001").collect()}
    for r in small.collect():
        spans = slow(r.text)
        assert got[r.doc_id].spans == ",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in spans)
        assert got[r.doc_id].n_hex == sum(n == 2 for _, n, _ in spans)
