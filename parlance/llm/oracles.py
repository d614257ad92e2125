"""SQL for the results of those queries that SQL can express, written independently of the operators."""

from __future__ import annotations

import string

from .secret_scan import ADDED
from .sharding import PRIME, round_keys

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
    WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
    sized AS (SELECT item, w, least(13, len(w)) AS width FROM items WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, width, array_to_string(w[s:s + width - 1], ' ') AS window_text
                FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS s FROM sized) x),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    runs AS (SELECT r, width, s, array_to_string(w[s:s + width - 1], ' ') AS window_text
             FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS s FROM docs, (SELECT DISTINCT width FROM windows) v) x),
    met AS (SELECT DISTINCT r, s, width, item FROM runs JOIN windows USING (width, window_text)),
    hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + width)) AS p FROM (SELECT DISTINCT r, s, width FROM met) y) z GROUP BY 1),
    found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM met) y GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)"""


def _mixed(value: str, key: int, size: str) -> str:
    s = f"(({value} + {key}) % {PRIME})"
    return f"(((({s} * {s} + {key}) % {PRIME} * {s} + {key}) % {PRIME} * {size}) >> 31)"


def sharding(shards: int = 24, seed: int = 17) -> str:
    """The permutation of the whole grid, a walk over it for each row number, and CRC-32 by its table."""
    rounds, last = [], "r0"
    for at, key in enumerate(round_keys(seed)):
        x, y = (f"(x + {_mixed('y', key, 'a')}) % a", "y") if at % 2 == 0 else ("x", f"(y + {_mixed('x', key, 'b')}) % b")
        rounds.append(f"r{at + 1} AS (SELECT v, a, b, n, {x} AS x, {y} AS y FROM {last})")
        last = f"r{at + 1}"
    return f"""
    WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
                        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    summed AS (SELECT doc_id, len(h) // 2 + 8 AS size,
                      xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                          lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]))) AS text_crc32 FROM bytes, steps),
    numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS number FROM summed),
    one AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM summed) c),
    shape AS (SELECT n, a, (n + a - 1) // a AS b FROM one),
    r0 AS (SELECT v, a, b, n, v // b AS x, v % b AS y FROM (SELECT *, unnest(range(a * b)) AS v FROM shape) g),
    {', '.join(rounds)},
    mapped AS (SELECT v, n, x * b + y AS p FROM {last}),
    walk AS (SELECT v, n, p FROM mapped WHERE v < n UNION ALL SELECT w.v, w.n, m.p FROM walk w JOIN mapped m ON m.v = w.p WHERE w.p >= w.n)
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {shards} AS INT) AS shard, p // {shards} AS slot, CAST(NULL AS INT) AS grown_shard
    FROM numbered JOIN walk ON walk.v = number AND walk.p < walk.n"""


def _framed(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _tree(name: str, leaves: str, levels: int) -> list[str]:
    """Levels of trees over ``leaves`` (tree, i, n, h), and the siblings of every node on each."""
    parts = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        parts.append(f"{name}{k + 1} AS (SELECT tree, i // 3 AS i, n, CASE WHEN n > {3 ** k} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}{k} GROUP BY tree, i // 3, n)")
        parts.append(f"""{name}side{k} AS (SELECT a.tree, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
                     FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.i // 3 = b.i // 3 GROUP BY 1, 2)""")
    return parts


def merkle(levels: int = 10) -> str:
    """Level by level, for up to 3 ** ``levels`` documents a source and as many sources."""
    parts = _tree("d", """SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, leaf AS h FROM leaves""", levels)
    parts += _tree("s", f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h, tree AS member FROM d{levels}", levels)
    parts.append("""f0 AS (SELECT doc_id, tree, leaf, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, '' AS proof, seen AS node FROM leaves)""")
    for k in range(levels):
        parts.append(f"""f{k + 1} AS (SELECT f.* REPLACE (proof || CASE WHEN n > {3 ** k} THEN l || r ELSE '' END AS proof, CASE WHEN n > {3 ** k} THEN sha256(l || node || r) ELSE node END AS node)
                     FROM f{k} f JOIN dside{k} s ON s.tree = f.tree AND s.i = f.i // {3 ** k})""")
    parts.append(f"g0 AS (SELECT f.doc_id, f.leaf, f.proof, f.node, m.h AS subroot, m.i, m.n FROM f{levels} f JOIN s0 m ON m.member = f.tree)")
    for k in range(levels):
        parts.append(f"""g{k + 1} AS (SELECT g.* REPLACE (proof || CASE WHEN n > {3 ** k} THEN l || r ELSE '' END AS proof, CASE WHEN n > {3 ** k} THEN sha256(l || node || r) ELSE node END AS node)
                     FROM g{k} g JOIN sside{k} s ON s.i = g.i // {3 ** k})""")
    head = ", ".join(f"{_framed(c)} AS {c}_" for c in ("doc_id", "source", "lang", "n_chars"))
    return f"""
    WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
                        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    framed AS (SELECT doc_id, text, source, {head}, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM documents),
    summed AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
                      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS crc FROM framed, steps),
    leaves AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree, sha256(doc_id_ || source_ || lang_ || n_chars_ || {_framed('text')}) AS leaf,
                      sha256(doc_id_ || source_ || lang_ || n_chars_ || {_framed("(CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")}) AS seen FROM summed),
    {', '.join(parts)}
    SELECT doc_id, leaf, subroot, s{levels}.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = s{levels}.h AS verified FROM g{levels} JOIN s{levels} ON true"""


NEGATIVES = """
    WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id AS id, c.label, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
          FROM u a JOIN u c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT * FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank,
                 s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own <> s.label AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def secrets() -> str:
    """Matches by splitting: the text between matches and the matches give the places."""
    words = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either_case('api')}_?{_either_case('key')}"
    assign = rf"""(?:{words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""".replace("\\x20", "\x20")
    kinds = [("assign", assign, f"len(regexp_extract(m[k], '{assign}', 1)) >= 8"), ("access", "AKIA[A-Z0-9]+", "len(m[k]) >= 16"), ("hex", "[0-9a-f]{32,}", "true")]
    kinds += [(rule.kind, rule.pattern, "true") for rule in ADDED]
    found = " UNION ALL ".join(f"""SELECT r, '{kind}' AS kind, {number} AS no, unnest(range(1, len(m) + 1)) AS k, m, g FROM
        (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM docs)""" for number, (kind, pattern, _) in enumerate(kinds))
    kept = " ".join(f"WHEN '{kind}' THEN {condition}" for kind, _, condition in kinds)
    line = "kind || ':' || a || ':' || b"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({found}),
    placed AS (SELECT r, kind, no, m, k, CAST(list_sum(list_transform(g[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0) AS BIGINT) AS a FROM found
               WHERE CASE kind {kept} END),
    spans AS (SELECT r, kind, no, a, a + len(m[k]) AS b FROM placed),
    told AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                    string_agg({line}, ',' ORDER BY a, no) FILTER (no < 3) AS base, string_agg({line}, ',' ORDER BY a, no) AS spans FROM spans GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN told USING (r)"""


ORACLES = {
    "op3_decontamination": DECONTAMINATION, "op6_sharding": sharding(), "op11_merkle_manifest": merkle(), "op12_hard_negatives": NEGATIVES,
    "op13_secret_scan": secrets(),
}
