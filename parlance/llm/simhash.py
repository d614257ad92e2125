"""SimHash near copies: fingerprints, links by pigeonring filtering, components.

Links are searched among the different fingerprints, so exact copies cost
nothing. The 64 bits are a ring of segments. If two fingerprints differ in at
most ``distance`` bits, some segment starts a chain in which, for every length,
the differences stay within that length's share of the distance. With five
segments and two bits the first two segments of such a chain are equal: they are
the join key. The shares for longer chains prune what the key proposes before
the distance itself is checked.

Keys that many fingerprints share are not joined pair by pair. Their fingerprints
are filed once per way in which they may still differ (the differing bits
blanked): what meets in such a file is linked, so one link per fingerprint and
file is enough, and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

SEGMENTS = 5
#: Keys with more fingerprints are filed by their possible differences.
PAIRED = 128
SHIFTS = np.arange(64, dtype="uint64")


def fingerprint(text: str | None, width: int = 3, seed: int = 42, part: int = 1 << 16) -> int:
    """The bits that are set in more than half of the hashes of the word runs; 0 without a word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, "int64")
    for start in range(0, n, part):
        size = min(part, n - start)
        runs = map(b" ".join, zip(*(words[start + j : start + j + size] for j in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(run, seed) for run in runs), "<u8", size)
        bits = np.unpackbits(hashes.view("uint8").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype="int64")
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with the column bits, the fingerprint as a signed long.

    ASCII letters count in lower case; words end at ASCII white space; a text of
    fewer words than ``width`` is one run; null, empty and blank texts have 0.
    """

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(one, width) for one in texts), "uint64", len(texts))
        return pd.Series(found.view("int64"))

    return docs.withColumn("bits", bits.asNondeterministic()(F.col(text)))


def ring(segments: int = SEGMENTS) -> list[int]:
    """Bit masks of the segments, as unsigned numbers; sizes differ by one at most."""
    borders = [64 * i // segments for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(borders, borders[1:])]


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def chain(start: int, length: int, masks: list[int]) -> int:
    return sum(masks[(start + j) % len(masks)] for j in range(length))


def exact_length(segments: int, distance: int) -> int:
    """Leading segments of a chain whose share of the distance is below one bit."""
    return max(length for length in range(segments + 1) if length * distance < segments)


def within_shares(difference: Column, start: int, distance: int, masks: list[int]) -> Column:
    """The chain from ``start``: differences of its first l segments are l shares of the distance at most."""
    tests = [
        F.bit_count(difference.bitwiseAND(F.lit(signed(chain(start, length, masks))))) <= F.lit(length * distance // len(masks))
        for length in range(exact_length(len(masks), distance) + 1, len(masks) + 1)
    ]
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def blanks(start: int, distance: int, masks: list[int]) -> list[int]:
    """Every largest set of bits, as a mask, in which a chain from ``start`` may differ."""
    first = exact_length(len(masks), distance)
    free = [(bit, position) for position in range(first, len(masks)) for bit in _bits(masks[(start + position) % len(masks)])]
    out = []
    for chosen in combinations(free, distance):
        if all(sum(place < length for _, place in chosen) <= length * distance // len(masks) for length in range(1, len(masks) + 1)):
            out.append(sum(1 << bit for bit, _ in chosen))
    return out


def _bits(mask: int) -> list[int]:
    return [i for i in range(64) if mask >> i & 1]


def links(fingerprints: DataFrame, distance: int = 2, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) between different fingerprints (column bits, each once).

    Every two within ``distance`` bits are linked directly or, where more than
    ``paired`` share a key, through fingerprints that are themselves within it.
    More segments make longer keys: seven give 27 bits instead of 25.
    """
    if distance < 1:
        return fingerprints.select(F.col("bits").alias("a"), F.col("bits").alias("b")).limit(0)
    masks = ring(segments)
    first = exact_length(segments, distance)
    keys = F.array(*[
        F.struct(F.lit(start).cast("int").alias("start"), F.col("bits").bitwiseAND(F.lit(signed(chain(start, first, masks)))).alias("key"))
        for start in range(segments)
    ])
    filed = fingerprints.select("bits", F.inline(keys))
    shared = filed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written(filed.join(shared, ["start", "key"]))

    few = met.filter(F.col("n") <= paired)
    left, right = few.select("start", "key", F.col("bits").alias("a")), few.select("start", "key", F.col("bits").alias("b"))
    difference = F.col("a").bitwiseXOR(F.col("b"))
    shares = F.lit(False)
    for start in range(segments):
        shares = shares | ((F.col("start") == start) & within_shares(difference, start, distance, masks))
    pairs = (
        left.join(right, ["start", "key"])
        .filter((F.col("a") < F.col("b")) & shares & (F.bit_count(difference) <= distance))
        .select("a", "b")
    )

    many = met.filter(F.col("n") > paired)
    ways = T.ArrayType(T.LongType())

    @F.pandas_udf(ways)
    def blanked(starts: pd.Series, bits: pd.Series) -> pd.Series:
        keep = [np.array([signed(~mask & (1 << 64) - 1) for mask in blanks(start, distance, masks)], "int64") for start in range(segments)]
        return pd.Series([keep[start] & one for start, one in zip(starts, bits.to_numpy())])

    files = many.select("start", "bits", F.posexplode(blanked("start", "bits")).alias("way", "rest"))
    least = files.groupBy("start", "way", "rest").agg(F.min("bits").alias("a"), F.max("bits").alias("most")).filter("a < most")
    through = (
        files.join(least, ["start", "way", "rest"]).filter("bits > a").select("a", F.col("bits").alias("b"))
    )
    return pairs.unionByName(through).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node of its component.

    Alternating star contractions: every node sends its larger neighbours, then
    its smaller ones, to the least node it knows. Each round is written, the number
    of rounds grows with the logarithm of the longest path, and nothing but a
    digest of the links comes to the driver.
    """
    current = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b"))
    before = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("b < a")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
            .filter("a < b").distinct()
        )
        current = written(small)
        digest = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if digest == before:
            break
        before = digest
    else:
        raise RuntimeError("links did not settle; raise rounds")
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("root"))
    ).distinct()


def classes(rows: DataFrame, key: str, distance: int = 2, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """(bits, component): the least ``key`` of all rows whose fingerprint is linked, for every fingerprint.

    Null keys count only if a component has no other.
    """
    own = written(rows.groupBy("bits").agg(F.min(key).alias("least")))
    linked = components(links(own.select("bits"), distance, segments, paired))
    roots = own.join(linked, own["bits"] == linked["node"], "left").select(
        "bits", F.coalesce("root", "bits").alias("root"), "least"
    )
    per_root = roots.groupBy("root").agg(F.min("least").alias("component"))
    return roots.join(per_root, "root").select("bits", "component")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 2, width: int = 3,
                segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """(key, fingerprint, component_id), one row per row of ``docs``.

    The fingerprint is 16 lower-case hex digits. component_id is the least key
    reachable over links. Documents without words have the fingerprint zero and
    are linked like any other.
    """
    rows = written(with_fingerprint(docs.select(key, text), text, width).select(key, "bits"))
    found = classes(rows, key, distance, segments, paired)
    return rows.join(found, "bits").select(
        key, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with its least key.

    Rows that share key and text are copies of each other and count as one. If the
    same key stands for several texts of a component, the least hash of the text decides.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.octet_length(F.coalesce(F.col(text), F.lit(""))))
    width = options.pop("width", 3)
    rows = written(
        with_fingerprint(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", width)
        .select(F.struct(F.col("id").isNull().alias("last"), "id", F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit("")))).alias("digest")).alias("row"), "bits")
    )
    kept = classes(rows, "row", **options).select("component.id", "component.digest").distinct()
    marked = docs.withColumn("__digest", digest)
    chosen = marked.join(kept, marked[key].eqNullSafe(kept["id"]) & (marked["__digest"] == kept["digest"]), "left_semi")
    return chosen.dropDuplicates([key, "__digest"]).drop("__digest")
