"""Reproducible shuffle into shards: a Feistel permutation of the global row numbers.

Rows are numbered in the order of their key without a gap; the number goes through
a keyed permutation of 0 to n - 1, and the result, modulo and divided by the
number of shards, is shard and slot. Both follow from any row number by
arithmetic, and back. Column functions only.

The permutation works on a grid of a times b cells with a and b next to the square
root of n: rounds add a keyed function of one coordinate to the other. Results of n
and more (fewer than a of them) go through it again until they are below n.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROUNDS = 6
#: A prime below 2 ** 31: products of two remainders fit into a long.
PRIME = 2_147_483_647


def grid(n: int) -> tuple[int, int]:
    """Rows and columns of a nearly square grid with n cells at least."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One number per round from the seed, by a multiplicative congruential rule."""
    keys, state = [], seed % (PRIME - 1) + 1
    for _ in range(rounds):
        state = state * 48_271 % PRIME
        keys.append(state)
    return keys


def mixed(value: str, key: str, size: int) -> str:
    """SQL for a number below ``size``: the high part of a keyed cubic modulo the prime."""
    shifted = f"(({value} + {key}) % {PRIME})"
    square = f"(({shifted} * {shifted} + {key}) % {PRIME})"
    return f"shiftright((({square} * {shifted} + {key}) % {PRIME}) * {size}, 31)"


def permuted(rows: DataFrame, number: str, n: int, seed: int) -> DataFrame:
    """``rows`` with the long column ``number``, 0 to n - 1, permuted."""
    a, b = grid(n)
    keys = round_keys(seed)
    out = rows.withColumns({"__x": F.expr(f"{number} div {b}"), "__y": F.expr(f"{number} % {b}")})
    for at, key in enumerate(keys):
        if at % 2 == 0:
            out = out.withColumn("__x", F.expr(f"(__x + {mixed('__y', f'{key}L', a)}) % {a}"))
        else:
            out = out.withColumn("__y", F.expr(f"(__y + {mixed('__x', f'{key}L', b)}) % {b}"))
    out = out.withColumn(number, F.expr(f"__x * {b} + __y")).drop("__x", "__y")
    spare = a * b - n
    if not spare:
        return out
    # A walk visits each number of n and more once at most, so it ends within that many steps.
    steps = ", ".join(f"named_struct('even', {str(at % 2 == 0).lower()}, 'key', {key}L)" for at, key in enumerate(keys))
    again = (
        f"aggregate(array({steps}), named_struct('x', c div {b}, 'y', c % {b}), (s, k) -> named_struct("
        f"'x', CASE WHEN k.even THEN (s.x + {mixed('s.y', 'k.key', a)}) % {a} ELSE s.x END, "
        f"'y', CASE WHEN k.even THEN s.y ELSE (s.y + {mixed('s.x', 'k.key', b)}) % {b} END), s -> s.x * {b} + s.y)"
    )
    walk = f"aggregate(sequence(1, {spare}), {number}, (c, i) -> CASE WHEN c < {n} THEN c ELSE {again} END)"
    return out.withColumn(number, F.expr(f"CASE WHEN {number} < {n} THEN {number} ELSE {walk} END"))


def place_of(row_number: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number, by the same arithmetic."""
    a, b = grid(n)
    while True:
        x, y = divmod(row_number, b)
        for at, key in enumerate(round_keys(seed)):
            here, size = (y, a) if at % 2 == 0 else (x, b)
            s = (here + key) % PRIME
            high = ((s * s + key) % PRIME * s + key) % PRIME * size >> 31
            x, y = ((x + high) % a, y) if at % 2 == 0 else (x, (y + high) % b)
        row_number = x * b + y
        if row_number < n:
            return row_number % shards, row_number // shards


def row_number_of(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that :func:`place_of` puts there."""
    a, b = grid(n)
    number = slot * shards + shard
    while True:
        x, y = divmod(number, b)
        for at, key in reversed(list(enumerate(round_keys(seed)))):
            here, size = (y, a) if at % 2 == 0 else (x, b)
            s = (here + key) % PRIME
            high = ((s * s + key) % PRIME * s + key) % PRIME * size >> 31
            x, y = ((x - high) % a, y) if at % 2 == 0 else (x, (y - high) % b)
        number = x * b + y
        if number < n:
            return number


def numbered(rows: DataFrame, order: Sequence[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with their position from 0 in ``order`` (nulls first), and how many they are.

    Ranges of the order go to the tasks; the rows of each are counted, and the
    counts of the ranges before are added. Rows that are equal in the order are
    told apart by where they stood, so they are spread over tasks as well.
    """
    plain = written(rows.drop(number))
    placed = plain.withColumn("__at", F.monotonically_increasing_id())
    keys = [*order, "__at"]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = written(
        placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumns({"__range": F.spark_partition_id(), "__inside": inside}).drop("__at")
    )
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so as many as there are shuffle partitions at most.
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    out = ranged.join(F.broadcast(offsets), "__range").withColumn(number, F.col("__before") + F.col("__inside"))
    return out.select(*plain.columns, number), total


def sharded(rows: DataFrame, order: Sequence[str], shards: int, seed: int = 17) -> DataFrame:
    """``rows`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    The same rows, seed and number of shards give the same places, however the
    rows are stored; only rows equal in all of ``order`` may swap theirs. Shards
    differ by one row at most; with fewer rows than shards some are empty.
    """
    placed, total = numbered(rows.drop("shard", "slot"), order, "__number")
    out = permuted(placed, "__number", total, seed)
    return out.withColumns({
        "shard": (F.col("__number") % F.lit(shards)).cast("int"),
        "slot": F.expr(f"__number div {shards}"),
    }).drop("__number")


def write_shards(rows: DataFrame, path: str, order: Sequence[str], shards: int, seed: int = 17) -> None:
    """Parquet files, one folder per shard, sorted by slot within each file."""
    out = sharded(rows, order, shards, seed)
    out.repartition("shard", F.col("slot") % F.lit(16)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
