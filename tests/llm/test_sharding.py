"""Permutation, numbering and places."""

import pytest
from pyspark.sql import functions as F

from parlance.llm.sharding import numbered, permuted, place_of, row_number_of, sharded


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000, 4097])
def test_permutation_is_one_to_one_and_computable(llm, n):
    rows = permuted(llm.range(n).withColumn("p", F.col("id")), "p", n, seed=17).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    for r in rows:
        assert (r.p % 7, r.p // 7) == place_of(r.id, n, 7, 17)
        assert row_number_of(r.p % 7, r.p // 7, n, 7, 17) == r.id
    if n > 900:
        assert sum(abs(r.p - r.id) for r in rows) > n * n / 6


def test_numbers_follow_the_order_and_have_no_gap(llm, odd):
    rows, n = numbered(odd.select("doc_id", "text"), ["doc_id", "text"])
    got = sorted(rows.collect(), key=lambda r: r.row_number)
    assert [r.row_number for r in got] == list(range(n)) and n == odd.count()
    assert [r.doc_id for r in got] == [None, None, *sorted(r.doc_id for r in got[2:])]


def test_shards_are_even_gapless_and_reproducible(llm, small, nothing):
    docs = small.select("doc_id", F.lit("x").alias("shard"), F.lit(1.5).alias("slot"))
    rows = sharded(docs, ["doc_id"], 24).collect()
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(24)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    again = sharded(docs.repartition(13), ["doc_id"], 24).collect()
    assert sorted(rows) == sorted(again)
    assert sharded(nothing.select("doc_id"), ["doc_id"], 24).collect() == []


def test_one_key_with_all_rows(llm):
    rows = sharded(llm.range(500).select(F.lit(None).cast("long").alias("doc_id")), ["doc_id"], 24).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((p % 24, p // 24) for p in range(500))
