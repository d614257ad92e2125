"""What must not grow with the input: micro-batches, pairs, products, batches, evaluations."""

import random
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parlance.catalog.inputs import Inputs
from parlance.catalog.streams import as_stream
from parlance.functions import numbers as nm
from parlance.functions import text as tx
from parlance.operators import feedback, retrieval
from parlance.streaming import audit as sa

from .test_plans import plan


def test_micro_batches_do_not_grow_with_the_files(spark, tmp_path):
    """A large table has larger micro-batches of several files, in order, and not more of them."""
    rows = spark.range(1000).select("id", F.repeat(F.lit("x"), 10).alias("text"))
    for limit in ({"rows_per_file": 50}, {"bytes_per_file": 500}):
        seen = []
        stream = as_stream(Inputs(spark, ""), rows, "id", **limit)
        query = (stream.writeStream.foreachBatch(lambda df, epoch: seen.append(df.withColumn("f", F.input_file_name()).agg(F.min("id"), F.max("id"), F.count("id"), F.count_distinct("f")).first()))
                 .option("checkpointLocation", str(tmp_path / str(limit))).trigger(availableNow=True).start())
        query.awaitTermination(120)
        assert len(seen) == 4 and sum(r[2] for r in seen) == 1000 and all(r[3] == 5 for r in seen)
        assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def stream_of(spark, folder, schema):
    folder.mkdir()
    return spark.readStream.schema(schema).parquet(str(folder))


KEYS = "workspace_id bigint, destination string, provider string, operation_id string"


def test_consent_and_budget_have_no_pairs_and_few_states(spark, tmp_path):
    requests = stream_of(spark, tmp_path / "r", "id bigint, ts timestamp, " + KEYS)
    grants = stream_of(spark, tmp_path / "g", "granted_at timestamp, expires_at timestamp, " + KEYS)
    assert "Join" not in plan(sa.consented(requests, grants), "simple")
    calls = requests.withColumns({"allowed_calls": F.lit(1), "expires_at": F.col("ts")})
    assert "__part" in plan(sa.admitted_calls(calls), "extended")


def test_intervals_cover_what_their_grants_cover():
    rng = random.Random(5)
    for _ in range(50):
        times = [(a, a + rng.randrange(0, 6)) for a in (rng.randrange(40) for _ in range(rng.randrange(1, 12)))]
        kept = sa.merged(times)
        assert all(a[1] < b[0] for a, b in zip(kept, kept[1:]))
        assert all(sa.within(kept, at) == any(a <= at < b for a, b in times) for at in range(-1, 50))


def test_products_come_in_tiles(monkeypatch):
    """Whatever the cell, a task holds a bounded product; ties, scopes and vectors without a cosine stay right."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float)
    vectors[7] = np.nan
    chunks = pd.DataFrame({"chunk_id": rng.permutation(60), "document_id": np.arange(60) % 5, "embedding": list(vectors)})
    asked = pd.DataFrame({"query_id": np.arange(30), "embedding": list(vectors[10:40]), "scope": [np.array([1, 3]) if i % 3 else None for i in range(30)]})
    monkeypatch.setattr(retrieval, "TILE", 128)
    sizes = [near.size for _, near in retrieval._tiles(vectors, vectors)]
    assert max(sizes) <= 128 and sum(sizes) == 3600
    for pool in (3, 100):
        got = retrieval._cell_hits(pool)(asked, chunks)
        for _, q in asked.iterrows():
            unit = retrieval._unit_rows(chunks["embedding"])
            mine = np.round(1 - unit @ retrieval._unit_rows(pd.Series([q.embedding]))[0], 6) + 0.0
            held = [(np.nan_to_num(x, nan=9.0), c) for x, c, d in zip(mine, chunks.chunk_id, chunks.document_id) if q["scope"] is None or d in q["scope"]]
            rows = got[got.query_id == q.query_id]
            assert list(zip(rows.distance.fillna(9.0), rows.chunk_id)) == sorted(held)[:pool]


def test_citations_move_snippets_not_texts(spark):
    """The texts are cut before they meet the hits, which are read once."""
    hits = spark.createDataFrame([(1, r, 10 + r, r % 2, r / 10) for r in range(1, 5)], "query_id bigint, rank int, chunk_id bigint, document_id bigint, distance double")
    chunks = spark.createDataFrame([(10 + r, "y" * 900 + str(r), f"p{r}") for r in range(1, 4)], "chunk_id bigint, text string, locator string")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "document_id bigint, filename string")
    answers = spark.createDataFrame([(1, True, [9, 3, 4, 3])], "query_id bigint, found boolean, used_context_ids array<int>")
    found = retrieval.resolve_citations(answers, hits, chunks, names)
    assert sorted((r.position, r.chunk_id, len(r.snippet), r.is_fallback) for r in found.collect()) == [(1, 13, 401, False), (3, 13, 401, False)]
    nothing = retrieval.resolve_citations(answers.withColumn("used_context_ids", F.array(F.lit(4))), hits, chunks, names)
    assert [(r.context_id, r.chunk_id, r.filename, r.is_fallback) for r in nothing.collect()] == [(1, 11, "b", True)]
    assert "locator" in plan(found) and "substring" not in plan(found)      # cut, joined and written before


def test_python_batches_are_bounded_by_bytes(spark):
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_means_evaluate_every_score_once(spark):
    assert str(nm.row_mean([F.col("qq"), F.col("rr")])).count("qq") == 1
    rows = [(None, None, None), (0.0, None, None), (1.0, 1.1, None), (9.9, 10.0, 0.3), (0.1, 0.2, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").select(nm.row_mean([F.col(c).cast("decimal(4,1)") for c in "abc"]).alias("m"))
    assert [None if r.m is None else float(r.m) for r in df.collect()] == [None, 0.0, 1.1, 6.7, 0.2]


def test_gap_trend_orders_only_the_middle(spark):
    """The halves are those of the whole order, also where one day holds a workspace or the middle falls between two."""
    rng = random.Random(8)
    rows = [(w, 0 if w == 1 else rng.randrange(6), i, rng.randrange(0, 50) / 10, rng.randrange(0, 50) / 10) for w in range(5) for i in range(3 + 17 * w)]
    rows += [(9, None, i, float(i), 0.0) for i in range(3)] + [(9, 1, 9, 9.0, 0.0), (None, 1, 1, 1.0, 2.0), (4, 1, 1000, None, 2.0)]
    pairs = spark.createDataFrame(rows, "workspace_id int, created_at int, verdict_id int, e double, a double").select(
        "*", F.col("e").cast("decimal(4,1)").alias("e_overall"), F.col("a").cast("decimal(4,1)").alias("a_overall"))
    got = {r.workspace_id: r for r in feedback.gap_trend(pairs, [F.col("created_at"), F.col("verdict_id")]).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 9]
    for w, r in got.items():
        mine = sorted(((-1 if t is None else t, i, abs(round(e * 10) - round(a * 10))) for k, t, i, e, a in rows if k == w and e is not None))
        gaps = [g for *_, g in mine]
        half = len(gaps) // 2
        assert r.n == len(gaps)
        if r.n >= 4:
            assert abs(r.early - sum(gaps[:half]) / half / 10) <= 0.0501 and abs(r.late - sum(gaps[half:]) / (len(gaps) - half) / 10) <= 0.0501


def test_composition_and_languages_skip_plain_letters(spark):
    assert "regexp_replace" in str(tx.nfc(F.col("t"))) and str(tx.block_language(F.col("t"))).count("\\p{L}") == 1
    texts = ["plain words of the text that is long enough", "á ê composed", "é già là perché così più", "ạộ €–’ dấu tiếng Việt có đủ dài", "中文 ̧ç 가가", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.nfc(F.col("t")).alias("n"), tx.block_language(F.col("t")).alias("l"))
    assert [(r.n, r.l) for r in df.collect()] == [(unicodedata.normalize("NFC", t), l) for t, l in zip(texts, ["en", "unknown", "unknown", "vi", "unknown", "unknown"])]
