"""Filtered nearest-neighbour retrieval, diversification and citations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions import text as tx
from ..functions import vectors
from ..functions.sided import on_first_row
from ..session import cut_lineage

# ---- fixed values ----
TOP_K = 10
POOL_FACTOR = 4
POOL_MINIMUM = 24
WEAK_CONTEXT_DISTANCE = 0.75
SNIPPET_CHARS = 400
CONTEXT_SEPARATOR = "\n\n---\n\n"
DISTANCE_DIGITS = 6
# ---- end of fixed values ----

CHUNKS_PER_CELL = 20_000
#: A chunk is shuffled once per block of questions, so these are large blocks; the product is made in tiles.
QUERIES_PER_CELL = 5_000
#: Products that a task holds at a time (eight bytes each, a few copies).
TILE = 1 << 20
#: Bytes of question vectors that one pass over the chunks takes along.
QUESTION_BYTES = 16 << 20


def pool_size(k: int) -> int:
    """Hits fetched before diversification picks ``k`` of them."""
    return max(POOL_FACTOR * k, POOL_MINIMUM)


def normalise(chunks: DataFrame, column: str = "embedding") -> DataFrame:
    return chunks.withColumn(column, vectors.unit(F.col(column)))


def upsert_vectors(current: DataFrame, updates: DataFrame, version: str = "version") -> DataFrame:
    """Last write per chunk_id wins. Both sides have the same columns."""
    rows = current.unionByName(updates)
    others = [c for c in rows.columns if c != "chunk_id"]
    newest = rows.groupBy("chunk_id").agg(
        F.max_by(F.struct(*others), F.col(version)).alias("__row")
    )
    return newest.select("chunk_id", *[F.col(f"__row.{c}").alias(c) for c in others])


def _unit_rows(column: pd.Series) -> np.ndarray:
    matrix = np.stack(column.to_numpy()).astype(np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def _best(near: np.ndarray, scopes: Sequence, ids: np.ndarray, documents: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, chunk, distance) of the ``pool`` nearest chunks per row of a tile, as places; changes the tile.

    near: cosines, minus infinity where a chunk does not count. Without a cosine a
    chunk is behind all others. Equal distances are ordered by id. Only what
    rounding can bring among the first is rounded and sorted.
    """
    near[np.isnan(near)] = -2.0
    for row, scope in enumerate(scopes):
        if scope is not None:
            near[row, ~np.isin(documents, scope)] = -np.inf
    counts = near > -np.inf
    if near.shape[1] > pool:
        last = np.partition(near, -pool, axis=1)[:, -pool]
        counts &= near >= (last - 2 * 10.0 ** -DISTANCE_DIGITS)[:, None]
    row, column = np.nonzero(counts)
    distance = np.round(1.0 - near[row, column], DISTANCE_DIGITS) + 0.0
    order = np.lexsort((ids[column], distance, row))
    row, column, distance = row[order], column[order], distance[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < pool
    return row[first], column[first], np.where(distance[first] == 3.0, np.nan, distance[first])


def _tiles(asked: np.ndarray, chunks: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Cosines of some rows of ``asked`` with all rows of ``chunks``, a bounded number at a time."""
    step = max(1, TILE // max(1, len(chunks)))
    for at in range(0, len(asked), step):
        yield slice(at, at + step), asked[at:at + step] @ chunks.T


def _cell_hits(pool: int):
    """Best ``pool`` chunks of one cell for each query of that cell."""

    def hits(queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "chunk_id", "document_id", "distance"]
        if queries.empty or chunks.empty:
            return pd.DataFrame(columns=columns)
        ids, documents, scopes = chunks["chunk_id"].to_numpy(), chunks["document_id"].to_numpy(), queries["scope"].to_numpy()
        met = []
        for rows, near in _tiles(_unit_rows(queries["embedding"]), _unit_rows(chunks["embedding"])):
            row, column, distance = _best(near, scopes[rows], ids, documents, pool)
            met.append((row + rows.start, column, distance))
        row, column, distance = (np.concatenate(part) for part in zip(*met))
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[row], "chunk_id": ids[column],
                             "document_id": documents[column], "distance": distance})

    return hits


def _cells(df: DataFrame, keys: Sequence[str], rows_per_cell: int) -> DataFrame:
    """How many cells each key needs so that a cell stays below a row count."""
    return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_cell).cast("int").alias("__n"))


def cell_topk(
    queries: DataFrame,
    chunks: DataFrame,
    pool: int,
    keys: Sequence[str] = ("workspace_id",),
    chunks_per_cell: int = CHUNKS_PER_CELL,
    queries_per_cell: int = QUERIES_PER_CELL,
) -> DataFrame:
    """Per cell and query the ``pool`` nearest chunks with equal ``keys``.

    Both sides of a key are cut into blocks of bounded size by a hash of their
    id, and every (query block, chunk block) is one task-sized cell: a matrix
    product that returns at most ``pool`` rows per query. No pair of rows is
    ever shuffled, nothing is broadcast, and a workspace with a third of all
    chunks only has more cells.
    """
    keys = list(keys)
    query_cells = _cells(queries, keys, queries_per_cell).withColumnRenamed("__n", "__nq")
    chunk_cells = _cells(chunks, keys, chunks_per_cell).withColumnRenamed("__n", "__nc")
    shape = query_cells.join(chunk_cells, keys)

    def blocked(df: DataFrame, id_column: str, own: str, other: str, own_n: str, other_n: str) -> DataFrame:
        return (
            df.join(shape, keys)
            .withColumn(own, F.pmod(F.xxhash64(id_column), F.col(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
            .drop("__nq", "__nc")
        )

    # own column identities: questions may be selected from the chunks themselves
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    if "scope" not in queries.columns:
        queries = queries.withColumn("scope", F.lit(None).cast("array<bigint>"))
    left = blocked(queries.select(*keys, "query_id", "embedding", "scope"),
                   "query_id", "__q", "__c", "__nq", "__nc")
    right = blocked(chunks.select(*keys, "chunk_id", "document_id", "embedding"),
                    "chunk_id", "__c", "__q", "__nc", "__nq")
    cell = [*keys, "__q", "__c"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
        _cell_hits(pool), "query_id bigint, chunk_id bigint, document_id bigint, distance double"
    )


def nearest(queries: DataFrame, chunks: DataFrame, k: int, **cells) -> DataFrame:
    """Exact cosine top-k: (query_id, rank, chunk_id, document_id, distance).

    queries: query_id, workspace_id, embedding and optionally scope (array of
    the only document ids wanted). Equal distances are ordered by chunk_id.
    """
    order = [F.col("distance"), F.col("chunk_id")]
    return ordered.first_per_key(cell_topk(queries, chunks, k, **cells), ["query_id"], order, k)


def nearest_by_pass(questions: DataFrame, chunks: DataFrame, k: int, blocks: int = 1) -> DataFrame:
    """Like :func:`nearest`, for questions that fit into broadcast blocks: chunks stay where they are.

    The questions of a block (QUESTION_BYTES at most; with more of them
    ``blocks`` must grow, or the query stops) ride on the first row of every
    partition of the chunks. One pass over the chunk files multiplies batches
    with the block and keeps k chunks per question; only those are shuffled.
    """
    if "scope" not in questions.columns:
        questions = questions.withColumn("scope", F.lit(None).cast("array<bigint>"))
    asked = questions.filter(F.col("workspace_id").isNotNull()).select("query_id", "workspace_id", F.col("embedding").cast("array<double>").alias("embedding"), "scope")
    held = chunks.select("workspace_id", "chunk_id", "document_id", "embedding")
    fits = F.sum(8 * (F.size("embedding") + F.greatest(F.size("scope"), F.lit(0)))) <= QUESTION_BYTES
    parts = []
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        rows = F.collect_list(F.struct(*asked.columns))
        single = mine.agg(F.when(F.coalesce(fits, F.lit(True)), rows).otherwise(
            F.raise_error(F.lit("questions of a block exceed its bytes: raise blocks"))).alias("__asked"))
        parts.append(on_first_row(held, single).mapInArrow(_pass(k), "query_id bigint, chunk_id bigint, document_id bigint, distance double"))
    return ordered.first_per_key(reduce(DataFrame.unionByName, parts), ["query_id"], [F.col("distance"), F.col("chunk_id")], k)


def _pass(k: int):
    """Nearest ``k`` chunks of a partition for each question on its first row."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = None, None
        for batch in batches:
            if batch.num_rows and batch.column(4)[0].is_valid:
                rows = batch.column(4)[0].values
                asked = rows.field("query_id").to_numpy(zero_copy_only=False), rows.field("workspace_id").to_numpy(zero_copy_only=False), \
                    _unit_rows(rows.field("embedding").to_pandas()) if len(rows) else None, np.array([*rows.field("scope").to_pylist(), None], object)[:-1]
                best = tuple(np.zeros(0, kind) for kind in ("int64", "float64", "int64", "int64"))
            if not asked or not len(asked[0]) or not batch.num_rows:
                continue
            workspace, chunk, document = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            met = [best]
            for rows, near in _tiles(asked[2], _unit_rows(batch.column(3).to_pandas())):
                near[~(asked[1][rows, None] == workspace[None, :]) | np.isnan(near)] = -np.inf
                row, column, distance = _best(near, asked[3][rows], chunk, document, k)
                met.append((row + rows.start, distance, chunk[column], document[column]))
            met = [np.concatenate(part) for part in zip(*met)]
            order = np.lexsort((met[2], met[1], met[0]))
            met = [m[order] for m in met]
            best = tuple(m[np.arange(len(order)) - np.searchsorted(met[0], met[0]) < k] for m in met)
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked[0].astype("int64")[best[0]]), pa.array(best[2].astype("int64")), pa.array(best[3].astype("int64")), pa.array(best[1])],
                names=["query_id", "chunk_id", "document_id", "distance"])

    return hits


def round_robin(hits: DataFrame, k: int) -> DataFrame:
    """k hits per query, taking each document's best before any second best.

    hits is the bounded pool of :func:`nearest`. Documents come in the order of
    their best hit; the result is ranked by distance again.
    """
    by_document = Window.partitionBy("query_id", "document_id").orderBy("distance", "chunk_id")
    turn = Window.partitionBy("query_id").orderBy("depth", "best", "document_id")
    final = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return (
        hits.drop("rank")
        .withColumn("depth", F.row_number().over(by_document))
        .withColumn("best", F.first("distance").over(by_document))
        .withColumn("turn", F.row_number().over(turn))
        .filter(F.col("turn") <= k)
        .withColumn("rank", F.row_number().over(final))
        .select("query_id", "rank", "chunk_id", "document_id", "distance")
    )


def search(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, **cells) -> DataFrame:
    """Over-fetch, then diversify by document."""
    return round_robin(nearest(queries, chunks, pool_size(k), **cells), k)


# ------------------------------------------------------------------ approximate search


def _signature(planes: np.ndarray):
    @F.pandas_udf("array<int>")
    def signatures(embeddings: pd.Series) -> pd.Series:
        sides = (_unit_rows(embeddings) @ planes.reshape(-1, planes.shape[-1]).T) > 0
        bits = sides.reshape(len(embeddings), planes.shape[0], planes.shape[1])
        codes = bits @ (1 << np.arange(planes.shape[1]))
        return pd.Series(list(codes.astype(np.int32)))

    return signatures


def nearest_approximate(
    queries: DataFrame, chunks: DataFrame, k: int, dimensions: int,
    tables: int = 16, planes: int = 4, seed: int = 17, **cells,
) -> DataFrame:
    """Like :func:`nearest`, but only chunks that share a random-plane bucket are compared.

    Each of ``tables`` hash tables splits the space with ``planes`` hyperplanes:
    more planes compare less, more tables find more. A crowded bucket is cut
    into cells like everything else.
    """
    normals = np.random.default_rng(seed).standard_normal((tables, planes, dimensions))
    signature = _signature(normals)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("__codes", signature(F.col("embedding"))).select(
            *df.columns, F.posexplode("__codes").alias("__table", "__code")
        )

    candidates = cell_topk(
        bucketed(queries), bucketed(chunks), k, ("workspace_id", "__table", "__code"), **cells
    ).dropDuplicates(["query_id", "chunk_id"])
    return ordered.first_per_key(candidates, ["query_id"], [F.col("distance"), F.col("chunk_id")], k)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, in one row."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("__found"))
    return exact.join(found, ["query_id", "chunk_id"], "left").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("__found").alias("n_found"),
        F.round(F.count("__found") / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("recall"),
    )


# ------------------------------------------------------------------ context and citations


def hit_chunks(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Text, place and file name of each hit; hits without a chunk disappear.

    chunks: chunk_id, text, locator, document_id. documents: document_id, filename.
    """
    body = chunks.select("chunk_id", "text", "locator")
    names = documents.select("document_id", "filename")
    # The texts last: they are moved once.
    others = [c for c in hits.columns if c not in ("document_id", "chunk_id")]
    return hits.join(names, "document_id").join(body, "chunk_id").select("document_id", "chunk_id", *others, "text", "locator", "filename")


def context_blocks(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One numbered context text per query.

    Numbers count all hits, so a hit whose chunk is gone leaves a gap. At most k
    rows meet per query.
    """
    block = F.concat(
        F.lit("[Đoạn "), F.col("rank").cast("string"), F.lit("] (tệp: "), F.col("filename"),
        F.lit(" · "), F.col("locator"), F.lit(")\n"), F.col("text"),
    )
    found = hit_chunks(hits, chunks, documents).withColumn("__block", block)
    gathered = F.sort_array(F.collect_list(F.struct("rank", "__block")))
    return found.groupBy("query_id").agg(
        F.array_join(F.transform(gathered, lambda b: b["__block"]), CONTEXT_SEPARATOR).alias("context"),
        F.count(F.lit(1)).alias("n_context"),
    )


def context_quality(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: best distance and ``not_found`` / ``weak`` / ``ok``."""
    best = hits.groupBy("query_id").agg(F.min("distance").alias("best_distance"))
    return queries.select("query_id").join(best, "query_id", "left").withColumn(
        "context_state",
        F.when(F.col("best_distance").isNull(), "not_found")
        .when(F.col("best_distance") > WEAK_CONTEXT_DISTANCE, "weak")
        .otherwise("ok"),
    )


def resolve_citations(answers: DataFrame, hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Context numbers used by an answer, resolved to chunks.

    answers: query_id, found, used_context_ids (array). Numbers that do not
    exist are dropped, order and repeats are kept. An answer that was found but
    cites nothing valid gets its nearest hit, flagged ``is_fallback``.

    Texts are cut to snippets before they meet the hits, and what the hits of a
    query show is written once, as citations and fallback read it.
    """
    short = chunks.withColumn("text", tx.excerpt(F.col("text"), SNIPPET_CHARS))
    context = cut_lineage(hit_chunks(hits, short, documents).select(
        "query_id", F.col("rank").alias("context_id"), "chunk_id", "document_id", "filename", "locator", F.col("text").alias("snippet")))
    cited = (
        answers.select("query_id", F.posexplode("used_context_ids").alias("position", "context_id"))
        .join(context, ["query_id", "context_id"])
        .withColumn("is_fallback", F.lit(False))
    )
    without = answers.filter("found").select("query_id").join(cited.select("query_id"), "query_id", "left_anti")
    nearest_hit = context.groupBy("query_id").agg(
        F.min_by(F.struct("context_id", "chunk_id", "document_id", "filename", "locator", "snippet"),
                 F.col("context_id")).alias("__hit")
    )
    fallback = without.join(nearest_hit, "query_id").select(
        "query_id", F.col("__hit.context_id").alias("context_id"), F.lit(0).alias("position"),
        "__hit.chunk_id", "__hit.document_id", "__hit.filename", "__hit.locator", "__hit.snippet",
        F.lit(True).alias("is_fallback"),
    )
    return cited.unionByName(fallback)


def answer_state(answers: DataFrame) -> DataFrame:
    """Shown confidence, and whether an inferential answer misses its inference part."""
    return answers.select(
        "query_id",
        F.when(F.col("found"), F.col("confidence")).otherwise("not_found").alias("confidence"),
        (F.col("is_inferential") & tx.blank(F.col("inference"))).alias("inference_missing"),
        F.nullif(tx.strip(F.coalesce("inference", F.lit(""))), F.lit("")).alias("inference_part"),
    )


def history(answers: DataFrame, limit: int = 50) -> DataFrame:
    """Newest answers per workspace."""
    return ordered.first_per_key(
        answers, ["workspace_id"], [F.col("created_at").desc(), F.col("id").desc()], limit
    )


def vector_counts(chunks: DataFrame) -> DataFrame:
    """Vectors per workspace and, with a NULL workspace, in total."""
    return chunks.rollup("workspace_id").agg(F.count(F.lit(1)).alias("n_vectors"))
