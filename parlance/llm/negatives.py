"""Hard negatives by exact scores, with the method of the Four Russians.

Components become integers and are stored as bit planes: one byte holds one bit of
eight dimensions. For an anchor and a group of eight dimensions a table has the sums
of all 256 subsets of the anchor's components, so a candidate's byte finds the
product of its bits with the anchor in one lookup. Lookups of a plane are added,
planes are shifted and added: that is the whole integer inner product.

Anchors go to the tasks in blocks of a bounded number; each block passes all
candidates twice. The first pass finds the positives of every anchor, the second the
best negatives inside the window that each positive opens. A task keeps a few rows
per anchor, and those of all tasks are merged per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered
from ..session import run_dir
from .common import dealt, written

#: Anchors per pass, vectors per chunk, anchors whose tables stand in a processor's cache together.
ANCHORS, CHUNK, TABLES = 4096, 2048, 256
#: Scores stay below this, so that comparisons of their multiples fit into a long.
LARGEST = 1 << 56
CHUNKS = "size int, dims int, planes int, ids binary, labels binary, bits binary"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def integers(column: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of floor(scale * x) and which rows count: those without a null or non-finite component.

    Shorter vectors are filled up with zeros. Components beyond what keeps a score
    below LARGEST are held at that bound.
    """
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype("float64") if len(flat) else np.zeros(0)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = np.asarray(column.is_valid()).copy()
    good[row[~np.isfinite(values)]] = False
    dims = int(lengths.max(initial=0))
    bound = int((LARGEST / max(dims, 1)) ** 0.5)
    out = np.zeros((len(lengths), dims), "int64")
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.clip(np.floor(values * scale), -bound, bound)
    out[row, np.arange(len(row)) - starts[row]] = np.where(np.isfinite(scaled), scaled, 0).astype("int64")
    return out, good


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """Bytes (plane, group, vector) of two's complement numbers; the last plane is that of the sign."""
    n, dims = vectors.shape
    groups = -(-dims // 8)
    low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
    planes = 1 + max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0)
    filled = np.zeros((n, groups * 8), "int64")
    filled[:, :dims] = vectors
    out = np.empty((planes, groups, n), "uint8")
    for plane in range(planes):
        bits = ((filled >> plane) & 1).astype("uint8").reshape(n, groups, 8)
        out[plane] = np.packbits(bits, axis=2, bitorder="little")[:, :, 0].T
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (group, byte, anchor): the sum of an anchor's components over the bits of the byte."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    bound = int(np.abs(anchors).sum(axis=1).max(initial=0))
    kind = "int16" if bound < 1 << 15 else "int32" if bound < 1 << 31 else "int64"
    filled = np.zeros((n, groups * 8), "int64")
    filled[:, :dims] = anchors
    tables = np.zeros((groups, 256, n), kind)
    for group in range(groups):
        for bit in range(8):
            tables[group, 1 << bit : 2 << bit] = tables[group, : 1 << bit] + filled[:, group * 8 + bit].astype(kind)
    return tables


def scores(tables: np.ndarray, bits: np.ndarray, kind: str = "int64") -> np.ndarray:
    """Inner products (vector, anchor) from subset-sum tables and bit planes.

    Groups that one of the two does not have are zeros there, so they are passed over.
    """
    planes, groups, n = bits.shape
    groups = min(groups, len(tables))
    total = np.zeros((n, tables.shape[2]), kind)
    found, summed = np.empty(total.shape, tables.dtype), np.empty(total.shape, tables.dtype)
    for plane in reversed(range(planes)):
        summed[:] = 0
        for group in range(groups):
            np.take(tables[group], bits[plane, group], axis=0, out=found, mode="clip")
            summed += found
        if plane == planes - 1:
            np.subtract(total, summed, out=total)       # the sign
        else:
            total <<= 1
            total += summed
    return total


class Best:
    """The first ``k`` rows per group by falling score, then rising id."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.id = (np.zeros(0, "int64") for _ in range(3))
        #: Score that a row needs to come in; ties may.
        self.least = np.full(groups, np.iinfo("int64").min)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
        kept = place < self.k
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]
        last = place[kept] == self.k - 1
        self.least[self.group[last]] = self.score[last]

    def batch(self, names: tuple[str, str, str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.group, self.id, self.score)], names=list(names))


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector) of rows where none of the three is null."""
    return vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("vector")).dropna()


def chunks_of(rows: DataFrame, scale: int, chunk: int = CHUNK) -> DataFrame:
    """Rows (id, label, vector) as chunks of ids, labels and bit planes, each sorted by label and id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk:
                yield _packed(held, scale)
                held = []
        if held:
            yield _packed(held, scale)

    return rows.mapInArrow(pack, CHUNKS)


def _packed(batches: list[pa.RecordBatch], scale: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, labels = table.column(0).to_numpy(), table.column(1).to_numpy()
    vectors, good = integers(table.column(2).combine_chunks(), scale)
    order = np.lexsort((ids, labels))
    order = order[good[order]]
    bits = bit_planes(vectors[order])
    row = {"size": [len(order)], "dims": [vectors.shape[1]], "planes": [bits.shape[0]], "ids": [ids[order].astype("<i8").tobytes()],
           "labels": [labels[order].astype("<i8").tobytes()], "bits": [bits.tobytes()]}
    return pa.RecordBatch.from_pydict(row, pa.schema([("size", pa.int32()), ("dims", pa.int32()), ("planes", pa.int32()), ("ids", pa.binary()),
                                                      ("labels", pa.binary()), ("bits", pa.binary())]))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            n = row["size"]
            if n:
                bits = np.frombuffer(row["bits"], "uint8").reshape(row["planes"], -(-row["dims"] // 8), n)
                yield np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), bits


class AnchorBlock:
    """Anchors of one block, sorted by label: numbers of the block, ids, labels and integer vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]

    def parts(self, bits: np.ndarray, tables_at_once: int = TABLES) -> Iterator[tuple[slice, np.ndarray]]:
        """Scores of a chunk with a few anchors at a time."""
        largest = int(np.abs(self.vectors).sum(axis=1).max(initial=0)) << bits.shape[0]
        kind = "int32" if largest < 1 << 30 else "int64"
        for start in range(0, len(self.ids), tables_at_once):
            part = slice(start, start + tables_at_once)
            yield part, scores(subset_sums(self.vectors[part]), bits, kind)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def positives_in(chunks: Iterator[tuple], block: AnchorBlock, k: int) -> Best:
    """The best rows of the same label per anchor; an anchor's own id is no other row."""
    best = Best(len(block.ids), k)
    for ids, labels, bits in chunks:
        for label in np.unique(labels).tolist():
            mine, rows = block.of_label(label), slice(*np.searchsorted(labels, [label, label + 1]))
            if mine.start == mine.stop:
                continue
            own = AnchorBlock(block.ids[mine], block.labels[mine], block.vectors[mine])
            for part, found in own.parts(bits[:, :, rows]):
                at = np.arange(len(own.ids))[part] + mine.start
                row, column = np.nonzero((found >= best.least[at]) & (ids[rows, None] != block.ids[at]))
                best.add(at[column], found[row, column].astype("int64"), ids[rows][row])
    return best


def negatives_in(chunks: Iterator[tuple], block: AnchorBlock, low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """The best rows of another label per anchor and positive, with scores from ``low`` to ``high`` (anchor, positive)."""
    n, each = low.shape
    best = Best(n * each, k)
    for ids, labels, bits in chunks:
        for part, found in block.parts(bits):
            found = found.astype("int64", copy=False)
            at = np.arange(n)[part]
            other = labels[:, None] != block.labels[at]
            for which in range(each):
                least = np.maximum(low[at, which], best.least[at * each + which])
                row, column = np.nonzero((found <= high[at, which]) & (found >= least) & other)
                best.add(at[column] * each + which, found[row, column], ids[row])
    return best


def _blocks(rows: DataFrame, asked: Column, scale: int, anchors: int) -> Iterator[AnchorBlock]:
    """The anchors, ``anchors`` of them at a time in the driver."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, good = integers(batch.column(2), scale)
            lists = pa.array(list(vectors[good]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good)), lists], names=["id", "label", "vector"])

    found = written(rows.filter(asked).mapInArrow(whole, "id bigint, label bigint, vector array<bigint>"))
    placed = written(ordered.running(found.withColumn("__all", F.lit(0)), ["__all"], [F.col("id"), F.col("label")], F.lit(1).cast("bigint"), "__place", F.sum))
    for start in range(0, found.count(), anchors):
        part = placed.filter(F.col("__place").between(start + 1, start + anchors)).select("id", "label", "vector").toArrow()
        dims = max((len(v) for v in part.column("vector")), default=0)
        vectors = np.zeros((part.num_rows, dims), "int64")
        for i, v in enumerate(part.column("vector").to_pylist()):
            vectors[i, : len(v)] = v
        yield AnchorBlock(part.column("id").to_numpy(), part.column("label").to_numpy(), vectors)


def _merged(rows: DataFrame, group: str, k: int) -> DataFrame:
    """The first ``k`` per group of what the tasks found, with their rank."""
    window = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
                   positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), scale: int = 256,
                   anchors: int = ANCHORS) -> DataFrame:
    """Negatives per anchor and positive, best first: RESULT.

    ``asked`` (over the column id) names the anchors. An anchor's positives are its
    best rows of the same label with another id; the negatives of a positive are
    the best rows of other labels with ``share[0]`` to ``share[1]`` hundredths of
    its score. Ties go to the smaller id. Without rows in the window an anchor and
    positive have no result; so have anchors without positive.

    Rows with a null id, label or vector or a null or non-finite component take no
    part; shorter vectors count as filled up with zeros, empty ones score zero.
    Rows that occur twice are two rows: each can be positive or negative, and an
    anchor that occurs twice has its results twice. Components so large that
    multiples of a score would leave a long are held at a bound. All candidates
    are scored exactly; none is capped or sampled.
    """
    spark = vectors.sparkSession
    if not isinstance(label, str):
        vectors = vectors.withColumn("__label", label)
        label = "__label"
    rows = usable(vectors, key, vector, label)
    packed = written(chunks_of(rows, scale))
    chunks = written(dealt(packed, packed.count(), 2))
    path = run_dir(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for block in _blocks(rows, asked, scale, anchors):
        _mined(chunks, block, positives, negatives, share).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _mined(chunks: DataFrame, block: AnchorBlock, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(block)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield positives_in(_unpacked(batches), shared.value, positives).batch(("anchor", "id", "score"))

    found = _merged(chunks.mapInArrow(first, "anchor bigint, id bigint, score bigint"), "anchor", positives)
    best = found.select("anchor", "rank", "id", "score").toArrow()      # a few per anchor of the block
    anchor, place = best.column("anchor").to_numpy(), best.column("rank").to_numpy() - 1
    score, ids = np.zeros((len(block.ids), positives), "int64"), np.zeros((len(block.ids), positives), "int64")
    low, high = np.ones_like(score), np.zeros_like(score)       # nothing lies between
    score[anchor, place], ids[anchor, place] = best.column("score").to_numpy(), best.column("id").to_numpy()
    # least and largest whole numbers n with share[0] * p <= 100 * n <= share[1] * p
    low[anchor, place], high[anchor, place] = -(-share[0] * score[anchor, place] // 100), share[1] * score[anchor, place] // 100
    windows = chunks.sparkSession.sparkContext.broadcast((low, high, ids, score))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs, of, scored = windows.value
        got = negatives_in(_unpacked(batches), shared.value, lows, highs, negatives)
        pair = got.group
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (pair, shared.value.ids[pair // positives], of.ravel()[pair], got.id, scored.ravel()[pair], got.score)],
            names=["pair", "anchor_id", "positive_id", "id", "positive_score", "score"])

    mined = chunks.mapInArrow(second, "pair bigint, anchor_id bigint, positive_id bigint, id bigint, positive_score bigint, score bigint")
    return _merged(mined, "pair", negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
