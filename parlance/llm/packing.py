"""Best-fit packing of documents into training sequences, with certified bin counts.

Token ids come from a word tokenizer, one white-space separated word at a time
(its normaliser and splitter never look across white space), so each different
word is encoded once per worker. The pieces are dealt evenly over tasks; each
task packs its own by best-fit decreasing and computes a lower bound from
dual-feasible functions. A task whose count equals its bound is done, but for its
emptiest sequence; a task with a gap gives back every sequence that is not full.
What was given back is dealt again to fewer tasks and packed again, until one
task had all of it or nothing is gained.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, written

#: A task packs about so many pieces.
PER_TASK = 100_000
#: Times that pieces are given back and packed again, at most.
ROUNDS = 4
SLICE = 1 << 20
#: Punctuation that the tokenizer keeps apart from letters before it, and the last letter taken as plain.
TAIL, PLAIN = string.punctuation.replace("'", ""), "\u024f"


def byte_signs() -> dict[int, str]:
    """The sign that byte-level models write for each byte: itself if it is visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(0x100) if byte not in visible]
    return {byte: chr(byte) for byte in visible} | {byte: chr(0x100 + place) for place, byte in enumerate(hidden)}


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer puts letters in lower case and cuts a word where letters meet
    punctuation, so a word is looked up in lower case, and a word of plain letters
    with a tail of punctuation is its letters and its tail.
    """

    def __init__(self, definition: bytes, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.end = np.array([end_id], "<u4").tobytes()
        self.ids = Memo(self._encode, limit=1_000_000)
        #: What the tokenizer looks for as it is written, before it lowers anything.
        self.special = tuple(token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values())

    def _encode(self, word: bytes) -> bytes:
        text = word.decode()
        body = text.rstrip(TAIL)
        # Lower case may end in a mark that joins the punctuation, so it must be letters as well.
        lowered = body.lower()
        if lowered.isalpha() and max(body) <= PLAIN:
            if body != text:
                return self.ids[body.encode()] + self.ids[text[len(body) :].encode()]
            # Plain letters are composed and are one pre-token: what is left to do is the model's.
            signs = lowered.encode().decode("latin-1").translate(self.signs)
            return struct.pack(f"<{len(tokens := self.model.tokenize(signs))}I", *[token.id for token in tokens])
        return struct.pack(f"<{len(ids := self.tokenizer.encode(text, add_special_tokens=False).ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Words are cut at ASCII white space only; all other characters go to the tokenizer."""
        data = (text or "").encode()
        lowered = data.lower()
        if not any(token in lowered for token in self.special):
            data = lowered
        if len(data) <= SLICE:
            return b"".join(map(self.ids.__getitem__, data.split())) + self.end
        parts, start = [], 0
        while start < len(data):
            stop = start + SLICE
            while stop < len(data) and data[stop] not in b" \t\n\x0b\x0c\r":
                stop += 1
            parts += map(self.ids.__getitem__, data[start:stop].split())
            start = stop
        return b"".join(parts) + self.end


@lru_cache(maxsize=2)
def encoder(definition: bytes, end_id: int) -> WordEncoder:
    return WordEncoder(definition, end_id)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
           with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and the end id. Only longer ones are cut, into pieces
    of ``capacity``; the last may be shorter. A null or empty text is the end id
    alone. Special strings inside a text are handled as the tokenizer does by default.
    """
    with open(tokenizer_path, "rb") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(definition.value, end_id)
        for batch in batches:
            rows, columns = [], [[] for _ in range(5)]
            for row, one in enumerate(batch.column(1).to_pylist()):
                ids = words.encode(one)
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    for column, value in zip(columns, (number, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:4])]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(part, "<u4").astype("int64") for part in columns[4]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(key, text).mapInArrow(cut, T.StructType(fields))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the load of every bin.

    Bins are found by the room they have left; ``rooms`` has a bit for every
    room that occurs, so the tightest fit is its lowest bit from the length on.
    """
    bins, offsets, load = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64"), []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(load)
            load.append(0)
        bins[item], offsets[item] = chosen, load[chosen]
        load[chosen] += length
        if room > length:
            by_room.setdefault(room - length, []).append(chosen)
            rooms |= 1 << (room - length)
    return bins, offsets, np.array(load, "int64")


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of bins: the largest sum over two families of dual-feasible functions.

    One counts what is too large to share with the cut-off as a whole bin and
    drops what is smaller than the cut-off; the other rounds multiples of
    capacity / (k + 1). Each keeps the sum over any feasible bin at one bin or less.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype("int64")
    size = np.arange(capacity + 1)
    mass, above = np.concatenate([[0], np.cumsum(count * size)]), np.concatenate([[0], np.cumsum(count)])
    cut = np.arange(0, capacity // 2 + 1)
    whole = above[-1] - above[capacity - cut + 1]
    middle = mass[capacity - cut + 1] - mass[cut]
    best = int(np.max(-(-(whole * capacity + middle) // capacity)))
    for k in range(1, 33):
        part = (k + 1) * size
        exact = part % capacity == 0
        # In units of 1 / (k * capacity) of a bin.
        value = np.where(exact, size * k, part // capacity * capacity)
        best = max(best, int(-(-int((value * count).sum()) // (k * capacity))))
    return best


PACKED = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
          T.StructField("given_back", T.BooleanType())]


def _pack_once(items: DataFrame, tasks: int, capacity: int, first_id: int) -> DataFrame:
    """Packs evenly dealt parts of the items; ``given_back`` marks what should be packed again."""
    schema = T.StructType([*items.schema.fields, *PACKED])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths = table.column("length").to_numpy()
        bins, offsets, load = best_fit_decreasing(lengths, capacity)
        if len(load) == least_bins(lengths, capacity):
            again = np.arange(len(load)) == int(np.argmin(load))
        else:
            again = np.ones(len(load), bool)
        again &= load < capacity
        base = first_id + (TaskContext.get().partitionId() << 32)
        for name, column in (("sequence_id", bins + base), ("offset", offsets), ("given_back", again[bins])):
            table = table.append_column(name, pa.array(column))
        yield from table.to_batches()

    return items.repartition(tasks).mapInArrow(pack, schema)


def pack(items: DataFrame, capacity: int = 4096, per_task: int = PER_TASK, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (column length, 1 to ``capacity``) with sequence_id and offset.

    Items may repeat; offsets in a sequence are gapless from 0. Memory of a task
    is that of ``per_task`` items, whatever the keys. Ids are any numbers, one per sequence.
    """
    items = items.drop("sequence_id", "offset", "given_back")
    done: list[DataFrame] = []
    pool, before = items, None
    for number in range(rounds + 1):
        n = pool.count()
        tasks = max(1, ceil(n / per_task))
        packed = written(_pack_once(pool, tasks, capacity, number << 56))
        open_rows = packed.filter("given_back")
        opened = open_rows.agg(F.countDistinct("sequence_id")).first()[0]
        if number == rounds or not opened or tasks == 1 or (before is not None and opened >= before):
            done.append(packed)
            break
        done.append(packed.filter("NOT given_back"))
        pool, before = open_rows.select(*items.columns), opened
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("given_back")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
                   with_ids: bool = False, key: str = "doc_id", text: str = "text", per_task: int = PER_TASK) -> DataFrame:
    """Pieces of the documents with their place: sequence_id and offset; see :func:`pieces` and :func:`pack`."""
    cut = written(pieces(docs, tokenizer_path, capacity, end_id, with_ids, key, text))
    return pack(cut, capacity, per_task)
