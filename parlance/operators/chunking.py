"""Cutting documents into chunks that keep their place in the file.

Where a document is cut follows from the lengths of its pieces alone, so the cuts
are found first, on running sums of lengths: a piece is the longest run of atoms
(sentences, cut where one is longer than the limit) that fits, a chunk the longest
run of pieces that fits beside the tail kept from the chunk before. Texts, ranges
and languages are then read off the cut table. This is done on the document row in
an Arrow UDF, so it needs no shuffle and no grouping.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import unnest
from ..functions.text import SENTENCE_BREAK
from ..sources.files import PARAGRAPH_LOCATOR

# ---- fixed values ----
CHUNK_CHARS = 1200
OVERLAP_CHARS = 200
# ---- end of fixed values ----

_SENTENCE = re.compile(SENTENCE_BREAK)
_CHUNKS = "array<struct<text:string,lang:string,block_start:int,block_end:int,first_loc:int,last_loc:int>>"
_GAP = "\n\n"


def pieces_of(block: str, limit: int) -> list[str]:
    """A block as pieces of at most ``limit`` characters, cut between sentences where possible.

    White space that a cut sentence leaves in front of a piece of several atoms does not count.
    """
    if len(block) <= limit:
        return [block]
    atoms = [s[at:at + limit] for s in _SENTENCE.split(block.strip()) for at in range(0, len(s), limit)]
    ends = list(accumulate(len(atom) + 1 for atom in atoms))
    out, first = [], 0
    while first < len(atoms):
        before = ends[first - 1] if first else 0
        blank = len(atoms[first]) - len(atoms[first].lstrip()) + (not atoms[first].strip())
        after = bisect_right(ends, before + blank + limit + 1, lo=first + 1)
        out.append(atoms[first] if after == first + 1 else " ".join(atoms[first:after]).strip())
        first = after
    return out


def cut_table(lengths: Sequence[int], size: int, overlap: int) -> list[tuple[int, int, int]]:
    """Chunks as (first piece, piece after the last, characters kept from the chunk before).

    Separators do not count for the size, and the first piece of a chunk always
    fits, whatever was kept before it.
    """
    sums, table, first, kept = [0, *accumulate(lengths)], [], 0, 0
    while first < len(lengths):
        after = max(first + 1, bisect_right(sums, sums[first] + size - kept) - 1)
        table.append((first, after, kept))
        parts = after - first + (kept > 0 or first > 0 and overlap > 0)
        kept = min(overlap, kept + sums[after] - sums[first] + len(_GAP) * (parts - 1)) if overlap > 0 else 0
        first = after
    return table


def chunks_of(blocks: Sequence[str], langs: Sequence[str], size: int, overlap: int) -> list[dict]:
    """The chunks of one document.

    A chunk starts at the block of its first own piece and ends at the block of the
    piece after it; the kept tail has the place and the language of the piece it was
    cut from, and counts like a piece. A blank chunk is left out.
    """
    pieces = [(piece, at) for at, block in enumerate(blocks) for piece in pieces_of(block, size)]
    out, before = [], ""
    for first, after, kept in cut_table([len(piece) for piece, _ in pieces], size, overlap):
        own = pieces[first:after]
        tail = [(before[len(before) - kept:], pieces[first - 1][1])] if first and overlap > 0 else []
        before = _GAP.join(text for text, _ in tail + own)
        places = [at for _, at in tail + own]
        votes = [langs[at] for at in places]
        vi, en = votes.count("vi"), votes.count("en")
        if before.strip():
            out.append({
                "text": before.strip(), "lang": "unknown" if not vi + en else "vi" if vi >= en else "en",
                "block_start": own[0][1], "block_end": pieces[after][1] if after < len(pieces) else len(blocks) - 1,
                "first_loc": places[0], "last_loc": places[-1],
            })
    return out


def _packer(size: int, overlap: int):
    @F.pandas_udf(_CHUNKS)
    def pack_batch(blocks: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(list(b), list(l), size, overlap) for b, l in zip(blocks, langs)])

    return pack_batch


def locator_range(first: Column, last: Column) -> Column:
    """``đoạn 3–7`` for one kind of unit, ``a → b`` for two, ``a`` if both are equal."""
    pattern = r"^(\D+?)\s*(\d+)"
    unit_a, unit_b = (F.trim(F.regexp_extract(c, pattern, 1)) for c in (first, last))
    no_a, no_b = (F.regexp_extract(c, pattern, 2) for c in (first, last))
    same_unit = (no_a != "") & (no_b != "") & (unit_a == unit_b)
    return (
        F.when(first == last, first)
        .when(same_unit, F.concat(unit_a, F.lit(" "), no_a, F.lit("–"), no_b))
        .otherwise(F.concat(first, F.lit(" → "), last))
    )


def chunk_documents(
    documents: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """One row per chunk. documents: doc_id, workspace_id, blocks, block_langs.

    Equal counts of both languages make a chunk Vietnamese.
    """
    packed = documents.select(
        "doc_id", "workspace_id", _packer(size, overlap)(F.col("blocks"), F.col("block_langs")).alias("__chunks")
    )
    rows = unnest(packed, ["doc_id", "workspace_id"], F.col("__chunks"), "__c", "chunk_idx")

    def locator(index: str) -> Column:
        return F.concat(F.lit(PARAGRAPH_LOCATOR), (F.col(f"__c.{index}") + 1).cast("string"))

    return rows.select(
        "doc_id", "workspace_id", "chunk_idx", "__c.text",
        locator_range(locator("first_loc"), locator("last_loc")).alias("locator"),
        "__c.lang", "__c.block_start", "__c.block_end",
    )


def split_blocks(documents: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """One row per piece of a block: doc_id, block (from 0), piece. documents: doc_id, blocks."""

    @F.pandas_udf("array<struct<block:int,piece:string>>")
    def split(blocks: pd.Series) -> pd.Series:
        return pd.Series([[{"block": at, "piece": piece} for at, block in enumerate(one) for piece in pieces_of(block, limit)] for one in blocks])

    return documents.select("doc_id", F.inline(split(F.col("blocks"))))
