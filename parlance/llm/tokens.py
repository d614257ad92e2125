"""Token counts of whole texts for a sentencepiece BPE model, with a whole-token shortcut.

A merge never crosses the border between a character and a following white
space mark, nor a line break, because no piece of the vocabulary does: that is
checked on the vocabulary when it is loaded. A text is therefore a sequence of
independent pre-tokens. The vocabulary strings that the model encodes, alone, as
one token are found once per worker; a pre-token among them counts 1 without any
merging. Only the others are given to the library, each different one once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, slices

MARK = "▁"
BORDER = re.compile(f"(?<!{MARK}){MARK}")
#: A run of marks with what follows, what follows a line break, or a line break.
PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
PRE_TOKEN_WITH_BREAKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class TokenCounter:
    """Counts the tokens of texts; ``model`` is the content of a sentencepiece file."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size()) if self._plain(i)]
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece crosses a word border, so texts cannot be split there")
        self.breaks_apart = not any("\n" in piece for piece in pieces)
        self.pre_token = PRE_TOKEN if self.breaks_apart else PRE_TOKEN_WITH_BREAKS
        self.single = frozenset(piece for piece in pieces if self.merged(piece) == 1)
        self.counts = Memo(self.merged, start=dict.fromkeys(self.single, 1))

    def _plain(self, i: int) -> bool:
        sp = self.library
        return not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))

    def merged(self, pre_token: str) -> int:
        """Tokens of one pre-token, by the library, which puts a mark in front of what it gets."""
        if pre_token[0] == MARK:
            return len(self.library.encode(pre_token[1:])) if len(pre_token) > 1 else 1
        # A line break is no part of any merge, so what stands before it only adds its own tokens.
        return len(self.library.encode("\n" + pre_token)) - self._prefix

    @property
    def _prefix(self) -> int:
        if not hasattr(self, "_prefix_tokens"):
            self._prefix_tokens = len(self.library.encode("\n"))
        return self._prefix_tokens

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return sum(sum(map(self.counts.__getitem__, self.pre_token.findall(part))) for part in slices(marked, BORDER))


@lru_cache(maxsize=2)
def counter(model: bytes) -> TokenCounter:
    return TokenCounter(model)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit.

    ``model_path`` is a sentencepiece file that the driver can read; its content
    (about half a megabyte, whatever the input) goes to the executors as a
    broadcast variable. A null or empty text has 0 bytes and 0 tokens. Texts of
    any length are counted whole, in parts of about a million characters.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(counter(model.value).count).astype("int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("n_bytes", F.octet_length(whole).cast("long"))
        .withColumn("n_tokens", tokens.asNondeterministic()(whole))
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )
