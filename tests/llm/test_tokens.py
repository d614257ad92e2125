"""Token counts against the library on whole texts."""

from parlance.llm import catalog
from parlance.llm.tokens import TokenCounter, count_tokens

PATH = catalog.tokenizer("piece_bpe_32k.model")


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def test_counts_are_those_of_the_library(odd, small):
    sp = library()
    for docs in (odd, small):
        rows = count_tokens(docs, PATH, limit=100).collect()
        assert len(rows) == docs.count()
        for row in rows:
            assert row.n_tokens == len(sp.encode(row.text or "")), repr((row.text or "")[:80])
            assert row.n_bytes == len((row.text or "").encode())
            assert row.over_limit == (row.n_tokens > 100)


def test_shortcut_holds_for_every_single_token():
    sp, counter = library(), TokenCounter(open(PATH, "rb").read())
    assert len(counter.single) > 20_000
    for piece in counter.single:
        if piece.startswith("▁"):
            assert len(sp.encode(piece[1:])) == 1 or piece == "▁"


def test_columns_are_replaced_and_empty_tables_stay_empty(odd, nothing):
    assert set(count_tokens(odd, PATH).columns) == set(odd.columns) | {"n_bytes", "n_tokens", "over_limit"}
    assert count_tokens(nothing, PATH).collect() == []
