import random

import pytest

from parlance.llm.common import ready

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, bits string, component string, label string"


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)


def odd_texts() -> list:
    """Null, empty, blank, very long, repeated and unusual texts."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Über", "naïve", "x" * 300, "日本語", "á", "▁", "<s>", "<|endoftext|>", "it's", "42", "don't", "🙂", " ", "\x00", " z"]
    long = " ".join(rng.choice(words[:5]) + str(rng.randrange(50)) for _ in range(40_000))
    texts = [None, "", "   ", "\n\n\t", "a", " a", "a ", "one two", "one two three", long, long, "ONE TWO three", "one  two\n\nthree\r\n", "q" * 200_000]
    for _ in range(60):
        texts.append("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "", "\t", " \n "]) for _ in range(rng.randrange(1, 60))))
    return texts


@pytest.fixture(scope="session")
def odd_rows():
    texts = odd_texts()
    rows = [(i, t, "en" if i % 3 else None, None, None, "clash", "b", "c", "l") for i, t in enumerate(texts)]
    return [*rows, (3, texts[3], None, None, None, None, None, None, None), (None, "one two three", None, None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(llm, odd_rows):
    return llm.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def nothing(llm):
    return llm.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(llm):
    return llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
