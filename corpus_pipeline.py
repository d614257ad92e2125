"""From raw documents to packed training sequences, in five stages.

Every stage is one operator of ``parlance.llm``; it gets the documents that the
stage before kept, reread from Parquet, and its decisions take effect. All stages
but the last return the columns of documents.

Common to all stages: a null text is the empty text; rows that occur twice are two
rows, unless near copies make one of them; ties are decided by the least doc_id, a null
one only where there is no other; whole texts are read, however long; further columns stay as they are, also with
names that the operators use inside; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import catalog, decontaminate, packing, quality, simhash, toxicity
from parlance.llm.common import fold, ready, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rules or of which most words stand on boilerplate lines.

    Null and empty texts have no words and go. Without labels of both kinds the field has fixed weights.
    """
    return quality.only_good(docs, catalog.table(ready(spark), sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; one fold of the labels is not learned from.

    Empty texts have a score like others. Of labels that contradict the larger counts.
    """
    return toxicity.without_toxic(docs, catalog.table(ready(spark), sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id.

    Texts without words are copies of each other; of rows with equal ids and texts one stays.
    """
    ready(spark)
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more is benchmark text go.

    A text without words is clean; items without words have no windows.
    """
    return decontaminate.without_contaminated(docs, catalog.table(ready(spark), sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens.

    Other columns do not go along. An empty text is its end token alone.
    """
    ready(spark)
    return packing.pack_documents(docs, catalog.tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: The stages learn models and tokenize, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the table documents, each written and read again."""
    docs = catalog.table(ready(spark), sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs)
    return docs
