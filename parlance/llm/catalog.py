"""The operators of this subpackage as queries on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, languages, likelihood, merkle, negatives, packing, pages, quality, secret_scan, sharding, simhash, tokens, toxicity
from .common import fold, ready
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[name] = lambda spark, folder: fn(ready(spark), folder)
        return fn

    return register


@query("op1_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokenizer("piece_bpe_32k.model")).drop("text")


@query("op2_near_copies")
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


@query("op3_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    return decontaminate.judged(decontaminate.scan(docs, benchmark)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


@query("op4_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extracted(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op5_toxicity")
def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    classifier = toxicity.fitted(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return toxicity.scored(docs, classifier).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op6_sharding")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.sharded(docs, ["doc_id", "text_crc32", "size"], 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op7_likelihood")
def likelihoods(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    found = likelihood.scored(docs, ~held_out, tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


@query("op9_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.judged(docs, quality.fitted(docs, table(spark, folder, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )


@query("op10_language")
def language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = languages.fitted(docs, where=~held_out)
    return languages.predicted(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op11_merkle_manifest")
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, folder, "documents"), tampered=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_hard_negatives")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, label=label)


@query("op13_secret_scan")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, folder, "documents").select("doc_id", "text"))
    kinds = [rule.kind for rule in secret_scan.BASE]
    base = F.filter("found", lambda x: x["kind"].isin(kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
