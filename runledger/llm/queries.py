"""One query per operator, over its whole table, and their SQL where it exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import checkpoint_dir
from . import (
    alignment, binaryids, decontamination, fim, jaccard, langid, oracles, pii, quality, sharding, superminhash, tokencount, toxicity, unigram,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"), limit=64 << 20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, docs.filter(~langid.held_out()), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.withColumn("held_out", langid.held_out()), index)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumn("broken_rules", F.array_join("broken_rules", ","))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    binaryids.write_ids(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return binaryids.read_ids(spark, folder, ids=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, decontamination.contaminated().alias("contaminated"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    digest = F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.written(F.col("spans")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    named = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(named, model)


def vocabulary() -> unigram.Vocabulary:
    return unigram.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.encode(docs, vocabulary(), ids=False).drop("text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, tokencount.Automaton(tokencount.piece_vocabulary(vocabulary())))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.groups(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.linked(_table(spark, sf_dir, "documents"), *files, groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fim.restored()).alias("restored_sha256"),
    )


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (
        op1_sharding, op2_toxicity, op3_quality_rules, op4_token_ids, op5_decontamination, op6_pii, op7_language_id, op8_sentencepiece, op9_token_counts,
        op10_jaccard_join, op11_minhash_dedup, op12_alignment, op13_fill_in_middle,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
