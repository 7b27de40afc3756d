"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumatab.llm import embedding_dedup, fair_mix, html_text, quality_rules, rule_ensemble, shard_table, shared, simhash, token_files, toxicity, word_bpe


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_quality(shared.table(spark, sf_dir, "documents"))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.train(docs, shared.table(spark, sf_dir, "labels")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared.folder(spark, "token-shards")
    manifest = token_files.write_shards(shared.table(spark, sf_dir, "documents"), uri, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_shards(manifest, uri)


def op4_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.folder(spark, "placed")
    placed = shard_table.place(shared.table(spark, sf_dir, "documents"), shard_table.SHARDS)
    shard_table.write_placed(placed, path)
    return shard_table.read_placed(spark, path, placed.schema).select("doc_id", "slot", "shard")


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op6_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.queue(shared.table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(shared.table(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(shared.table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(shared.table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, shared.table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_quality": op1_line_quality,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_token_files": op3_token_files,
    "op4_shard_table": op4_shard_table,
    "op5_word_bpe": op5_word_bpe,
    "op6_fair_mix": op6_fair_mix,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_html_text": op8_html_text,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_line_quality": quality_rules.SQL,
    "op4_shard_table": shard_table.oracle(),
    "op6_fair_mix": fair_mix.SQL,
    "op7_embedding_dedup": embedding_dedup.SQL,
}
