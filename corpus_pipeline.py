"""From documents to token ids: five stages, each one of the operators in lumatab.llm, each a table of its own.

Defined cases, beside those of the operators: a null text is scored like an empty one by the classifier and rejected by the
rules; null ids, languages and sources go through (a null source is one source); repeated rows are judged one by one
and are one row after near-dedup; ties are broken by (id, hash of the row); other columns of documents are kept up to
mixing; an empty table, or one of which a stage keeps nothing, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumatab.llm import fair_mix, quality_rules, rule_ensemble, shared, simhash, word_bpe

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at one half or more; without labels of both classes all or none."""
    return rule_ensemble.accepted(docs, rule_ensemble.train(docs, shared.table(spark, sf_dir, "labels")))


def quality_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough of their text, without the lines that fail; null and empty texts, and those of under 50 words, go."""
    return quality_rules.cleaned_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest (id, hash of the row); fingerprints and radius are operator 9's."""
    return simhash.deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: some not at all, some up to three times; texts without words never."""
    return fair_mix.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of their decoded text; each row is encoded by itself, repeats too."""
    return word_bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("source",))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_lines),
    ("simhash near-dedup", near_dedup),
    ("mixing", mixing),
    ("bpe encoding", encoding),
]

#: SQL can't express the trained classifier and the encoder.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    docs, old = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, at = shared.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if old:
            shared.drop(spark, old)
        old = at
    return docs
