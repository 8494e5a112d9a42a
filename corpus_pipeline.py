"""From raw documents to token ids: five stages, each over all rows that the one before kept.

Language ID drops documents without a determined language; toxicity drops those predicted toxic; the n-gram
Jaccard join keeps the smallest id of each group of near-duplicates (five words, a similarity of 0.8); mixing
repeats and drops whole documents so that sources come near their targets; BPE encodes what is left: doc_id, n_tokens,
digests of ids and decoded text, and the ids.

Documents without letters, null and empty ones among them, go in the first stage. Very long texts are taken whole,
rows that repeat an id or a text are rows like others until the third stage, which treats an id as one document; null ids stay
in every stage. An empty table gives an empty result. Columns other than doc_id, text, lang and source are carried along, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadentia.llm import bpe, jaccard_join, language, mixing, toxicity
from cadentia.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language_documents(spark, docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.harmless_documents(spark, docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_group(spark, docs, width=5, threshold=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(spark, docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [("language ID", language_stage), ("toxicity", toxicity_stage), ("n-gram Jaccard join", jaccard_stage), ("mixing", mixing_stage), ("BPE", bpe_stage)]

# Trained models and near-duplicate groups have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(spark, docs, f"pipeline-{i}")
    return docs
