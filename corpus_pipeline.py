"""The corpus pipeline: each stage takes the documents its predecessor kept, written as Parquet and read again.

1. Quality rules: documents that fail the base rules or the likelihood ratio against the trusted ones go.
2. Quality classifier: documents whose labelled neighbours among all documents vote against them go.
3. Near duplicates: one document of each group of similar ones stays.
4. Long repeats: passages that an earlier document holds are cut out of the texts.
5. Packing: the texts become sequences of at most 2048 tokens.

A document whose text is null or has fewer words than the rules ask for goes in the first stage; rows that share an id are
documents of their own until the third, where one of each group of similar texts stays. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plantwatch.llm.common import cut_lineage
from plantwatch.llm.jaccard_regions import one_of_each
from plantwatch.llm.packing import pack
from plantwatch.llm.quality_neighbours import kept_by_neighbours
from plantwatch.llm.quality_rules import kept_by_rules
from plantwatch.llm.repeats import cleaned


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_by_rules(docs, _labels(spark, sf_dir).where("quality = 1"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Learned from the unsifted documents: the rules leave hardly any of low quality to learn from.
    return kept_by_neighbours(docs, _labels(spark, sf_dir), learn_from=_documents(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cleaned(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near duplicates", near_duplicates),
    ("long repeats", long_repeats),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
