"""The operators of this package as queries over the test tables: one opN_<name> each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm import chat_view, sql_twins
from plantwatch.llm.ball_tree import top_products
from plantwatch.llm.chunk_reuse import encode_and_decode
from plantwatch.llm.jaccard_regions import jaccard_components
from plantwatch.llm.language_id import language_id
from plantwatch.llm.merkle_manifest import merkle_manifest
from plantwatch.llm.near_vectors import near_vectors
from plantwatch.llm.packing import pack
from plantwatch.llm.prefix_trie import prefix_trie
from plantwatch.llm.quality_neighbours import quality_neighbours
from plantwatch.llm.quality_rules import quality_rules
from plantwatch.llm.repeats import repeat_digests
from plantwatch.llm.tool_calls import link_tool_calls
from plantwatch.llm.toxicity import toxicity

VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL twin where there is one."""

    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


@query("op7_quality_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_neighbours(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op3_chunk_reuse")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query(
    "op8_ball_tree",
    """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_suffix_groups")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


@query("op5_jaccard_regions")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op1_tool_calls", chat_view.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(chat_view.messages(table(spark, sf_dir, "conversations")), chat_view.tools(spark))


def crc32(column: str):
    """CRC-32 of a whole number as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


@query("op11_merkle_manifest", sql_twins.MANIFEST)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"), crc32("doc_id") % 5 == 0)


@query("op13_prefix_trie", sql_twins.TRIE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return prefix_trie(conversations, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9, 8, 5)


@query("op12_small_world", sql_twins.NEAR_VECTORS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
