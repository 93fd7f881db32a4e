"""What several operators of this package need: packed texts, bounded samples, class of a text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm.textblocks import BLOCK_BYTES, Block, block_of
from plantwatch.session import cut_lineage

__all__ = ["bounded_sample", "cut_lineage", "held_out", "labelled_sample", "others", "packed_blocks", "packed_texts", "picked", "small_batches", "unpacked"]


def picked(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns as `0`, `1` and so on, found by place: other columns may have dots in their names, or differ by case only."""
    every = rows.columns
    at = [every.index(n) if n in every else [c.lower() for c in every].index(n.lower()) for n in names]
    return rows.toDF(*[f"_p{k}" for k in range(len(every))]).select(*[F.col(f"_p{k}").alias(str(i)) for i, k in enumerate(at)])


def packed_texts(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, uid, packed[, rest]): the text as zstd bytes, about a third of its size, for joins that have to move it.

    `uid` tells rows with other texts under the same id apart; equal rows share it. `rest` holds the columns to carry along.
    """
    kept = picked(docs, ["doc_id", "text", *carry])
    places = [F.col(f"`{k}`") for k in range(len(carry) + 2)]
    rest = [F.struct(*[c.alias(name) for c, name in zip(places[2:], carry, strict=True)]).alias("rest")] if carry else []
    doc_id, text = places[0].cast("bigint"), places[1].cast("string")
    rows = kept.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("uid"), text.alias("text"), *rest)
    kinds = ", ".join(f"`{name}`: {kind.simpleString()}" for name, kind in zip(carry, (f.dataType for f in kept.schema.fields[2:]), strict=True))
    return rows.mapInArrow(_pack, "doc_id bigint, uid bigint, packed binary" + (f", rest struct<{kinds}>" if carry else ""))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        packed = pa.array([press.compress(x.as_buffer()) for x in texts], pa.binary())
        rest = [c for c in batch.schema.names if c == "rest"]
        columns = [batch.column("doc_id"), batch.column("uid"), packed, *[batch.column(c) for c in rest]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "packed", *rest])


def unpacked(packed: pa.Array) -> pa.Array:
    """The UTF-8 bytes of packed texts."""
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x.as_buffer()) for x in packed], pa.large_binary())


def packed_blocks(packed: pa.Array, block_bytes: int = BLOCK_BYTES, block_documents: int = 4096) -> Iterator[Block]:
    """Packed texts as blocks, unpacked a block at a time. Null counts as empty."""
    press = zstandard.ZstdDecompressor()
    first, held, size = 0, [], 0
    for k, text in enumerate(packed):
        held.append(press.decompress(text.as_buffer()) if text.is_valid else b"")
        size += len(held[-1])
        if size >= block_bytes or len(held) == block_documents or k + 1 == len(packed):
            block = block_of(np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held], np.int64))
            yield Block(first, k + 1, block.data, block.offsets)
            first, held, size = k + 1, [], 0


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs that run inside send Python batches of at most `size`, whatever the rows' texts; the setting is put back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The `limit` distinct keys with the smallest hash: a bounded sample that does not depend on layout."""
    return rows.select(key).distinct().orderBy(F.xxhash64(F.col(key), F.lit("sample")), key).limit(limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most `limit` different rows of (doc_id, text) with a label, those with the smallest hash.

    The bound is on rows: an id with many texts takes part with as many as the hash draws. Of several labels of one id the mean counts,
    rounded.
    """
    known = labels.groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label")).dropna()
    named = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")).join(known, "doc_id").distinct()
    drawn = named.orderBy(F.xxhash64("doc_id", "_text", F.lit("sample")), "doc_id", "_text").limit(limit)
    rows = docs.withColumn("_text", F.xxhash64(F.coalesce("text", F.lit("")))).join(F.broadcast(drawn), ["doc_id", "_text"])
    return rows.dropDuplicates(["doc_id", "_text"]).select("doc_id", "text", "label")


def held_out(key: str, modulus: int, remainder: int):
    """Whether the CRC-32 of the key as text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def others(docs: DataFrame) -> list[str]:
    """The columns of documents besides id and text."""
    return [c for c in docs.columns if c not in ("doc_id", "text")]
