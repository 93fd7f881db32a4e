"""Rule statistics of every text, and a log-likelihood ratio between a trusted target and the raw corpus.

Words are runs of bytes other than space and 0x09-0x0D. Every unigram and bigram of words is hashed into a fixed
number of buckets; two multinomials are counted over the buckets, one on trusted documents and one on all of them.
A document's score is the sum of log(target / raw) over its n-grams divided by their number, so that length does not
matter; it is kept when the score reaches `threshold`.

Nulls: a null text has no words (base_failed). A null id is kept as a row, never trusted. Repeated rows count as often
as they occur in the raw corpus and are scored alike. Without trusted documents the ratio is 0 and all that pass the
base rules are kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.common import packed_blocks, packed_texts
from plantwatch.llm.textblocks import IN_WORD, Block, blocks, mixed, paired

BUCKETS = 1 << 16
THRESHOLD = -0.1
SMOOTHING = 20.0

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "llr double, base_failed boolean, kept boolean"
)


def _buckets(words: np.ndarray, document: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each unigram and each bigram, and the document of each bigram."""
    same = document[1:] == document[:-1]
    pairs = paired(words[:-1], words[1:])[same]
    n = np.uint64(n_buckets)
    return (words % n).astype(np.int64), (pairs % n).astype(np.int64), document[1:][same]


def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, document = block.words()
    prefix = block.prefix()
    return block.hashes(prefix, starts, ends), document, starts, prefix


def bucket_counts(flagged: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, target, raw): n-gram counts of the trusted documents and of all documents of (packed, trusted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for batch in batches:
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for block in packed_blocks(batch.column("packed")):
                words, document, _, _ = _words(block)
                one, two, of_two = _buckets(words, document, n_buckets)
                good = trusted[block.first : block.last]
                raw += np.bincount(one, minlength=n_buckets) + np.bincount(two, minlength=n_buckets)
                target += np.bincount(one[good[document]], minlength=n_buckets)
                target += np.bincount(two[good[of_two]], minlength=n_buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(target[used]), pa.array(raw[used])], ["bucket", "target", "raw"]
        )

    partial = flagged.select("packed", "trusted").mapInArrow(count, "bucket bigint, target bigint, raw bigint")
    return partial.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def bucket_weights(counts: DataFrame, n_buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(target share / raw share) per bucket; at most `n_buckets` rows reach the driver.

    Each bucket's count in the target is held against the count that the raw corpus lets expect there, `smoothing` added
    to both, so that a bucket seen a few times says little and a small corpus does not reject what it merely has not seen.
    """
    table = counts.toArrow()
    target, raw = np.zeros(n_buckets), np.zeros(n_buckets)
    at = table["bucket"].to_numpy()
    target[at], raw[at] = table["target"].to_numpy(), table["raw"].to_numpy()
    if not target.sum():
        return np.zeros(n_buckets)
    share = lambda x: (x + smoothing) / (x + smoothing).sum()
    return np.log(share(target)) - np.log(share(raw * (target.sum() / raw.sum())))


def _repeat_words(words: np.ndarray, document: np.ndarray, n_documents: int) -> np.ndarray:
    """Per document, the words that lie in a 3-word window found twice or more in it."""
    if len(words) < 3:
        return np.zeros(n_documents, np.int64)
    inside = document[2:] == document[:-2]
    windows = paired(paired(words[:-2], words[1:-1]), words[2:])
    keys = mixed(windows + document[2:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(inside)
    order = at[np.argsort(keys[at], kind="stable")]
    equal = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(words), dtype=bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    covered = again.copy()
    covered[1:] |= again[:-1]
    covered[2:] |= again[:-2]
    return np.bincount(document[covered], minlength=n_documents)


def _dup_lines(block: Block, prefix: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Per document, the lines with a word that equal an earlier line."""
    starts, ends, document = block.spans(block.data != 0x0A)
    with_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, document = starts[with_word], ends[with_word], document[with_word]
    keys = mixed(block.hashes(prefix, starts, ends) + document.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    n = block.documents
    return np.bincount(document, minlength=n) - np.bincount(document[first], minlength=n)


def rule_columns(block: Block, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics and the ratio of each document of a block."""
    n = block.documents
    words, document, starts, prefix = _words(block)
    one, two, of_two = _buckets(words, document, len(weights))
    score = np.bincount(document, weights[one], n) + np.bincount(of_two, weights[two], n)
    grams = np.bincount(document, minlength=n) + np.bincount(of_two, minlength=n)
    return {
        "n_words": np.bincount(document, minlength=n),
        "word_chars": block.per_document(IN_WORD[block.data] & ((block.data & 0xC0) != 0x80)),
        "n_symbols": block.per_document(SYMBOL[block.data]),
        "n_dup_lines": _dup_lines(block, prefix, starts),
        "n_repeat_words": _repeat_words(words, document, n),
        "llr": score / np.maximum(grams, 1),
    }


def fit_weights(docs: DataFrame, trusted: DataFrame, n_buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Weights of the buckets from all documents and all trusted ones.

    `trusted` has the ids (`doc_id`) of the trusted documents, any number of them. Texts move once, packed, to meet their
    flag; what comes back is a fixed `n_buckets` numbers.
    """
    flags = trusted.select(F.col("doc_id").cast("bigint").alias("doc_id")).dropna().distinct().withColumn("trusted", F.lit(True))
    flagged = packed_texts(docs).join(flags.hint("merge"), "doc_id", "left")
    return bucket_weights(bucket_counts(flagged.select("packed", F.coalesce("trusted", F.lit(False)).alias("trusted")), n_buckets), n_buckets, smoothing)


def _judged(block: Block, weights: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    out = rule_columns(block, weights)
    failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    return out | {"base_failed": failed, "kept": ~failed & (out["llr"] >= threshold)}


def quality_rules(docs: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """One row per document: its rule statistics, its ratio and whether it is kept."""
    weights = fit_weights(docs, trusted, **fitting)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                out = _judged(block, weights, threshold)
                ids = batch.column("doc_id").slice(block.first, block.documents)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out.values())], ["doc_id", *out])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, SCHEMA)


def kept_by_rules(docs: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """The documents that the rules keep, with all their columns; they are judged where they are read."""
    weights = fit_weights(docs, trusted, **fitting)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                yield batch.slice(block.first, block.documents).filter(pa.array(_judged(block, weights, threshold)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
