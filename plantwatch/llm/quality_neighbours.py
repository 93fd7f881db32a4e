"""Nearest-neighbour quality classifier over latent-semantic vectors.

A text is a vector of hashed terms: its words, the pairs of neighbouring character classes, and a term for each word
that repeats the one before it. Term weights are sqrt(frequency) x inverse document frequency; a truncated singular
value decomposition of a bounded labelled sample gives the latent space. The sample's latent vectors and labels are
broadcast (`sample` rows of `rank` numbers), every document's cosines with all of them are computed exactly in blocks,
and the `neighbours` nearest vote with their similarity as weight.

Nulls: a null or empty text, or one without terms, gets the share of label 1 in the sample, as does every row when
no label can be learned from. A null id is kept and never learned from. Repeated rows score alike; of several labels
of one id the mean is learned, rounded. Ties among neighbours go to the smaller sample position. An empty table gives
an empty result. Only id and text of the documents are read; labels, language and source are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.common import held_out, labelled_sample
from plantwatch.llm.textblocks import Block, blocks

WORD_TERMS, PAIR_TERMS = 1024, 2048
TERMS = WORD_TERMS + PAIR_TERMS + 1
SAMPLE, RANK, NEIGHBOURS = 4000, 32, 25
FINE, UNIT = 1 << 18, 1 << 19
BLOCK_DOCUMENTS = 512


def _classes() -> np.ndarray:
    """Lower-case letters share a class, as do capitals, digits and bytes of other letters; the rest stand for themselves."""
    out = np.arange(256, dtype=np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 97, 65, 48, 97
    return out


CLASS = _classes()


def term_counts(block: Block) -> np.ndarray:
    """Documents x terms, as counts."""
    n = block.documents
    starts, ends, document = block.words()
    words = block.hashes(block.prefix(), starts, ends)
    out = np.bincount(document * TERMS + (words % np.uint64(WORD_TERMS)).astype(np.int64), minlength=n * TERMS)
    same = (words[1:] == words[:-1]) & (document[1:] == document[:-1])
    out += np.bincount(document[1:][same] * TERMS + TERMS - 1, minlength=n * TERMS)
    kind = CLASS[block.data]
    owner = np.repeat(np.arange(n), np.diff(block.offsets))
    inside = owner[1:] == owner[:-1]
    pairs = ((kind[:-1] * 257 + kind[1:]) * 2654435761 >> 7) % PAIR_TERMS
    out += np.bincount((owner[1:] * TERMS + WORD_TERMS + pairs)[inside], minlength=n * TERMS)
    return out.reshape(n, TERMS)


@dataclass
class Space:
    """Term weights, projection, and the labelled vectors in it."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Latent vectors of term counts, of length UNIT and rounded to whole numbers; zero where there are none.

        Weights and axes are whole numbers too, so that sums are exact, whatever their order: a document's vector does
        not depend on the block it is in.
        """
        rows = np.rint(_weighted(counts, self.idf) * FINE) @ np.rint(self.axes.astype(np.float64) * FINE)
        return np.rint(_unit(rows) * UNIT)

    def scores(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.labels) or not len(counts):
            return out
        latent, n = self.project(counts), len(self.labels)
        cosines = latent @ self.vectors.T
        # One number for cosine and position: of equal cosines the earlier one is nearer.
        key = cosines * n - np.arange(n)
        k = min(neighbours, n)
        near = np.argpartition(-key, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(key, near, axis=1), axis=1), axis=1)
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) / UNIT**2
        for _ in range(3):
            weight = weight * weight  # to the eighth power, by products alone
        total = weight.sum(axis=1)
        some = (total > 0) & latent.any(axis=1)
        out[some] = ((weight * self.labels[near]).sum(axis=1)[some] / total[some]).clip(0, 1)
        return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = counts.astype(np.float64)
    size = np.maximum(rows.sum(axis=1, keepdims=True), 1)
    return np.sqrt(rows / size) * idf


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def fit_space(counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Space:
    """Latent space of a sample by randomized subspace iteration with a fixed seed."""
    if not len(counts):
        return Space(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    rows = _weighted(counts, idf).astype(np.float32)
    basis = np.random.default_rng(7).standard_normal((TERMS, min(rank + 8, TERMS))).astype(np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    axes = (basis @ right.T)[:, :rank].astype(np.float32)
    space = Space(idf, axes, np.zeros((0, axes.shape[1])), labels)
    return replace(space, vectors=space.project(counts))


def labelled_counts(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of a bounded sample of (doc_id, label); the driver receives non-zero terms only."""
    rows = labelled_sample(docs, labels, limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), block_documents=BLOCK_DOCUMENTS):
                table = term_counts(block)
                terms = [np.flatnonzero(x).astype(np.int32) for x in table]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.documents),
                        batch.column("label").slice(block.first, block.documents),
                        pa.array([t.tobytes() for t in terms], pa.binary()),
                        pa.array([x[t].astype(np.int32).tobytes() for x, t in zip(table, terms, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "label", "terms", "counts"],
                )

    found = rows.select("doc_id", "label", "text").mapInArrow(count, "doc_id bigint, label int, terms binary, counts binary")
    sample = found.toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending"), ("counts", "ascending")])
    out = np.zeros((sample.num_rows, TERMS), np.int32)
    for k, (terms, counts) in enumerate(zip(sample["terms"], sample["counts"], strict=True)):
        out[k, np.frombuffer(terms.as_buffer(), np.int32)] = np.frombuffer(counts.as_buffer(), np.int32)
    return out, sample["label"].to_numpy().astype(np.float64)


def neighbour_scores(docs: DataFrame, space: Space, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score) of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), block_documents=BLOCK_DOCUMENTS):
                ids = batch.column("doc_id").slice(block.first, block.documents)
                yield pa.RecordBatch.from_arrays([ids, pa.array(space.scores(term_counts(block), neighbours))], ["doc_id", "score"])

    return docs.mapInArrow(score, "doc_id bigint, score double")


def learned_space(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Space:
    """The space of a bounded sample of labelled documents, out of those whose id has a CRC-32 that is not 1 modulo 3."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna()
    return fit_space(*labelled_counts(rows, learned.where(~held_out("doc_id", 3, 1)), sample), rank)


def quality_neighbours(
    docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS, threshold: float = 0.5
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; `labels` has doc_id and quality."""
    space = learned_space(docs, labels, sample, rank)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return neighbour_scores(rows, space, neighbours).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def kept_by_neighbours(
    docs: DataFrame, labels: DataFrame, *, learn_from: DataFrame | None = None, neighbours: int = NEIGHBOURS, threshold: float = 0.5, **fitting
) -> DataFrame:
    """The documents with a score of at least `threshold`, with all their columns; they are judged where they are read.

    `learn_from` holds the documents to learn from; give it where `docs` have been sifted, as sifted ones may lack a label.
    """
    space = learned_space(docs if learn_from is None else learn_from, labels, **fitting)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), block_documents=BLOCK_DOCUMENTS):
                good = space.scores(term_counts(block), neighbours) >= threshold
                yield batch.slice(block.first, block.documents).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
