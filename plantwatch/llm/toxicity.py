"""Toxicity classifier with counterfactual regularisation.

Logistic regression on the presence of words and of stems (the first four and five bytes of longer words). Those that
separate the labels significantly on the training documents become features, and so does every identity term. Each
labelled text that names an identity group is paired with the same text about another group of its kind (its features
without the word and the stems of the one, but for stems that another word gives too, and with those of the other), and
the squared difference of the two scores is penalised, so that naming a group does not by itself raise a score.

Words are runs of ASCII letters and bytes of other characters, ASCII letters lower-cased.

Nulls: a null or empty text has no features and gets the score of the intercept; a null id is kept and never learned
from. Of several labels of one id the mean is learned, rounded. Repeated rows score alike and, equal in every column,
are learned from once. Without both labels every score is the share of label 1. An empty table gives an empty result.
Only id and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.common import cut_lineage, held_out, labelled_sample
from plantwatch.llm.textblocks import BYTE_CODES, LOWER, Block, blocks, mixed

FIT_SAMPLE = 20_000
MAX_FEATURES = 4096
MIN_DOCUMENTS, MIN_Z = 3, 3.0
PENALTY, RIDGE, STEPS, MAX_WEIGHT = 1.0, 1e-4, 800, 2.0
THRESHOLD = 0.3
STEMS = (4, 5)

# Kinds of identity terms; terms of a kind are swapped for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("men", "women"), ("man", "woman"), ("boys", "girls"), ("he", "she"), ("male", "female"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"), ("young", "old"), ("deaf", "blind", "disabled"),
    ("hombres", "mujeres"), ("hommes", "femmes"), ("frauen", "männer"),
    ("immigrants", "natives", "refugees"),
)

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LOWER_CODES = BYTE_CODES[LOWER]


def word_hashes(block: Block, stems: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, case folded, and its document; with `stems` also those of the first bytes of longer words."""
    starts, ends, document = block.spans(LETTER[block.data])
    prefix = block.prefix(LOWER_CODES)
    words = block.hashes(prefix, starts, ends)
    if not stems:
        return words, document
    found, owners = [words], [document]
    for size in STEMS:
        long = ends - starts > size
        found.append(mixed(block.hashes(prefix, starts[long], starts[long] + size) + np.uint64(size)))
        owners.append(document[long])
    return np.concatenate(found), np.concatenate(owners)


def hashes_of(words: Sequence[str]) -> np.ndarray:
    """The hashes of whole words; each counts as one document of its own."""
    out = np.zeros(len(words), np.uint64)
    for block in blocks(pa.array(list(words), pa.string())):
        found, document = word_hashes(block, stems=False)
        out[document + block.first] = found
    return out


def stems_of(words: Sequence[str], features: np.ndarray) -> list[np.ndarray]:
    """For each word the features that are stems of it."""
    out = [np.zeros(0, np.int64)] * len(words)
    for block in blocks(pa.array(list(words), pa.string())):
        whole = len(word_hashes(block, stems=False)[0])
        found, document = (x[whole:] for x in word_hashes(block))
        known = np.isin(found, features)
        at = np.searchsorted(features, found)
        for k in range(block.documents):
            out[block.first + k] = at[known & (document == k)]
    return out


def given_twice(block: Block, features: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) for each of these stems that several different words of a document give."""
    starts, ends, document = block.spans(LETTER[block.data])
    prefix = block.prefix(LOWER_CODES)
    words = block.hashes(prefix, starts, ends)
    cells, sources = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        stem = mixed(block.hashes(prefix, starts[long], starts[long] + size) + np.uint64(size))
        known = np.isin(stem, features[stems])
        cells.append(document[long[known]] * len(features) + np.searchsorted(features, stem[known]))
        sources.append(words[long[known]])
    cell, source = np.concatenate(cells), np.concatenate(sources)
    order = np.lexsort((source, cell))
    cell, source = cell[order], source[order]
    other = np.unique(cell[1:][(cell[1:] == cell[:-1]) & (source[1:] != source[:-1])])
    return other // len(features), other % len(features)


@dataclass
class Toxicity:
    """Sorted feature hashes, their weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, block: Block) -> np.ndarray:
        document, feature = present(block, self.features)
        logit = self.intercept + np.bincount(document, self.weights[feature], minlength=block.documents)
        return _sigmoid(logit)


def present(block: Block, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) for each feature that a document has, once."""
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, document = word_hashes(block)
    at = np.searchsorted(features, words).clip(0, len(features) - 1)
    known = features[at] == words
    cells = np.unique(document[known] * len(features) + at[known])
    return cells // len(features), cells % len(features)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def word_statistics(rows: DataFrame) -> DataFrame:
    """(word, documents, toxic): in how many documents of (text, label) a word occurs, and in how many toxic ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            for block in blocks(batch.column("text")):
                words, document = word_hashes(block)
                order = np.lexsort((document, words))
                words, document = words[order], document[order]
                first = np.ones(len(words), dtype=bool)
                first[1:] = (words[1:] != words[:-1]) | (document[1:] != document[:-1])
                words, document = words[first], document[first]
                if not len(words):
                    continue
                begins = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(words[begins].view(np.int64)),
                        pa.array(np.diff(np.r_[begins, len(words)])),
                        pa.array(np.add.reduceat(label[block.first : block.last][document], begins)),
                    ],
                    ["word", "documents", "toxic"],
                )

    partial = rows.select("text", "label").mapInArrow(count, "word bigint, documents bigint, toxic bigint")
    return partial.groupBy("word").agg(F.sum("documents").alias("documents"), F.sum("toxic").alias("toxic"))


def separating_words(statistics: DataFrame, n: int, n_toxic: int, limit: int = MAX_FEATURES) -> np.ndarray:
    """Hashes of the words whose share of toxic documents is significantly above or below the average."""
    share = n_toxic / n
    expected = F.col("documents") * share
    z = (F.col("toxic") - expected) / F.sqrt(expected * (1 - share))
    rows = (
        statistics.where(F.col("documents") >= MIN_DOCUMENTS).withColumn("z", F.abs(z)).where(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "word").limit(limit).select("word")
    )
    return np.sort(rows.toArrow()["word"].to_numpy().astype(np.int64).view(np.uint64))


def swaps(kinds: Sequence[Sequence[str]], features: np.ndarray) -> list[tuple[int, int]]:
    """(feature, feature it is swapped for): each term with the next one of its kind, in a circle."""
    out = []
    for kind in kinds:
        at = np.searchsorted(features, hashes_of(kind))
        out += [(int(a), int(b)) for a, b in zip(at, np.roll(at, -1), strict=True) if a != b]
    return out


def changes(
    rows: np.ndarray, columns: np.ndarray, swapped: Sequence[tuple[int, int]], stems: dict[int, Sequence[int]], twice: set[tuple[int, int]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text of each pair, and the cells in which its swapped text differs: pair, feature, and 1 or -1.

    `stems` has the stems of each term; `twice` the cells (text, stem) that do not go with a single word.
    """
    order = np.argsort(rows, kind="stable")
    begins = np.searchsorted(rows[order], np.arange(rows.max(initial=-1) + 2))
    texts, pairs, features, signs = [], [], [], []
    for a, b in swapped:
        old, new = {a, *stems.get(a, ())}, {b, *stems.get(b, ())}
        for x in np.unique(rows[columns == a]).tolist():
            have = set(columns[order[begins[x] : begins[x + 1]]].tolist())
            gone = {f for f in old & have if (x, f) not in twice} - new
            came = new - have
            pairs += [len(texts)] * (len(gone) + len(came))
            features += [*sorted(gone), *sorted(came)]
            signs += [-1.0] * len(gone) + [1.0] * len(came)
            texts.append(x)
    return np.array(texts, np.int64), np.array(pairs, np.int64), np.array(features, np.int64), np.array(signs, float)


def fit_weights(
    rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, n_features: int, swapped: Sequence[tuple[int, int]], penalty: float,
    stems: dict[int, Sequence[int]] | None = None, twice: set[tuple[int, int]] | None = None,
) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise log loss + ridge + penalty * mean (score - score of the swapped text)^2.

    The feature matrix is given by its non-zero cells. Gradient steps with momentum, a fixed number of them. The log
    loss of a toxic text weighs as much more as toxic texts are rarer, up to `MAX_WEIGHT`.
    """
    n = len(labels)
    weight = np.where(labels > 0.5, np.clip((1 - labels.mean()) / labels.mean(), 1, MAX_WEIGHT), 1.0)
    x, pair, changed, sign = changes(rows, columns, swapped, stems or {}, twice or set())
    weights, intercept = np.zeros(n_features), float(np.log(labels.mean() / (1 - labels.mean())))
    speed, speed_0 = np.zeros(n_features), 0.0
    curvature = np.bincount(columns, weight[rows], minlength=n_features) / n * 0.25 + RIDGE + penalty / 8
    for _ in range(STEPS):
        logit = intercept + np.bincount(rows, weights[columns], minlength=n)
        score = _sigmoid(logit)
        error = (score - labels) * weight
        gradient = np.bincount(columns, error[rows], minlength=n_features) / n + RIDGE * weights
        gradient_0 = error.mean()
        if len(x):
            other = _sigmoid(logit[x] + np.bincount(pair, sign * weights[changed], minlength=len(x)))
            gap = 2 * penalty * (score[x] - other) / len(x)
            mine, theirs = gap * score[x] * (1 - score[x]), gap * other * (1 - other)
            push = np.zeros(n)
            np.add.at(push, x, mine - theirs)
            gradient += np.bincount(columns, push[rows], minlength=n_features)
            np.add.at(gradient, changed, -sign * theirs[pair])
            gradient_0 += (mine - theirs).sum()
        speed = 0.9 * speed - 0.2 * gradient / np.maximum(curvature, 0.002)
        speed_0 = 0.9 * speed_0 - 0.2 * gradient_0
        weights, intercept = weights + speed, intercept + speed_0
    return weights, float(intercept)


def fit(
    docs: DataFrame, labels: DataFrame, *, sample: int = FIT_SAMPLE, kinds: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = PENALTY,
    max_features: int = MAX_FEATURES,
) -> Toxicity:
    """Fit on (doc_id, text) and (doc_id, label): at most `sample` rows, and of them feature cells only on the driver.

    Of the words that separate the labels, the `max_features` with the highest z are learned; that bounds the model.
    """
    rows = cut_lineage(labelled_sample(docs, labels, sample))
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or n_toxic in (0, n):
        share = min(max(n_toxic / n if n else 0.5, 1e-6), 1 - 1e-6)
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    words = [word for kind in kinds for word in kind]
    terms = hashes_of(words)
    features = np.unique(np.concatenate([separating_words(word_statistics(rows), n, n_toxic, max_features), terms]))
    stems = {int(np.searchsorted(features, term)): found.tolist() for term, found in zip(terms, stems_of(words, features), strict=True)}
    of_terms = np.unique(np.array([f for found in stems.values() for f in found], np.int64))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                part = [batch.column(c).slice(block.first, block.documents) for c in ("doc_id", "label")]
                for document, feature in (present(block, features), given_twice(block, features, of_terms)):
                    cut = np.searchsorted(document, np.arange(block.documents + 1))
                    part.append(pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()))
                yield pa.RecordBatch.from_arrays(part, ["doc_id", "label", "features", "twice"])

    table = rows.select("doc_id", "label", "text").mapInArrow(cells, "doc_id bigint, label int, features binary, twice binary").distinct().toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("features", "ascending"), ("twice", "ascending")])

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        found = [np.frombuffer(x.as_buffer(), np.int32) for x in table[name]]
        at = np.repeat(np.arange(len(found)), [len(x) for x in found])
        return at, np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)

    twice = set(zip(*(x.tolist() for x in flat("twice")), strict=True))
    labels_seen = table["label"].to_numpy().astype(float)
    return Toxicity(features, *fit_weights(*flat("features"), labels_seen, len(features), swaps(kinds, features), penalty, stems, twice))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    `labels` has doc_id and toxic; only ids whose CRC-32 modulo 4 is not 2 are learned from.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label")).dropna()
    model = fit(rows, learned.where(~held_out("doc_id", 4, 2)), **fitting)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                ids = batch.column("doc_id").slice(block.first, block.documents)
                yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(block))], ["doc_id", "score"])

    return rows.mapInArrow(score, "doc_id bigint, score double").select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
