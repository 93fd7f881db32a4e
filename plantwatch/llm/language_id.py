"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts of order 0 to 3 holds how often each byte followed. A byte seen in its longest
context costs -log2(c / (n + u)) bits there (n bytes and u distinct bytes followed the context); one not seen costs
the escape, -log2(u / (n + u)), and then its cost in the context one byte shorter, down to 1/256 for each byte. The
statistics are frozen after training, so the cost of every (context, byte) is a constant: it is worked out once, in
1/512 bit, and a text's code length in a language is an exact integer sum. The shortest code wins.

Nulls: a null text, or one without a letter, is `und` with score 0; so is every text when no language was learned.
Null ids are kept and never learned from. Repeated rows get the same answer and, equal in id and text, are learned from
once. Ties go to the language whose name sorts first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.llm.common import held_out
from plantwatch.operators.ordered import top_per_key
from plantwatch.llm.textblocks import Block, blocks

FIT_DOCUMENTS = 400
UNIT = 512
PAD = 0x0A
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True


def _before(symbols: np.ndarray, block: Block, back: int, pad: int) -> np.ndarray:
    """The symbol `back` places earlier in the same document, `pad` before its start."""
    out = np.empty_like(symbols)
    out[back:] = symbols[: len(symbols) - back]
    out[:back] = pad
    for k in range(back):
        at = block.offsets[:-1] + k
        out[at[at < block.offsets[1:]]] = pad
    return out


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): how often three bytes and the byte after them occur in the texts of (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for block in blocks(batch.column("text")):
                data = block.data
                if not len(data):
                    continue
                gram = data.astype(np.uint32)
                for back in (1, 2, 3):
                    gram |= _before(data, block, back, PAD).astype(np.uint32) << np.uint32(8 * back)
                owner = langs[block.first : block.last].repeat(np.diff(block.offsets))
                for lang in sorted(set(owner)):
                    grams, n = np.unique(gram[owner == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                    )

    partial = rows.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Languages:
    """Costs of every context and byte. Bytes are numbered by `symbol`; `row` names a context's line in `cost`."""

    names: list[str]
    symbol: np.ndarray
    size: int
    row: np.ndarray
    cost: np.ndarray

    def code_lengths(self, block: Block) -> np.ndarray:
        """Documents x languages, in 1/UNIT bit."""
        n, langs = block.documents, len(self.names)
        if not len(block.data):
            return np.zeros((n, langs), np.int64)
        own = self.symbol[block.data].astype(np.int64)
        pad = int(self.symbol[PAD])
        context = _before(own, block, 3, pad)
        for back in (2, 1):
            context *= self.size
            context += _before(own, block, back, pad)
        at = self.row[context].astype(np.int64) * self.size + own
        out = np.zeros((n, langs), np.int64)
        total = np.zeros(len(at) + 1, np.int64)
        for k in range(langs):
            np.cumsum(self.cost[k][at], dtype=np.int64, out=total[1:])
            out[:, k] = total[block.offsets[1:]] - total[block.offsets[:-1]]
        return out


def frozen(counts: pa.Table) -> Languages:
    """Cost tables from the gram counts of a bounded sample."""
    names = sorted(set(counts["lang"].to_pylist()))
    gram = counts["gram"].to_numpy()
    used = np.unique(np.concatenate([(gram >> shift) & 255 for shift in (0, 8, 16, 24)] + [np.array([PAD])])).astype(np.int64)
    size = len(used) + 1  # the last number stands for all bytes that were never seen
    symbol = np.full(256, size - 1, dtype=np.int64)
    symbol[used] = np.arange(size - 1)
    owner = np.searchsorted(names, np.array(counts["lang"].to_pylist()))
    digits = [symbol[(gram >> shift) & 255] for shift in (24, 16, 8, 0)]
    deep = np.unique((digits[0] * size + digits[1]) * size + digits[2])
    row = np.tile(np.arange(size * size, dtype=np.int32) + len(deep), size)
    row[deep] = np.arange(len(deep), dtype=np.int32)
    cost = np.zeros((len(names), (len(deep) + size * size) * size), np.uint16)
    for k in range(len(names)):
        mine = owner == k
        d = [x[mine] for x in digits]
        n = counts["n"].to_numpy()[mine].astype(float)
        lower = np.full(size, 1 / 256)
        shares = _refined(np.bincount(d[3], n, size)[None, :], lower[None, :])
        one = _refined(np.bincount(d[2] * size + d[3], n, size**2).reshape(size, size), np.broadcast_to(shares, (size, size)))
        two = np.bincount((d[1] * size + d[2]) * size + d[3], n, size**3).reshape(size * size, size)
        two = _refined(two, np.tile(one, (size, 1)))
        at = np.searchsorted(deep, (d[0] * size + d[1]) * size + d[2])
        three = np.bincount(at * size + d[3], n, len(deep) * size).reshape(len(deep), size)
        three = _refined(three, two[deep % (size * size)])
        bits = -np.log2(np.concatenate([three, two]).ravel())
        cost[k] = np.minimum(np.rint(bits * UNIT), 65535).astype(np.uint16)
    return Languages(names, symbol, size, row, cost)


def _refined(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in contexts (rows) from their counts and those in the contexts one byte shorter."""
    total = counts.sum(axis=1, keepdims=True)
    distinct = (counts > 0).sum(axis=1, keepdims=True)
    whole = np.maximum(total + distinct, 1)
    out = np.where(counts > 0, counts / whole, distinct / whole * shorter)
    return np.where(total > 0, out, shorter)


def sample_per_language(rows: DataFrame, limit: int) -> DataFrame:
    """(lang, doc_id, text) of at most `limit` different rows of each language, those with the smallest hash of id and text.

    A language that owns most rows is cut in every task, then per salt, before its rows meet.
    """
    named = rows.select("lang", "doc_id", F.xxhash64("text").alias("_text")).distinct()
    drawn = named.withColumn("_draw", F.xxhash64("doc_id", "_text", F.lit("lang")))
    ids = top_per_key(drawn, ["lang"], ["_draw", "doc_id", "_text"], limit).select("lang", "doc_id", "_text")
    chosen = rows.withColumn("_text", F.xxhash64("text")).join(ids, ["lang", "doc_id", "_text"])
    return chosen.dropDuplicates(["lang", "doc_id", "_text"]).select("lang", "doc_id", "text")


def _has_letter(block: Block) -> np.ndarray:
    out = block.per_document(LETTER[block.data]) > 0
    for k in np.flatnonzero(~out & (block.per_document(block.data >= 128) > 0)):
        out[k] = any(map(str.isalpha, block.text(k).decode("utf-8", "replace")))
    return out


def language_id(docs: DataFrame, *, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits) of every document of (doc_id, text, lang).

    Learned from at most `fit_documents` documents of each language, out of those with a language and an id whose
    CRC-32 modulo 4 is not 2. `score` is the share of the predicted language when each language's probability is 2^-bits.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))
    counts = gram_counts(sample_per_language(known, fit_documents)).toArrow()
    model = frozen(counts.sort_by([("lang", "ascending"), ("gram", "ascending")])) if counts.num_rows else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                ids = batch.column("doc_id").slice(block.first, block.documents)
                if model is None:
                    names, score, bits = ["und"] * block.documents, np.zeros(block.documents), np.zeros(block.documents)
                else:
                    length = model.code_lengths(block)
                    best = length.argmin(axis=1)
                    least = length[np.arange(len(best)), best]
                    known = _has_letter(block)
                    share = 1 / np.exp2(np.maximum(-(length - least[:, None]) / UNIT, -1000)).sum(axis=1)
                    names = [model.names[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                    score, bits = np.where(known, share, 0.0), least / UNIT
                columns = [ids, pa.array(names, pa.string()), pa.array(score), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "bits"])

    found = rows.select("doc_id", "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double, bits double")
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "bits")
