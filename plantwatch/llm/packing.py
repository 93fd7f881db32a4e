"""Sum-of-squares online packing of tokenised documents into windows of a fixed length.

Documents longer than a window give whole windows first. What is left of each, and every shorter document, is placed
online into one of the partially filled windows or a new one: the choice that leaves the smallest sum of squared counts
of open windows per fill level, read from an array of counts by level (ties: the fullest). Each task packs its own
documents. Windows that are open at its end, or when `max_open` are, are emptied and their pieces laid end to
end, cut at the window length; the last rest is cut into powers of two, which need no padding. So no sequence is padded.

Nulls: a null text is empty; a document is then its end mark alone. A null id is carried as it is. Every row is packed,
repeated ones as often as they occur. Ties cannot arise: order within a task is the order of its rows. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.bpe import encoder
from plantwatch.llm.textblocks import blocks

WINDOW = 2048
END_ID = 1
MAX_OPEN = 4096
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


class Packer:
    """The open windows of one task. Pieces are (doc_id, doc_tokens, start, ids); closed windows become rows."""

    def __init__(self, window: int, first_sequence: int, max_open: int = MAX_OPEN):
        self.window = window
        self.next_sequence = first_sequence
        self.max_open = max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, window = len(ids), self.window
        whole = n // window * window
        for start in range(0, whole, window):
            self._close([(doc_id, n, start, ids[start : start + window])])
        if whole < n:
            self._place((doc_id, n, whole, ids[whole:].copy()))

    def level_for(self, size: int) -> int:
        """The fill level whose window takes a piece of `size` at the smallest sum of squares; 0 opens a window."""
        counts, window = self.counts, self.window
        change = 2 * (counts[size : window + 1] - counts[: window + 1 - size]) + 2
        change[0] = 2 * counts[size] + 1
        change[-1] = 1 - 2 * counts[window - size]
        possible = counts[: window + 1 - size] > 0
        possible[0] = True
        change[~possible] = np.iinfo(np.int64).max
        return len(change) - 1 - int(change[::-1].argmin())

    def _place(self, piece: tuple) -> None:
        size = len(piece[3])
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self._close(pieces)
            return
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.settle()

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, n, start, ids in pieces:
            crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
            self.rows.append((doc_id, start, len(ids), crc, n, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1

    def settle(self) -> None:
        """Empty the open windows without padding, fullest first."""
        pieces = [p for level in reversed(self.open) for window in level for p in window]
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.n_open = 0
        left = sum(len(p[3]) for p in pieces)
        sequence: list[tuple] = []
        room = self._room(left)
        for doc_id, n, start, ids in pieces:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                sequence.append((doc_id, n, start, part))
                start += len(part)
                room -= len(part)
                left -= len(part)
                if not room:
                    self._close(sequence)
                    sequence, room = [], self._room(left)

    def _room(self, left: int) -> int:
        return self.window if left >= self.window else (1 << (left.bit_length() - 1) if left else 0)

    def take(self) -> pa.RecordBatch:
        columns = [*zip(*self.rows, strict=True)] or [()] * 7
        self.rows = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece of a document: where it starts in it, its sequence and its place there.

    `tokenizer` is the path of the vocabulary on every executor. Sequence ids hold the task's number in their upper bits.
    Packing needs no shuffle; a lost task is repeated over the same rows and gives the same sequences.
    """
    if window & (window - 1):
        raise ValueError("the window has to be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 32, max_open)
        tokens = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for block in blocks(batch.column("text")):
                ids, counts = tokens.encode(block)
                cut = np.concatenate([[0], np.cumsum(counts)]).tolist()
                for k in range(block.documents):
                    packer.add(ids_of[block.first + k], np.concatenate([ids[cut[k] : cut[k + 1]], end]))
                yield packer.take()
        packer.settle()
        yield packer.take()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
