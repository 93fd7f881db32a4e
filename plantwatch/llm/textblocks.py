"""Texts of an Arrow batch as numpy arrays: bytes, words and their hashes, a block of documents at a time.

A block holds whole documents, about `BLOCK_BYTES` of them, or a single longer one. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
WORD_BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IN_WORD = np.ones(256, dtype=bool)
IN_WORD[list(WORD_BREAKS)] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the hash base and of its inverse, modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        for k, base in enumerate((_STEP, _BACK)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mixed(x * np.uint64(0xD6E8FEB86659FD93) + (y ^ np.uint64(0x2545F4914F6CDD1D)))


@dataclass
class Block:
    """Documents `first` to `last` of a batch; document k has data[offsets[k]:offsets[k + 1]]."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def documents(self) -> int:
        return self.last - self.first

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def spans(self, inside: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the maximal runs where `inside` holds; runs end with their document.

        A run is also cut in front of each position in `cuts`, which have to be inside with the position before them.
        """
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        if cuts is not None:
            begin[cuts] = True
            end[cuts - 1] = True
        full = self.offsets[1:] > self.offsets[:-1]
        first, last = self.offsets[:-1][full], self.offsets[1:][full] - 1
        begin[first] = inside[first]
        end[last] = inside[last]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(IN_WORD[self.data])

    def prefix(self, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
        """Prefix sums from which `hashes` takes the hash of any span."""
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes[self.data] * powers(n)[0][:n], out=total[1:])
        return total

    def hashes(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span; equal spans have equal hashes."""
        raw = (prefix[ends] - prefix[starts]) * powers(len(self.data))[1][starts]
        return mixed(raw + (ends - starts).astype(np.uint64))

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES, block_documents: int = 4096) -> Iterator[Block]:
    """The texts of an Arrow string or binary array, at most `block_documents` in a block."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), first + block_documents, len(texts))
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def block_of(pieces: np.ndarray, lengths: np.ndarray) -> Block:
    """A block of texts given by their concatenated bytes and their lengths."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return Block(0, len(lengths), pieces, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths - starts, lengths)
