"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes of a text chooses chunk ends, so the same passage falls into the same chunks
wherever it occurs. Chunks are known by a 128-bit hash of their bytes. A chunk that several documents hold is encoded
once, by the first of them, and its ids are dealt to all; the others are encoded where they are. A chunk encoded alone
may be wrong at its two ends, where a word was cut: the words around each join are encoded again as one text, and once
more with a word on either side, and the range grows until both agree exactly. Ids then decode through the vocabulary.

Nulls: a null text counts as empty, with no ids. Null ids are carried. Rows equal in id and text get the same result.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.bpe import Encoder, encoder
from plantwatch.llm.common import packed_blocks, packed_texts
from plantwatch.llm.textblocks import Block, block_of, blocks, ragged

MASK_BITS = 10
MAX_CHUNK = 1 << 14
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def chunk_ends(block: Block, mask_bits: int = MASK_BITS, max_chunk: int = MAX_CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all documents, ascending, and the document of each. Chunks end between characters."""
    data = block.data
    roll = GEAR[data]
    for k in range(5):
        step = 1 << k
        roll[step:] += roll[:-step] << np.uint32(step)
    found = np.flatnonzero((roll >> np.uint32(32 - mask_bits)) == 0) + 1
    # A hash that reaches over the start of its document is not its own.
    found = found[found - block.offsets[np.searchsorted(block.offsets, found, side="left") - 1] >= 32] if len(found) else found
    whole = block.offsets[1:][block.offsets[1:] > block.offsets[:-1]]
    ends = np.unique(np.concatenate([found, whole]))
    gaps = np.diff(np.concatenate([[0], ends]))
    for k in np.flatnonzero(gaps > max_chunk):
        ends = np.concatenate([ends, np.arange(ends[k] - gaps[k] + max_chunk, ends[k], max_chunk)])
    ends = np.unique(ends)
    while True:
        inner = ends[ends < len(data)]
        bad = inner[(data[inner] & 0xC0) == 0x80]
        if not len(bad):
            break
        ends = np.unique(np.where(np.isin(ends, bad), ends + 1, ends))
    return ends, np.searchsorted(block.offsets, ends, side="left") - 1


def chunk_keys(block: Block, ends: np.ndarray) -> list[bytes]:
    raw = block.data.tobytes()
    starts = [0, *ends[:-1].tolist()] if len(ends) else []
    return [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts, ends.tolist(), strict=True)]


def cores(block: Block, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunks with a core, as indices into `ends`, and where the cores start and end.

    A core goes from the first break (space, tab, line end) in its chunk to the last one, both included. It depends
    on the bytes of the chunk alone, and no token reaches over its two ends.
    """
    breaks = np.flatnonzero(SPACE[block.data])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    first, behind = np.searchsorted(breaks, starts), np.searchsorted(breaks, ends)
    has = np.flatnonzero(behind > first)
    return has, breaks[first[has]], breaks[behind[has] - 1] + 1


def _encode_spans(tokens: Encoder, block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = ends - starts
    return tokens.encode(block_of(block.data[ragged(starts, lengths)], lengths))


def _each(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    cut = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def repaired_joins(tokens: Encoder, block: Block, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Ids of the ranges [begin, end), widened by words inside [low, high) until a second encoding agrees.

    The second encoding of each range has one more word on either side; the range's ids have to be found in it
    between those of the two words alone. Where they are not, the range takes these words in and is tried again.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(begin)
    todo = np.arange(len(begin))
    begin, end = begin.copy(), end.copy()
    while len(todo):
        b, e = begin[todo], end[todo]
        left, right = _word_before(block, b, low[todo]), _word_after(block, e, high[todo])
        own = _each(*_encode_spans(tokens, block, b, e))
        wide = _each(*_encode_spans(tokens, block, left, right))
        before = _each(*_encode_spans(tokens, block, left, b))
        after = _each(*_encode_spans(tokens, block, e, right))
        again = []
        for k, at in enumerate(todo):
            if np.array_equal(np.concatenate([before[k], own[k], after[k]]), wide[k]):
                out[at] = own[k]
            else:
                begin[at], end[at] = left[k], right[k]
                again.append(at)
        todo = np.array(again, dtype=np.int64)
    return out


def _word_before(block: Block, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Start of the word in front of each position, not below `low`."""
    begins = np.flatnonzero(~SPACE[block.data] & np.concatenate([[True], SPACE[block.data[:-1]]]))
    k = np.searchsorted(begins, at) - 1
    return np.maximum(np.where(k >= 0, begins[k.clip(0)] if len(begins) else 0, 0), low)


def _word_after(block: Block, at: np.ndarray, high: np.ndarray) -> np.ndarray:
    """End of the word behind each position, not above `high`."""
    stops = np.flatnonzero(~SPACE[block.data] & np.concatenate([SPACE[block.data[1:]], [True]])) + 1
    k = np.searchsorted(stops, at, side="right")
    known = k < len(stops)
    return np.minimum(np.where(known, stops[k.clip(0, max(len(stops) - 1, 0))] if len(stops) else 0, len(block.data)), high)


def encode_chunked(tokens: Encoder, block: Block, reused: list[dict[bytes, bytes]]) -> list[np.ndarray]:
    """Ids of each document of a block; `reused` has, per document, ids of the cores of chunks encoded elsewhere."""
    ends, of_end = chunk_ends(block)
    has, begin, end = cores(block, ends)
    document = of_end[has]
    if any(reused):
        keys = chunk_keys(block, ends)
        ready = [reused[d].get(keys[k]) for d, k in zip(document.tolist(), has.tolist(), strict=True)]
    else:
        ready = [None] * len(has)
    own = np.array([k for k, ids in enumerate(ready) if ids is None], dtype=np.int64)
    encoded = iter(_each(*_encode_spans(tokens, block, begin[own], end[own])))
    core_ids = [next(encoded) if ids is None else np.frombuffer(ids, np.uint32) for ids in ready]
    # What lies between the cores of a document, in front of the first and behind the last of them.
    n = block.documents
    seen = np.concatenate([[0], np.cumsum(np.bincount(document, minlength=n))])
    gap_from, gap_to = np.zeros(len(has) + n, np.int64), np.zeros(len(has) + n, np.int64)
    which = np.arange(len(has)) + document
    gap_from[seen[:-1] + np.arange(n)], gap_to[seen[1:] + np.arange(n)] = block.offsets[:-1], block.offsets[1:]
    gap_from[which + 1], gap_to[which] = end, begin
    owner = np.repeat(np.arange(n), np.diff(seen) + 1)
    some = np.flatnonzero(gap_to > gap_from)
    low, high = block.offsets[owner[some]], block.offsets[owner[some] + 1]
    gap_ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(gap_from)
    for k, ids in zip(some.tolist(), repaired_joins(tokens, block, gap_from[some], gap_to[some], low, high), strict=True):
        gap_ids[k] = ids
    out = []
    for d in range(n):
        a, b = int(seen[d]), int(seen[d + 1])
        parts = [gap_ids[a + d]]
        for k in range(a, b):
            parts += [core_ids[k], gap_ids[k + d + 1]]
        out.append(np.concatenate(parts))
    return out


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """The text of every token, by id, as the library's decoder gives it: separated by spaces where it has no decoder."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    if described["decoder"] is not None:
        raise ValueError("only vocabularies without a decoder are handled")
    words = dict(described["model"]["vocab"]) | {t["content"]: t["id"] for t in described["added_tokens"]}
    out = np.empty(max(words.values()) + 1, dtype=object)
    out[:] = b""
    for word, k in words.items():
        out[k] = word.encode()
    return out


def decoded(ids: np.ndarray, words: np.ndarray) -> bytes:
    return b" ".join(words[ids].tolist())


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uids = batch.column("uid").to_numpy()
        for block in blocks(batch.column("text")):
            ends, document = chunk_ends(block)
            has, _, _ = cores(block, ends)
            keys = chunk_keys(block, ends)
            rows = sorted({(int(document[k]), keys[k]) for k in has.tolist()})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uids[block.first : block.last][[d for d, _ in rows]] if rows else uids[:0]),
                    pa.array([key for _, key in rows], pa.binary()),
                ],
                ["uid", "key"],
            )


def shared_chunks(docs: DataFrame) -> DataFrame:
    """(uid, key, owner) for each chunk of (doc_id, text) that several documents hold; the owner is to encode it."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("uid"), "text").mapInArrow(_chunk_rows, "uid bigint, key binary")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("uid").alias("owner")).where("n > 1")
    return rows.join(shared.select("key", "owner").hint("merge"), "key")


def encoded_chunks(placed: DataFrame, refs: DataFrame, tokenizer: str) -> DataFrame:
    """(key, ids): each shared chunk's core, encoded by the document that owns it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            batch = batch.filter(batch.column("keys").is_valid())
            wanted = [set(keys) for keys in batch.column("keys").to_pylist()]
            for block in packed_blocks(batch.column("packed")):
                ends, document = chunk_ends(block)
                has, begin, end = cores(block, ends)
                keys = chunk_keys(block, ends)
                found = {}
                for j, k in enumerate(has.tolist()):
                    if keys[k] in wanted[block.first + document[k]]:
                        found[keys[k]] = j
                at = np.array(list(found.values()), np.int64)
                ids = _each(*_encode_spans(tokens, block, begin[at], end[at]))
                columns = [pa.array(list(found), pa.binary()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids"])

    owned = refs.where("uid = owner").groupBy("uid").agg(F.collect_set("key").alias("keys"))
    # A left join with every column, as below, so that the texts are moved once for both; documents that own nothing skip.
    rows = placed.join(owned.hint("merge"), "uid", "left").select("doc_id", "packed", "keys")
    return rows.mapInArrow(encode, "key binary, ids binary").dropDuplicates(["key"])


def encode_corpus(docs: DataFrame, tokenizer: str, schema: str, rows_of) -> DataFrame:
    """Run `rows_of(ids of the documents, list of id arrays)` over all documents; it returns the columns of `schema`.

    Texts are moved once, packed; only ids of shared chunks meet them. `tokenizer` is the vocabulary's path on every
    executor.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = packed_texts(docs)
    refs = shared_chunks(docs)
    encoded = encoded_chunks(placed, refs, tokenizer)
    dealt = refs.select("uid", "key").distinct().join(encoded.hint("merge"), "key")
    lists = dealt.groupBy("uid").agg(F.collect_list("key").alias("keys"), F.collect_list("ids").alias("ids"))
    joined = placed.join(lists.hint("merge"), "uid", "left").select("doc_id", "packed", "keys", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            keys, ids = batch.column("keys").to_pylist(), batch.column("ids").to_pylist()
            reused = [dict(zip(k, i, strict=True)) if k else {} for k, i in zip(keys, ids, strict=True)]
            for block in packed_blocks(batch.column("packed")):
                found = encode_chunked(tokens, block, reused[block.first : block.last])
                yield rows_of(batch.column("doc_id").slice(block.first, block.documents), found)

    return joined.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each document's ids and of their decoded text."""

    def digests(doc_ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
        words = token_bytes(tokenizer)
        return pa.RecordBatch.from_arrays(
            [
                doc_ids,
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]),
                pa.array([hashlib.sha256(decoded(x, words)).hexdigest() for x in found]),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return encode_corpus(docs, tokenizer, SCHEMA, digests)
