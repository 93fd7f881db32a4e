"""Exact removal of long repeats across documents, by suffix arrays over the passages that can hold them.

Every byte covered by a string of `length` bytes that also starts earlier (in a document with a smaller id, or earlier in the same one) goes.

1. Anchors. Each window of `length` bytes chooses the 24-byte gram in it with the smallest hash, the leftmost of equals.
   Equal windows choose alike, so a window whose anchor gram occurs once in the corpus is unique. Grams seen several
   times in a batch are known at once and send one row on, so no frequent gram gathers in one task.
2. Slices. Neighbouring windows with one anchor form a slice of less than 2 `length` bytes. Slices of anchors that recur are dealt
   by anchor, each text once per batch with its first place. An anchor with many different surroundings in a bounded
   sample of documents has its windows dealt one by one, by their own bytes.
3. Suffix array. Each task sorts the suffixes of its distinct slices (`suffix_groups`); neighbours in that order which
   share `length` bytes are the repeats, and all but the first place of each is a repeat start.
4. Removal. A slice text belongs to the document where it starts first; its repeat starts are sent there. In all other
   places each of its windows repeats an earlier one. Documents then remove what the repeat starts cover.

Nulls: a null text counts as empty. Rows with a null id come after all others; rows that share an id but not the text are
documents of their own, in order of a hash of id and text; rows equal in both are one document, with the same result. Ties
are impossible otherwise. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.common import bounded_sample, others, packed_blocks, packed_texts
from plantwatch.llm.recurring import SCHEMA, recurring, routed
from plantwatch.llm.suffix_groups import Strings, suffix_array
from plantwatch.llm.textblocks import Block, blocks, ragged

LENGTH, GRAM = 100, 24
SAMPLE_DOCUMENTS, WIDE = 20_000, 100
SORT_BYTES = 1 << 19
SLICES = "route bigint, text binary, anchor int, doc_id bigint, uid bigint, start bigint"
NO_ID = np.iinfo(np.int64).max


class Anchors:
    """The windows of a block: start, document, place and hash of the anchor; and the slices they form."""

    def __init__(self, block: Block, length: int, gram: int):
        data, n = block.data, len(block.data)
        self.starts = self.at = self.keys = self.document = np.zeros(0, np.int64)
        self.first = self.last = self.slice_keys = self.slice_document = self.slice_at = np.zeros(0, np.int64)
        if n < length:
            return
        grams = np.arange(n - gram + 1)
        hashes = block.hashes(block.prefix(), grams, grams + gram)
        least = (hashes >> np.uint64(32) << np.uint64(32)) | grams.astype(np.uint64)
        size, span = length - gram + 1, 1
        while span * 2 <= size:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if size > span:
            least = np.minimum(least[: len(least) - (size - span)], least[size - span :])
        sizes = np.maximum(np.diff(block.offsets) - length + 1, 0)
        self.starts = ragged(block.offsets[:-1], sizes)
        self.document = np.repeat(np.arange(block.documents), sizes)
        self.at = (least[self.starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.keys = hashes[self.at].view(np.int64)
        new = np.ones(len(self.starts), dtype=bool)
        new[1:] = (self.at[1:] != self.at[:-1]) | (self.document[1:] != self.document[:-1])
        begins = np.flatnonzero(new)
        self.first = self.starts[begins]
        self.last = self.starts[np.concatenate([begins[1:] - 1, [len(new) - 1]])] if len(new) else begins
        self.slice_keys, self.slice_document, self.slice_at = self.keys[begins], self.document[begins], self.at[begins]


def _gram_rows(length: int, gram: int) -> Callable:
    """Rows (route, gram, uid, many): where each anchor gram occurs, and whether more than one place is known of."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            keys, owners = [], []
            for block in blocks(batch.column("text")):
                found = Anchors(block, length, gram)
                keys.append(found.slice_keys)
                owners.append(uids[block.first : block.last][found.slice_document])
            if not keys:
                continue
            yield routed(np.concatenate(keys), np.concatenate(owners))

    return rows


def recurring_grams(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(uid, gram): the anchor grams of each document of (doc_id, text) that occur in more than one place."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("uid"), "text")
    return recurring(rows.mapInArrow(_gram_rows(length, gram), SCHEMA))


def wide_grams(docs: DataFrame, length: int, gram: int, sample: int, wide: int) -> np.ndarray:
    """Grams with more than `wide` different slice texts in a bounded sample: at most a few per sampled document."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                found = Anchors(block, length, gram)
                texts = block.hashes(block.prefix(), found.first, found.last + length)
                cells = np.unique(np.stack([found.slice_keys, texts.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cells[0]), pa.array(cells[1])], ["gram", "context"])

    ids = bounded_sample(docs, "doc_id", sample)
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(contexts, "gram bigint, context bigint")
    counts = rows.distinct().groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > wide)
    return np.sort(counts.select("gram").toArrow()["gram"].to_numpy().astype(np.int64))


def _has(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    return sorted_values[np.searchsorted(sorted_values, x).clip(0, len(sorted_values) - 1)] == x


def _in_list(found: Anchors, lists: list[np.ndarray | None]) -> np.ndarray:
    """Of each slice, whether its anchor is in the list of its document."""
    out = np.zeros(len(found.slice_keys), dtype=bool)
    cut = np.searchsorted(found.slice_document, np.arange(len(lists) + 1))
    for d, grams in enumerate(lists):
        if grams is not None and cut[d] < cut[d + 1]:
            out[cut[d] : cut[d + 1]] = np.isin(found.slice_keys[cut[d] : cut[d + 1]], grams)
    return out


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]


def _units(found: Anchors, some: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, slice) of what is dealt: whole slices, or single windows where the anchor is wide."""
    split = some[_has(wide, found.slice_keys[some])]
    whole = some[~_has(wide, found.slice_keys[some])]
    sizes = found.last[split] - found.first[split] + 1
    single = ragged(found.first[split], sizes)
    return (
        np.concatenate([found.first[whole], single]),
        np.concatenate([found.last[whole], single]),
        np.concatenate([whole, np.repeat(split, sizes)]),
    )


def _slice_rows(length: int, gram: int, wide: np.ndarray) -> Callable:
    """Rows (route, text, anchor, doc_id, uid, start): each recurring slice text of a batch once, at its first place in it.

    `anchor` is where the anchor gram stands in the text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("grams").is_valid())
            ids, uids = batch.column("doc_id").fill_null(NO_ID).to_numpy(), batch.column("uid").to_numpy()
            lists = _lists(batch.column("grams"))
            seen: dict[bytes, tuple[int, int, int, int, int]] = {}
            for block in packed_blocks(batch.column("packed")):
                found = Anchors(block, length, gram)
                some = np.flatnonzero(_in_list(found, lists[block.first : block.last]))
                first, last, of_slice = _units(found, some, wide)
                split = first == last
                route = found.slice_keys[of_slice]
                own = block.hashes(block.prefix(), first, last + length).view(np.int64)
                route = np.where(split & _has(wide, route), own, route)
                document = found.slice_document[of_slice]
                place = first - block.offsets[document]
                anchor = np.where(split & _has(wide, found.slice_keys[of_slice]), 0, found.slice_at[of_slice] - first)
                raw = block.data.tobytes()
                doc, uid = ids[document + block.first].tolist(), uids[document + block.first].tolist()
                for a, b, *here in zip(
                    first.tolist(), (last + length).tolist(), doc, uid, place.tolist(), route.tolist(), anchor.tolist(), strict=True
                ):
                    text, here = raw[a:b], tuple(here)
                    known = seen.get(text)
                    if known is None or here < known:
                        seen[text] = here
            if seen:
                doc, uid, start, route, anchor = zip(*seen.values(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route, pa.int64()), pa.array(list(seen), pa.binary()), pa.array(anchor, pa.int32())]
                    + [pa.array(x, pa.int64()) for x in (doc, uid, start)],
                    ["route", "text", "anchor", "doc_id", "uid", "start"],
                )

    return rows


def repeat_starts(texts: list[bytes], places: list[tuple[int, int, int]], length: int) -> list[np.ndarray]:
    """For each distinct text, at its first place, the starts in it whose window also starts at an earlier place."""
    lengths = np.array([len(x) for x in texts], np.int64)
    strings = Strings.of(np.frombuffer(b"".join(texts), np.uint8), lengths)
    order = suffix_array(strings)
    shares = strings.share(order[1:], order[:-1], length)
    run = np.cumsum(np.concatenate([np.zeros(min(len(order), 1), np.int64), ~shares]))
    inside = np.flatnonzero(np.bincount(run, minlength=1)[run] > 1)
    firsts = np.cumsum(lengths + 1) - lengths - 1
    at, run = order[inside], run[inside]
    text = np.searchsorted(firsts, at, side="right") - 1
    offset = at - firsts[text]
    place = np.array(places, np.int64).reshape(-1, 3)[text]
    rank = np.lexsort((place[:, 2] + offset, place[:, 1], place[:, 0], run))
    first = np.ones(len(rank), dtype=bool)
    first[1:] = run[rank][1:] != run[rank][:-1]
    repeats = rank[~first]
    text, offset = text[repeats], offset[repeats]
    by_text = np.lexsort((offset, text))
    cut = np.searchsorted(text[by_text], np.arange(len(texts) + 1))
    return [offset[by_text[a:b]] for a, b in zip(cut, cut[1:], strict=False)]


def shared_ranges(texts: list[bytes], anchors: np.ndarray, group: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each text that can lie in a window of another text of its group: [from, to).

    Windows with one anchor gram can only be equal where the texts agree from the gram outwards. So the part reaches to
    the left and to the right as far as the longest agreement with any other text, found next to it in sorted order.
    """
    left = [x[:a][::-1] for x, a in zip(texts, anchors.tolist(), strict=True)]
    right = [x[a + gram :] for x, a in zip(texts, anchors.tolist(), strict=True)]
    return anchors - _longest_agreement(left, group), anchors + gram + _longest_agreement(right, group)


def _longest_agreement(sides: list[bytes], group: np.ndarray) -> np.ndarray:
    sizes = np.array([len(x) for x in sides], np.int64)
    width = max(int(sizes.max(initial=0)), 1)
    table = np.zeros((len(sides), width), np.int16)
    table.ravel()[ragged(np.arange(len(sides)) * width, sizes)] = np.frombuffer(b"".join(sides), np.uint8).astype(np.int16) + 1
    keys = np.ascontiguousarray(table.astype(">i2")).view(f"V{2 * width}").ravel()
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    rows = table[order]
    agree = np.logical_and.accumulate((rows[1:] == rows[:-1]) & (rows[1:] > 0), axis=1).sum(axis=1)
    agree[group[order][1:] != group[order][:-1]] = 0
    out = np.zeros(len(sides), np.int64)
    out[order[1:]] = agree
    out[order[:-1]] = np.maximum(out[order[:-1]], agree)
    return out


def repeats_of_slices(texts: list[bytes], places: list[tuple[int, int, int]], anchors: np.ndarray, group: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """For each distinct slice text of a group, at its first place, the starts in it whose window also starts earlier.

    Slices are cut to what another slice of their group can share; equal cuts are one string, which starts at the earliest of
    their places, and in all later ones each of its windows is a repeat. The suffix array is built over these strings.
    """
    out = [np.zeros(0, np.int64)] * len(texts)
    low, high = shared_ranges(texts, anchors, group, gram)
    some = np.flatnonzero(high - low >= length).tolist()
    strings: dict[tuple[int, bytes], tuple[tuple[int, int, int], int]] = {}
    for k in some:
        doc, uid, start = places[k]
        key, here = (int(group[k]), texts[k][low[k] : high[k]]), ((doc, uid, start + int(low[k])), k)
        known = strings.get(key)
        strings[key] = here if known is None else min(known, here)
        later = k if known is None or here > known else known[1]
        if known is not None:
            out[later] = np.arange(low[later], high[later] - length + 1)
    if strings:
        found = repeat_starts([text for _, text in strings], [place for place, _ in strings.values()], length)
        for (_, k), starts in zip(strings.values(), found, strict=True):
            out[k] = starts + low[k]
    return out


def _first_places(length: int, gram: int) -> Callable:
    """Rows (uid, start, windows, repeats) for each distinct slice text, from rows sorted by route."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        places: list[tuple[int, int, int]] = []
        anchors: list[int] = []
        groups: list[int] = []
        group: dict[bytes, tuple[int, int, int, int]] = {}
        held, route, number = 0, None, 0

        def close_group() -> None:
            nonlocal held, number
            number += 1
            for text, (doc, uid, start, anchor) in group.items():
                texts.append(text)
                places.append((doc, uid, start))
                anchors.append(anchor)
                groups.append(number)
                held += len(text)
            group.clear()

        def flush() -> pa.RecordBatch:
            nonlocal held
            number = np.array(groups, np.int64)
            repeats = [np.zeros(0, np.int64)] * len(texts)
            # A text alone in its group is a string that nothing else can share a window with.
            several = np.flatnonzero(np.bincount(number)[number] > 1) if len(number) else number
            if len(several):
                found = repeats_of_slices(
                    [texts[k] for k in several], [places[k] for k in several], np.array(anchors, np.int64)[several], number[several], length, gram
                )
                for k, starts in zip(several.tolist(), found, strict=True):
                    repeats[k] = starts
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([p[1] for p in places], pa.int64()),
                    pa.array([p[2] for p in places], pa.int32()),
                    pa.array([len(t) - length + 1 for t in texts], pa.int32()),
                    pa.array([r.astype(np.int16).tobytes() for r in repeats], pa.binary()),
                ],
                ["uid", "start", "windows", "repeats"],
            )
            for held_list in (texts, places, anchors, groups):
                held_list.clear()
            held = 0
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("route", "text", "doc_id", "uid", "start", "anchor")]
            for r, text, *here in zip(*columns, strict=True):
                if r != route:
                    close_group()
                    route = r
                    if held >= SORT_BYTES:
                        yield flush()
                here = tuple(here)
                known = group.get(text)
                if known is None or here < known:
                    group[text] = here
        close_group()
        if texts:
            yield flush()

    return rows


def removed_spans(block: Block, found: Anchors, recurs: np.ndarray, wide: np.ndarray, messages: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes covered by repeat starts, over the whole block."""
    first, last, _ = _units(found, np.flatnonzero(recurs), wide)
    repeat = np.zeros(len(block.data) + 1, dtype=bool)
    repeat[ragged(first, last - first + 1)] = True
    for d, told in enumerate(messages):
        base = int(block.offsets[d])
        for (start, windows), starts in told.items():
            repeat[base + start : base + start + windows] = False
            repeat[base + start + starts] = True
    starts = np.flatnonzero(repeat)
    if not len(starts):
        return starts, starts
    new = np.ones(len(starts), dtype=bool)
    # Windows of one document run together when they touch; a window never reaches into the next document.
    owner = np.searchsorted(block.offsets, starts, side="right") - 1
    new[1:] = (starts[1:] > starts[:-1] + length) | (owner[1:] != owner[:-1])
    return starts[new], np.concatenate([starts[np.flatnonzero(new)[1:] - 1], starts[-1:]]) + length


def without_repeats(
    docs: DataFrame, schema: str, rows_of: Callable, *, carry: Sequence[str] = (), length: int = LENGTH, gram: int = GRAM, sample: int = SAMPLE_DOCUMENTS, wide: int = WIDE
) -> DataFrame:
    """Run `rows_of(columns, sizes, kept texts, removed bytes, spans)` over all documents; it returns the columns of `schema`.

    `columns` are the documents' own, without the text: doc_id and, if `carry` names any, the struct `rest`.

    Texts are moved once, packed, for both passes over them. What else moves are grams and slices that recur, and
    the first places of slices.
    """
    whole = docs
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rest = ["rest"] if carry else []
    wide_keys = wide_grams(docs, length, gram, sample, wide)
    grams = recurring_grams(docs, length, gram).groupBy("uid").agg(F.collect_set("gram").alias("grams"))
    placed = packed_texts(whole, carry).join(grams.hint("merge"), "uid", "left").select("uid", "doc_id", "packed", "grams", *rest)
    slices = placed.mapInArrow(_slice_rows(length, gram, wide_keys), SLICES)
    dealt = slices.repartition("route").sortWithinPartitions("route")
    first = dealt.mapInArrow(_first_places(length, gram), "uid bigint, start int, windows int, repeats binary")
    told = first.groupBy("uid").agg(F.collect_list(F.struct("start", "windows", "repeats")).alias("told"))
    joined = placed.join(told.hint("merge"), "uid", "left").select("doc_id", "packed", "grams", "told", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, told = _lists(batch.column("grams")), batch.column("told").to_pylist()
            for block in packed_blocks(batch.column("packed")):
                found = Anchors(block, length, gram)
                messages = [
                    {(m["start"], m["windows"]): np.frombuffer(m["repeats"], np.int16).astype(np.int64) for m in x or ()} for x in told[block.first : block.last]
                ]
                recurs = _in_list(found, lists[block.first : block.last])
                begin, end = removed_spans(block, found, recurs, wide_keys, messages, length)
                gone = np.zeros(len(block.data), dtype=bool)
                gone[ragged(begin, end - begin)] = True
                spans = np.bincount(np.searchsorted(block.offsets, begin, side="right") - 1, minlength=block.documents)
                kept = block.data[~gone].tobytes()
                removed = block.per_document(gone)
                cut = np.concatenate([[0], np.cumsum(np.diff(block.offsets) - removed)]).tolist()
                texts = [kept[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                yield rows_of(batch.select(["doc_id", *rest]).slice(block.first, block.documents), np.diff(block.offsets), texts, removed, spans)

    return joined.mapInArrow(run, schema)


def repeat_digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def digests(columns: pa.RecordBatch, n_bytes: np.ndarray, kept: list[bytes], removed: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns.column("doc_id"), pa.array(n_bytes), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return without_repeats(docs, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", digests, **options)


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """The documents with their repeats removed, all columns kept; n_chars, where there is one, counts the new text.

    Where a removed run begins or ends inside a character, what is left of that character goes too, so that texts stay UTF-8.
    """
    carry, names = others(docs), docs.columns

    def rows(columns: pa.RecordBatch, n_bytes: np.ndarray, kept: list[bytes], removed: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
        texts = [x.decode("utf-8", "ignore") for x in kept]
        found = {"doc_id": columns.column("doc_id"), "text": pa.array(texts, pa.string())}
        if carry:
            found |= dict(zip(carry, columns.column("rest").flatten(), strict=True))
        if "n_chars" in found:
            found["n_chars"] = pa.array([len(x) for x in texts], found["n_chars"].type)
        return pa.RecordBatch.from_arrays([found[c] for c in names], names)

    return without_repeats(docs, docs.schema, rows, carry=carry, **options)
