"""Encoding, packing and long repeats against the library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plantwatch.llm.bpe import Encoder
from plantwatch.llm.chunk_reuse import chunk_ends, chunk_keys, cores, encode_and_decode, encode_chunked
from plantwatch.llm.packing import Packer, pack
from plantwatch.llm.repeats import cleaned, repeat_digests
from plantwatch.llm.suffix_groups import Strings, suffix_array
from plantwatch.llm.textblocks import blocks
from tests.llm.helpers import awkward, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


PARTS = [
    "a", "B", "é", "É", "ß", " ", " ", "\n", "\t", ".", ",", "'s", "'t", "'", "!!", "###", "12", "<|endoftext|>", "<|", "|>", "H̱", "İ", "Σ", "中",
    "​", " ", "\x1c", "😀", "…", "ﬁ", "½", "x|", "word", "Word,", "'LL", "́", "--", "(", "\x00", "ǅ",
]


def odd_texts(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_units_encode_as_the_library(library):
    encoder = Encoder(PATH, max_units=5000)  # so small that it is emptied on the way
    texts = odd_texts(20_000, 14, 1) + odd_texts(40, 3000, 2)
    for block in blocks(pa.array(texts)):
        ids, counts = encoder.encode(block)
        cut = np.concatenate([[0], np.cumsum(counts)])
        for k, expected in enumerate(library.encode_batch(texts[block.first : block.last], add_special_tokens=False)):
            assert ids[cut[k] : cut[k + 1]].tolist() == expected.ids


@pytest.mark.parametrize("shouted_first", [False, True])
def test_special_tokens_in_other_cases_encode_as_the_library(library, shouted_first):
    special = ["<|endoftext|>", "<|startoftext|>", "a<|endoftext|>b", "É<|startoftext|>", "<|endoftext|><|startoftext|>", "x|<|endoftext|>."]
    texts = special + [x.upper() for x in special] + [x.title() for x in special] + ["".join(x) for x in zip(special, map(str.upper, special[::-1]), strict=True)]
    encoder = Encoder(PATH)
    for text in texts[::-1] if shouted_first else texts:
        ids, _ = encoder.encode(next(blocks(pa.array([text]))))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    ids, counts = encoder.encode(next(blocks(pa.array(texts))))
    assert ids.tolist() == [i for x in library.encode_batch(texts, add_special_tokens=False) for i in x.ids]


@pytest.mark.parametrize("reuse", [False, True])
def test_chunks_and_repaired_joins_encode_as_the_library(library, reuse):
    encoder = Encoder(PATH)
    texts = odd_texts(60, 4000, 3) + ["a" * 40_000, "中" * 9000, "", "é" * 20_001]
    for block in blocks(pa.array(texts)):
        known = [{} for _ in texts]
        if reuse:
            ends, document = chunk_ends(block)
            has, begin, end = cores(block, ends)
            keys = chunk_keys(block, ends)
            for k, a, b in zip(has, begin, end, strict=True):
                ids = library.encode(block.data[a:b].tobytes().decode(), add_special_tokens=False).ids
                known[document[k]][keys[k]] = np.array(ids, np.uint32).tobytes()
        got = encode_chunked(encoder, block, known[block.first : block.last])
        for ids, text in zip(got, texts[block.first : block.last], strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunk_ends_depend_on_content_only():
    text = "".join(odd_texts(1, 9000, 5)) * 2
    one, two = next(blocks(pa.array([text]))), next(blocks(pa.array(["short lead " + text])))
    shift = len("short lead ")
    ends = set(chunk_ends(one)[0].tolist())
    moved = {e - shift for e in chunk_ends(two)[0].tolist()}
    assert {e for e in ends if e > 64} == {e for e in moved if e > 64}


def test_digests_of_awkward_table(spark, library):
    rows = awkward() + list(enumerate(odd_texts(30, 500, 6), 300))
    got = encode_and_decode(documents(spark, rows), PATH).collect()
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(expected)
    assert encode_and_decode(documents(spark, rows).limit(0), PATH).collect() == []


def check_pieces(rows, documents_ids, window):
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r[0], []).append(r)
        by_sequence.setdefault(r[5], []).append(r)
    assert set(by_document) == set(documents_ids)
    for i, pieces in by_document.items():
        ids, at = documents_ids[i], 0
        for _, start, length, crc, n, _, _ in sorted(pieces, key=lambda r: r[1]):
            assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at == window or (at < window and at & (at - 1) == 0)


@pytest.mark.parametrize("max_open", [3, 4096])
def test_packer_places_every_id_once_without_padding(max_open):
    rng = random.Random(2)
    documents_ids = {i: [rng.randrange(60_000) for _ in range(rng.choice([1, 2, 7, 30, 64, 65, 200]))] for i in range(400)}
    packer = Packer(64, 7 << 32, max_open)
    for i, ids in documents_ids.items():
        packer.add(i, np.array(ids, np.uint32))
        assert packer.n_open <= max_open
    packer.settle()
    check_pieces(packer.rows, documents_ids, 64)


def test_packer_takes_the_level_of_least_squares():
    rng = random.Random(3)
    packer = Packer(16, 0)
    for i in range(300):
        size = rng.randint(1, 15)
        before = packer.counts.copy()
        best = None
        for level in [0, *np.flatnonzero(before[: 17 - size])]:
            after = before.copy()
            after[level] -= level > 0
            if level + size < 16:
                after[level + size] += 1
            key = (int((after[1:16] ** 2).sum()), -int(level))
            best = min(best, key) if best else key
        assert packer.level_for(size) == -best[1]
        packer.add(i, np.zeros(size, np.uint32))


def test_packing_of_awkward_table(spark, library):
    rows = [r for k, r in enumerate(awkward()) if r[0] is not None and r not in awkward()[:k]]
    got = pack(documents(spark, rows), PATH).collect()
    check_pieces([tuple(r) for r in got], {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}, 2048)
    every = pack(documents(spark, awkward()), PATH)
    assert every.where("doc_id IS NULL").selectExpr("sum(length)").first()[0] == sum(
        len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in awkward() if i is None
    )
    assert pack(documents(spark, rows).limit(0), PATH).collect() == []


def test_suffix_array_matches_sorting():
    rng = random.Random(1)
    for _ in range(200):
        letters, strings = rng.choice([1, 2, 3, 26]), []
        for _ in range(rng.randint(0, 10)):
            x = bytes(rng.randint(0, letters) for _ in range(rng.randint(0, 120)))
            if strings and rng.random() < 0.5:
                x = (x[:20] + rng.choice(strings)[rng.randint(0, 60) :])[:170]
            strings.append((x[:5] * 40)[:150] if rng.random() < 0.2 else x)
        laid, at = [], 0
        for x in strings:
            laid += [(x[k:], -(at + k), at + k) for k in range(len(x) + 1)]
            at += len(x) + 1
        found = suffix_array(Strings.of(np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings], np.int64)))
        assert found.tolist() == [x[2] for x in sorted(laid)]


def plain_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows):
        data = (t or "").encode()
        cover = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                cover[s : s + length] = True
            seen.add(window)
        spans = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(data) else 0
        out.append((i, len(data), int(cover.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~cover])))
    return out


def repeat_rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("ab cdé\n") for _ in range(rng.randint(80, 400))) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "ab" * 300), (3, "q" * 500), (4, "q" * 99), (5, "q" * 100)]
    for i in range(6, 220):
        parts = [rng.choice([rng.choice(base), rng.choice(base)[rng.randint(0, 50) :], "".join(rng.choice("xyz ") for _ in range(60))]) for _ in range(rng.randint(0, 4))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("wide", [100, 2])
def test_repeats_match_brute_force(spark, wide):
    rows = repeat_rows()
    got = repeat_digests(documents(spark, rows), wide=wide).collect()
    assert sorted(map(tuple, got)) == [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in plain_repeats(rows)]


def test_repeats_in_awkward_table(spark):
    rows = awkward()
    got = repeat_digests(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert len({tuple(r) for r in got if r.doc_id == 20}) == 1
    named = [r for k, r in enumerate(rows) if r[0] is not None and r not in rows[:k]]
    expected = {x[0]: x[2] for x in plain_repeats(named)}
    assert all(r.n_removed == expected[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.n_removed for r in got if r.doc_id is None and r.n_bytes >= 100)  # they come last
    assert repeat_digests(documents(spark, rows).limit(0)).collect() == []


def test_cleaned_documents_keep_their_columns(spark):
    rows = repeat_rows()
    docs = documents(spark, rows)
    got = cleaned(docs)
    assert got.schema == docs.schema
    texts = {r.doc_id: r for r in got.collect()}
    for i, *_, kept in plain_repeats(rows):
        text = kept.decode("utf-8", "ignore")
        assert texts[i].text == text and texts[i].n_chars == len(text) and texts[i].kept == "no"
