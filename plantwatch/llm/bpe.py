"""Token ids of many texts at once, equal to those of the tokenizers library.

The vocabulary splits text at white space and between letters and punctuation, and no merge crosses such a place. So a
text's ids are those of its units (runs between white space, cut where an ASCII or Latin-1 letter meets ASCII
punctuation), and a unit that has been encoded once is looked up from then on. Units whose split or normalisation is
not plain go to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from plantwatch.llm.textblocks import BYTE_CODES, IN_WORD, LOWER, Block, mixed, ragged

MAX_UNITS = 1_000_000

# Punctuation in front of which a letter ends a unit. Not the apostrophe (contractions), nor the signs of special tokens.
CUT_BEFORE = np.zeros(256, dtype=bool)
CUT_BEFORE[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|"]] = True
ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
PLAIN_TAIL = np.zeros(256, dtype=bool)
PLAIN_TAIL[0x80:0xC0] = True
PLAIN_TAIL[[0x97, 0xB7]] = False
EXOTIC = np.zeros(256, dtype=bool)
EXOTIC[0xC0:] = True
EXOTIC[0xC3] = False

SPECIAL = b"<|"

LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
SIGNS = re.compile(r"[!-&(-/:;=-@\[-`{}~]+")
_LOWER_CODES = BYTE_CODES[LOWER]


class Encoder:
    """Ids of blocks of texts, with a bounded table of units that is emptied when it is full."""

    def __init__(self, path: str, max_units: int = MAX_UNITS):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.max_units = max_units
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_shown = {c: shown.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def unit_ids(self, unit: bytes) -> list[int]:
        text = unit.decode("utf-8", "replace")
        if LETTERS.fullmatch(text):
            text = text.lower()
            if len(text) != len(unit):
                text = "".join(self.bytes_shown.get(c, c) for c in text)
            return [t.id for t in self.model.tokenize(text)]
        if SIGNS.fullmatch(text):
            return [t.id for t in self.model.tokenize(text)]
        return self.library.encode(text, add_special_tokens=False).ids

    def units(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, documents and keys of the units."""
        data = block.data
        letter = ASCII_LETTER[data]
        wide = np.zeros(len(data), dtype=bool)
        wide[1:] = (data[:-1] == 0xC3) & PLAIN_TAIL[data[1:]]
        cuts = np.flatnonzero(CUT_BEFORE[data[1:]] & (letter[:-1] | wide[:-1])) + 1
        # A cut at the start of a document is none; `spans` starts a run there anyway.
        cuts = cuts[~np.isin(cuts, block.offsets)] if len(cuts) else cuts
        starts, ends, document = block.spans(IN_WORD[data], cuts)
        keys = block.hashes(block.prefix(_LOWER_CODES), starts, ends)
        odd = EXOTIC[data]
        # Special tokens match raw text, in one case only.
        special = np.flatnonzero((data[:-1] == SPECIAL[0]) & (data[1:] == SPECIAL[1]))
        odd[special] = True
        if odd.any():
            total = np.concatenate([[0], np.cumsum(odd)])
            some = np.flatnonzero(total[ends] > total[starts])
            keys[some] = mixed(block.hashes(block.prefix(), starts[some], ends[some]) + np.uint64(1))
        return starts, ends, document, keys

    def _learn(self, block: Block, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.max_units:
            self._clear()
        raw = block.data.tobytes()
        found = [self.unit_ids(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        lengths = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.starts = np.concatenate([self.starts, first])[order]
        self.lengths = np.concatenate([self.lengths, lengths])[order]

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), dtype=bool)
        at = np.searchsorted(self.keys, keys).clip(0, len(self.keys) - 1)
        return at, self.keys[at] == keys

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, one text after the other, and how many each has."""
        if not len(block.data):
            return np.zeros(0, np.uint32), np.zeros(block.documents, np.int64)
        starts, ends, document, keys = self.units(block)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        _, known = self._at(distinct)
        new = first[~known]
        if len(new):
            if len(self.keys) + len(new) > self.max_units:
                self._clear()
                new = first
            self._learn(block, keys[new], starts[new], ends[new])
        at, _ = self._at(distinct)
        lengths = self.lengths[at][which]
        ids = self.ids[ragged(self.starts[at][which], lengths)]
        return ids, np.bincount(document, lengths, block.documents).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker; later tasks of the worker go on with its table."""
    return Encoder(path)
