"""A forest as balanced parentheses: one pair per node in preorder, with a tree of least excess over blocks.

The excess of a position is the number of pairs that are open after it. The close of a node is the first later position
whose excess is one below that of its open; blocks whose least excess is not below it are passed over, whole subtrees of
blocks at a time.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    def __init__(self, bits: np.ndarray):
        """`bits` is 1 for an open and 0 for a close; they have to balance."""
        self.bits = bits.astype(bool)
        self.opens = np.flatnonzero(self.bits)
        self.excess = np.cumsum(np.where(self.bits, 1, -1))
        blocks = max(1, -(-len(bits) // BLOCK))
        width = 1 << (blocks - 1).bit_length()
        far = np.iinfo(np.int64).max
        padded = np.full(width * BLOCK, far, dtype=np.int64)
        padded[: len(bits)] = self.excess
        self.padded = padded
        # Least excess per block, then per pair of blocks, and so on to the root: node 1, children 2k and 2k + 1.
        self.least = np.full(2 * width, far, dtype=np.int64)
        self.least[width:] = padded.reshape(width, BLOCK).min(axis=1)
        first = width >> 1
        while first:
            self.least[first : 2 * first] = self.least[2 * first : 4 * first].reshape(first, 2).min(axis=1)
            first >>= 1
        self.width = width

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First position of the block beyond `after` with an excess of `target` or less, -1 for none."""
        start = block * BLOCK
        here = self.padded[start[:, None] + np.arange(BLOCK)]
        fits = (here <= target[:, None]) & (start[:, None] + np.arange(BLOCK) > after[:, None])
        return np.where(fits.any(axis=1), start + fits.argmax(axis=1), -1)

    def find_close(self, at: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """The position of the close for each open in `at`."""
        return np.concatenate([self._closes(at[k : k + step]) for k in range(0, len(at), step)] or [np.zeros(0, np.int64)])

    def _closes(self, at: np.ndarray) -> np.ndarray:
        target = self.excess[at] - 1
        found = self._in_block(at // BLOCK, at, target)
        todo = np.flatnonzero(found < 0)
        node = at[todo] // BLOCK + self.width
        # Up, until a right sibling holds an excess as low as that; then down to its first such block.
        climbing = np.ones(len(todo), dtype=bool)
        while climbing.any():
            sibling = np.where(climbing & (node % 2 == 0), node + 1, 1)
            hit = climbing & (sibling > 1) & (self.least[sibling] <= target[todo])
            node = np.where(hit, sibling, np.where(climbing, node >> 1, node))
            climbing &= ~hit
        while len(node) and (node < self.width).any():
            inner = node < self.width
            left = np.where(inner, 2 * node, node)
            node = np.where(inner & (self.least[left] > target[todo]), left + 1, left)
        block = node - self.width
        found[todo] = self._in_block(block, block * BLOCK - 1, target[todo])
        return found

    def opens_before(self, at: np.ndarray) -> np.ndarray:
        """Rank: how many nodes open before a position."""
        return np.searchsorted(self.opens, at)

    def is_leaf(self) -> np.ndarray:
        """For each node in preorder, whether its pair is closed at once."""
        following = np.append(self.bits[1:], False)
        return ~following[self.opens]
