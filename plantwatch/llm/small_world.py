"""A hierarchical navigable small-world graph over the unit vectors of one shard, built and searched in batches.

Every row has a level, drawn from a hash of its number, with a share of 1 / `degree` going one level higher. Each level has a graph of its own
over the rows that reach it. Rows enter in batches: a batch is searched for in what is there, compared with itself, and linked to
near rows that do not lie behind a nearer one; links go both ways and lists that grow too long are cut by the same rule.
A search walks down greedily, and on the lowest level keeps a beam of the best rows seen.
"""

from __future__ import annotations

import numpy as np

DEGREE = 12
BUILD_BEAM = 32
FIRST = 64
BATCH = 1024
STEP = 4  # rows of the beam that are expanded at a time


def _levels(n: int, degree: int) -> np.ndarray:
    """Levels by rank in a fixed shuffle: n / degree rows reach level 1, n / degree^2 level 2, and so on."""
    spread = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(spread, kind="stable")] = np.arange(n)
    levels, size = np.zeros(n, dtype=np.int64), n // degree
    while size >= FIRST:
        levels[rank < size] += 1
        size //= degree
    return levels


class Level:
    """The graph of one level: `links[i]` are neighbours of `members[i]`, as places among the members, -1 for none."""

    def __init__(self, vectors: np.ndarray, members: np.ndarray, degree: int):
        self.vectors, self.members, self.degree = vectors, members, degree
        self.links = np.full((len(members), 2 * degree), -1, dtype=np.int64)

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int, size: int, each=None) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of the beams, best first, among the first `size` members; -1 and -inf where there are fewer.

        `each` is told (query, place, similarity) of every row that a query meets.
        """
        q = len(queries)
        rows = np.arange(q)
        seen = np.zeros((q, size), dtype=bool)
        seen[rows, entry] = True
        best = np.full((q, beam), -1, dtype=np.int64)
        score = np.full((q, beam), -np.inf, dtype=np.float32)
        best[:, 0], score[:, 0] = entry, np.einsum("qd,qd->q", queries, self.vectors[entry])
        if each:
            each(rows, entry, score[:, 0])
        open_ = np.zeros((q, beam), dtype=bool)
        open_[:, 0] = True
        live = rows
        while len(live):
            # The nearest rows of each beam that were not expanded yet.
            waiting = np.where(open_[live], score[live], -np.inf)
            step = min(STEP, beam)
            at = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
            picked = np.take_along_axis(waiting, at, axis=1) > -np.inf
            going = picked.any(axis=1)
            live, at, picked = live[going], at[going], picked[going]
            if not len(live):
                break
            grid = live[:, None]
            open_[grid, at] &= ~picked
            near = np.where(picked[:, :, None], self.links[np.where(picked, best[grid, at], 0)], -1).reshape(len(live), -1)
            near = np.where(near < size, near, -1)
            near[seen[grid, np.where(near < 0, 0, near)] & (near >= 0)] = -1
            # A row that two of the expanded ones lead to counts once.
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            of, col = np.nonzero(near >= 0)
            if not len(of):
                continue
            place = near[of, col]
            seen[live[of], place] = True
            similar = np.einsum("nd,nd->n", queries[live[of]], self.vectors[place])
            if each:
                each(live[of], place, similar)
            fresh = np.full(near.shape, -np.inf, dtype=np.float32)
            fresh[of, col] = similar
            all_score = np.concatenate([score[live], fresh], axis=1)
            all_best = np.concatenate([best[live], near], axis=1)
            all_open = np.concatenate([open_[live], near >= 0], axis=1)
            keep = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
            score[live] = np.take_along_axis(all_score, keep, axis=1)
            best[live] = np.where(score[live] > -np.inf, np.take_along_axis(all_best, keep, axis=1), -1)
            open_[live] = np.take_along_axis(all_open, keep, axis=1) & (best[live] >= 0)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(best, order, axis=1), np.take_along_axis(score, order, axis=1)

    def chosen(self, own: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Of candidates sorted best first, those nearer to their own row than to any row chosen before; then the best of the rest."""
        q, width = near.shape
        known = near >= 0
        points = self.vectors[np.where(known, near, 0)]
        between = points @ points.transpose(0, 2, 1)
        taken = np.zeros((q, width), dtype=bool)
        for k in range(width):
            behind = (taken & (between[:, k] > score[:, k, None])).any(axis=1)
            taken[:, k] = known[:, k] & ~behind & (taken.sum(axis=1) < most)
        # Places left over go to the best that were passed by.
        order = np.argsort(np.where(taken, 0, np.where(known, 1, 2)), axis=1, kind="stable")[:, :most]
        links = np.take_along_axis(np.where(known, near, -1), order, axis=1)
        return np.pad(links, ((0, 0), (0, max(0, most - links.shape[1]))), constant_values=-1)

    def enter(self, begin: int, end: int, entry: np.ndarray | None) -> None:
        """Link the members begin..end with those before them and among each other."""
        own = np.arange(begin, end)
        points = self.vectors[begin:end]
        among = points @ points.T
        np.fill_diagonal(among, -np.inf)
        width = min(BUILD_BEAM, end - begin - 1)
        near = np.full((end - begin, 0), -1, dtype=np.int64)
        score = np.zeros((end - begin, 0), dtype=np.float32)
        if width > 0:
            at = np.argpartition(-among, width - 1, axis=1)[:, :width]
            near, score = at + begin, np.take_along_axis(among, at, axis=1)
        if begin:
            # A row found on the level above may not be here yet.
            found, similar = self.search(points, np.where(entry < begin, entry, 0), BUILD_BEAM, begin)
            near, score = np.concatenate([near, found], axis=1), np.concatenate([score, similar], axis=1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :BUILD_BEAM]
        near, score = np.take_along_axis(near, order, axis=1), np.take_along_axis(score, order, axis=1)
        if not near.shape[1]:
            return
        links = self.chosen(own, near, score, self.degree)
        self.links[begin:end, : self.degree] = links
        # And back: what a row is linked from joins its list, which is cut when it grows too long.
        source = np.repeat(own, self.degree)[links.ravel() >= 0]
        target = links.ravel()[links.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, first, count = np.unique(target, return_index=True, return_counts=True)
        slot = np.arange(len(target)) - np.repeat(first, count)
        room = 2 * BUILD_BEAM
        joined = np.full((len(touched), self.links.shape[1] + room), -1, dtype=np.int64)
        joined[:, : self.links.shape[1]] = self.links[touched]
        fits = slot < room
        joined[np.repeat(np.arange(len(touched)), count)[fits], self.links.shape[1] + slot[fits]] = source[fits]
        joined = np.sort(joined, axis=1)
        joined[:, 1:][joined[:, 1:] == joined[:, :-1]] = -1
        for a in range(0, len(touched), BATCH):
            rows, lists = touched[a : a + BATCH], joined[a : a + BATCH]
            similar = np.einsum("qd,qkd->qk", self.vectors[rows], self.vectors[np.where(lists >= 0, lists, 0)])
            similar = np.where(lists >= 0, similar, -np.inf)
            order = np.argsort(-similar, axis=1, kind="stable")[:, : 2 * self.links.shape[1]]
            lists, similar = np.take_along_axis(lists, order, axis=1), np.take_along_axis(similar, order, axis=1)
            full = (lists >= 0).sum(axis=1) > self.links.shape[1]
            kept = lists[:, : self.links.shape[1]].copy()
            if full.any():
                kept[full] = self.chosen(rows[full], lists[full], similar[full], self.links.shape[1])
            self.links[rows] = kept


class SmallWorld:
    """The graph over unit vectors (float32); `numbers` maps its places to rows."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE):
        levels = _levels(len(vectors), degree)
        # Rows of higher levels come first, so each level is a prefix of the one below.
        self.numbers = np.argsort(-levels, kind="stable")
        self.vectors = np.ascontiguousarray(vectors[self.numbers], dtype=np.float32)
        sizes = [int((levels >= level).sum()) for level in range(int(levels.max()) + 1 if len(levels) else 1)]
        self.levels: list[Level] = []  # from the highest down
        for size in sizes[::-1]:
            level = Level(self.vectors, np.arange(size), degree)
            begin = 0
            while begin < size:
                end = min(size, max(FIRST, begin + min(BATCH, max(begin, FIRST))))
                level.enter(begin, end, self._entry(self.vectors[begin:end]) if begin else None)
                begin = end
            self.levels.append(level)

    @classmethod
    def of(cls, vectors: np.ndarray, numbers: np.ndarray, sizes: list[int], links: list[np.ndarray]) -> SmallWorld:
        """A graph that was built elsewhere, its rows in the order of places."""
        self = cls.__new__(cls)
        self.vectors, self.numbers, self.levels = vectors, numbers, []
        for size, lists in zip(sizes, links, strict=True):
            level = Level(vectors, np.arange(size), lists.shape[1] // 2)
            level.links = lists
            self.levels.append(level)
        return self

    def _entry(self, queries: np.ndarray) -> np.ndarray:
        """Where to enter the level below those that are built: the nearest row found on the levels above."""
        at = np.zeros(len(queries), dtype=np.int64)
        for level in self.levels:
            best, _ = level.search(queries, at, 4, len(level.members))
            at = best[:, 0]
        return at

    def within(self, queries: np.ndarray, least: float, beam: int, each) -> None:
        """Tell `each` of (query, place, similarity) of rows met by beams of this width with a similarity of `least` or more."""
        at = np.zeros(len(queries), dtype=np.int64)
        for level in self.levels[:-1]:
            best, _ = level.search(queries, at, 4, len(level.members))
            at = best[:, 0]
        lowest = self.levels[-1]

        def told(of: np.ndarray, place: np.ndarray, similar: np.ndarray) -> None:
            near = similar >= least
            if near.any():
                each(of[near], place[near], similar[near])

        lowest.search(queries, at, min(beam, len(lowest.members)), len(lowest.members), told)
