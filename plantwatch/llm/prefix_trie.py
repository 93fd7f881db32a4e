"""Trie of conversation prefixes, by balanced parentheses per shard.

Conversations, as paths of turns, are put in order by a range shuffle. A task cuts its stretch into shards of bounded size
and writes each shard's trie as balanced parentheses: `find_close` delimits a node's subtree, the rank of leaf pairs counts its
leaves, and cumulative arrays give members and savings. Only the nodes on the paths of a shard's first and last conversation,
its spines, can go on in another shard. Everything else is finished; a spine goes on as a path that carries, per node, what hangs
from it. The spines of all shards are a small table in the same order, whose nodes merge by the same method, in as many
rounds as it takes until they fit one shard.

Scale. Turns move as two 64-bit hashes and a byte count, never as text. Conversations are cut into segments of `segment` turns, so
that a conversation without end is not one row; the tries below a cut are built first, and what they hold is hung under the
node they grow from. Places of turns come from slices, so one conversation may hold any share of the rows. A path that very many
conversations share is spread over shards. The ids that end at a node are hashed in ascending order as one stream of
pieces, since SHA-256 cannot be computed otherwise; a task holds one piece at a time.

Cases: a null role or text counts as empty. Turns of one number come in order of their hashes, repeated rows stay. Rows without
conv_id take no part. A conversation that has no turns after rebuilding belongs to the root alone. An empty table has no
root and gives an empty result. Texts of any length are hashed where they are read. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.llm.common import cut_lineage, picked
from plantwatch.llm.parentheses import Parentheses
from plantwatch.operators.ordered import with_position

SEGMENT_TURNS = 1024
SHARD_TURNS = 1 << 18
PIECE_IDS = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()
FAR = np.iinfo(np.int64).max

VALUES = "array<struct<depth: int, ends: bigint, first: bigint, children: bigint, leaves: bigint, saved: bigint, sha: string>>"
PATHS = f"root array<bigint>, path array<bigint>, bytes array<bigint>, conv_id bigint, vals {VALUES}"
FOUND = (
    f"kind int, {PATHS}, depth bigint, parent_conv_id bigint, parent_key binary, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, key binary, text string"
)
NODE, SPINE, PIECE, GROWN = range(4)
ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("root", pa.list_(pa.int64())), ("path", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())), ("conv_id", pa.int64()),
        ("vals", pa.list_(pa.struct([
            ("depth", pa.int32()), ("ends", pa.int64()), ("first", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
            ("saved", pa.int64()), ("sha", pa.string()),
        ]))),
        ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("key", pa.binary()), ("text", pa.string()),
    ]
)


# --- rebuilding ---------------------------------------------------------------------------------------------------


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, n): the turns with two hashes of role and text, and the text's bytes."""
    own = picked(conversations, ["conv_id", "turn", "role", "text"])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("2", "3"))
    return own.select(
        F.col("0").cast("bigint").alias("conv_id"),
        F.col("1").cast("bigint").alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, F.octet_length(role), role).alias("b"),
        F.octet_length(text).cast("bigint").alias("n"),
    ).where("conv_id IS NOT NULL")


def rebuilt(turns: DataFrame, base: Callable[[Column], Column], shared: Callable[[Column], Column], most: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, a, b, n) of the rebuilt conversations, `at` from 0, and all conv_ids.

    The first `shared(c)` turns of conversation c, at most `most`, come from conversation `base(c)`, the rest are its own. `base(c)` lies
    less than `spread` from c, so the few first turns of a base are offered to those ids alone.
    """
    placed = cut_lineage(with_position(turns, ["conv_id"], ["turn", "a", "b"], "place"))
    ids = cut_lineage(placed.select("conv_id").distinct())
    offered = placed.where((F.col("place") < most) & (base(F.col("conv_id")) == F.col("conv_id")))
    steps = F.explode(F.sequence(F.lit(1 - spread), F.lit(spread - 1)))
    lent = offered.withColumn("_of", F.col("conv_id")).withColumn("_step", steps).withColumn("conv_id", F.col("conv_id") + F.col("_step"))
    lent = lent.where((base(F.col("conv_id")) == F.col("_of")) & (F.col("place") < shared(F.col("conv_id"))))
    lent = lent.join(ids, "conv_id", "left_semi").withColumn("part", F.lit(0))
    kept = placed.where(F.col("place") >= shared(F.col("conv_id"))).withColumn("part", F.lit(1))
    both = lent.select("conv_id", "part", "place", "a", "b", "n").unionByName(kept.select("conv_id", "part", "place", "a", "b", "n"))
    return with_position(both, ["conv_id"], ["part", "place"], "at", checkpoint=True).drop("part", "place"), ids


def segments(turns: DataFrame, ids: DataFrame, segment: int) -> DataFrame:
    """(conv_id, segment, root, path, bytes, last): the turns of a conversation in stretches of `segment`.

    The last stretch is the only one that is not full, and may be empty. `root` names the turns before the stretch.
    """
    number = F.floor(F.col("at") / segment).cast("bigint")
    full = turns.groupBy("conv_id", number.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("at", "a", "b", "n"))).alias("_t"))
    path = F.flatten(F.transform("_t", lambda t: F.array(t["a"], t["b"])))
    rows = full.select("conv_id", "segment", path.alias("path"), F.transform("_t", lambda t: t["n"]).alias("bytes"))
    of_ids = rows.groupBy("conv_id").agg(F.max(F.struct("segment", F.size("bytes").alias("n"))).alias("_end"))
    ended = ids.join(of_ids, "conv_id", "left")
    none = F.array().cast("array<bigint>")
    # An empty stretch for conversations without turns, and for those whose last stretch is full.
    after = ended.where(F.col("_end").isNull() | (F.col("_end.n") == segment)).select(
        "conv_id", F.coalesce(F.col("_end.segment") + 1, F.lit(0)).cast("bigint").alias("segment"), none.alias("path"), none.alias("bytes")
    )
    every = rows.unionByName(after)
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # Sums of hashed stretches name what came before; halves of the hashes, so that sums stay far from overflow.
    words = [F.xxhash64(F.lit(k), F.col("segment"), F.col("path")) for k in (1, 2)]
    halves = [h for w in words for h in (F.shiftrightunsigned(w, 32), w.bitwiseAND(F.lit(0xFFFFFFFF)))]
    root = F.array(*[F.coalesce(F.sum(h).over(earlier), F.lit(0)).cast("bigint") for h in halves])
    return every.select("conv_id", "segment", "path", "bytes", root.alias("root"), (F.size("bytes") < segment).alias("last"))


# --- one shard ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Shard:
    """Paths in order, flattened: `sizes` turns each, two words per turn, with the ids that end there (-1 in `known` for none)."""

    roots: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    bytes: np.ndarray
    conv: np.ndarray
    known: np.ndarray
    vals: dict[int, list[dict]]

    @staticmethod
    def of(rows: pa.Table) -> Shard:
        rows = rows.combine_chunks()
        one = lambda c: rows[c].chunk(0) if rows[c].num_chunks else rows[c].combine_chunks()
        sizes = np.diff(one("bytes").offsets.to_numpy()).astype(np.int64)
        conv = one("conv_id")
        held = one("vals")
        vals = {int(k): held[int(k)].as_py() for k in np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))}
        return Shard(
            one("root").flatten().to_numpy().reshape(-1, 4), sizes, one("path").flatten().to_numpy().reshape(-1, 2),
            one("bytes").flatten().to_numpy(), conv.fill_null(0).to_numpy(), conv.is_valid().to_numpy(zero_copy_only=False), vals,
        )

    def common(self) -> np.ndarray:
        """Turns that each path shares with the one before it; -1 where even the root differs."""
        n = len(self.sizes)
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        shared = np.full(n, -1, dtype=np.int64)
        alive = np.flatnonzero((self.roots[1:] == self.roots[:-1]).all(axis=1)) + 1
        depth = 0
        while len(alive):
            shared[alive] = depth
            alive = alive[np.minimum(self.sizes[alive], self.sizes[alive - 1]) > depth]
            same = (self.words[starts[alive] + depth] == self.words[starts[alive - 1] + depth]).all(axis=1)
            alive = alive[same]
            depth += 1
        return shared


class Trie:
    """The trie of a shard: nodes in preorder, and for each what its subtree holds."""

    def __init__(self, shard: Shard):
        self.shard = shard
        sizes, shared = shard.sizes, shard.common()
        self.shared = shared
        new = sizes - shared
        total = int(new.sum())
        # A path closes what it does not share, then opens what is new; at the end all is closed.
        closes = np.concatenate([[0], sizes[:-1] - shared[1:], [sizes[-1] + 1]])
        runs = np.stack([closes[:-1], new], axis=1).ravel()
        bits = np.concatenate([np.repeat(np.tile([0, 1], len(sizes)), runs), np.zeros(closes[-1], np.int64)])
        self.pairs = Parentheses(bits)
        starts = np.concatenate([[0], np.cumsum(new)])
        row = np.repeat(np.arange(len(sizes)), new)
        self.row = row
        self.depth = shared[row] + 1 + np.arange(total) - starts[row]
        self.end = starts[1:] - 1  # the node that each path ends at
        self.last = self.pairs.opens_before(self.pairs.find_close(self.pairs.opens))
        self.parent = self._parents()
        turn = np.concatenate([[0], np.cumsum(sizes)])[row] + self.depth - 1
        self.bytes = np.where(self.depth > 0, shard.bytes[np.where(self.depth > 0, turn, 0)] if len(shard.bytes) else 0, 0)

    def _parents(self) -> np.ndarray:
        """The last node before each that lies one level higher."""
        parent = np.full(len(self.depth), -1, dtype=np.int64)
        order = np.argsort(self.depth, kind="stable")
        bounds = np.searchsorted(self.depth[order], np.arange(int(self.depth.max()) + 2))
        self.by_depth = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for upper, lower in zip(self.by_depth[:-1], self.by_depth[1:], strict=True):
            parent[lower] = upper[np.searchsorted(upper, lower) - 1]
        return parent

    def path_to(self, node: int) -> list[int]:
        """The nodes from the root down to a node."""
        way = []
        while node >= 0:
            way.append(node)
            node = int(self.parent[node])
        return way[::-1]

    def over_subtree(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.last] - sums[: len(values)]

    def measure(self) -> None:
        """Members, children, leaves, savings and the smallest member of every node, with what hangs from the paths."""
        n, shard = len(self.depth), self.shard
        self.ends, self.first = np.zeros(n, np.int64), np.full(n, FAR)
        self.hung = {name: np.zeros(n, np.int64) for name in ("children", "leaves", "saved")}
        self.sha: dict[int, str] = {}
        np.add.at(self.ends, self.end[shard.known], 1)
        np.minimum.at(self.first, self.end[shard.known], shard.conv[shard.known])
        for k, vals in shard.vals.items():
            way = self.path_to(int(self.end[k]))
            for v in vals:
                node = way[v["depth"]]
                self.ends[node] += v["ends"]
                if v["first"] is not None:
                    self.first[node] = min(self.first[node], v["first"])
                for name, column in self.hung.items():
                    column[node] += v[name]
                if v["sha"]:
                    self.sha[node] = v["sha"]
        inside = np.bincount(self.parent[self.parent >= 0], minlength=n)
        self.children = inside + self.hung["children"]
        self.members = self.over_subtree(self.ends)
        self.is_leaf = self.pairs.is_leaf() & (self.hung["children"] == 0)
        self.leaves = self.over_subtree(self.is_leaf + self.hung["leaves"])
        self.saved = self.over_subtree((self.members - 1) * self.bytes + self.hung["saved"])
        self.smallest = self.first.copy()
        for lower in self.by_depth[:0:-1]:
            np.minimum.at(self.smallest, self.parent[lower], self.smallest[lower])

    def keys(self, level: int, row: int, depth: int) -> list[bytes]:
        """Names of the nodes on a path, down to `depth`: hashes of all that leads there."""
        shard = self.shard
        begin = int(shard.sizes[:row].sum())
        running = hashlib.blake2b(np.int64(level).tobytes() + shard.roots[row].tobytes(), digest_size=16)
        names = [running.digest()]
        for turn in shard.words[begin : begin + depth]:
            running.update(turn.tobytes())
            names.append(running.digest())
        return names

    def ids_at(self) -> Iterator[tuple[int, np.ndarray]]:
        """The nodes that conversations end at, with their ids in ascending order."""
        known = np.flatnonzero(self.shard.known)
        if len(known):
            at = self.end[known]
            cuts = np.flatnonzero(np.diff(at)) + 1
            for ids, node in zip(np.split(self.shard.conv[known], cuts), at[np.concatenate([[0], cuts])], strict=True):
                yield int(node), np.sort(ids)


def joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def shard_rows(shard: Shard, level: int, segment: int, merging: bool, whole: bool) -> Iterator[pa.RecordBatch]:
    """The finished nodes of a shard, its spines, and the ids that end on them.

    Where spines are `merging`, every node has a name that its ids are filed under; a `whole` trie has no spines of its own.
    """
    trie = Trie(shard)
    trie.measure()
    n, last_row = len(trie.depth), len(shard.sizes) - 1
    left, right = trie.path_to(int(trie.end[0])), trie.path_to(int(trie.end[last_row]))
    names: dict[int, bytes] = {}
    spine = np.zeros(n, dtype=bool)
    for row in range(last_row + 1) if merging else (0, last_row):
        way = trie.path_to(int(trie.end[row]))
        names.update(zip(way, trie.keys(level, row, len(way) - 1), strict=True))
    if not whole:
        spine[left] = spine[right] = True

    sha = np.full(n, None, dtype=object)
    for node, text in trie.sha.items():
        sha[node] = text
    pieces = []
    for node, ids in trie.ids_at():
        if spine[node]:
            pieces += [(names[node], int(ids[k]), joined(ids[k : k + PIECE_IDS])) for k in range(0, len(ids), PIECE_IDS)]
        else:
            sha[node] = hashlib.sha256(joined(ids).encode()).hexdigest()
    done = np.flatnonzero(~spine)
    if not merging:
        sha[done[sha[done] == None]] = NOTHING  # noqa: E711
    if len(done):
        parent = trie.parent[done]
        has = parent >= 0
        open_parent = has & spine[np.where(has, parent, 0)]
        grown = (trie.depth[done] == 0) & (level > 0)
        yield _batch(
            len(done),
            kind=np.where(grown, GROWN, NODE).astype(np.int32),
            conv_id=trie.smallest[done],
            depth=trie.depth[done] + level * segment,
            parent_conv_id=pa.array(trie.smallest[np.where(has, parent, 0)], mask=~has | open_parent),
            parent_key=pa.array([names[int(p)] if o else None for p, o in zip(parent, open_parent, strict=True)], pa.binary()),
            n_convs=trie.members[done],
            n_children=trie.children[done],
            # What grows on under a cut: the node itself is counted where it is cut.
            n_leaves=trie.leaves[done] - np.where(grown, trie.is_leaf[done], 0),
            saved_tokens=trie.saved[done],
            ends_sha256=pa.array(sha[done].tolist(), pa.string()),
            key=pa.array([names.get(int(k)) for k in done], pa.binary()),
        )
    if pieces:
        key, first, text = zip(*pieces, strict=True)
        yield _batch(len(pieces), kind=PIECE, key=pa.array(key, pa.binary()), conv_id=np.array(first, np.int64), text=pa.array(text, pa.string()))
    if whole:
        return
    # What hangs from the spines: their own ends, and the finished subtrees below them.
    child = done[(trie.parent[done] >= 0) & spine[np.where(trie.parent[done] >= 0, trie.parent[done], 0)]]
    up = trie.parent[child]
    ends, first, hung = trie.ends.copy(), trie.first.copy(), {k: v.copy() for k, v in trie.hung.items()}
    np.add.at(ends, up, trie.members[child])
    np.minimum.at(first, up, trie.smallest[child])
    np.add.at(hung["children"], up, 1)
    np.add.at(hung["leaves"], up, trie.leaves[child])
    np.add.at(hung["saved"], up, trie.saved[child])
    told: set[int] = set()
    begins = np.concatenate([[0], np.cumsum(shard.sizes)])
    out: dict[str, list] = {c: [] for c in ("root", "path", "bytes", "vals")}
    for row, way in ((0, left), (last_row, right)):
        fresh = [(d, node) for d, node in enumerate(way) if node not in told]
        if not fresh:
            continue
        told.update(way)
        a, b = int(begins[row]), int(begins[row + 1])
        out["root"].append(shard.roots[row].tolist())
        out["path"].append(shard.words[a:b].ravel().tolist())
        out["bytes"].append(shard.bytes[a:b].tolist())
        out["vals"].append(
            [
                {
                    "depth": d, "ends": int(ends[v]), "first": None if first[v] == FAR else int(first[v]), "children": int(hung["children"][v]),
                    "leaves": int(hung["leaves"][v]), "saved": int(hung["saved"][v]), "sha": trie.sha.get(v),
                }
                for d, v in fresh
            ]
        )
    yield _batch(len(out["root"]), kind=SPINE, **{c: pa.array(v, ARROW.field(c).type) for c, v in out.items()})


def _batch(n: int, **columns) -> pa.RecordBatch:
    arrays = []
    for field in ARROW:
        value = columns.get(field.name)
        if value is None:
            arrays.append(pa.nulls(n, field.type))
        elif np.isscalar(value):
            arrays.append(pa.array(np.full(n, value), field.type))
        else:
            arrays.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def shard_task(level: int, segment: int, merging: bool, whole: bool, shard_turns: int):
    """A task over rows in order: shards of about `shard_turns`, or one shard if it is to be `whole`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            begin = 0
            weight = np.cumsum(np.diff(batch.column("bytes").offsets.to_numpy()) + 1)
            while begin < batch.num_rows:
                before = int(weight[begin - 1]) if begin else 0
                # As many rows as fill the shard, one at least.
                fit = batch.num_rows if whole else max(begin + 1, int(np.searchsorted(weight, before + shard_turns - size, side="right")))
                fit = min(fit, batch.num_rows)
                held.append(batch.slice(begin, fit - begin))
                size += int(weight[fit - 1]) - before
                begin = fit
                if not whole and size >= shard_turns - 1:
                    yield from shard_rows(Shard.of(pa.Table.from_batches(held)), level, segment, merging, whole)
                    held, size = [], 0
        if held:
            yield from shard_rows(Shard.of(pa.Table.from_batches(held)), level, segment, merging, whole)

    return run


# --- all shards ---------------------------------------------------------------------------------------------------


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha) from pieces sorted by key and first id; a piece is held at a time."""
    key, running = None, None
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for name, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
            if name != key:
                if running is not None:
                    out.append((key, running.hexdigest()))
                key, running = name, hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["key", "sha"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["key", "sha"])


def level_nodes(paths: DataFrame, level: int, segment: int, shard_turns: int) -> DataFrame:
    """The finished rows, kinds NODE and GROWN, of the tries over these paths."""
    order = ["root", "path", "conv_id"]
    found: list[DataFrame] = []
    whole = False
    while True:
        dealt = paths.repartition(1) if whole else paths.repartitionByRange(*order)
        task = shard_task(level, segment, bool(found), whole, shard_turns)
        rows = cut_lineage(dealt.sortWithinPartitions(*order).mapInArrow(task, FOUND))
        found.append(rows)
        if whole:
            break
        paths = rows.where(F.col("kind") == SPINE).select("root", "path", "bytes", "conv_id", "vals")
        # One shard holds the spines of some hundred others; more of them take another round.
        whole = (paths.agg(F.sum(F.size("bytes") + 1)).first()[0] or 0) <= shard_turns
    every = reduce(DataFrame.unionByName, found)
    pieces = every.where(F.col("kind") == PIECE).select("key", "conv_id", "text")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "text").mapInArrow(_hashed_ids, "key binary, sha string")
    nodes = every.where(F.col("kind").isin(NODE, GROWN)).drop("root", "path", "bytes", "vals", "text")
    # Nodes with a name were spines: the ids that end there, and the children that hang there, are filed under it.
    named = nodes.where("key IS NOT NULL").join(hashes, "key", "left")
    named = cut_lineage(named.withColumn("ends_sha256", F.coalesce("sha", "ends_sha256", F.lit(NOTHING))).drop("sha"))
    parents = named.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_of"))
    each = named.unionByName(nodes.where("key IS NULL"))
    hanging = each.where("parent_key IS NOT NULL").join(parents, "parent_key").withColumn("parent_conv_id", F.col("_of")).drop("_of")
    return hanging.unionByName(each.where("parent_key IS NULL")).drop("key", "parent_key")


def prefix_trie(
    conversations: DataFrame,
    base: Callable[[Column], Column],
    shared: Callable[[Column], Column],
    most: int,
    spread: int,
    *,
    segment: int = SEGMENT_TURNS,
    shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every prefix.

    Conversation c is rebuilt from the first `shared(c)` (at most `most`) turns of `base(c)`, which lies less than `spread` from c, and its own later
    turns. A prefix is named by its smallest member and its depth.
    """
    turns, ids = rebuilt(turn_rows(conversations), base, shared, most, spread)
    stretches = cut_lineage(segments(turns, ids, segment))
    deepest = stretches.agg(F.max("segment")).first()[0]
    grown: DataFrame | None = None
    found: list[DataFrame] = []
    for level in range(deepest if deepest is not None else 0, -1, -1):
        here = stretches.where(F.col("segment") == level)
        paths = here.where("last").select("root", "path", "bytes", "conv_id", F.lit(None).cast(VALUES).alias("vals"))
        if grown is not None:
            # A trie below a cut hangs from the stretch that leads there, of any of its members.
            val = F.struct(
                F.lit(segment).cast("int").alias("depth"), F.col("n_convs").alias("ends"), F.col("conv_id").alias("first"), F.col("n_children").alias("children"),
                F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.col("ends_sha256").alias("sha"),
            )
            hung = here.join(grown.select("conv_id", F.array(val).cast(VALUES).alias("vals")), "conv_id")
            paths = paths.unionByName(hung.select("root", "path", "bytes", F.lit(None).cast("bigint").alias("conv_id"), "vals"))
        rows = cut_lineage(level_nodes(paths, level, segment, shard_turns))
        grown = rows.where(F.col("kind") == GROWN)
        found.append(rows.where(F.col("kind") == NODE).drop("kind"))
    return reduce(DataFrame.unionByName, found).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
