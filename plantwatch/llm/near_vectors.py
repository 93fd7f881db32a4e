"""Near duplicates among vectors: a navigable small-world graph per shard, asked by every vector that may have a link there.

Equal vectors form a class and are compared once. Classes are dealt to shards by the nearest of some pivots; a crowded cell is
split by hash, so a place where a third of all vectors lie is several shards. Each shard's graph is built once and stored. A vector asks
every shard whose cell can hold a link: its angle to the pivot may exceed the widest angle in the cell by the angle of the
threshold, no more. Cells of vectors without structure exclude nothing, and then every vector asks every shard.

A block of queries searches with a narrow beam first. Queries whose beam fills up with links go on with wider ones, up to the whole
shard. Then a sample of the block is audited against all rows of the shard, and while the share of links found is below
`recall`, the block starts again with a wider beam. Links are kept only if their cosine in double precision reaches the threshold.

A task gives each query's number of links, not the pairs, and one link from a query to a hub, with a spanning forest over
what the hubs reach: no more rows than it has vectors. Components come from these links, in rounds of joins.

Cases: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing, and keeps its row. Vectors
of other lengths are not compared. Repeated rows, and rows that share an id, are vectors of their own; equal vectors are linked. A
component without any id has a null id; a null id is kept if that is so. An empty table gives an empty result. A cosine within 1e-9
of the threshold is computed again, term by term, so that it does not depend on the layout. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.common import cut_lineage, picked
from plantwatch.llm.components import components
from plantwatch.llm.small_world import SmallWorld

SHARD_ROWS, BLOCK_ROWS = 65_536, 16_384
CHUNK = 256
BEAM = 32
AUDIT_ROWS = 128
RECALL = 0.995
PAIRS = 1 << 17
CELLS = 1 << 22  # of a product of queries and a whole shard
BATCH_ROWS = 20_000


def units(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit vectors in double precision; the largest component is taken out first, so that squares do not overflow."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("nd,nd->n", rows, rows))[:, None]


def reaches(cosine: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Whether cosines reach the threshold; `left` and `right` give the vectors of those close to it."""
    passed = cosine >= least
    for k in np.flatnonzero(np.abs(cosine - least) < 1e-9):
        passed[k] = math.fsum((left[k] * right[k]).tolist()) >= least
    return passed


class Links:
    """What a block of queries finds in a shard: counts, a hub for each query, and pairs of hubs and what they reach."""

    def __init__(self, world: SmallWorld, rows: np.ndarray, own: np.ndarray, weight: np.ndarray, queries: np.ndarray, asking: np.ndarray, least: float):
        self.world, self.rows, self.own, self.weight = world, rows, own, weight
        self.queries, self.asking, self.least = queries, asking, least
        self.light = queries.astype(np.float32)

    def start(self) -> None:
        self.count = np.zeros(len(self.queries), dtype=np.int64)
        self.weights = np.zeros(len(self.queries), dtype=np.int64)
        self.hub = np.full(len(self.queries), -1, dtype=np.int64)
        self.reached: set[int] = set()

    def beams(self, which: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of the links of these queries that beams of this width meet, in order of queries."""
        met: list[tuple[np.ndarray, np.ndarray]] = []
        self.world.within(self.light[which], self.least - 1e-4, beam, lambda of, place, similar: met.append((which[of], place)))
        if not met:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of, place = (np.concatenate(x) for x in zip(*met, strict=True))
        return self._verified(of, place)

    def _verified(self, of: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = np.zeros(len(of), dtype=bool)
        for k in range(0, len(of), PAIRS):
            left, right = self.queries[of[k : k + PAIRS]], self.rows[place[k : k + PAIRS]]
            kept[k : k + PAIRS] = reaches(np.einsum("nd,nd->n", left, right), left, right, self.least)
        kept &= self.own[place] != self.asking[of]
        of, place = of[kept], place[kept]
        order = np.lexsort((place, of))
        return of[order], place[order]

    def all_rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing these queries with the whole shard: the widest beam there is."""
        of, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, CELLS // max(1, len(self.rows)))
        for k in range(0, len(which), step):
            at, place = np.nonzero(self.queries[which[k : k + step]] @ self.rows.T >= self.least - 1e-9)
            of.append(which[k : k + step][at])
            places.append(place)
        return self._verified(np.concatenate(of), np.concatenate(places))

    def take(self, which: np.ndarray, of: np.ndarray, place: np.ndarray) -> None:
        """Note the links of these queries, in place of what was noted before."""
        self.count[which] = np.bincount(of, minlength=len(self.queries))[which]
        self.weights[which] = np.bincount(of, weights=self.weight[place], minlength=len(self.queries))[which].astype(np.int64)
        if len(of):
            asked, first = np.unique(of, return_index=True)
            self.hub[asked] = place[first]
            hubs = np.repeat(place[first], np.diff(np.append(first, len(of))))
            self.reached.update(np.unique(hubs * len(self.rows) + place).tolist())

    def search(self, recall: float, audit_rows: int) -> None:
        """Beams that widen until the audit passes."""
        everyone = np.arange(len(self.queries))
        audited = everyone[:: max(1, len(everyone) // audit_rows)]
        # Beams of some hundredths of a shard already meet more rows than a product of matrices compares in that time.
        whole = max(2 * BEAM, len(self.rows) // 256)
        true = np.bincount(self.all_rows(audited)[0], minlength=len(everyone))[audited]
        start = BEAM
        while True:
            self.start()
            beam, todo = start, everyone
            while len(todo):
                for k in range(0, len(todo), CHUNK):
                    part = todo[k : k + CHUNK]
                    self.take(part, *(self.beams(part, beam) if beam < whole else self.all_rows(part)))
                # A beam filled up with links may have missed some.
                todo = todo[2 * self.count[todo] >= beam] if beam < whole else todo[:0]
                beam *= 4
            if start >= whole or self.count[audited].sum() >= recall * true.sum():
                return
            start *= 2

    def forest(self) -> list[tuple[int, int]]:
        """Links that connect all that the hubs reach, with none to spare."""
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        tree = []
        for pair in sorted(self.reached):
            a, b = divmod(pair, len(self.rows))
            x, y = top(a), top(b)
            if x != y:
                above[max(x, y)] = min(x, y)
                tree.append((a, b))
        return tree


def _built(rows: pa.Table) -> pa.Table:
    """The graph of a shard, a row for each vector in the order of its places."""
    rows = rows.combine_chunks().sort_by("node")
    dim = rows["dim"][0].as_py()
    world = SmallWorld(units(rows["embedding"], dim).astype(np.float32))
    rows = rows.take(pa.array(world.numbers))
    upper: list[list[list[int]]] = [[] for _ in range(rows.num_rows)]
    for level in world.levels[:-1]:
        for place, links in enumerate(level.links.tolist()):
            upper[place].insert(0, [x for x in links if x >= 0])
    lowest = [[x for x in links if x >= 0] for links in world.levels[-1].links.tolist()]
    links = pa.array([[low, *up] for low, up in zip(lowest, upper, strict=True)], pa.list_(pa.list_(pa.int32())))
    return rows.append_column("place", pa.array(np.arange(rows.num_rows), pa.int32())).append_column("links", links)


def _world(rows: pa.Table, vectors: np.ndarray) -> SmallWorld:
    lists = rows["links"].combine_chunks()
    inner = lists.flatten()
    values, cuts = inner.flatten().to_numpy(), inner.offsets.to_numpy() - inner.offsets[0].as_py()
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    depth = np.diff(first)
    sizes, tables = [], []
    for level in range(int(depth.max()) - 1, -1, -1):
        at = first[:-1][depth > level] + level
        count = cuts[at + 1] - cuts[at]
        table = np.full((len(at), max(2, int(count.max()) + int(count.max()) % 2)), -1, dtype=np.int64)
        row = np.repeat(np.arange(len(at)), count)
        column = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        table[row, column] = values[cuts[at][row] + column]
        sizes.append(len(at))
        tables.append(table)
    return SmallWorld.of(vectors.astype(np.float32), np.arange(len(vectors)), sizes, tables)


def near_vectors(
    embeddings: DataFrame, least: float = 0.95, *, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, recall: float = RECALL, audit_rows: int = AUDIT_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    A shard has about `shard_rows` classes and meets blocks of about `block_rows` queries. The driver holds a pivot, a count and an angle
    for each shard.
    """
    spark = embeddings.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col("embedding")
    sound = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    # Two hashes name a vector.
    rows = picked(embeddings, ["vec_id", "embedding"]).select(F.col("0").cast("bigint").alias("vec_id"), F.col("1").alias("embedding")).select(
        "vec_id", "embedding", F.xxhash64(vector).alias("h"), F.xxhash64(F.lit(1), F.reverse(vector)).alias("g"), F.coalesce(sound, F.lit(False)).alias("sound")
    )
    grouped = rows.where("sound").groupBy("h", "g").agg(F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("first"), F.any_value("embedding").alias("embedding"))
    classes = cut_lineage(grouped.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("embedding")}))
    n = classes.count()
    element = classes.schema["embedding"].dataType.simpleString()

    shards = max(1, math.ceil(n / shard_rows))
    chosen = classes.orderBy(F.xxhash64("h", "g"), "h", "g").limit(shards).select("dim", "embedding").toArrow()
    pivots = {d: units(chosen["embedding"].filter(pa.array(chosen["dim"].to_numpy() == d)), d) for d in set(chosen["dim"].to_pylist())}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, cosine = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, -1.0)
            dims = batch.column("dim").to_numpy()
            for d in set(dims.tolist()) & set(pivots):
                at = np.flatnonzero(dims == d)
                similar = units(batch.column("embedding").take(pa.array(at)), d) @ pivots[d].T
                cell[at], cosine[at] = similar.argmax(axis=1), similar.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(cosine)], [*batch.schema.names, "cell", "cosine"])

    kept = f"node bigint, rows bigint, dim int, embedding {element}"
    in_cells = cut_lineage(classes.select("node", "rows", "dim", "embedding").mapInArrow(placed, f"{kept}, cell int, cosine double"))
    cells = in_cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).orderBy("dim", "cell").collect()
    # Each cell is one shard, or as many as its size needs.
    first, known = 0, {}
    for c in cells:
        split = max(1, round(c["n"] / shard_rows))
        known[(c["dim"], c["cell"])] = (first, split, math.acos(max(-1.0, min(1.0, c["least"]))))
        first += split
    reach = math.acos(least) + 1e-6

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spread = batch.column("node").to_numpy() * np.int64(2654435761) >> np.int64(16)
            cell = zip(batch.column("dim").to_pylist(), batch.column("cell").to_pylist(), strict=True)
            shard = np.array([known[c][0] + int(s) % known[c][1] for c, s in zip(cell, spread, strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "rows", "dim", "embedding")], pa.array(shard)], ["node", "rows", "dim", "embedding", "shard"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim = {d: sorted((c, *v) for (e, c), v in known.items() if e == d) for d in {e for e, _ in known}}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            which, shard = [], []

            def out() -> pa.RecordBatch:
                rows = batch.select(["node", "dim", "embedding"]).take(pa.array(np.concatenate(which)))
                said = pa.array(np.concatenate(shard))
                which.clear(), shard.clear()
                return pa.RecordBatch.from_arrays([*rows.columns, said], ["node", "dim", "embedding", "shard"])

            for d in set(dims.tolist()):
                at = np.flatnonzero(dims == d)
                vectors = units(batch.column("embedding").take(pa.array(at)), d)
                for c, begin, split, angle in by_dim[d]:
                    near = at
                    if d in pivots:
                        near = at[np.arccos(np.clip(vectors @ pivots[d][c], -1, 1)) <= angle + reach]
                    for s in range(split):
                        which.append(near)
                        shard.append(np.full(len(near), begin + s, np.int32))
                        if sum(map(len, which)) >= BATCH_ROWS:
                            yield out()
            if which:
                yield out()

    graphs = cut_lineage(
        in_cells.mapInArrow(sharded, f"{kept}, shard int")
        .groupBy("shard")
        .applyInArrow(_built, f"{kept}, shard int, place int, links array<array<int>>")
    )
    parts = max(1, math.ceil(n / block_rows))
    left = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = in_cells.mapInArrow(asked, f"node bigint, dim int, embedding {element}, shard int")
    right = right.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))

    def search(there: pa.Table, queries: pa.Table) -> pa.Table:
        a, b, n_found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if there.num_rows and queries.num_rows:
            there, queries = there.sort_by("place"), queries.sort_by("node")
            dim = there["dim"][0].as_py()
            vectors = units(there["embedding"], dim)
            node, asking = there["node"].to_numpy(), queries["node"].to_numpy()
            links = Links(_world(there, vectors), vectors, node, there["rows"].to_numpy(), units(queries["embedding"], dim), asking, least)
            links.search(recall, audit_rows)
            linked = np.flatnonzero(links.hub >= 0)
            tree = np.array(links.forest(), dtype=np.int64).reshape(-1, 2)
            # A count for each query with links, the link to its hub, and the links below the hubs.
            a = [asking[linked], asking[linked], node[tree[:, 0]]]
            b = [np.full(len(linked), -1), node[links.hub[linked]], node[tree[:, 1]]]
            n_found = [links.weights[linked], np.zeros(len(linked), np.int64), np.zeros(len(tree), np.int64)]
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b, n_found)], ["a", "b", "n"])

    found = cut_lineage(left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(search, "a bigint, b bigint, n bigint"))
    counts = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("found"))
    comps = components(found.where("b >= 0").select("a", "b"))
    of_class = (
        classes.select("node", "h", "g", "rows", "first")
        .join(counts, "node", "left")
        .join(comps, "node", "left")
        .withColumn("comp", F.coalesce("comp", "node"))
    )
    of_class = cut_lineage(of_class)
    least_id = of_class.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = of_class.join(least_id, "comp").select(
        "h", "g", F.lit(True).alias("sound"), (F.coalesce("found", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id"
    )
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    whole = rows.select("vec_id", "h", "g", "sound").join(named, ["h", "g", "sound"], "left")
    return whole.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
