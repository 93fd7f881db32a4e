"""Exact top-k inner products by ball-tree branch and bound per shard.

Vectors are dealt to shards of about `shard_rows` by a hash of their id, queries to blocks of about `block_rows`; every
shard meets every block once. A shard builds a ball tree. For each query, nodes wait in order of the upper bound
q.c + |q| r of their ball; the search ends when the best bound lies below the current kth score. That score is shared:
every query starts from its kth best among a bounded pilot of vectors, and the tree only raises it. Shards return
what reaches it, and the k best over all shards are the answer.

Components become floor(1024 x), scores are exact integers (sums below 2^53). Vectors that are null or empty, or hold a null or
non-finite component, and rows without an id, take no part. Rows equal in id and vector count once; rows
that share an id but not the vector are candidates and queries of their own, but never candidates for their own id.
Vectors of other lengths are not compared. Ties go to the smaller id. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_ROWS, PILOT_ROWS, LEAF_ROWS = 2048, 4096, 1024, 64
SCALE = 1024


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, uid, dim, vec) of the rows that take part; `uid` names a distinct pair of id and vector."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    real = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.transform("real", lambda x: F.floor(x * scale).cast("bigint"))
    return (
        rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), real.alias("real"))
        .where(F.col("vec_id").isNotNull() & (F.size("real") > 0) & F.forall("real", finite))
        .select("vec_id", whole.alias("vec"))
        .distinct()
        .select("vec_id", F.xxhash64("vec_id", "vec").alias("uid"), F.size("vec").alias("dim"), "vec")
    )


def matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), dim)


class BallTree:
    """Nodes (first, last, centre, radius, left, right) over rows in tree order; a leaf has no children."""

    def __init__(self, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(rows))
        self.nodes: list[tuple] = []
        todo = [(0, len(rows), -1, 0)]
        children: dict[int, list[int]] = {}
        while todo:
            first, last, parent, _ = todo.pop()
            here = rows[self.order[first:last]]
            centre = here.mean(axis=0)
            radius = math.sqrt(((here - centre) ** 2).sum(axis=1).max())
            me = len(self.nodes)
            self.nodes.append((first, last, centre, radius))
            children[me] = []
            if parent >= 0:
                children[parent].append(me)
            if last - first > leaf_rows and radius > 0:
                far = here[((here - centre) ** 2).sum(axis=1).argmax()]
                other = here[((here - far) ** 2).sum(axis=1).argmax()]
                middle = (last - first) // 2
                side = np.argpartition(here @ (far - other), middle)
                self.order[first:last] = self.order[first:last][side]
                todo += [(first, first + middle, me, 0), (first + middle, last, me, 1)]
        self.rows = rows[self.order]
        self.children = children
        self.centres = np.array([n[2] for n in self.nodes])
        self.radii = np.array([n[3] for n in self.nodes])

    def search(self, query: np.ndarray, bound: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """(score, -id) of at most k rows, best first, of those that reach `floor`; `bound` has each node's upper bound."""
        best: list[tuple[int, int]] = []
        waiting = [(-bound[0], 0)]
        while waiting:
            upper, node = heapq.heappop(waiting)
            kth = max(floor, best[0][0]) if len(best) == k else floor
            if -upper < kth:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= kth:
                        heapq.heappush(waiting, (-bound[child], child))
                continue
            first, last, _, _ = self.nodes[node]
            scores = self.rows[first:last] @ query
            for at in np.flatnonzero(scores >= kth):
                vec_id = int(ids[self.order[first + at]])
                if vec_id == own:
                    continue
                entry = (int(scores[at]), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return sorted(best, reverse=True)


def with_floor(queries: DataFrame, pilot: pa.Table, k: int) -> DataFrame:
    """The queries with their kth best score among the pilot vectors, the least that their answers have to reach."""
    ids = pilot["vec_id"].to_numpy()
    by_dim = {d: (ids[at], pilot["vec"].take(pa.array(at))) for d in set(pilot["dim"].to_pylist()) for at in [np.flatnonzero(pilot["dim"].to_numpy() == d)]}

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {d: (i, matrix(v, d)) for d, (i, v) in by_dim.items()}
        for batch in batches:
            floor = np.full(batch.num_rows, -np.inf)
            dims = batch.column("dim").to_numpy()
            for d in set(dims.tolist()):
                at = np.flatnonzero(dims == d)
                if d not in known:
                    continue
                own, rows = known[d]
                scores = matrix(batch.column("vec").take(pa.array(at)), d) @ rows.T
                scores[batch.column("vec_id").to_numpy()[at][:, None] == own[None, :]] = -np.inf
                if len(own) >= k:
                    floor[at] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], [*batch.schema.names, "floor"])

    return queries.mapInArrow(bound, "vec_id bigint, uid bigint, dim int, vec array<bigint>, floor double")


def top_products(
    embeddings: DataFrame, is_query: Column, *, k: int = 10, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, pilot_rows: int = PILOT_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with every other row.

    `is_query` is a condition on vec_id. A task holds one shard and one block of queries.
    """
    vectors = integer_vectors(embeddings)
    queries = vectors.where(is_query)
    n, n_queries = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, n_blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / block_rows))
    pilot = vectors.orderBy(F.xxhash64("uid"), "uid").limit(pilot_rows).select("vec_id", "dim", "vec").toArrow()
    asked = with_floor(queries, pilot, k)

    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(shards)).cast("int")).withColumn("part", every(n_blocks))
    right = asked.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(2)), F.lit(n_blocks)).cast("int")).withColumn("shard", every(shards))

    def search(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if rows.num_rows and wanted.num_rows:
            dim = rows["dim"][0].as_py()
            ids, tree = rows["vec_id"].to_numpy(), BallTree(matrix(rows["vec"], dim))
            q = matrix(wanted["vec"], dim)
            reach = np.linalg.norm(q, axis=1)[:, None] * tree.radii[None, :]
            bounds = q @ tree.centres.T + reach
            bounds += 1e-6 * (np.abs(bounds) + reach) + 1e-3  # more than rounding can take from a bound
            floors = wanted["floor"].to_numpy()
            for j, (uid, own) in enumerate(zip(wanted["uid"].to_pylist(), wanted["vec_id"].to_pylist(), strict=True)):
                best = tree.search(q[j], bounds[j], ids, own, k, floors[j])
                found += [(uid, own, -minus, score) for score, minus in best]
        columns = [*zip(*found, strict=True)] or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["uid", "query_id", "vec_id", "score"])

    keys = ("dim", "shard", "part")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "uid bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
