"""Isolation forest: samples drawn and trees grown in parallel, scores from a broadcast model.

Trees see at most `sample` rows each, so the model and everything the driver holds have a size set
by the parameters and not by the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.local import local_table
from plantwatch.operators.ordered import ROWS_PER_SLICE, with_position
from plantwatch.operators.prep import operating_point
from plantwatch.session import cut_lineage

ROW_GROUP = 4 << 20
EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, path double"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, dtype=float)
    long = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER_GAMMA) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def grow_tree(values: np.ndarray, height: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, threshold, left, path) of one random tree; node 0 is the root.

    The right child follows the left one. A leaf points to itself and has no upper threshold, so
    that a walk of fixed length ends there.
    """
    nodes: list[tuple] = [()]
    todo = [(0, np.arange(len(values)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        inside = values[rows]
        low, high = inside.min(axis=0), inside.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= height or len(rows) <= 1 or not len(usable):
            nodes[node] = (node, 0, np.inf, node, depth + float(average_path(len(rows))))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = inside[:, feature] <= threshold
        left = len(nodes)
        nodes.extend([(), ()])
        nodes[node] = (node, feature, threshold, left, 0.0)
        todo += [(left, rows[goes_left], depth + 1), (left + 1, rows[~goes_left], depth + 1)]
    return nodes


@dataclass(frozen=True)
class IsolationForestModel:
    """Fitted forest. `roots` are the places of the tree roots in the node arrays."""

    features: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    height: int
    normal_path: float
    cut: float = 0.0

    def raw_scores(self, values: np.ndarray) -> np.ndarray:
        """2^(-mean path / normal path): near 1 for rows that are easy to isolate."""
        scaled = ((values - self.mean) / self.std).ravel()
        n = len(values)
        starts = np.arange(n) * len(self.features)
        total = np.zeros(n)
        # Every step writes into the same few arrays. All places are inside, so nothing is clipped; numpy would check and copy them otherwise.
        at, after, place = np.empty(n, self.left.dtype), np.empty(n, self.left.dtype), np.empty(n, self.feature.dtype)
        value, limit, right, path = np.empty(n), np.empty(n), np.empty(n, bool), np.empty(n)
        for root in self.roots:
            at.fill(root)
            for _ in range(self.height):
                self.feature.take(at, out=place, mode="clip")
                place += starts
                scaled.take(place, out=value, mode="clip")
                self.threshold.take(at, out=limit, mode="clip")
                np.greater(value, limit, out=right)
                # The right child follows the left one; nothing exceeds the threshold of a leaf.
                self.left.take(at, out=after, mode="clip")
                after += right
                at, after = after, at
            total += self.path.take(at, out=path, mode="clip")
        return np.exp2(-total / (len(self.roots) * self.normal_path))

    def score_column(self, columns: Sequence[Column]) -> Column:
        """Raw score of a row from its feature columns; NULL where a feature is missing."""
        # The closure holds the model, a few megabytes whatever the table size; Spark broadcasts it.
        model = self

        @F.pandas_udf("double")
        def score(*batch: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy(dtype=float) for c in batch])
            return pd.Series(np.where(np.isnan(values).any(axis=1), np.nan, model.raw_scores(values)))

        return F.nanvl(score(*[c.cast("double") for c in columns]), F.lit(None).cast("double"))

    def score(self, df: DataFrame) -> DataFrame:
        """Add `iforest_score`, positive for anomalies, and `predicted_failure`."""
        raw = self.score_column([F.col(c) for c in self.features])
        return df.withColumn("iforest_score", raw - F.lit(self.cut)).withColumn(
            "predicted_failure", (F.col("iforest_score") > 0).cast("int")
        )


    def save(self, spark: SparkSession, path: str) -> None:
        """Write the nodes, the scaling and the settings as three small tables."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        columns = (tree, self.feature, self.threshold, self.left, self.path)
        nodes = list(zip(range(len(self.feature)), *[c.tolist() for c in columns]))
        tables = {
            "nodes": (nodes, "node long, tree long, feature long, threshold double, left long, path double"),
            "scaling": (
                [(i, f, float(m), float(s)) for i, (f, m, s) in enumerate(zip(self.features, self.mean, self.std))],
                "place int, feature string, mean double, std double",
            ),
            "settings": ([(self.height, self.normal_path, self.cut)], "height int, normal_path double, cut double"),
        }
        for name, (rows, schema) in tables.items():
            local_table(spark, rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForestModel:
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values("node")
        scaling = spark.read.parquet(f"{path}/scaling").orderBy("place").collect()
        settings = spark.read.parquet(f"{path}/settings").first()
        return IsolationForestModel(
            features=tuple(r["feature"] for r in scaling),
            mean=np.array([r["mean"] for r in scaling]),
            std=np.array([r["std"] for r in scaling]),
            feature=nodes["feature"].to_numpy(),
            threshold=nodes["threshold"].to_numpy(),
            left=nodes["left"].to_numpy(),
            path=nodes["path"].to_numpy(),
            roots=np.flatnonzero(nodes["tree"].diff().to_numpy() != 0),
            height=settings["height"],
            normal_path=settings["normal_path"],
            cut=settings["cut"],
        )


@dataclass(frozen=True)
class IsolationForest:
    n_trees: int = 200
    sample: int = 256
    contamination: float = 0.01
    seed: int = 42

    def _below(self, draw: Column, share: float) -> Column:
        """True for the given share of evenly drawn 64-bit numbers."""
        return F.lit(True) if share >= 1 else draw < F.lit(int(-(2**63) + share * 2**64))

    def samples(self, df: DataFrame, by: Sequence[str], features: Sequence[str], rows: int) -> DataFrame:
        """(tree, draw, features): exactly `sample` rows per tree, or all rows of a smaller table.

        Every tree draws from all rows. One hash per row picks the rows that may be drawn at all, as many as all trees
        together take, and only those are hashed per tree. That gives a tree about twice the rows it needs; the
        lowest hashes of those make its sample.
        """
        share = min(1.0, 2.0 * self.sample / rows)
        any_tree = min(1.0, share * self.n_trees)
        candidates = df.filter(self._below(F.xxhash64(*by, F.lit(self.seed)), any_tree))
        trees = F.sequence(F.lit(0), F.lit(self.n_trees - 1))
        drawn = F.filter(trees, lambda t: self._below(F.xxhash64(*by, t, F.lit(self.seed + 1)), share / any_tree))
        candidates = candidates.select(*by, *features, F.explode(drawn).alias("tree")).withColumn(
            "draw", F.xxhash64(*by, F.col("tree"), F.lit(self.seed + 1))
        )
        lowest = Window.partitionBy("tree").orderBy("draw", *by)
        return (
            candidates.withColumn("_rank", F.row_number().over(lowest))
            .filter(F.col("_rank") <= self.sample)
            .select("tree", "draw", *[F.col(f).cast("double").alias(f) for f in features])
        )

    def fit(
        self,
        normal: DataFrame,
        features: Sequence[str],
        by: Sequence[str],
        rows_per_slice: int = ROWS_PER_SLICE,
    ) -> IsolationForestModel:
        """Fit scaling and forest on normal rows; the cut leaves `contamination` of them above it.

        `by` identifies a row and decides the samples, so a repeated fit gives the same forest.
        """
        features = list(features)
        usable = normal.dropna(subset=features)
        stats = usable.agg(
            F.count(F.lit(1)),
            *[F.avg(F.col(f).cast("double")) for f in features],
            *[F.stddev_pop(F.col(f).cast("double")) for f in features],
        ).first()
        rows, width = stats[0], len(features)
        if not rows:
            raise ValueError("no row to fit on")
        mean = np.array(stats[1 : 1 + width])
        std = np.array([s or 1.0 for s in stats[1 + width :]])
        size = min(self.sample, rows)
        height = max(1, ceil(log2(size)))
        seed = self.seed

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            ordered = pdf.sort_values(["draw", *features])
            values = (ordered[features].to_numpy(dtype=float) - mean) / std
            nodes = grow_tree(values, height, np.random.default_rng([seed, tree]))
            grown = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "path"])
            grown.insert(0, "tree", tree)
            return grown

        sampled = self.samples(usable, by, features, rows)
        # At most n_trees * (2 * sample - 1) small rows.
        grown = sampled.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
        grown = grown.sort_values(["tree", "node"], ignore_index=True)
        sizes = grown.groupby("tree").size()
        roots = np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]]).astype(np.int64)
        offset = np.repeat(roots, sizes.to_numpy())
        model = IsolationForestModel(
            features=tuple(features),
            mean=mean,
            std=std,
            feature=grown["feature"].to_numpy(dtype=np.int64),
            threshold=grown["threshold"].to_numpy(dtype=float),
            left=grown["left"].to_numpy(dtype=np.int64) + offset,
            path=grown["path"].to_numpy(dtype=float),
            roots=roots,
            height=height,
            normal_path=max(float(average_path(size)), 1e-12),
        )
        raw = usable.select(model.score_column([F.col(f) for f in features]).alias("raw"))
        cut = operating_point(raw, "raw", self.contamination, rows_per_slice).first()["threshold"]
        return IsolationForestModel(**{**model.__dict__, "cut": float(cut)})


def shuffled(place: Column, n: int, seed: int, rounds: int = 6) -> Column:
    """A place in 0..n-1 for every place in 0..n-1, each taken once, and none remembered.

    A Feistel network on a rectangle of places: a row's column moves by a hash of its row, then its row by a hash of its column, and so on.
    Every round can be undone, so no two places meet. The rectangle is a little larger than n; a place that lands
    outside goes on until it is inside, which keeps the map one to one.
    """
    wide = max(1, ceil(n**0.5))
    high = max(1, ceil(n / wide))

    def hashed(value: Column, k: Column, limit: int) -> Column:
        return F.pmod(F.xxhash64(value, k, F.lit(seed)), F.lit(limit).cast("bigint"))

    def turn(at: Column, k: Column) -> Column:
        x, y = at["x"], at["y"]
        return F.when(k % 2 == 0, F.struct(F.pmod(x + hashed(y, k, wide), F.lit(wide)).alias("x"), y.alias("y"))).otherwise(
            F.struct(x.alias("x"), F.pmod(y + hashed(x, k, high), F.lit(high)).alias("y"))
        )

    def once(at: Column) -> Column:
        start = F.struct((at % wide).cast("bigint").alias("x"), F.floor(at / wide).cast("bigint").alias("y"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: s["y"] * wide + s["x"])

    # Outside lies less than a row of the rectangle; a walk of 64 steps that never comes inside does not happen.
    steps = F.sequence(F.lit(0), F.lit(63))

    def walked(at: Column) -> Column:
        inside = lambda at: F.when(at < n, at).otherwise(F.raise_error(F.lit("no place inside")).cast("bigint"))
        return F.aggregate(steps, at, lambda at, _: F.when(at < n, at).otherwise(once(at)), inside)

    # The first step is taken once and named; few rows go on from there.
    first = F.transform(F.array(once(place.cast("bigint"))), lambda at: F.when(at < n, at).otherwise(walked(at)))
    return F.get(first, F.lit(0))


def permutation_importance(
    df: DataFrame,
    score: Callable[[Sequence[Column]], Column],
    features: Sequence[str],
    by: Sequence[str],
    seed: int = 42,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """(feature, importance): mean change of the score when one feature is shuffled, largest first.

    One shuffle serves all features. Rows are numbered once, in order of a hash, and a row's donor is the row that a bijection of the numbers
    sends there, so every value is given away exactly once.
    """
    columns = list(features)
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    numbered = with_position(
        rows.withColumn("_draw", F.xxhash64(*by, F.lit(seed))), [], ["_draw", *by], "_place", rows_per_slice
    )
    # A slice is one file; small row groups let many tasks read it.
    numbered = cut_lineage(numbered, **{"parquet.block.size": str(ROW_GROUP)})
    given_to = shuffled(F.col("_place"), numbered.count(), seed)
    donors = numbered.select(given_to.alias("_place"), *[F.col(c).alias(f"_other_{c}") for c in columns])
    paired = numbered.join(donors, "_place")
    variants = [score([F.col(c) for c in columns]).alias("_base")]
    for changed in columns:
        given = [F.col(f"_other_{c}") if c == changed else F.col(c) for c in columns]
        variants.append(score(given).alias(changed))
    changes = [F.avg(F.abs(F.col("_base") - F.col(c))).alias(c) for c in columns]
    return (
        paired.select(*variants)
        .agg(*changes)
        .unpivot([], columns, "feature", "importance")
        .orderBy(F.desc("importance"), "feature")
    )
