"""Training preparation: splits, scaling, weights, operating points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantwatch.local import local_table, measured
from plantwatch.operators.ordered import ROWS_PER_SLICE, running, slice_rows
from plantwatch.session import cut_lineage

SCALE_EPSILON = 1e-8


def stratified_split(
    df: DataFrame,
    strata: str,
    by: Sequence[str],
    ratio: float = 0.2,
    seed: int = 42,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add `split`: in every stratum the first round(n * ratio) rows by hash are "test".

    `by` identifies a row. The split point of a stratum is found by a radix descent over the 64 bits of the hash: counts per band
    of 16 bits tell the band it falls in, and a band with more than `rows_per_slice` rows is counted again by its
    next 16 bits. Only the rows of the last band are ranked, so no task ranks more than `rows_per_slice` of a stratum.
    """
    draw = F.xxhash64(*by, F.lit(seed))
    ids = [F.col(c).alias(f"_id_{i}") for i, c in enumerate(by)]
    order = ["_draw", *[f"_id_{i}" for i in range(len(by))]]
    drawn = df.select(F.col(strata).alias("_stratum"), draw.alias("_draw"), *ids)
    in_band, boundary = drawn, None
    for shift in (48, 32, 16, 0):
        if boundary is not None:
            of_band = F.col("_stratum").eqNullSafe(F.col("_of")) & (F.shiftright("_draw", shift + 16) == F.col("_in"))
            in_band = drawn.join(boundary.select("_of", "_in", "_take"), of_band)
        boundary = cut_lineage(_boundary(in_band, shift, None if boundary is not None else ratio))
        if (boundary.agg(F.max("_n")).first()[0] or 0) <= rows_per_slice:
            break
    of_band = F.col("_stratum").eqNullSafe(F.col("_of")) & (F.shiftright("_draw", shift) == F.col("_in"))
    ranked = Window.partitionBy("_of").orderBy(*order)
    # One row per stratum that has a test row: its last one.
    cuts = measured(
        drawn.join(boundary, of_band)
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") == F.col("_take"))
        .select("_of", *[F.col(c).alias(f"_cut{c}") for c in order])
    )
    mine = F.struct(draw.alias("_draw"), *ids)
    cut = F.struct(*[F.col(f"_cut{c}").alias(c) for c in order])
    in_test = F.col("_of").eqNullSafe(F.col(strata)) & F.col("_cut_draw").isNotNull() & (mine <= cut)
    return (
        df.join(cuts, F.col(strata).eqNullSafe(F.col("_of")), "left")
        .withColumn("split", F.when(in_test, F.lit("test")).otherwise(F.lit("train")))
        .drop("_of", *[f"_cut{c}" for c in order])
    )


def _boundary(rows: DataFrame, shift: int, ratio: float | None) -> DataFrame:
    """(_of, _in, _n, _take): the band of each stratum that its split point falls in, and how many of its rows are taken.

    Bands are what is left of the hash after the shift, which keeps the sign and so the order. Without a `ratio`, the rows are those of
    a wider band and carry what is left to take as `_take`.
    """
    taken = [] if ratio is not None else ["_take"]
    per_band = rows.groupBy("_stratum", *taken, F.shiftright("_draw", shift).alias("_band")).agg(F.count(F.lit(1)).alias("_n"))
    in_stratum = Window.partitionBy("_stratum")
    before = in_stratum.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    # Half to even, as the split sizes are defined.
    goal = F.col("_take") if ratio is None else F.bround(F.sum("_n").over(in_stratum) * F.lit(float(ratio))).cast("long")
    return (
        per_band.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_goal", goal)
        .filter((F.col("_before") < F.col("_goal")) & (F.col("_goal") <= F.col("_before") + F.col("_n")))
        .select(F.col("_stratum").alias("_of"), F.col("_band").alias("_in"), "_n", (F.col("_goal") - F.col("_before")).alias("_take"))
    )


@dataclass(frozen=True)
class ZScore:
    """Mean and scale per feature."""

    mean: tuple[float, ...]
    std: tuple[float, ...]

    def scaled(self, features: Column) -> Column:
        mean = F.array(*[F.lit(m) for m in self.mean])
        std = F.array(*[F.lit(s) for s in self.std])
        return F.transform(features, lambda x, i: (x - F.get(mean, i)) / F.get(std, i))

    def save(self, spark: SparkSession, path: str, size: int) -> None:
        """Write the scaling, with the frame length it was learnt on."""
        rows = [(i, m, s, size) for i, (m, s) in enumerate(zip(self.mean, self.std))]
        schema = "feature int, mean double, std double, size int"
        local_table(spark, rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> tuple[ZScore, int]:
        rows = spark.read.parquet(path).orderBy("feature").collect()
        return ZScore(tuple(r["mean"] for r in rows), tuple(r["std"] for r in rows)), rows[0]["size"]


def frame_weights(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int = 20,
    rows_per_slice: int = ROWS_PER_SLICE,
    trailing: bool = False,
) -> DataFrame:
    """Add `weight`: how many full frames of `size` rows a row is in.

    It follows from the row's place in its key and the key's length, so no frame is made. Frames are those of `lag_windows`, or, with
    `trailing`, of `trailing_frames`.
    """
    counted = running(slice_rows(df, keys, order, rows_per_slice), {"_upto": ("sum", F.lit(1).cast("long"))}, whole=["_upto"]).rows()
    # A frame ends right before a row from the place `size` on, or at a row from the place `size` - 1 on.
    skip = 0 if trailing else 1
    place, last = F.col("_upto") - 1, F.col("_upto_all") - 1
    first_end = F.greatest(place + skip, F.lit(size - 1 + skip))
    last_end = F.least(place + size - 1 + skip, last)
    return counted.withColumn("weight", F.greatest(last_end - first_end + 1, F.lit(0))).drop("_upto", "_upto_all")


MOMENTS = "feature int, weight double, mean double, squares double"


def _merged(one: tuple, other: tuple) -> tuple:
    """Weight, mean and squared deviations of two groups together."""
    weight = one[0] + other[0]
    share = np.divide(other[0], weight, out=np.zeros_like(weight), where=weight > 0)
    gap = np.where(one[0] * other[0] > 0, other[1] - one[1], 0)
    mean = np.where(one[0] > 0, one[1] + gap * share, other[1])
    return weight, mean, one[2] + other[2] + gap * gap * one[0] * share


def _batch_moments(values: np.ndarray, known: np.ndarray, weight: np.ndarray) -> tuple:
    """Weight, mean and squared deviations of every column of `values`, over the entries that are known."""
    shares = np.where(known, weight[:, None], 0.0)
    total = shares.sum(axis=0)
    mean = np.divide((np.where(known, values, 0) * shares).sum(axis=0), total, out=np.zeros(len(total)), where=total > 0)
    return total, mean, (np.where(shares > 0, values - mean, 0) ** 2 * shares).sum(axis=0)


def _settled(partial: DataFrame) -> DataFrame:
    """(feature, mean, std) from the moments of all partitions; std is that of the population plus a tiny constant."""
    every = Window.partitionBy("feature")
    total = F.sum("weight").over(every)
    centred = partial.withColumn("_all", F.try_divide(F.sum(F.col("weight") * F.col("mean")).over(every), total))
    gap = F.col("mean") - F.col("_all")
    squares = F.sum(F.col("squares") + F.col("weight") * gap * gap)
    std = F.sqrt(F.try_divide(squares, F.sum("weight"))) + F.lit(SCALE_EPSILON)
    return centred.groupBy("feature").agg(F.max("_all").alias("mean"), std.alias("std"))


def weighted_stats(rows: DataFrame, features: Sequence[str], weight: str = "weight") -> DataFrame:
    """(feature, mean, std) over columns, every row counted by its weight; features are numbered in their order.

    Each task merges its batches into one row per feature, and those rows are merged again. Unknown values do not count.
    """
    narrow = rows.where(F.col(weight) > 0).select(F.col(weight).cast("double").alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    names = [f"x{i}" for i in range(len(features))]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            known = np.stack([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in names], axis=1)
            values = np.stack([batch.column(c).fill_null(0.0).to_numpy() for c in names], axis=1)
            here = _batch_moments(values, known, batch.column("w").to_numpy())
            held = here if held is None else _merged(held, here)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), *map(pa.array, held)], ["feature", "weight", "mean", "squares"])

    return _settled(narrow.mapInArrow(moments, MOMENTS))


def zscore_stats(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """(feature, mean, std) over the rows of all frames: a reading counts once per frame it is in.

    Frames are read as they are, an array of feature arrays per row, and never exploded. For the frames of whole windows,
    `weighted_stats` of `frame_weights` gives the same from one row per reading.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = batch.column(0).flatten()
            rows = rows.filter(rows.is_valid())
            flat = rows.flatten()
            if not len(flat):
                continue
            sizes = np.diff(rows.offsets.to_numpy()) if rows.offset == 0 else rows.value_lengths().to_numpy()
            # Feature arrays of one width; shorter ones leave their last features unknown.
            place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            of = np.repeat(np.arange(len(sizes)), sizes)
            values, known = np.zeros((len(sizes), sizes.max())), np.zeros((len(sizes), sizes.max()), dtype=bool)
            values[of, place] = flat.fill_null(0.0).to_numpy()
            known[of, place] = flat.is_valid().to_numpy(zero_copy_only=False)
            here = _batch_moments(values, known, np.ones(len(sizes)))
            if held is not None and len(held[0]) != len(here[0]):
                width = max(len(held[0]), len(here[0]))
                held, here = (tuple(np.pad(x, (0, width - len(x))) for x in m) for m in (held, here))
            held = here if held is None else _merged(held, here)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held[0]), dtype=np.int32)), *map(pa.array, held)], ["feature", "weight", "mean", "squares"])

    return _settled(frames.select(F.col(frame).cast("array<array<double>>").alias("f")).mapInArrow(moments, MOMENTS))


def fit_zscore(frames: DataFrame, width: int, frame: str = "frame") -> ZScore:
    """Scaling learnt from the rows of all training frames."""
    found = {r["feature"]: r for r in zscore_stats(frames, frame).collect()}
    return ZScore(tuple(found[i]["mean"] for i in range(width)), tuple(found[i]["std"] for i in range(width)))


def apply_zscore(df: DataFrame, scaling: ZScore, frame: str = "frame") -> DataFrame:
    """Scale every feature array of every frame."""
    return df.withColumn(frame, F.transform(frame, scaling.scaled))


def positive_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, positives, weight): negatives per positive, with at least one positive assumed."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in labels])
    floored = F.greatest(F.coalesce(F.col("_positives"), F.lit(0)), F.lit(1))
    return counts.unpivot(["_n"], list(labels), "label", "_positives").select(
        "label", floored.alias("positives"), ((F.col("_n") - floored) / floored).alias("weight")
    )


def operating_point(
    scored: DataFrame, score: str, contamination: float, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """One row: the score above which the given share of rows lies.

    The exact percentile with linear interpolation between the two neighbouring scores; `flagged`
    rows lie above it.
    """
    counts = (
        scored.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("_s"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    sliced = slice_rows(counts, [], ["_s"], rows_per_slice, checkpoint=True)
    ranked = running(sliced, {"_upto": ("sum", F.col("_n"))}, whole=["_upto"]).rows()
    place = F.lit(1.0 - contamination) * (F.col("_upto_all") - 1)
    lower = F.floor(place)
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    holds_lower = lower.between(first, last)
    holds_upper = F.least(lower + 1, F.col("_upto_all") - 1).between(first, last)
    bounds = ranked.agg(
        F.max(F.when(holds_lower, F.col("_s"))).alias("_low"),
        F.max(F.when(holds_upper, F.col("_s"))).alias("_high"),
        F.max(F.when(holds_lower, place - lower)).alias("_share"),
        F.max(F.when(holds_lower, F.col("_upto"))).alias("_at_low"),
        F.max("_upto_all").alias("_all"),
    )
    cut = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")
    return bounds.select(cut.alias("threshold"), (F.col("_all") - F.col("_at_low")).alias("flagged"))
