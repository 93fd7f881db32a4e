"""Ordered work that never puts a large key, or one global series, into one task.

Keys that fit one task are left whole. Where a key has more than `rows_per_slice` rows, the table is cut into *slices* of about
that many rows by a sample sort: splitters are whole tuples of key and order columns, drawn by Spark's range
partitioner, NULL and NaN included, so rows that share a time are parted by their number. A window then runs per (key, slice), and
what a slice must know of its past arrives as a few *carry rows* placed in front of it:

* for running totals, one row with the total of the earlier slices;
* for frames of the last n rows, the n rows that precede the slice.

The cut table is written to shared storage, since splitters come from a sample and both passes over the rows must see the same
ones; a lost executor reads it again. The driver holds two counts. A key that owns a third of the table is spread over as many tasks as
it has slices. Only rows that agree in the key and in every order column stay together; an order that identifies a row has none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.session import cut_lineage

ROWS_PER_SLICE = 1_000_000
SALTS = 64

SLICE, CARRY = "_slice", "_carry"


@dataclass(frozen=True)
class Sliced:
    """Rows with their slice number; `single` says that every key is one slice."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    single: bool

    def rows(self) -> DataFrame:
        return self.df.drop(SLICE)


def slice_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_slice: int = ROWS_PER_SLICE,
    checkpoint: bool = False,
) -> Sliced:
    """Add the slice number of every row; within a key it never decreases along the order.

    Counts the rows per key and, when a key exceeds one slice, sorts the table into slices and stores it. `checkpoint=True` stores
    the input first; use it when the input is more than a scan, which is read to count, to draw splitters and to deal.
    """
    if checkpoint:
        df = cut_lineage(df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    if (most or 0) <= rows_per_slice:
        return Sliced(df.withColumn(SLICE, F.lit(0)), tuple(keys), tuple(order), single=True)
    dealt = df.repartitionByRange(ceil(total / rows_per_slice), *keys, *order)
    return Sliced(cut_lineage(dealt.withColumn(SLICE, F.spark_partition_id())), tuple(keys), tuple(order), single=False)


def stored(sliced: Sliced) -> Sliced:
    """Store the rows between two passes, each of which reads its input twice."""
    return sliced if sliced.single else replace(sliced, df=cut_lineage(sliced.df))


def running(
    sliced: Sliced,
    totals: Mapping[str, tuple[str, Column]],
    whole: Sequence[str] = (),
    before: Sequence[str] = (),
    backward: bool = False,
) -> Sliced:
    """Running totals per key in ascending order, which must identify a row within its key.

    `totals` maps an output name to ("sum" | "max" | "min", value). Names in `before` leave out the
    current row. For a name in `whole` a column `<name>_all` holds the total of the entire key.
    `backward` runs from the last row of a key to its first.
    """
    along = F.desc if backward else F.asc
    functions = {"sum": F.sum, "max": F.max, "min": F.min}
    keys, order = list(sliced.keys), sliced.order
    group = [*keys, SLICE]
    kept = [*sliced.df.columns, *totals, *[f"{name}_all" for name in whole]]
    out = sliced.df.select("*", *[value.alias(f"_v_{name}") for name, (_, value) in totals.items()])

    if sliced.single:
        ordered = Window.partitionBy(*group).orderBy(*[along(c) for c in order])
    else:
        # One row per (key, slice): a key has a row for each `rows_per_slice` of its rows.
        per_slice = out.groupBy(*group).agg(
            *[functions[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in totals.items()]
        )
        past = Window.partitionBy(*keys).orderBy(along(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        entire = Window.partitionBy(*keys)
        carry = per_slice.select(
            *group,
            F.lit(True).alias(CARRY),
            *[functions[kind](f"_t_{name}").over(past).alias(f"_v_{name}") for name, (kind, _) in totals.items()],
            *[functions[totals[name][0]](f"_t_{name}").over(entire).alias(f"{name}_all") for name in whole],
        )
        out = out.withColumn(CARRY, F.lit(False)).unionByName(carry, allowMissingColumns=True)
        ordered = Window.partitionBy(*group).orderBy(F.desc(CARRY), *[along(c) for c in order])

    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in totals.items():
        out = out.withColumn(name, functions[kind](f"_v_{name}").over(earlier if name in before else upto))
    for name in whole:
        if sliced.single:
            total = functions[totals[name][0]](f"_v_{name}").over(Window.partitionBy(*group))
        else:
            total = F.first(f"{name}_all", ignorenulls=True).over(upto)
        out = out.withColumn(f"{name}_all", total)
    if not sliced.single:
        out = out.filter(~F.col(CARRY))
    return replace(sliced, df=out.select(*kept))


def positions(sliced: Sliced, name: str = "position") -> Sliced:
    """Dense 0-based position of every row within its key."""
    counted = running(sliced, {name: ("sum", F.lit(1).cast("long"))})
    return replace(counted, df=counted.df.withColumn(name, F.col(name) - 1))


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    rows_per_slice: int = ROWS_PER_SLICE,
    checkpoint: bool = False,
) -> DataFrame:
    """`positions` of a DataFrame; `order` must identify a row within its key."""
    return positions(slice_rows(df, keys, order, rows_per_slice, checkpoint), name).rows()


def with_past_rows(sliced: Sliced, depth: int) -> DataFrame:
    """The sliced rows plus, marked in CARRY, copies of the `depth` rows in front of every slice."""
    rows = sliced.df.withColumn(CARRY, F.lit(False))
    if sliced.single or depth < 1:
        return rows
    keys = sliced.keys
    latest = Window.partitionBy(*keys, SLICE).orderBy(*[F.desc(c) for c in sliced.order])
    tails = sliced.df.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") <= depth)
    # At most `depth` rows per (key, slice) are left, so a whole key fits one window here. A row
    # belongs in front of every slice that begins within the next `depth` of these rows.
    following = Window.partitionBy(*keys).orderBy(SLICE, F.desc("_rank")).rowsBetween(1, depth)
    copies = (
        tails.withColumn("_ahead", F.collect_set(SLICE).over(following))
        .withColumn(SLICE, F.explode(F.array_except("_ahead", F.array(SLICE))))
        .drop("_ahead", "_rank")
    )
    return rows.unionByName(copies.withColumn(CARRY, F.lit(True)))


def _frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    first: int,
    last: int,
    rows_per_slice: int,
) -> DataFrame:
    padded = with_past_rows(slice_rows(df, keys, order, rows_per_slice), -first)
    span = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(first, last)
    row = F.array(*[F.col(c).cast("double") for c in features])
    framed = padded.withColumn("frame", F.collect_list(row).over(span))
    return framed.filter(~F.col(CARRY)).drop(SLICE, CARRY)


def lag_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    size: int = 20,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Training frames: every row with the `size` rows before it as `frame`, an array of feature
    arrays. The first `size` rows of a key have no full past and are left out."""
    return _frames(df, keys, order, features, -size, -1, rows_per_slice).filter(F.size("frame") == size)


def lag_windows_bucketed(
    df: DataFrame,
    order: Sequence[str],
    features: Sequence[str],
    size: int = 20,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """`lag_windows` over one series without a key, still cut into slices."""
    return lag_windows(df, [], order, features, size, rows_per_slice)


def trailing_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    size: int = 20,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Scoring frames: the last `size` rows up to and including the current one."""
    return partial_frames(df, keys, order, features, size, rows_per_slice).filter(F.size("frame") == size)


def partial_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[str],
    size: int = 20,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """`trailing_frames` of every row, shorter at the start of a key."""
    return _frames(df, keys, order, features, 1 - size, 0, rows_per_slice)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank"
) -> DataFrame:
    """First k rows per key in the given order, numbered from 1; the order must be total.

    Spark cuts to k rows per key in every task before the shuffle. What the tasks keep of one key
    goes to many tasks first, chosen by the task it comes from, and only k rows of each go on: the
    final sort of a hot key does not grow with the table.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for group in ([*keys, "_salt"], list(keys)):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        salted = salted.withColumn(name, place).filter(F.col(name) <= k)
    return salted.drop("_salt")


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows per key, with `recency` 1 for the newest."""
    return top_per_key(df, keys, [F.desc(c) for c in order], n, "recency")
