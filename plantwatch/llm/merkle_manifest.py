"""Merkle manifest of a document table, and a proof for every document by a recursive query.

A leaf is the hash of a row's columns. Per source, ordered by id, every 16 consecutive nodes become one until one is left
(the subroot); subroots, ordered by source, become the root in the same way. The levels are stored as rows, one per run of
up to 16 siblings, each with the address of its parent. A recursive query of Spark SQL climbs these rows from every leaf: a
step joins the run that the node lies in and folds the claimed hash with the siblings into the parent's. The siblings above
the first run are the same for its 16 leaves, so the first of them appends them for all; those within are taken from the run.

Scale. Ids are put in order by one range shuffle of the whole table, so a source that owns a third of the rows is spread
like the rest; places within a source follow from counts per task. Near the root all leaves meet the same run: runs
are repeated per salt so that about `SPREAD` leaves meet one copy, at most a sixteenth of the leaves in rows per level.
Texts are hashed where they are read and never move. The driver holds the numbers of levels and of runs per level.

Rows and ties: every row is a leaf. Rows that share an id lie side by side, in order of their leaf hashes; equal rows get
equal leaves and their own places. A null id comes first in its source, a null source is a source of its own, a null column
counts as `-`, an empty text as `0:`. One source has its subroot as root, one row its leaf. An empty table gives an empty
result. Other columns are ignored; of columns whose names differ by case only, the one written as here is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantwatch.llm.common import cut_lineage, picked

FANOUT = 16
DIGEST = 32
SPREAD = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the tree over the subroots; other trees have the number of their source
RECURSION = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "-1"}


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _hashed(text: Column) -> Column:
    """SHA-256 as 32 bytes, half the size of its hex text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf_hash(values: dict[str, Column]) -> Column:
    """Hash of the fields in their order: `-` for null, else the count of UTF-8 bytes, a colon and the value."""
    parts = []
    for name in FIELDS:
        value = values[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return _hashed(F.concat(*parts))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else. `lower` does the same faster where every character is one byte."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, source, leaf, claimed): `claimed` is the hash of the row as it is presented, altered where `tampered` says so."""
    kinds = {c: "bigint" if c in ("doc_id", "n_chars") else "string" for c in FIELDS}
    rows = picked(docs, FIELDS).select(*[F.col(str(k)).cast(kinds[c]).alias(c) for k, c in enumerate(FIELDS)])
    fields = {c: F.col(c) for c in FIELDS}
    leaf = leaf_hash(fields)
    altered = F.when(tampered, leaf_hash({**fields, "text": lower_ascii(F.col("text"))}))
    return rows.select("doc_id", "source", leaf.alias("leaf"), altered.alias("_altered")).select(
        "doc_id", "source", "leaf", F.coalesce("_altered", "leaf").alias("claimed")
    )


def in_order(rows: DataFrame, group: str | None, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with `number`, unique, and `place`, 0-based within their group, in this order; and (group, n).

    One range shuffle sorts the table. The number that Spark gives a stored row holds its task and its place there, so
    places need nothing but the counts per task and group.
    """
    by = [*([group] if group else []), *order]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("number", F.monotonically_increasing_id())
    stored = cut_lineage(ordered)
    key = F.col(group) if group else F.lit(0)
    task = F.shiftright("number", 33)
    counts = cut_lineage(
        stored.groupBy(key.alias("_group"), task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"), F.min("number").alias("_first"))
    )
    earlier = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = key.eqNullSafe(F.col("_group")) & (task == F.col("_task"))
    placed = stored.join(starts, same).withColumn("place", F.col("_before") + F.col("number") - F.col("_first"))
    sizes = counts.groupBy("_group").agg(F.sum("_n").alias("n"))
    return placed.drop("_group", "_task", "_before", "_first"), sizes


@dataclass(frozen=True)
class Levels:
    """The stored runs of all levels and the last node of each tree, with the number of runs per level."""

    runs: DataFrame
    last: DataFrame
    runs_per_level: list[int]


def build_levels(nodes: DataFrame) -> Levels:
    """Levels over (tree, place, digest, size), where `size` is the number of nodes that the tree begins with.

    Runs are (tree, level, run, children, lone): `lone` marks the run below a tree's last node. `last` is (tree, digest).
    """
    written, counts = [], []
    last = nodes.where("size = 1").select("tree", "digest")
    while True:
        gathered = nodes.where("size > 1").groupBy("tree", "size", F.floor(F.col("place") / FANOUT).alias("run"))
        # At most 16 digests in a run, joined into one value of 32 bytes each.
        run = F.array_sort(F.collect_list(F.struct("place", "digest")))
        children = F.aggregate(run, F.lit(b""), lambda joined, node: F.concat(joined, node["digest"]))
        rows = gathered.agg(children.alias("children")).withColumns({"level": F.lit(len(counts)), "lone": F.col("size") <= FANOUT})
        stored = cut_lineage(rows)
        written.append(stored)
        n = stored.count()
        if not n:
            break
        counts.append(n)
        digest = _hashed(_hex(F.col("children"))).alias("digest")
        nodes = stored.select("tree", F.col("run").alias("place"), digest, F.ceil(F.col("size") / FANOUT).alias("size"))
        last = last.unionByName(nodes.where("size = 1").select("tree", "digest"))
    return Levels(reduce(DataFrame.unionByName, written).drop("size"), last, counts)


def _salts(n_leaves: int, runs_per_level: list[int]) -> list[int]:
    """Copies of each run of a level: about SPREAD leaves a copy, and no more than a sixteenth of the leaves in rows."""
    return [max(1, n_leaves // max(SPREAD, FANOUT * n)) for n in runs_per_level] or [1]


def parent_linked(below: Levels, above: Levels, n_leaves: int) -> DataFrame:
    """All runs, (tree, level, run, salt, children, up_tree, up_level, up_place): the latter are the address of their parent.

    A subroot's address is the place of its source in the tree above; the root has none, and a null `up_tree` leads there.
    """
    subroots_are_nodes = F.lit(bool(above.runs_per_level))

    def linked(levels: Levels, up_tree: Column, up_place: Column) -> DataFrame:
        each = F.array(*[F.lit(n).cast("bigint") for n in _salts(n_leaves, levels.runs_per_level)])
        salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.get(each, F.col("level")) - 1))
        tree = F.when(F.col("lone"), up_tree).otherwise(F.col("tree")).cast("bigint")
        up_level = F.when(F.col("lone"), F.lit(0)).otherwise(F.col("level") + 1)
        place = F.when(F.col("lone"), up_place).otherwise(F.col("run")).cast("bigint")
        return levels.runs.select(
            "tree", "level", "run", salt.alias("salt"), "children", tree.alias("up_tree"), up_level.alias("up_level"), place.alias("up_place")
        )

    rising = linked(below, F.when(subroots_are_nodes, F.lit(TOP)), F.col("tree"))
    return cut_lineage(rising.unionByName(linked(above, F.lit(None), F.lit(0))))


# A step up: the run that the node lies in gives the siblings, and the parent's hash as the claimed one would make it.
CLIMB = f"""
WITH RECURSIVE climb(number, step, tree, level, place, first, folded, siblings) AS (
  SELECT number, 0, tree, 0, place, first, claimed, CAST('' AS BINARY) FROM {{starts}}
  UNION ALL
  SELECT number, step + 1, up_tree, up_level, up_place, first,
    unhex(sha2(CAST(lower(hex(concat(ahead, folded, behind))) AS BINARY), 256)),
    IF(first AND (step > 0 OR tree = {TOP}), concat(ahead, behind), CAST('' AS BINARY))
  FROM (
    SELECT c.number, c.step, c.tree, c.first, c.folded, r.up_tree, r.up_level, r.up_place,
      substring(r.children, 1, CAST(c.place % {FANOUT} * {DIGEST} AS INT)) AS ahead,
      substring(r.children, CAST((c.place % {FANOUT} + 1) * {DIGEST} + 1 AS INT)) AS behind
    FROM climb c JOIN {{runs}} r ON c.tree = r.tree AND c.level = r.level AND c.place DIV {FANOUT} = r.run
      AND c.number % get(IF(c.tree = {TOP}, {{salts_above}}, {{salts_below}}), c.level) = r.salt))
SELECT number, step, tree IS NULL AS arrived, folded, siblings FROM climb WHERE tree IS NULL OR length(siblings) > 0
"""


def climbed(starts: DataFrame, runs: DataFrame, salts_below: Sequence[int], salts_above: Sequence[int]) -> DataFrame:
    """(number, step, arrived, folded, siblings) from the recursive query: a row for each leaf that has arrived at the root, and
    one for each step that appends siblings.

    Spark stops a recursive query at a number of rows. Here they are as many as leaves times levels, so the query runs, and
    what it gives is stored, with that limit off.
    """
    spark = starts.sparkSession
    text = CLIMB.format(
        starts="{starts}",
        runs="{runs}",
        salts_below=f"array({', '.join(f'{n}L' for n in salts_below)})",
        salts_above=f"array({', '.join(f'{n}L' for n in salts_above)})",
    )
    before = {name: spark.conf.get(name) for name in RECURSION}
    try:
        for name, value in RECURSION.items():
            spark.conf.set(name, value)
        return cut_lineage(spark.sql(text, starts=starts, runs=runs))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def merkle_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    `tampered` is a condition on doc_id; such rows are presented with their texts in lower case. `proof_sha256` is the hash of
    all siblings on the way up, `folded_root` what the presented leaf and the original siblings give.
    """
    # Stored, since a range shuffle reads its rows twice: once to find its bounds.
    placed, sizes = in_order(cut_lineage(leaves(docs, tampered)), "source", ["doc_id", "leaf"])
    # Sources in order: their places in the tree above are also the numbers of their own trees.
    numbered, _ = in_order(sizes.withColumnRenamed("_group", "source"), None, ["source"])
    sources = cut_lineage(numbered.select(F.col("source").alias("_of"), F.col("place").alias("tree"), F.col("n").alias("size")))
    base = cut_lineage(placed.join(sources, F.col("source").eqNullSafe(F.col("_of"))).drop("_of", "source"))
    n_leaves, n_sources = base.count(), sources.count()

    below = build_levels(base.select("tree", "place", F.col("leaf").alias("digest"), "size"))
    subroots = cut_lineage(below.last)
    above = build_levels(
        subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(n_sources).cast("bigint").alias("size"))
    )
    top = above.last.select(_hex(F.col("digest"))).first()
    runs = parent_linked(below, above, n_leaves)
    # A lone leaf is its own subroot and starts in the tree above; a lone subroot is the root.
    lone, first = F.col("size") == 1, F.col("place") % FANOUT == 0
    start = F.when(~lone, F.col("tree")).when(F.lit(n_sources > 1), F.lit(TOP))
    starts = base.select(
        "number", start.cast("bigint").alias("tree"), F.when(lone, F.col("tree")).otherwise(F.col("place")).alias("place"), first.alias("first"), "claimed"
    )
    steps = climbed(starts, runs, _salts(n_leaves, below.runs_per_level), _salts(n_leaves, above.runs_per_level))
    arrived = steps.where("arrived").select("number", _hex(F.col("folded")).alias("folded_root"))
    # A handful of steps per first leaf: one for each level.
    way = F.transform(F.array_sort(F.collect_list(F.struct("step", "siblings"))), lambda s: _hex(s["siblings"]))
    higher = steps.where(F.length("siblings") > 0).groupBy("number").agg(F.array_join(way, "").alias("higher"))
    own_run = F.floor(F.col("place") / FANOUT).alias("run")
    shared = base.where(first).select("number", "tree", own_run).join(higher, "number", "left").drop("number")
    lowest = below.runs.where("level = 0").select("tree", "run", "children")
    shared = shared.join(lowest, ["tree", "run"], "left").join(subroots.select("tree", _hex(F.col("digest")).alias("subroot")), "tree")
    at = (F.col("place") % FANOUT * DIGEST).cast("int")
    ahead, behind = F.col("children").substr(F.lit(1), at), F.substring("children", at + DIGEST + 1, F.lit(FANOUT * DIGEST))
    within = F.coalesce(_hex(F.concat(ahead, behind)), F.lit(""))
    root = F.lit(top[0] if top else None).cast("string")
    return (
        base.select("number", "doc_id", "tree", "place", "leaf", own_run)
        .join(arrived, "number")
        .join(shared, ["tree", "run"])
        .select(
            "doc_id", _hex(F.col("leaf")).alias("leaf"), "subroot", root.alias("root"),
            F.sha2(F.concat(within, F.coalesce("higher", F.lit(""))).cast("binary"), 256).alias("proof_sha256"),
            "folded_root", (F.col("folded_root") == root).alias("verified"),
        )
    )
