"""Exact Jaccard join of word-shingle sets with pivots, regions and triangle-inequality windows.

Documents with equal sets are one class. Jaccard distance is a metric, but unrelated documents all lie at distance 1 from each
other, where no pivot taken from the documents can tell them apart. The first pivots are therefore single shingles:
a set lies nearest (1 - 1/size) to the shingles it holds. All sets order the shingles alike, and a set's regions
are those of its first shingles, as many as a partner within the radius must share some of: that is the window in
which it is replicated. A set whose shared shingles are too few to have any partner leaves here.

Inside the regions pivots are sets. Every member's exact distance to its region's pivot is computed; members within the
radius are linked. A region whose members are connected by now is done. A region of more than `small` members takes several
pivots, sends each member to its nearest pivot and to every other within 2 x radius more (a pair within the radius meets in the
region of either's nearest pivot), and its regions are joined in the same way. What is left apart, and regions that the
pivots cannot part, is dealt as pairs of blocks of bounded size; sizes and counts per hash class say which members of
different components may be near. Regions have most members in common, so their pairs are named there, kept once, held against
finer counts and only then compared by their texts. Where a block has more pairs than it pays to name (`NAMED_PAIRS` per member),
its texts meet in it instead. That gives the components. Links never leave a component, so where their number is asked for, a
second pass compares all pairs inside each, again by pairs of blocks.

Nulls: a null text, or one without words, has an empty set and is linked with nothing. A null id never becomes a
component's id; a component without any id has none. Equal rows are members of one class. Ties have no effect: the
result does not depend on the choice of pivots. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.common import bounded_sample, cut_lineage, others, packed_blocks, packed_texts, picked, small_batches, unpacked
from plantwatch.llm.components import components
from plantwatch.llm.recurring import SCHEMA, recurring, routed
from plantwatch.llm.textblocks import BYTE_CODES, LOWER, Block, blocks, mixed, paired

SHINGLE, RADIUS_PERCENT = 5, 25
SAMPLE_DOCUMENTS, COMMON = 4000, 4
SMALL_REGION, PIVOTS, SKETCH = 4096, 8, 64
# Finer counts, for the classes of regions.
FINE, FINEST = 256, 1024
# Regions and components are compared as pairs of blocks of so many classes, and of so many shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1 << 18
GROUP_PAIRS = 512
# So many pairs per member of a block are named; so many pairs are held at a time.
NAMED_PAIRS, HELD_PAIRS = 64, 1 << 21
FEW_PAIRS, COLUMNS = 64, 4096
LOWER_CODES = BYTE_CODES[LOWER]


def shingle_sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all documents of a block, sorted by document and hash, and where each document's start."""
    starts, ends, document = block.words()
    words = block.hashes(block.prefix(LOWER_CODES), starts, ends)
    count = np.bincount(document, minlength=block.documents)
    state = words.copy()
    for k in range(1, size):
        state[: len(words) - k] = paired(state[: len(words) - k], words[k:])
    whole = np.flatnonzero(document[: len(words) - size + 1] == document[size - 1 :]) if len(words) >= size else np.zeros(0, np.int64)
    hashes, owner = state[whole], document[whole]
    for d in np.flatnonzero((count > 0) & (count < size)):
        at = np.searchsorted(document, d)
        short = words[at : at + 1]
        for k in range(1, int(count[d])):
            short = paired(short, words[at + k : at + k + 1])
        hashes, owner = np.append(hashes, mixed(short + np.uint64(count[d]))), np.append(owner, d)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(block.documents + 1))


def classes_of(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set from two sums over its members and its size; 0 for the empty set."""
    out = np.zeros(len(cut) - 1, np.int64)
    full = np.flatnonzero(np.diff(cut))
    if len(full):
        one = np.add.reduceat(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), cut[full])
        two = np.add.reduceat(mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)), cut[full])
        out[full] = (paired(one, two + np.diff(cut)[full].astype(np.uint64)) | np.uint64(1)).view(np.int64)
    return out


def sketches_of(hashes: np.ndarray, cut: np.ndarray, cells: int = SKETCH) -> np.ndarray:
    """How many members of each set fall into each of `cells` hash classes, at most 255.

    The counts of two sets differ in sum by no more than the sets do: a bound on their distance that needs no members.
    """
    n = len(cut) - 1
    owner = np.repeat(np.arange(n), np.diff(cut))
    at = owner * cells + (hashes % np.uint64(cells)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * cells), 255).astype(np.uint8).reshape(n, cells)


def must_share(n: np.ndarray) -> np.ndarray:
    """How many of its first shingles a set of size n shares with a partner of at least its size."""
    return 1 + n // 16


def least_overlap(n: np.ndarray, radius: int) -> np.ndarray:
    return (n * (100 - radius) + 99) // 100


def class_table(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, uid, cls, n, sketch) of every document of (doc_id, text); equal rows share their uid."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                hashes, cut = shingle_sets(block, size)
                ids, uids = (batch.column(c).slice(block.first, block.documents) for c in ("doc_id", "uid"))
                sketches = pa.array([x.tobytes() for x in sketches_of(hashes, cut)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids, uids, pa.array(classes_of(hashes, cut)), pa.array(np.diff(cut)), sketches], ["doc_id", "uid", "cls", "n", "sketch"]
                )

    named = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")
    return named.mapInArrow(rows, "doc_id bigint, uid bigint, cls bigint, n bigint, sketch binary")


def common_shingles(docs: DataFrame, size: int, sample: int, common: int) -> np.ndarray:
    """Shingles of at least `common` documents of a bounded sample, sorted; they come last in the order of shingles.

    Any order gives the same result. This one keeps passages that many documents hold out of the first shingles.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(block, size)[0].view(np.int64))], ["shingle"])

    ids = bounded_sample(docs, "doc_id", sample)
    found = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(rows, "shingle bigint")
    counts = found.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= common)
    return np.sort(counts.select("shingle").toArrow()["shingle"].to_numpy().astype(np.int64).view(np.uint64))


def first_shingles(docs: DataFrame, common: np.ndarray, size: int, radius: int) -> DataFrame:
    """The first shingles of each class, once per batch, as rows of `recurring`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(0, np.int64)
            shingles, classes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for block in blocks(batch.column("text")):
                hashes, cut = shingle_sets(block, size)
                cls, n = classes_of(hashes, cut), np.diff(cut)
                _, first = np.unique(cls, return_index=True)
                take = np.zeros(len(cls), dtype=bool)
                take[first] = True
                take &= (n > 0) & ~np.isin(cls, seen)
                seen = np.union1d(seen, cls[take])
                owner = np.repeat(np.arange(len(n)), n)
                keep = take[owner]
                hashes, owner = hashes[keep], owner[keep]
                last = np.zeros(len(hashes), dtype=bool)
                if len(common):
                    last = common[np.searchsorted(common, hashes).clip(0, len(common) - 1)] == hashes
                order = np.lexsort((hashes, last, owner))
                hashes, owner = hashes[order], owner[order]
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                wanted = n - least_overlap(n, radius) + must_share(n)
                near = place < wanted[owner]
                shingles.append(hashes[near].view(np.int64))
                classes.append(cls[owner[near]])
            yield routed(np.concatenate(shingles), np.concatenate(classes))

    return docs.select("text").mapInArrow(rows, SCHEMA)


def regions_of_shingles(first: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """(region, cls, n): classes that may have a partner, in the regions of their first shingles that other such classes hold.

    `sizes` has (cls, n). A class needs as many shared first shingles as it would share with its smallest partner.
    """
    shared = cut_lineage(recurring(first))
    held = shared.distinct().groupBy("uid").agg(F.count("*").alias("held")).join(sizes.hint("merge"), F.col("uid") == F.col("cls"))
    enough = 1 + F.floor(F.ceil(F.col("n") * (100 - radius) / 100) / 16)
    able = held.where(F.col("held") >= enough).select("uid", "n")
    regions = shared.join(able.hint("merge"), "uid").select(F.col("gram").alias("region"), F.col("uid").alias("cls"), "n").distinct()
    regions = cut_lineage(regions)
    # Shingles that stand side by side have the same members; one region of each set of members is enough.
    named = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"name_{k}") for k in (0, 1)]
    several = regions.groupBy("region").agg(F.count("*").alias("held"), *named).where("held > 1")
    chosen = several.groupBy("held", "name_0", "name_1").agg(F.min("region").alias("region")).select("region")
    return regions.join(chosen.hint("merge"), "region")


def class_texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, packed): one text of each wanted class. Copies are dropped in each batch before anything moves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            seen: dict[int, bytes] = {}
            for block in blocks(batch.column("text")):
                for k, cls in enumerate(classes_of(*shingle_sets(block, size)).tolist()):
                    if cls and cls not in seen:
                        seen[cls] = press.compress(block.text(k))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], ["cls", "packed"])

    packed = docs.select("text").mapInArrow(rows, "cls bigint, packed binary")
    return packed.join(wanted.hint("merge"), "cls").groupBy("cls").agg(F.first("packed").alias("packed"))


def fine_sketches(texts: DataFrame, size: int) -> DataFrame:
    """(cls, n, fine, finest) of the classes of (cls, packed)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _byte_slices(whole, "packed"):
                for block in packed_blocks(batch.column("packed")):
                    hashes, cut = shingle_sets(block, size)
                    sketches = [pa.array([x.tobytes() for x in sketches_of(hashes, cut, cells)], pa.binary()) for cells in (FINE, FINEST)]
                    cls = batch.column("cls").slice(block.first, block.documents)
                    yield pa.RecordBatch.from_arrays([cls, pa.array(np.diff(cut)), *sketches], ["cls", "n", "fine", "finest"])

    return texts.select("cls", "packed").mapInArrow(rows, "cls bigint, n bigint, fine binary, finest binary")


def distances(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) with `both` and `either`, the sizes of their sets' intersection and union.

    The pairs are stored first, as they are counted and dealt. Pairs with the same `a` go in groups of about GROUP_PAIRS; the text of `a` moves once per group, in front of the others.
    """
    pairs = cut_lineage(pairs)
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_PAIRS).cast("int").alias("groups"))
    dealt = pairs.join(counts.hint("merge"), "a").withColumn("part", F.pmod(F.xxhash64("b", F.lit("group")), F.col("groups")).cast("int"))
    dealt = cut_lineage(dealt.select("a", "part", "b"))
    members = dealt.select("a", "part", F.col("b").alias("cls"), F.lit(1).alias("role"))
    heads = dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("cls"), F.lit(0).alias("role"))
    rows = members.unionByName(heads).join(texts.hint("merge"), "cls").select("a", "part", "role", "cls", "packed")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_set = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in _byte_slices(whole, "packed"):
                a, part, role, cls = (batch.column(c).to_numpy() for c in ("a", "part", "role", "cls"))
                out: list[tuple[int, int, int, int]] = []
                for block in packed_blocks(batch.column("packed")):
                    hashes, cut = shingle_sets(block, size)
                    for k, (x, y) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False), block.first):
                        if role[k] == 0:
                            head, head_set = (a[k], part[k]), hashes[x:y].copy()
                            continue
                        assert head == (a[k], part[k])
                        both = len(np.intersect1d(head_set, hashes[x:y], assume_unique=True))
                        out.append((int(a[k]), int(cls[k]), both, len(head_set) + y - x - both))
                columns = zip(*out, strict=True) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "both", "either"])

    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return ordered.mapInArrow(count, "a bigint, b bigint, both bigint, either bigint")


def likely(pairs: DataFrame, classes: DataFrame, radius: int, sketch: str = "sketch") -> DataFrame:
    """The pairs (a, b) that can be within the radius by their sizes and sketches, so that no text moves for the others."""
    known = classes.where("n > 0").dropDuplicates(["cls"]).select("cls", F.struct("n", F.col(sketch).alias("sketch")).alias("s"))
    with_a = pairs.join(known.select(F.col("cls").alias("a"), F.col("s").alias("s_a")).hint("merge"), "a")
    rows = with_a.join(known.select(F.col("cls").alias("b"), F.col("s").alias("s_b")).hint("merge"), "b").select("a", "b", "s_a", "s_b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.num_rows
            n = np.concatenate([batch.column(c).field("n").to_numpy() for c in ("s_a", "s_b")])
            counts = np.frombuffer(b"".join(x for c in ("s_a", "s_b") for x in batch.column(c).field("sketch").to_pylist()), np.uint8)
            at = np.arange(half)
            near = _may_be_near(at, at + half, n, counts.reshape(2 * half, -1) if half else counts.reshape(0, 1), radius, np.ones(half, dtype=bool))
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return rows.mapInArrow(keep, "a bigint, b bigint")


def _byte_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes of a binary column, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = int(sizes[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _near(radius: int):
    return F.col("both") * 100 >= F.col("either") * (100 - radius)


def _fits(a: str, b: str, radius: int):
    """Sizes of sets that can be partners."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * (100 - radius)


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of (region, cls, n) with the component of each class; one without links is its own."""
    labels = comps.select(F.col("node").alias("cls"), "comp")
    return rows.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def still_apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Of pairs (a, b) of different components one for each `b` and component of `a`."""
    for side in ("a", "b"):
        labels = comps.select(F.col("node").alias(side), F.col("comp").alias(f"c_{side}"))
        pairs = pairs.join(labels.hint("merge"), side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    return pairs.where("c_a <> c_b").groupBy("b", "c_a").agg(F.min("a").alias("a")).select("a", "b")


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) with more links (a, b); of the links before, one per node is enough."""
    return components(cut_lineage(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(links.select("a", "b"))))


def _apart(rows: DataFrame) -> DataFrame:
    """The rows of regions with several components, with the size of the region."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("members"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    return rows.join(sizes.where("c1 <> c2").select("region", "members").hint("merge"), "region")


def _parts(members, shingles, block: int):
    """Into how many blocks so many members with so many shingles are cut."""
    return F.greatest(F.lit(1), F.ceil(members / block), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _block_of(parts):
    return F.pmod(F.xxhash64("cls", F.lit("block")), F.col(parts)).cast("int")


def crossing_groups(rows: DataFrame, block: int) -> DataFrame:
    """(grp, role, cls, n, comp): regions (region, cls, n, comp) with several components, dealt as pairs of blocks.

    A small region is one group, where all pairs are asked for (role 0). Of a larger one the members outside its largest
    component (role 1) meet all members (role 2), a block with a block.
    """
    per = rows.groupBy("region", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    sums = per.groupBy("region").agg(F.max(F.struct("c", "comp", "s")).alias("major"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("comps"))
    parts = sums.where("comps > 1").select(
        "region", F.col("major.comp").alias("major"), _parts(F.col("c"), F.col("s"), block).alias("parts"),
        _parts(F.col("c") - F.col("major.c"), F.col("s") - F.col("major.s"), block).alias("few"),
    )
    known = rows.join(parts.hint("merge"), "region")
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("role")))
    asked = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda k: F.struct(k.alias("i"), _block_of("parts").alias("j"), F.lit(2).alias("role")))
    asking = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(_block_of("few").alias("i"), k.alias("j"), F.lit(1).alias("role")))
    places = F.when(F.col("parts") == 1, whole).when(F.col("comp") == F.col("major"), asked).otherwise(F.concat(asked, asking))
    dealt = known.select("region", "cls", "n", "comp", F.explode(places).alias("at"))
    return dealt.select(F.xxhash64("region", "at.i", "at.j").alias("grp"), "at.role", "cls", "n", "comp")


def component_groups(rows: DataFrame, block: int) -> DataFrame:
    """(grp, role, cls, n, comp): all pairs inside the components of (cls, n, comp), each in one group of two blocks."""
    sums = rows.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = sums.select("comp", _parts(F.col("c"), F.col("s"), block).alias("parts"))
    known = rows.join(parts.hint("merge"), "comp").withColumn("own", _block_of("parts"))
    dealt = known.select("cls", "n", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    role = F.when(F.col("own") == F.col("k"), 0).when(F.col("own") < F.col("k"), 1).otherwise(2)
    return dealt.select(F.xxhash64("comp", F.least("own", "k"), F.greatest("own", "k")).alias("grp"), role.alias("role"), "cls", "n", "comp")


def _in_groups(rows: DataFrame, solve, schema: str) -> DataFrame:
    """`solve` on tables that hold whole groups of `rows`, sorted by group."""

    packed = "packed" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            # Parts of a batch, so that what is copied and unpacked at a time does not depend on how Spark cuts batches.
            for batch in _byte_slices(whole, "packed", 4 << 20) if packed else [whole]:
                if not batch.num_rows:
                    continue
                end = int(np.searchsorted(batch.column("grp").to_numpy(), batch.column("grp")[-1].as_py()))
                if end or held and held[-1].column("grp")[-1] != batch.column("grp")[0]:
                    yield solve(pa.Table.from_batches([*held, batch.slice(0, end)]))
                    held = []
                held.append(batch.slice(end))
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.repartition("grp").sortWithinPartitions("grp", "cls", "role").mapInArrow(run, schema)


def possible(rows: DataFrame, sketches: DataFrame, radius: int) -> DataFrame:
    """What of the groups may be near by sizes and sketches, with one more column: pairs (`cls`, `other`) of different components.

    Of a group with more than NAMED_PAIRS such pairs per member the members stay instead, with a null `other`. The same pair may
    come from several groups.
    """
    columns = rows.columns
    names = [*columns, "other"]

    def named(table: pa.Table, sketch: np.ndarray) -> pa.RecordBatch:
        grp, n, comp, role, cls = (table[c].to_numpy() for c in ("grp", "n", "comp", "role", "cls"))
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, len(grp)):
            i = np.flatnonzero(grp[step:] == grp[:-step])
            if not len(i):
                break
            near = _may_be_near(i, i + step, n, sketch, radius, (comp[i] != comp[i + step]) & _asked(role[i], role[i + step]))
            one.append(i[near])
            two.append(i[near] + step)
        i, j = np.concatenate(one), np.concatenate(two)
        which = np.cumsum(np.r_[False, grp[1:] != grp[:-1]])
        many = np.bincount(which[i], minlength=which[-1] + 1) > NAMED_PAIRS * np.bincount(which)
        stays = np.zeros(len(grp), dtype=bool)
        dense = many[which[i]]
        stays[i[dense]] = stays[j[dense]] = True
        kept = table.filter(pa.array(stays))
        members, place = np.unique(cls, return_inverse=True)
        x, y = place[i[~dense]], place[j[~dense]]
        pair = np.unique(np.minimum(x, y) * len(members) + np.maximum(x, y))
        x, y = members[pair // len(members)], members[pair % len(members)]
        found = {"cls": pa.array(x), "other": pa.array(y)}
        held = {c: kept[c].combine_chunks() for c in columns} | {"other": pa.nulls(kept.num_rows, pa.int64())}
        blank = {c: pa.array(np.zeros(len(x), np.int64)).cast(held[c].type) for c in names}
        return pa.RecordBatch.from_arrays([pa.concat_arrays([held[c], found.get(c, blank[c])]) for c in names], names)

    def solve(table: pa.Table) -> pa.RecordBatch:
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        grp = table["grp"].to_numpy()
        begins = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
        upto = np.concatenate([[0], np.cumsum(np.diff(begins) ** 2)])
        out, first = [], 0
        while first + 1 < len(begins):
            # Groups with about so many pairs as are held at a time, a group at least.
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + HELD_PAIRS, side="right")) - 1)
            a, b = int(begins[first]), int(begins[last])
            out.append(named(table.slice(a, b - a), sketch[a:b]))
            first = last
        return pa.concat_batches(out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", other bigint"
    return _in_groups(rows.join(sketches.hint("merge"), "cls").select(*columns, "sketch"), solve, schema)


def _asked(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether a group asks for the pairs of members with these roles."""
    return (one + two == 0) | (one + two == 3)


def _may_be_near(i: np.ndarray, j: np.ndarray, n: np.ndarray, sketch: np.ndarray, radius: int, some: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) that hold in `some` can be partners by their sizes and sketches.

    Sets at most `radius` percent apart differ in no more members than this share of both sizes.
    """
    at = np.flatnonzero(some & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * (100 - radius)))
    near = np.zeros(len(i), dtype=bool)
    width = (1 << 21) // sketch.shape[1]
    for k in range(0, len(at), width):
        a, b = i[at[k : k + width]], j[at[k : k + width]]
        differ = np.abs(sketch[a].astype(np.int16) - sketch[b]).sum(axis=1, dtype=np.int64)
        near[at[k : k + width]] = differ * (200 - radius) <= radius * (n[a] + n[b])
    return near


def near_inside(hashes: np.ndarray, cut: np.ndarray, role: np.ndarray, comp: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of the sets of one group that are within the radius; with `comp`, of different components only."""
    n, sketch = np.diff(cut), sketches_of(hashes, cut)
    i, j = np.triu_indices(len(n), 1)
    some = _asked(role[i], role[j])
    if comp is not None:
        some &= comp[i] != comp[j]
    near = _may_be_near(i, j, n, sketch, radius, some)
    i, j = i[near], j[near]
    if len(i) <= FEW_PAIRS:
        both = np.array([len(np.intersect1d(hashes[cut[a] : cut[a + 1]], hashes[cut[b] : cut[b + 1]], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        both = overlaps(hashes, cut, i, j)
    linked = both * 100 >= (n[i] + n[j] - both) * (100 - radius)
    return i[linked], j[linked]


def overlaps(hashes: np.ndarray, cut: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many members the sets i and j share, from products of 0/1 matrices over the hashes that several sets hold."""
    members, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    wanted = np.zeros(len(cut) - 1, dtype=bool)
    wanted[members] = True
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    keep = wanted[owner]
    row = np.searchsorted(members, owner[keep])
    _, column, count = np.unique(hashes[keep], return_inverse=True, return_counts=True)
    several = count > 1
    column, row = (np.cumsum(several) - 1)[column[several[column]]], row[several[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((len(members), len(members)), np.float64)
    for start in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        cells = np.zeros((len(members), COLUMNS), np.float32)
        cells[row[a:b], column[a:b] - start] = 1
        total += cells @ cells.T
    return total[place[: len(i)], place[len(i) :]].astype(np.int64)


def compared(rows: DataFrame, texts: DataFrame, size: int, radius: int, counting: bool) -> DataFrame:
    """The pairs asked for in groups, compared exactly where the texts meet.

    With `counting` (cls, n_links): how many partners a class has in a group. Otherwise links (a, b) that join the components
    of a group, no more than it takes to join them.
    """

    def solve(table: pa.Table) -> pa.RecordBatch:
        grp, role, cls, comp = (table[c].to_numpy() for c in ("grp", "role", "cls", "comp"))
        packed = table["packed"].combine_chunks()
        begins = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True]).tolist()
        upto = np.concatenate([[0], np.cumsum(table["n"].to_numpy() + 16)])
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(begins) > 1:
            # Groups with about as many shingles as one may have, a group at least.
            weight = upto[begins] - upto[begins[0]]
            last = max(1, int(np.searchsorted(weight, BLOCK_SHINGLES, side="right")) - 1)
            first, hashes, cut = begins[0], [], [np.zeros(1, np.int64)]
            for part in packed_blocks(packed.slice(first, begins[last] - first)):
                found, at = shingle_sets(part, size)
                hashes.append(found)
                cut.append(at[1:] + cut[-1][-1])
            sets, ends = np.concatenate(hashes), np.concatenate(cut)
            for a, b in zip(begins[:last], begins[1 : last + 1], strict=True):
                own = ends[a - first : b - first + 1]
                i, j = near_inside(sets[own[0] : own[-1]], own - own[0], role[a:b], None if counting else comp[a:b], radius)
                if not counting:
                    i, j = _forest(i, j, comp[a:b])
                one.append(cls[a:b][i])
                two.append(cls[a:b][j])
            begins = begins[last:]
        a, b = np.concatenate(one), np.concatenate(two)
        if counting:
            a, b = np.unique(np.concatenate([a, b]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.astype(np.int64))], ["cls", "n_links"] if counting else ["a", "b"])

    with_text = rows.join(texts.hint("merge"), "cls").select(*rows.columns, "packed")
    return _in_groups(with_text, solve, "cls bigint, n_links bigint" if counting else "a bigint, b bigint")


def _forest(i: np.ndarray, j: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that join components not joined by the pairs before them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x] = root.get(root[x], root[x])
        return x

    keep = np.zeros(len(i), dtype=bool)
    for k, (x, y) in enumerate(zip(comp[i].tolist(), comp[j].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep[k] = True
    return i[keep], j[keep]


def n_links(classes: DataFrame, comps: DataFrame, texts: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS_PERCENT, block: int = BLOCK_CLASSES) -> DataFrame:
    """(cls, n_links): how many other classes are within the radius of each class that has any. They all share its component."""
    sizes = classes.where("n > 0").select("cls", "n").distinct()
    members = cut_lineage(comps.select(F.col("node").alias("cls"), "comp").join(sizes.hint("merge"), "cls").select("cls", "n", "comp"))
    with small_batches(texts.sparkSession):
        counts = compared(component_groups(members, block), texts, shingle, radius, True)
        return cut_lineage(counts.groupBy("cls").agg(F.sum("n_links").alias("n_links")))


def parted(rows: DataFrame, texts: DataFrame, size: int, radius: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """One round on large regions: links to their pivots, and the regions (region, cls, n, parent, whole) around them.

    A member goes to its nearest pivot, and to every pivot that is at most 2 x radius farther. `parent` is the size of the
    region that was parted, `whole` its name.
    """
    picked = rows.groupBy("region", F.pmod(F.xxhash64("cls", "region"), F.lit(pivots)).alias("k")).agg(F.min(F.struct("cls", "n")).alias("p"))
    asked = rows.join(picked.select("region", F.col("p.cls").alias("a")).hint("merge"), "region").select("region", "a", F.col("cls").alias("b"), "n", "members")
    known = distances(asked.select("a", "b").where("a <> b").distinct(), texts, size)
    known = cut_lineage(known)
    found = asked.join(known, ["a", "b"], "left").withColumn("d", F.when(F.col("a") == F.col("b"), 0.0).otherwise(1 - F.col("both") / F.col("either")))
    nearest = found.groupBy("region", "b").agg(F.min("d").alias("least"))
    inside = found.join(nearest, ["region", "b"]).where(F.col("d") <= F.col("least") + 2 * radius / 100 + 1e-9)
    regions = inside.select(F.xxhash64("region", "a").alias("region"), F.col("b").alias("cls"), "n", F.col("members").alias("parent"), F.col("region").alias("whole"))
    return known.where(_near(radius)).select("a", "b"), cut_lineage(regions)


def linked_classes(
    docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS_PERCENT, sample: int = SAMPLE_DOCUMENTS, common: int = COMMON,
    small: int = SMALL_REGION, pivots: int = PIVOTS, block: int = BLOCK_CLASSES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The class of every document (`class_table`), a text of each class that may have a partner, and the components (node, comp).

    For components not all links are needed; `n_links` compares all pairs.
    """
    with small_batches(docs.sparkSession):
        return _linked_classes(docs, shingle, radius, sample, common, small, pivots, block)


def _linked_classes(
    docs: DataFrame, shingle: int, radius: int, sample: int, common: int, small: int, pivots: int, block: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = picked(docs, ["doc_id", "text"]).select(F.col("0").cast("bigint").alias("doc_id"), F.col("1").cast("string").alias("text"))
    classes = cut_lineage(class_table(rows, shingle))
    first = first_shingles(rows, common_shingles(rows, shingle, sample, common), shingle, radius)
    regions = cut_lineage(regions_of_shingles(first, classes.where("n > 0").select("cls", "n").distinct(), radius))
    texts = cut_lineage(class_texts(rows, regions.select("cls").distinct(), shingle))
    finer = cut_lineage(fine_sketches(texts, shingle))

    # Every member against the smallest class of its region: first one such class per member, then those it is still apart from.
    pivot = regions.groupBy("region").agg(F.min(F.struct("cls", "n")).alias("p")).select("region", F.col("p.cls").alias("a"), F.col("p.n").alias("na"))
    stars = regions.join(pivot.hint("merge"), "region").where((F.col("a") != F.col("cls")) & _fits("na", "n", radius))
    near = cut_lineage(likely(stars.select("a", F.col("cls").alias("b")).distinct(), classes, radius))
    one = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    comps = components(cut_lineage(distances(one, texts, shingle).where(_near(radius)).select("a", "b")))
    rest = still_apart(near.join(one.hint("merge"), ["a", "b"], "left_anti"), comps)
    comps = joined(comps, distances(rest, texts, shingle).where(_near(radius)))

    # What is still apart in larger regions, against a pivot of each region's own.
    left = cut_lineage(_apart(_labelled(regions, comps)))
    several = left.where(F.col("members") > block // 8)
    if not several.isEmpty():
        drawn = several.groupBy("region").agg(F.min_by(F.struct("cls", "n"), F.xxhash64("cls", "region")).alias("p"))
        stars = several.join(drawn.select("region", F.col("p.cls").alias("a"), F.col("p.n").alias("na")).hint("merge"), "region")
        stars = stars.where((F.col("a") != F.col("cls")) & _fits("na", "n", radius)).select("a", F.col("cls").alias("b")).distinct()
        near = distances(likely(still_apart(stars, comps), finer, radius, "fine"), texts, shingle)
        comps = joined(comps, near.where(_near(radius)))
        left = cut_lineage(_apart(_labelled(left.drop("comp", "members"), comps)))

    # What is still apart inside a region.
    flat = left.where(F.col("members") <= small)
    large = left.where(F.col("members") > small)
    while not large.isEmpty():
        more, parts = parted(large, texts, shingle, radius, pivots)
        comps = joined(comps, more)
        now = cut_lineage(_apart(_labelled(parts, comps)))
        # A region that pivots cannot part is compared once, as it was.
        stuck = now.where((F.col("members") > small) & (F.col("members") * 10 > F.col("parent") * 9)).select("whole").distinct()
        flat = flat.unionByName(large.join(stuck, F.col("region") == F.col("whole"), "left_semi"))
        now = now.join(stuck, "whole", "left_anti").select(*flat.columns)
        flat = flat.unionByName(now.where(F.col("members") <= small))
        large = now.where(F.col("members") > small)
    sketches = classes.where("n > 0").dropDuplicates(["cls"]).select("cls", "sketch")
    groups = crossing_groups(_labelled(flat.drop("comp", "members"), comps), block)
    groups = cut_lineage(possible(groups, sketches, radius))
    pairs = groups.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")).distinct()
    for counts in ("fine", "finest"):
        pairs = likely(pairs, finer, radius, counts)
    links = distances(pairs, texts, shingle).where(_near(radius)).select("a", "b")
    links = links.union(compared(groups.where("other IS NULL").drop("other"), texts, shingle, radius, False))
    return classes, texts, joined(comps, links)


def _named(classes: DataFrame, comps: DataFrame) -> DataFrame:
    """(cls, component) of every class: the smallest id of all documents in its component, null if none has an id."""
    names = classes.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    labelled = names.join(comps.withColumnRenamed("node", "cls"), "cls", "left")
    smallest = labelled.where("comp IS NOT NULL").groupBy("comp").agg(F.min("least").alias("of_comp"))
    return labelled.join(smallest, "comp", "left").select("cls", F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("of_comp")).alias("component"))


def jaccard_components(docs: DataFrame, *, links: bool = False, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that links lead to, for every document.

    Two documents are linked when their Jaccard distance is at most `radius` percent. With `links` there is also `n_links`, how many
    other classes (different sets) the document's class is linked with; that compares all pairs inside every component.
    """
    classes, texts, comps = linked_classes(docs, **options)
    by_class = _named(classes, comps)
    empty = classes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = []
    if links:
        degree = n_links(classes, comps, texts, **{k: v for k, v in options.items() if k in ("shingle", "radius", "block")})
        by_class = by_class.join(degree, "cls", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("bigint"))
        empty = empty.withColumn("n_links", F.lit(0).cast("bigint"))
        found = ["n_links"]
    full = classes.where("n > 0").join(by_class.hint("merge"), "cls")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), *found).union(empty)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id, rows without an id last.

    Documents without words are linked with nothing and stay; of rows equal in id and text one stays.
    """
    classes, _, comps = linked_classes(docs, **options)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")
    of_class = classes.where("n > 0").groupBy("cls").agg(F.min(place).alias("place"))
    labelled = of_class.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    first = labelled.groupBy("comp").agg(F.min("place").alias("place")).select(F.col("place.uid").alias("uid"))
    chosen = first.union(classes.where("n = 0").select("uid")).distinct()
    carry, names = others(docs), docs.columns
    packed = packed_texts(docs, carry).join(chosen.hint("merge"), "uid").dropDuplicates(["uid"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"doc_id": batch.column("doc_id"), "text": unpacked(batch.column("packed")).cast(pa.large_string())}
            if carry:
                found |= dict(zip(carry, batch.column("rest").flatten(), strict=True))
            yield pa.RecordBatch.from_arrays([found[c] for c in names], names)

    kept = packed.select("doc_id", "packed", *(["rest"] if carry else []))
    return kept.mapInArrow(unpack, docs.schema)
