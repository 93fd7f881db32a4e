"""Merkle manifest, near vectors and the prefix trie against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantwatch.llm import merkle_manifest as manifest
from plantwatch.llm.near_vectors import near_vectors
from plantwatch.llm.parentheses import Parentheses
from plantwatch.llm.prefix_trie import prefix_trie
from plantwatch.llm.small_world import SmallWorld
from tests.llm.helpers import SCHEMA, awkward, documents, lowered


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc32(column):
    return F.crc32(column.cast("string").cast("binary"))


# --- manifest -----------------------------------------------------------------------------------------------------


def plain_leaf(row, text):
    said = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in said))


def plain_rise(nodes):
    """The last node over a list of hashes, and each one's siblings by level with its place among them."""
    ways = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for k, way in enumerate(ways):
            way.append((runs[place[k] // 16], place[k] % 16))
            place[k] //= 16
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0] if nodes else None, ways


def plain_manifest(rows):
    """Rows of (doc_id, leaf, subroot, root, proof, folded root)."""
    by_source = {}
    for row in rows:
        tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
        leaf = plain_leaf(row, row["text"])
        claimed = plain_leaf(row, None if row["text"] is None else lowered(row["text"])) if tampered else leaf
        by_source.setdefault(row["source"], []).append((row["doc_id"], leaf, claimed))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        low[s] = plain_rise([x[1] for x in by_source[s]])
    root, high = plain_rise([low[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for (doc_id, leaf, claimed), way in zip(by_source[s], low[s][1], strict=True):
            proof, folded = "", claimed
            for run, at in [*way, *high[k]]:
                proof += "".join(run[:at] + run[at + 1 :])
                folded = sha("".join(run[:at]) + folded + "".join(run[at + 1 :]))
            out.append((doc_id, leaf, low[s][0], root, sha(proof), folded))
    return out


def sourced(n, seed=3):
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "é", "zz"] + [f"s{k}" for k in range(30)]
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.6 else rng.choice(sources)
        text = rng.choice([None, "", "MiXed Éé ÀB", "plain", "UPPER " * rng.randint(1, 400)])
        rows.append((rng.choice([i, i, i, rng.randrange(n), None]), text, rng.choice(["en", None]), source, rng.choice([None, i]), "u", 1, 0.5, None, "no"))
    return rows + rows[:3]


@pytest.mark.parametrize("n", [0, 1, 5, 700])
def test_manifest_equals_a_plain_one(spark, n):
    rows = [tuple(r) for r in sourced(n)] if n > 1 else [tuple(r) for r in sourced(1)][:n]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = manifest.merkle_manifest(docs, crc32(F.col("doc_id")) % 5 == 0).collect()
    expected = plain_manifest([r.asDict() for r in docs.collect()])
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def test_manifest_with_many_copies_of_the_upper_runs(spark, monkeypatch):
    """Salted runs give the same proofs."""
    monkeypatch.setattr(manifest, "SPREAD", 4)
    docs = spark.createDataFrame(sourced(400, 5), SCHEMA)
    got = manifest.merkle_manifest(docs, crc32(F.col("doc_id")) % 5 == 0).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(plain_manifest([r.asDict() for r in docs.collect()]), key=repr)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_awkward_documents(spark):
    docs = documents(spark, awkward())
    clashing = docs.select("*", F.lit(1).alias("Text"), F.lit(2).alias("a.b"), F.lit("x").alias("SOURCE"))
    got = manifest.merkle_manifest(clashing, F.col("doc_id") % 2 == 0)
    assert got.count() == docs.count()
    wrong = {r.doc_id for r in got.where("NOT verified").collect()}
    changed = {i for i, t in awkward() if i is not None and i % 2 == 0 and t is not None and lowered(t) != t}
    assert wrong == changed


# --- near vectors -------------------------------------------------------------------------------------------------


def plain_near(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) of each row, by comparing all."""
    sound = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if s else None for (_, v), s in zip(rows, sound)]
    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        known = [x for x in ids[find(k)] if x is not None]
        comp = min(known) if known else None
        out.append((i, links[k], comp, i == comp))
    return out


def clouds(seed, n, dim=12, hot=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    rows = []
    for i in range(n):
        centre = centres[0] if rng.random() < hot else centres[rng.integers(len(centres))]
        rows.append((i, [float(np.float32(x)) for x in centre + rng.normal(scale=rng.choice([0.02, 0.12]), size=dim)]))
    return rows


VECTORS = "vec_id bigint, embedding array<float>, label int, node string, h int, comp int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", 2, 3) for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("shard_rows,block_rows", [(16384, 16384), (60, 90)])
def test_near_vectors_equal_brute_force(spark, shard_rows, block_rows):
    rows = clouds(4, 420) + clouds(4, 420)[:9]
    got = near_vectors(vectors(spark, rows), shard_rows=shard_rows, block_rows=block_rows, recall=1.0, audit_rows=10_000)
    assert sorted(map(tuple, got.collect())) == sorted(plain_near(rows))


def test_near_vectors_on_awkward_rows(spark):
    one = [1.0, 0.5, 0.25]
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]),
        (9, one), (8, one), (8, one), (None, one), (None, [-1.0, 0.0, 0.5]), (10, [1.0, 0.5]), (11, [2.0, 1.0]), (12, [1e-30, 5e-31, 2.5e-31]), (13, [3e38, 1.5e38, 7.5e37]),
    ]
    got = near_vectors(vectors(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_near(rows), key=repr)
    assert near_vectors(vectors(spark, rows).limit(0)).count() == 0
    clashing = vectors(spark, rows).select("*", F.lit(1).alias("Vec_ID"), F.lit(2).alias("a.b"), F.lit(3).alias("EMBEDDING"))
    assert sorted(map(tuple, near_vectors(clashing).collect()), key=repr) == sorted(plain_near(rows), key=repr)
    assert near_vectors(vectors(spark, rows[:6])).where("n_links > 0 OR NOT kept").count() == 0


def test_beams_find_most_neighbours_without_a_scan():
    """The graph itself: beams much narrower than the shard meet the nearest rows."""
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(4000, 24)).astype(np.float32)
    rows[2000:] = rows[:2000] + rng.normal(scale=0.05, size=(2000, 24))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    world = SmallWorld(rows)
    assert len(world.levels) > 1 and sorted(world.numbers.tolist()) == list(range(4000))
    met = set()
    world.within(rows[:500], 0.95, 48, lambda of, place, similar: met.update(zip(of.tolist(), world.numbers[place].tolist())))
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero(rows[:500] @ rows.T >= 0.95))}
    assert len(met & near) >= 0.97 * len(near) and met <= near


# --- parentheses and trie -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_closes_of_parentheses(seed):
    rng = random.Random(seed)
    bits, depth = [], 0
    for _ in range(rng.choice([1, 10, 3000])):
        if depth and rng.random() < rng.choice([0.2, 0.5]):
            bits.append(0)
            depth -= 1
        else:
            bits.append(1)
            depth += 1
    bits += [0] * depth
    stack, close = [], {}
    for k, bit in enumerate(bits):
        if bit:
            stack.append(k)
        else:
            close[stack.pop()] = k
    pairs = Parentheses(np.array(bits))
    assert pairs.find_close(pairs.opens).tolist() == [close[k] for k in pairs.opens.tolist()]
    assert pairs.is_leaf().tolist() == [close[k] == k + 1 for k in pairs.opens.tolist()]


def plain_trie(rows):
    """All columns of every prefix, from rows of (conv_id, turn, role, text); turns of a conversation must differ in number."""
    turns = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            turns.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, ends = {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += own
    return [
        (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), leaves[p], saved[p], sha(",".join(map(str, sorted(ends.get(p, []))))))
        for p in members
    ]


TALKS = "conv_id bigint, turn bigint, role string, text string, key int, path string, place double"


def trie_of(spark, rows, **limits):
    talks = spark.createDataFrame([(*r, 1, "p", 0.5) for r in rows], TALKS).repartition(4)
    return prefix_trie(talks, lambda c: c - c % 5, lambda c: crc32(c) % 9, 8, 5, **limits)


def talks(seed, n, longest=9, hot=0.3):
    rng = random.Random(seed)
    openings = [("user", f"opening {k}") for k in range(4)]
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.1:
            continue
        if rng.random() < hot:
            rows += [(c, t, "user" if t % 2 else "bot", "the same Ünïcode") for t in range(6)]
            continue
        for t in range(rng.randint(0, longest)):
            role, text = openings[rng.randrange(4)] if t == 0 else (rng.choice(["user", None, ""]), rng.choice(["yes", "no", "", None, f"turn {t}"]))
            rows.append((c, None if t == 0 and rng.random() < 0.5 else t, role, text))
    return rows


@pytest.mark.parametrize("limits", [{}, {"segment": 4}, {"shard_turns": 40}, {"segment": 3, "shard_turns": 25}, {"segment": 1, "shard_turns": 12}])
def test_trie_equals_a_plain_one(spark, limits):
    rows = talks(2, 160)
    got = trie_of(spark, rows, **limits).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_trie(rows), key=repr)


def test_trie_of_few_and_of_awkward_conversations(spark):
    assert trie_of(spark, []).count() == 0
    assert trie_of(spark, [(None, 1, "a", "b")]).count() == 0
    for rows in ([(1, 1, "a", "b")], [(3, None, None, None)], [(10, t, "r", "x" * 70_000) for t in range(30)] + [(12, 0, "r", "x")]):
        assert sorted(map(tuple, trie_of(spark, rows, segment=8).collect()), key=repr) == sorted(plain_trie(rows), key=repr)
    clashing = spark.createDataFrame([(1, 1, "a", "b", 5, 6)], "conv_id bigint, turn int, role string, text string, Text int, `a.b` int")
    assert prefix_trie(clashing, lambda c: c, lambda c: F.lit(0), 8, 5).count() == 2
    tied = [(20, 1, "a", "b"), (20, 1, "a", "b"), (20, 1, "c", ""), (21, 1, "c", ""), (21, 1, "a", "b"), (21, 1, "a", "b")]
    got = [r.n_convs for r in trie_of(spark, tied).where("depth <= 3").orderBy("depth").collect()]
    assert got and trie_of(spark, tied).count() == trie_of(spark, tied[::-1]).count()
