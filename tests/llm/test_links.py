"""Jaccard regions, ball trees, tool calls and components against brute force."""

import json
import random
from collections import Counter

import pytest

from plantwatch.llm.ball_tree import top_products
from plantwatch.llm.components import components
from plantwatch.llm.jaccard_regions import crossing_groups, jaccard_components, one_of_each, possible
from plantwatch.llm.tool_calls import levels, link_tool_calls
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, documents, lowered, words_of


def shingles(text):
    words = words_of(lowered(text))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def plain_components(rows):
    """For each row its set size and the smallest id (nulls last) reachable by links."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders.get(g, ()))
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[max(find(k), find(j))] = min(find(k), find(j))
        for g in s:
            holders.setdefault(g, []).append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def near_copies(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["Word"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice([*vocabulary, "X"])
        if rng.random() < 0.1:
            words += rng.choice(base)
        rows.append((i, " ".join(words[: rng.randint(0, 6)] if rng.random() < 0.1 else words)))
    return rows


@pytest.mark.parametrize("options", [{}, {"small": 3, "pivots": 2, "sample": 50, "common": 2}])
def test_components_match_brute_force(spark, options):
    rows = near_copies(3)
    got = jaccard_components(documents(spark, rows), **options).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(plain_components(rows))


def plain_links(rows):
    """For each row the number of other sets at most a quarter apart from its own."""
    sets = [shingles(t) for _, t in rows]
    distinct = [s for s in set(sets) if s]
    links = {s: sum(s is not o and 100 * len(s & o) >= 75 * len(s | o) for o in distinct) for s in distinct}
    return [(i, links.get(s, 0)) for (i, _), s in zip(rows, sets, strict=True)]


def group_of_near_copies(seed, n=150):
    """Copies of one text with a few words changed: many are near, about as many are not."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 16}, {"block": 8, "small": 20, "pivots": 2, "sample": 50}])
def test_all_links_are_counted(spark, options):
    rows = near_copies(4) + [(1000 + i, t) for i, t in group_of_near_copies(1)]
    got = jaccard_components(documents(spark, rows), links=True, **options).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted(plain_links(rows))
    assert sorted(tuple(r)[:3] for r in got) == sorted(plain_components(rows))


def test_regions_are_dealt_as_bounded_blocks(spark):
    """One region of 300 classes, a third of them in one component: no group holds it, and every crossing pair meets."""
    rows = [(7, k, 50, 0 if k % 3 == 0 else k) for k in range(300)] + [(8, k, 50, k) for k in (1, 2)] + [(9, k, 50, 0) for k in (0, 3)]
    table = spark.createDataFrame(rows, "region bigint, cls bigint, n bigint, comp bigint")
    groups = {}
    for r in crossing_groups(table, 20).collect():
        groups.setdefault(r.grp, []).append(r)
    assert max(map(len, groups.values())) <= 80
    met = {(min(x.cls, y.cls), max(x.cls, y.cls)) for g in groups.values() for x in g for y in g if x.comp != y.comp and x.role + y.role in (0, 3)}
    assert met == {(x, y) for x in range(300) for y in range(x + 1, 300) if x % 3 or y % 3}
    none = spark.createDataFrame([(k, bytes([255 if j == k % 64 else 0 for j in range(64)])) for k in range(300)], "cls bigint, sketch binary")
    assert possible(crossing_groups(table.where("region = 8"), 20), none, 25).collect() == []


def test_texts_of_one_form_that_are_not_near(spark):
    """More texts than a region may hold, alike but all beyond the radius: pivots cannot part them."""
    rng = random.Random(6)
    form = [f"f{k}" for k in range(200)]
    rows = [(i, " ".join(w if k % 25 else f"x{rng.randrange(10**6)}" for k, w in enumerate(form))) for i in range(60)] + [(99, " ".join(form))]
    rows += [(100 + i, rows[i][1].replace("f7 ", "y ")) for i in range(5)]
    got = jaccard_components(documents(spark, rows), small=8, pivots=2, block=8, links=True).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(plain_components(rows))
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted(plain_links(rows))


def test_a_pair_that_meets_in_many_regions_is_named_once(spark):
    """Thirty regions with the same ten classes: their pairs are named, each once, and no member is to be moved for them."""
    rows = [(region, cls, 50, cls) for region in range(30) for cls in range(10)]
    table = spark.createDataFrame(rows, "region bigint, cls bigint, n bigint, comp bigint")
    alike = spark.createDataFrame([(k, bytes([1] * 64)) for k in range(10)], "cls bigint, sketch binary")
    found = possible(crossing_groups(table, 20), alike, 25).where("other IS NOT NULL").select("cls", "other").distinct().collect()
    assert sorted(map(tuple, found)) == [(x, y) for x in range(10) for y in range(x + 1, 10)]
    assert possible(crossing_groups(table, 20), alike, 25).where("other IS NULL").isEmpty()


def test_a_block_with_too_many_pairs_keeps_its_members(spark):
    """A region of 300 classes that may all be near: naming 44,850 pairs costs more than its members do."""
    table = spark.createDataFrame([(1, k, 50, k) for k in range(300)], "region bigint, cls bigint, n bigint, comp bigint")
    alike = spark.createDataFrame([(k, bytes([1] * 64)) for k in range(300)], "cls bigint, sketch binary")
    found = possible(crossing_groups(table, 512), alike, 25).collect()
    assert sorted(r.cls for r in found) == list(range(300)) and all(r.other is None for r in found)


def test_components_of_awkward_table(spark):
    rows = awkward()
    got = jaccard_components(documents(spark, rows)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(plain_components(rows), key=key)
    assert jaccard_components(documents(spark, rows).limit(0)).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = awkward()
    docs = documents(spark, rows)
    got = one_of_each(docs)
    assert got.schema == docs.schema
    found = [r.doc_id for r in got.collect()]
    smallest = {c for i, n, c in plain_components(rows) if n}
    empty = {i for i, n, _ in plain_components(rows) if not n}
    assert sorted(map(str, found)) == sorted(map(str, smallest | empty))


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and all(got[100 + k] == 100 for k in range(30)) and got[201] == 200


def plain_top(rows, k=10):
    out = []
    valid = [(i, [int(1024 * x // 1) for x in v]) for i, v in rows if i is not None and v and all(x is not None and abs(x) < float("inf") for x in v)]
    valid = sorted(set((i, tuple(v)) for i, v in valid))
    for q, own in valid:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in valid if i != q and len(v) == len(own))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return out


def test_top_products_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(900)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(2001, None), (2002, []), (2003, [1.0] * 5 + [None]), (2004, [float("nan")] * 6), (2005, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(100, rows[100][1]), (3000, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id bigint, embedding array<float>, uid string, shard int")
    single = [(r.vec_id, r.embedding) for r in table.collect()]
    got = top_products(table, F.col("vec_id") % 100 == 0, shard_rows=100, block_rows=4, pilot_rows=50).collect()
    assert sorted(map(tuple, got)) == plain_top(single)
    few = top_products(table.where("vec_id < 4 OR vec_id = 100"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, few)) == plain_top([r for r in single if r[0] is not None and (r[0] < 4 or r[0] == 100)])
    assert top_products(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []


TOOLS = [
    ("f", '{"properties":{"q":{"type":"string","enum":["x","y"]},"n":{"type":"integer","minimum":0,"maximum":9},"o":{"type":"object"}},'
          '"required":["q"],"additionalProperties":false}'),
    ("g", "{}"),
]


def call(i, name="g", arguments="{}", after=()):
    return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": arguments, "after": list(after)}]})


def test_tool_calls(spark):
    m = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call("a", "f", {"q": "x", "n": 3, "o": {"b": 1, "a": [True, None, "é\n"]}})),
        (1, 2, "tool", '{"tool_call_id": "a", "content": "fine \\"one\\""}'), (1, 2, "tool", '{"tool_call_id": "a", "content": "gone"}'),
        (1, 3, "assistant", call("b", "f", '{"n": "no", "z": 1}', ["c", "a"])), (1, 4, "assistant", call("c", "f", {"q": "w", "n": 11}, ["a"])),
        (1, 5, "assistant", call("a", "g")), (1, 6, "assistant", call("d", "nope", {}, ["zz"])), (1, 7, "assistant", call("e", "g", "[1]")),
        (1, 8, "assistant", call("p", after=["r"])), (1, 9, "assistant", call("r", after=["p"])), (1, 10, "assistant", call("s", after=["p", "a"])),
        (1, 11, "tool", '{"tool_call_id": "none", "content": "lost"}'), (1, 3, "tool", '{"tool_call_id": "d", "content": null}'),
        (2, 1, "assistant", call("a")), (2, 1, "assistant", call("a")), (None, 1, "assistant", call("n")), (2, None, "assistant", call("m")),
        (2, 5, "assistant", None), (2, 6, None, "x"), (2, 7, "assistant", "not json"), (2, 8, "assistant", ""), (2, 9, "tool", "{}"),
    ]
    table = spark.createDataFrame([(*x, "u", 1) for x in m], "conv_id bigint, turn bigint, role string, text string, level string, copies int")
    tools = spark.createDataFrame(TOOLS, "name string, parameters string")
    got = {(r.conv_id, r.turn, r.call_id): r for r in link_tool_calls(table, tools).collect()}
    a = got[1, 1, "a"]
    assert (a.status, a.level, a.position, a.result_turn, a.n_results, a.valid, a.errors) == ("ok", 0, 1, 2, 2, True, "")
    assert a.canonical == '{"arguments":{"n":3,"o":{"a":[true,null,"é\\n"],"b":1},"q":"x"},"id":"a","name":"f","result":"fine \\"one\\""}'
    b, c = got[1, 3, "b"], got[1, 4, "c"]
    assert (b.level, c.level, b.errors, c.errors) == (2, 1, "missing:q,type:n,unexpected:z", "enum:q,range:n")
    assert [x.position for x in (a, got[1, 6, "d"], got[1, 7, "e"], c, b)] == [1, 2, 3, 4, 5]
    assert got[1, 5, "a"].status == "duplicate" and got[1, 5, "a"].n_results is None
    assert got[1, 6, "d"].errors == "unknown_tool,unknown_dependency" and got[1, 6, "d"].status == "result_before_call"
    assert got[1, 7, "e"].errors == "arguments_not_object" and got[1, 7, "e"].canonical.startswith('{"arguments":null')
    assert [got[1, t, i].status for t, i in ((8, "p"), (9, "r"), (10, "s"))] == ["cycle"] * 3
    assert got[1, 11, "none"].status == "orphan_result" and got[1, 11, "none"].canonical == '{"content":"lost","tool_call_id":"none"}'
    assert (got[2, 1, "a"].copies, got[2, 1, "a"].status) == (2, "no_result")
    assert got[None, 1, "n"].status == got[2, None, "m"].status == "unidentified"
    assert len(got) == 13
    assert link_tool_calls(table.limit(0), tools).collect() == []
    assert all(r.errors == "unknown_tool" or r.valid is None for r in link_tool_calls(table.where("turn < 3"), tools.limit(0)).collect())


def test_levels_match_brute_force(spark):
    rng = random.Random(2)
    nodes = [(c, f"n{k}") for c in range(6) for k in range(25)]
    edges = {(c, f"n{k}", f"n{rng.randrange(k if c < 4 else 25)}") for c in range(6) for k in range(1, 25) for _ in range(rng.choice([0, 1, 1, 1, 2]))}
    edges |= {(9, f"n{k}", f"n{k - 1}") for k in range(1, 60)}
    nodes += [(9, f"n{k}") for k in range(60)]
    known, before = {}, None
    while before != len(known):
        before = len(known)
        for c, n in nodes:
            deps = [known.get((c, d)) for e, m, d in edges if (e, m) == (c, n)]
            if None not in deps:
                known[c, n] = max(deps, default=-1) + 1
    got = levels(spark.createDataFrame(nodes, "conv_id bigint, call_id string"), spark.createDataFrame(sorted(edges), "conv_id bigint, call_id string, dep string"))
    assert {(r.conv_id, r.call_id): r.level for r in got.collect()} == known


def test_one_of_each_carries_any_column(spark):
    """Names with dots, and names that differ from others by case only."""
    docs = documents(spark, awkward()).select("*", F.lit(1).alias("a.b"), F.lit("t").alias("Text"))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == one_of_each(documents(spark, awkward())).count()
    assert {r[-2:] for r in map(tuple, kept.collect())} == {(1, "t")}
