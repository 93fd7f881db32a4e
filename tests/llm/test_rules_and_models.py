"""Quality rules, neighbours, toxicity and language against plain versions, held-out accuracy and awkward tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plantwatch.llm import quality_neighbours as neighbours
from plantwatch.llm import quality_rules as rules
from plantwatch.llm.common import labelled_sample
from plantwatch.llm.language_id import frozen, language_id
from plantwatch.llm.textblocks import blocks, paired
from plantwatch.llm.toxicity import changes, fit_weights, given_twice, hashes_of, present, stems_of, swaps, toxicity, word_hashes
from plantwatch.llm.toxicity import fit as toxicity_model
from tests.conftest import SMALL
from tests.llm.helpers import awkward, documents, words_of


def plain_rules(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def word_hash(word):
    block = next(blocks(pa.array([word])))
    starts, ends, _ = block.words()
    return block.hashes(block.prefix(), starts, ends)[0]


def plain_ratio(rows, trusted, n_buckets, smoothing):
    """Score of each row from dictionaries of buckets."""
    hashes = {w: word_hash(w) for _, t in rows for w in words_of(t)}

    def grams(text):
        words = words_of(text)
        out = [int(hashes[w] % np.uint64(n_buckets)) for w in words]
        return out + [
            int(paired(np.array([hashes[a]]), np.array([hashes[b]]))[0] % np.uint64(n_buckets)) for a, b in zip(words, words[1:], strict=False)
        ]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def weight(b):
        scale = n_target / n_raw
        return math.log((target[b] + smoothing) / (n_target + smoothing * n_buckets)) - math.log(
            (raw[b] * scale + smoothing) / (n_target + smoothing * n_buckets)
        )

    return [sum(map(weight, g)) / len(g) if (g := grams(t)) else 0.0 for _, t in rows]


def test_rules_match_plain_version(spark):
    rows = [r for r in awkward(3) if r[0] != 5]
    rows += [(200, "a b c " * 40 + "\nx y\nx y\n \n"), (201, "###|<> " * 60)]
    docs = documents(spark, rows)
    trusted = spark.createDataFrame([(i,) for i in range(10, 40)] + [(10,), (None,)], "doc_id bigint")
    got = rules.quality_rules(docs, trusted, n_buckets=512, smoothing=2.0, threshold=-0.01).collect()
    scores = plain_ratio(rows, set(range(10, 40)), 512, 2.0)
    expected = sorted(
        (str(i), *plain_rules(t), round(s, 9), not plain_rules(t)[-1] and s >= -0.01) for (i, t), s in zip(rows, scores, strict=True)
    )
    found = sorted((str(r[0]), *r[1:6], r.base_failed, round(r.llr, 9), r.kept) for r in got)
    assert found == expected
    assert {r.kept for r in got} == {True, False}


def test_rules_without_trusted_documents_keep_what_passes(spark):
    docs = documents(spark, awkward())
    none = spark.createDataFrame([], "doc_id bigint")
    assert all(r.kept != r.base_failed and r.llr == 0 for r in rules.quality_rules(docs, none).collect())
    assert rules.quality_rules(docs.limit(0), none).collect() == []


def test_kept_documents_are_those_of_the_query(spark):
    docs = documents(spark, awkward())
    trusted = spark.createDataFrame([(i,) for i in range(6, 60)], "doc_id bigint")
    kept = rules.kept_by_rules(docs, trusted)
    assert kept.schema == docs.schema
    verdicts = rules.quality_rules(docs, trusted).where("kept").collect()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in verdicts)


def test_scores_do_not_depend_on_the_block():
    texts = [t or "" for _, t in awkward(4)]
    counts = np.concatenate([neighbours.term_counts(b) for b in blocks(pa.array(texts), block_documents=7)])
    space = neighbours.fit_space(counts[:40], np.array([len(t) % 2 for t in texts[:40]], float), rank=8)
    whole = space.scores(counts, 5)
    for size in (1, 3, 16):
        assert [x for k in range(0, len(counts), size) for x in space.scores(counts[k : k + size], 5)] == whole.tolist()


def test_latent_space_is_that_of_a_full_decomposition():
    texts = [t or "" for _, t in awkward(4) if t is None or len(t) < 5000]
    counts = np.concatenate([neighbours.term_counts(b) for b in blocks(pa.array(texts), block_documents=7)])
    space = neighbours.fit_space(counts, np.ones(len(texts)), rank=4)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    rows = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * idf
    assert np.allclose(space.idf, idf, atol=1e-5)
    right = np.linalg.svd(rows, full_matrices=False)[2][:4].T
    # The same subspace: what one basis leaves of the other has length one.
    assert np.allclose(np.linalg.svd(right.T @ space.axes)[1], 1, atol=1e-2)


def test_samples_are_bounded_in_rows(spark):
    """One id with very many texts does not push the others out, nor beyond the bound."""
    rows = [(1, f"text {k} " * 5) for k in range(300)] + [(i, f"other {i} " * 5) for i in range(2, 100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 100)], "doc_id bigint, label int")
    drawn = labelled_sample(documents(spark, rows), labels, 150).collect()
    assert len(drawn) == 150 and len({r.doc_id for r in drawn}) > 20
    again = labelled_sample(documents(spark, rows[::-1]).repartition(7), labels, 150).collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))


def test_cosine_votes_match_plain_version():
    texts = [t or "" for _, t in awkward(4) if t is None or len(t) < 5000]
    counts = np.concatenate([neighbours.term_counts(b) for b in blocks(pa.array(texts), block_documents=7)])
    labels = np.array([len(t) % 2 for t in texts], float)
    space = neighbours.fit_space(counts[:40], labels[:40], rank=8)
    got = space.scores(counts, 5)
    for k, row in enumerate(counts):
        x = np.sqrt(row / max(row.sum(), 1)) * space.idf @ space.axes
        if not x.any():
            assert got[k] == space.prior
            continue
        cosine = space.vectors / neighbours.UNIT @ (x / np.linalg.norm(x))
        near = np.argsort(-cosine, kind="stable")[:5]
        weight = np.maximum(cosine[near], 0) ** 8
        # Equal vectors tie; any choice among them has the same weights, so compare where labels of ties agree.
        tied = labels[:40][np.abs(cosine - cosine[near[-1]]) < 1e-6]
        if len(set(tied)) == 1 and weight.sum() > 0:
            assert got[k] == pytest.approx((weight * labels[:40][near]).sum() / weight.sum(), abs=1e-3)


def held_out(rows, modulus, remainder):
    return [r for r in rows if r.held_out] and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in rows if r.doc_id is not None)


def tables(spark, folder="/root/testdata/sf0.1"):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_quality_accuracy_on_held_out_documents(spark):
    docs, labels = tables(spark)
    found = neighbours.quality_neighbours(docs, labels).cache()
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert held_out(found.collect(), 3, 1)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_accuracy_on_held_out_documents(spark):
    docs, labels = tables(spark)
    found = toxicity(docs, labels).cache()
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert held_out(found.collect(), 4, 2)
    assert sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows) > 0.9
    assert sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows) < 0.01


def test_language_accuracy_on_held_out_documents(spark):
    docs, _ = tables(spark)
    found = language_id(docs).cache()
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert held_out(found.collect(), 4, 2)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_penalty_evens_out_identity_terms():
    terms = ["men", "women", "awful"]
    features = np.sort(hashes_of(terms))
    men, women, awful = (int(np.searchsorted(features, hashes_of([w])[0])) for w in terms)
    rng = np.random.default_rng(1)
    rows, columns, labels = [], [], []
    for k in range(400):
        named = men if k % 2 else women
        bad = rng.random() < (0.7 if named == women else 0.2)
        rows.append(k), columns.append(named), labels.append(float(bad))
        if bad:
            rows.append(k), columns.append(awful)
    pairs = swaps([("men", "women")], features)
    args = np.array(rows), np.array(columns), np.array(labels), 3, pairs
    free, _ = fit_weights(*args, 0.0)
    even, _ = fit_weights(*args, 200.0)
    assert abs(free[men] - free[women]) > 4 * abs(even[men] - even[women])
    assert even[awful] > 1


def named_texts(n=600):
    """Texts on a group each; those that name muslims are toxic far more often, by a word of their own."""
    rng = np.random.default_rng(4)
    rows, toxic = [], []
    for i in range(n):
        group = ("muslim", "jewish", "hindu", "buddhist", "atheist", "christian")[i % 6]
        bad = rng.random() < (0.8 if group == "muslim" else 0.05)
        words = [f"w{rng.integers(80)}" for _ in range(12)]
        rows.append((i, " ".join([*words[:6], group, *words[6:], *(["awful"] if bad and rng.random() < 0.5 else [])])))
        toxic.append((i, int(bad)))
    return rows, toxic


def test_penalty_covers_the_stems_of_identity_terms(spark):
    """With the parameters of the query the gap between groups shrinks, though the labels of this table ask for it."""
    rows, toxic = named_texts()
    docs, labels = documents(spark, rows).select("doc_id", "text"), spark.createDataFrame(toxic, "doc_id bigint, label int")
    gaps = []
    for model in (toxicity_model(docs, labels), toxicity_model(docs, labels, penalty=0.0)):
        assert np.isin(stem_hashes("muslim"), model.features).all()
        one, other = model.scores(next(blocks(pa.array(["w1 muslim w2", "w1 jewish w2"]))))
        gaps.append(one - other)
    assert 0 <= gaps[0] < 0.7 * gaps[1], gaps


def stem_hashes(word):
    found, _ = word_hashes(next(blocks(pa.array([word]))))
    return found[1:]


def test_swapped_cells_are_those_of_the_swapped_text():
    words = ["muslim", "jewish", "muslims", "muslin", "awful"]
    every = np.unique(np.concatenate([*map(stem_hashes, words), hashes_of(words)]))
    kinds = [("muslim", "jewish")]
    stems = {int(np.searchsorted(every, h)): s.tolist() for h, s in zip(hashes_of(kinds[0]), stems_of(kinds[0], every), strict=True)}
    texts = ["a muslim", "muslim and MUSLIM", "muslim muslims", "the muslin of a muslim", "jewish, not muslim", "awful jewish x", "none"]
    block = next(blocks(pa.array(texts)))
    rows, columns = present(block, every)
    twice = set(zip(*(x.tolist() for x in given_twice(block, every, np.unique(sum(stems.values(), [])))), strict=True))
    pairs = swaps(kinds, every)
    named, pair, feature, sign = changes(rows, columns, pairs, stems, twice)
    expected = [(x, t.lower().replace(f"{a} ", f"{b} ").strip()) for a, b in (kinds[0], kinds[0][::-1]) for x, t in enumerate(f"{t.lower().replace(',', '')} " for t in texts) if f"{a} " in t]
    assert named.tolist() == [x for x, _ in expected]
    for k, (x, swapped) in enumerate(expected):
        cells = set(columns[rows == x].tolist())
        for f, s in zip(feature[pair == k].tolist(), sign[pair == k], strict=True):
            (cells.add if s > 0 else cells.remove)(f)
        assert cells == set(present(next(blocks(pa.array([swapped]))), every)[1].tolist())


def test_code_lengths_match_plain_trees():
    """Costs from dictionaries of contexts, order 3 down to 0, with escapes."""
    texts = {"aa": ["abcabcabd", "abd cab"], "bb": ["xyzzy xyz", "zzz éa"]}
    grams = Counter()
    for lang, own in texts.items():
        for t in own:
            data = b"\n\n\n" + t.encode()
            grams.update((lang, int.from_bytes(data[k - 3 : k + 1], "big")) for k in range(3, len(data)))
    table = pa.table({"lang": [k[0] for k in grams], "gram": [k[1] for k in grams], "n": list(grams.values())})
    model = frozen(table)

    def cost(lang, context, byte):
        p = 1.0
        for order in (3, 2, 1, 0):
            seen = Counter()
            for (own, g), n in grams.items():
                data = g.to_bytes(4, "big")
                if own == lang and data[3 - order : 3] == context[3 - order :]:
                    seen[data[3]] += n
            total, distinct = sum(seen.values()), len(seen)
            if not total:
                continue
            if byte in seen:
                return p * seen[byte] / (total + distinct)
            p *= distinct / (total + distinct)
        return p / 256

    queries = ["abcx", "", "zz\néé", "q~" * 30]
    block = next(blocks(pa.array(queries)))
    got = model.code_lengths(block)
    for k, t in enumerate(queries):
        data = b"\n\n\n" + t.encode()
        for j, lang in enumerate(("aa", "bb")):
            costs = [cost(lang, data[i - 3 : i], data[i]) for i in range(3, len(data))]
            assert got[k, j] == sum(round(-math.log2(p) * 512) for p in costs)


@pytest.mark.parametrize("operator", ["neighbours", "toxicity", "language"])
def test_awkward_tables(spark, operator):
    rows = awkward()
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(0, 80)] + [(7, None, None), (None, 1, 1), (8, 1, 1)], "doc_id bigint, quality int, toxic int")
    run = {"neighbours": neighbours.quality_neighbours, "toxicity": toxicity, "language": lambda d, _: language_id(d)}[operator]
    got = run(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    for k in (20, None):  # repeated rows answer alike
        same = [r[2:] for r in got if r.doc_id == k]
        assert len(same) >= 3 and len(set(same)) <= (1 if k else 2)
    if operator == "language":
        assert all(r.lang_pred == "und" for r in got if r.doc_id in (0, 1, 2))
    assert run(docs.limit(0), labels).collect() == []
    assert len(run(docs, labels.limit(0)).collect()) == len(rows)


def test_queries_run_over_whole_tables(spark):
    from plantwatch.llm.queries import QUERIES

    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op2_quality_rules", "op4_toxicity", "op6_language_id", "op7_quality_neighbours"):
        assert QUERIES[name](spark, SMALL).count() == n
