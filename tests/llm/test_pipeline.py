"""The pipeline: every stage works on all its predecessor kept, and does what a plain version of it does."""

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from plantwatch.llm import quality_neighbours as neighbours
from plantwatch.llm import quality_rules as rules
from plantwatch.llm.textblocks import blocks
from plantwatch.session import cut_lineage
from tests.conftest import SMALL
from tests.llm.helpers import awkward, documents
from tests.llm.test_links import plain_components
from tests.llm.test_rules_and_models import plain_ratio, plain_rules
from tests.llm.test_texts import check_pieces, plain_repeats

FINER = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def read(spark, folder, table):
    return spark.read.parquet(f"{folder}/{table}.parquet")


def pairs(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_each_stage_equals_a_plain_version(spark):
    docs = read(spark, SMALL, "documents")
    columns, rows = docs.columns, pairs(docs)
    good = {r.doc_id for r in read(spark, SMALL, "labels").where("quality = 1").collect()}

    kept = cut_lineage(STAGES["quality rules"](spark, docs, SMALL))
    ratios = plain_ratio(rows, good, rules.BUCKETS, rules.SMOOTHING)
    expected = [r for r, s in zip(rows, ratios, strict=True) if not plain_rules(r[1])[-1] and s >= rules.THRESHOLD]
    assert kept.columns == columns and pairs(kept) == expected and 0 < len(expected) < len(rows)

    judged = cut_lineage(STAGES["quality classifier"](spark, kept, SMALL))
    space = neighbours.learned_space(docs, read(spark, SMALL, "labels"))
    scores = [space.scores(neighbours.term_counts(next(blocks(pa.array([t])))), neighbours.NEIGHBOURS)[0] for _, t in expected]
    expected = [r for r, s in zip(expected, scores, strict=True) if s >= 0.5]
    assert judged.columns == columns and pairs(judged) == expected

    single = cut_lineage(STAGES["near duplicates"](spark, judged, SMALL))
    plain = plain_components(expected)
    expected = [r for r, (i, n, comp) in zip(expected, plain, strict=True) if not n or i == comp]
    assert single.columns == columns and pairs(single) == expected

    cut = cut_lineage(STAGES["long repeats"](spark, single, SMALL))
    expected = [(x[0], x[4].decode("utf-8", "ignore")) for x in plain_repeats(expected)]
    assert cut.columns == columns and pairs(cut) == expected

    packed = STAGES["packing"](spark, cut, SMALL)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in expected}
    pieces = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in packed.collect()]
    check_pieces(pieces, ids, 2048)
    again = corpus_pipeline.run(spark, SMALL)
    assert again.columns == packed.columns and sum(r.length for r in again.select("length").collect()) == sum(map(len, ids.values()))


def test_the_classifier_finds_what_the_rules_leave(spark):
    """It learns from all documents, so those of low quality among the survivors go, and the rest stays."""
    docs, labels = read(spark, FINER, "documents"), read(spark, FINER, "labels")
    kept = cut_lineage(STAGES["quality rules"](spark, docs, FINER))
    judged = cut_lineage(STAGES["quality classifier"](spark, kept, FINER))
    share = lambda quality: (
        judged.join(labels.where(f"quality = {quality}"), "doc_id").count(), kept.join(labels.where(f"quality = {quality}"), "doc_id").count()
    )
    assert judged.count() < kept.count()
    left, before = share(0)
    assert left < before or before == 0
    left, before = share(1)
    assert left >= 0.98 * before


def test_stages_on_awkward_documents(spark):
    docs = documents(spark, awkward())
    seen = [pairs_or_none(docs)]
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = cut_lineage(stage(spark, docs, SMALL))
        assert docs.schema == documents(spark, []).schema
        seen.append(pairs_or_none(docs))
    # Nothing comes back that a stage before let go; texts change in the last of these only.
    assert all(set(b) <= set(a) for a, b in zip(seen[:3], seen[1:4], strict=True))
    assert (None, None) not in seen[1] and not any(t is None or len(t.split()) < 50 for _, t in seen[1])
    packed = STAGES["packing"](spark, docs, SMALL)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in seen[4]}
    empty = documents(spark, awkward()).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = cut_lineage(stage(spark, empty, SMALL))
        assert empty.count() == 0


def pairs_or_none(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]
