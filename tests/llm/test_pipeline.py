"""The pipeline against the stages' brute-force versions, each on its own input."""

import brute
import pytest

import corpus_pipeline
from helixmill.llm import minhash_dedup, packing, pii, quality_classifier
from helixmill.llm.common import keep

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(keep(stage(spark, out[-1], SMALL), name))
    return out


def test_columns(steps):
    assert all(x.dtypes == steps[0].dtypes for x in steps[1:-1])
    counts = [x.count() for x in steps]
    print(counts)
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 0


def test_quality(spark, steps):
    rejected = steps[0].join(steps[1], "doc_id", "left_anti")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = quality_classifier.classify(steps[0], labels).where("predicted = 0")
    assert {r.doc_id for r in rejected.collect()} == {r.doc_id for r in scores.collect()}


def test_near(spark, steps):
    from test_near import classes_by_force

    rows = steps[1].orderBy("doc_id").collect()
    idf = minhash_dedup.inverse_frequencies(*minhash_dedup.document_frequencies(minhash_dedup.prepared(steps[1], "text", "doc_id")))
    classes = classes_by_force([r.text for r in rows], idf)
    want = sorted({c: rows[c].doc_id for c in sorted(classes)}.values())
    assert sorted(r.doc_id for r in steps[2].collect()) == want


def test_benchmark(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = steps[2].collect()
    want = {r.doc_id for r, x in zip(rows, brute.contamination([r.text for r in rows], items), strict=True) if not x[-1]}
    assert {r.doc_id for r in steps[3].collect()} == want


def test_pii(steps):
    before = {r.doc_id: r for r in steps[3].collect()}
    for r in steps[4].collect():
        found = brute.pii(before[r.doc_id].text)[:4]
        if sum(found):
            assert sum(brute.pii(r.text)[:4]) == 0 and r.n_chars == len(r.text) and r.text != before[r.doc_id].text
    changed = steps[4].join(steps[3].select("doc_id", "text"), ["doc_id", "text"], "left_anti").count()
    assert changed == pii.find_pii(steps[3]).where("size(pii) > 0").count()


def test_packing(steps):
    pieces = steps[5].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in steps[4].collect()}
    lengths = {}
    for r in pieces:
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in lengths.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= packing.SIZE


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SMALL).count() == steps[5].count()


def test_odd_rows(spark):
    """Nulls, repeated rows and clashing names pass every stage."""
    text = "the words of a plain text that is here more than once and long enough to be one"
    rows = [(1, text, "en", 2, 0.1), (1, text, "en", 2, 0.2), (None, text, None, None, 0.3), (2, None, None, None, None), (3, "", "x", 0, 1.0), (4, "write to a.b@mail.example.com about the text", "en", 5, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, score double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    masked = {r.doc_id: r for r in corpus_pipeline.mask_pii(spark, docs, SMALL).collect()}
    assert masked[4].text == "write to [EMAIL] about the text" and masked[4].n_chars == len(masked[4].text) and masked[4].score == 0.5
    assert sum(r.text == text for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()) == 1
    assert corpus_pipeline.pack_sequences(spark, docs, SMALL).count() == len(rows)
