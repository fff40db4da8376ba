"""Row-local Python operators: classifier and decontamination."""

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import decontaminate, quality_classifier

SMALL = "/root/testdata/sf0.01"


def test_contamination_edges(spark):
    long = " ".join(f"w{i % 700}" for i in range(4000))
    item = " ".join(f"q{i}" for i in range(14))
    texts = [None, "", " .,; ", "Zero ONE two", f"a {item.upper()} b", "x " + " ".join(item.split()[2:12]), " ".join(item.split()[:9]), "one", "élan été one,two", item + " " + item, long, "q0 q1 " + item + " q2 q3", item]
    items = [(1, item), (2, "one two"), (3, None), (4, " ... "), (5, "été"), (10, item), (6, long), (7, " ".join(long.split()[100:115]))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[4], None), (4, texts[4], "y")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(texts, items)
    for options in ({}, {"block_bytes": 9000}):
        got = decontaminate.contamination_report(df, bench, **options).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            assert tuple(r)[1:6] == want[4 if r.doc_id is None else r.doc_id], r
    assert {r.doc_id: r.longest_match for r in got}[9] == 14
    assert decontaminate.contamination_report(df.limit(0), bench).count() == 0
    assert decontaminate.contamination_report(df, bench.limit(0)).where("contaminated").count() == 0


def test_items_without_id(spark):
    passage = " ".join(f"q{i}" for i in range(14))
    df = spark.createDataFrame([(1, f"a {passage} b"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, "x " * 12), (7, passage[3:])], "item_id long, text string")
    for items, n_items in ((bench, 2), (bench.where("item_id is null"), 1)):
        for options in ({}, {"block_bytes": 60}):
            got = {r.doc_id: r for r in decontaminate.contamination_report(df, items, **options).collect()}
            assert (got[1].n_hit, got[1].n_items, got[1].contaminated, got[1].longest_match) == (14, n_items, True, 14) and not got[2].contaminated
            assert [r.doc_id for r in decontaminate.remove_contaminated(df, items, **options).collect()] == [2]


def test_contamination_on_table(spark):
    df, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = df.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute.contamination([r.text for r in rows], [tuple(r) for r in bench.select("item_id", "text").collect()]), strict=True))
    assert {r.doc_id: tuple(r)[1:6] for r in decontaminate.contamination_report(df, bench).collect()} == want


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return quality_classifier.classifier_report(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_classifier_held_out(scored):
    assert len(scored) == 10_000 and scored.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(scored.doc_id, scored.held_out, strict=True))
    held = scored[scored.held_out & scored.quality.notna()]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    auc = np.mean(good[:, None] > bad[None, :])
    print("held-out AUC", auc, "recall of bad", (bad < 0.3).mean(), "good kept", (good >= 0.3).mean())
    assert auc > 0.95 and (good >= 0.3).mean() > 0.98


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 1.0), (None, "a b", 2.0), (4, "x" * 200_000, 1.0), (4, "x" * 200_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classifier_report(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classifier_report(docs.limit(0), labels).count() == 0
    assert quality_classifier.classify(docs, labels).where(F.col("doc_id").isNull()).count() == 1


def test_training_is_bounded(spark):
    """Repeated ids don't lift the bounds, equal rows count once, and the bytes of the rows are bounded too."""
    rows = [(i % 7, f"text {i % 50} of some words") for i in range(2000)] + [(3, "long " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)] * 3 + [(4, 1, 0)], "doc_id long, quality int, toxic int")
    every = quality_classifier.chosen_rows(docs, labels, "text", "quality", 6000, 1 << 30)
    usable = [i for i in range(7) if zlib.crc32(str(i).encode()) % 5]
    want = {(i, t, q) for i, t in rows if i in usable for q in ({i % 2, 1} if i == 4 else {i % 2})}
    assert len(every) == len(want) == len(set(every))
    assert quality_classifier.chosen_rows(docs, labels, "text", "quality", 11, 1 << 30) == every[:11]
    assert len(quality_classifier.chosen_rows(docs, labels, "text", "quality", 6000, 300)) < 20
    seen = []
    quality_classifier_ftrl, quality_classifier.ftrl = quality_classifier.ftrl, lambda x: seen.append(x) or np.zeros(quality_classifier.SLOTS + 1, np.float32)
    try:
        quality_classifier.train(docs, labels)
    finally:
        quality_classifier.ftrl = quality_classifier_ftrl
    assert [r[2] for r in seen[0]] == [r[2] for r in every]


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10_000)], "doc_id long, quality int, toxic int")
    got = quality_classifier.chosen_rows(docs, labels, "text", "quality", 60, 1 << 30)
    alone = quality_classifier.chosen_rows(docs, labels.where("doc_id < 100"), "text", "quality", 60, 1 << 30)
    assert got == alone and len(got) == 60


def plain_features(text):
    """Slots and their counts, token by token."""
    import re
    from collections import Counter

    from helixmill.llm.common import BYTE_CODES

    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    def hashed(token):
        return mix((sum(int(BYTE_CODES[b]) * pow(base, i, 1 << 64) for i, b in enumerate(token)) + len(token)) & mask)

    data = (text or "").encode()
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", data)
    hashes, shapes = [], []
    for token in tokens:
        h = hashed(token.lower())
        if re.match(rb"[0-9A-Za-z\x80-\xff]", token):
            upper, digits = len(re.findall(rb"[A-Z]", token)), len(re.findall(rb"[0-9]", token))
            kind = 1 if digits == len(token) else 2 if digits else 3 if not upper else 4 if upper == 1 and token[:1].isupper() else 5 if 2 * upper >= len(token) else 6
            shapes.append(mix(kind * 2 + (bool(hashes) and hashes[-1] == h) + 1))
        else:
            shapes.append(h)
        hashes.append(h)
    a, b, c, d = 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xCBBB9D5DC1059ED8, 0x629A292A367CD507
    grams = [h * a & mask | 1 for h in hashes] + [mix((x * b + y) & mask) for x, y in zip(hashes, hashes[1:])]
    grams += [mix(s ^ c) for s in shapes] + [mix((x * d + y) & mask) for x, y in zip(shapes, shapes[1:])]
    return Counter(mix(g) >> 46 for g in grams)


def test_features_by_force():
    import pyarrow as pa

    from helixmill.llm.common import text_bytes

    texts = [None, "", " \n", "One two TWO two, two 22 a1 mcD McD ...!", "é Über straße 99% of <b>x</b>", "a" * 300, "x y " * 50, "again again\tagain"]
    slots, rows = quality_classifier.features_of(*text_bytes(pa.array(texts)))
    from collections import Counter

    assert [Counter(slots[rows == i].tolist()) for i in range(len(texts))] == [plain_features(t) for t in texts]


def test_ftrl_by_force():
    """The same updates, a weight at a time."""
    import math
    import random

    q, rng = quality_classifier, random.Random(4)
    rows = [(np.array(rng.sample(range(40), 6)), np.array([rng.randint(1, 3) for _ in range(6)]), rng.randint(0, 1)) for _ in range(80)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= q.L1:
            return 0.0
        return -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(q.EPOCHS):
        for slots, counts, label in rows:
            x = {int(s): q.SCALE * int(c) / int(counts.sum()) for s, c in zip(slots, counts)} | {q.SLOTS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g, before = (p - label) * v, n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / q.ALPHA * w[i]
    got = q.ftrl(rows)
    assert all(math.isclose(got[i], weight(i), rel_tol=1e-4, abs_tol=1e-6) for i in [*range(40), q.SLOTS]) and not got[41:q.SLOTS].any()
