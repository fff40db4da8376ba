"""Near-duplicate classes against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from helixmill.llm import minhash_dedup as near
from helixmill.llm.common import text_bytes


def sets_of(texts, idf):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    row, code, weight = near.weighted_shingles(data, offsets, idf)
    return [(code[row == i], weight[row == i]) for i in range(len(texts))]


def classes_by_force(texts, idf, least=near.SIMILARITY):
    sets = sets_of(texts, idf)
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near.similarity(sets[i], sets[j]) >= least:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


def made(seed):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(1, 6)))
    texts = [None, "", " .,! ", "one two", "One, two", "one two three four five", "x" * 30_000]
    for _ in range(60):
        texts.append(" ".join(word() for _ in range(random.randint(1, 200))))
    base = [word() for _ in range(300)]
    for _ in range(60):  # a cloud around one text
        own = list(base)
        for _ in range(random.randint(0, 4)):
            own[random.randrange(len(own))] = word()
        texts.append(" ".join(own))
    passage = " ".join(word() for _ in range(80))
    for _ in range(30):  # a shared passage, not near
        texts.append(passage + " " + " ".join(word() for _ in range(120)))
    chain = [word() for _ in range(200)]
    for i in range(0, 100, 5):  # each near the next, ends far apart
        chain[i] = word()
        texts.append(" ".join(chain))
    return texts + texts[10:14]


def test_classes(spark):
    texts = made(3)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string").repartition(3)
    own = near.prepared(df, "text", "doc_id")
    counts, n = near.document_frequencies(own)
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    from helixmill.llm.decontaminate import words_of

    hashes, first = words_of(data, offsets)
    want = np.zeros(near.SLOTS, np.int64)
    for i in range(len(texts)):
        want[np.unique((hashes[first[i] : first[i + 1]] >> near.SLOT_SHIFT).astype(np.int64))] += 1
    assert n == (np.diff(first) > 0).sum() and (counts == want).all()
    force = classes_by_force(texts, near.inverse_frequencies(counts, n))
    got = {r.doc_id: r.class_id for r in near.near_report(df).collect()}
    assert [got[i] for i in range(len(texts))] == force
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(force))


def test_ids_and_empty(spark):
    t = "a text of a few words that stands here more than once"
    df = spark.createDataFrame([(None, t), (None, t), (7, t), (7, t), (3, None), (3, ""), (None, None), (None, "another text with enough words in it")], "doc_id long, text string")
    got = near.near_report(df).collect()
    assert len(got) == 8 and sorted((r.class_id, r.class_size) for r in got if r.class_size > 1) == [(7, 4)] * 4
    kept = near.drop_near_duplicates(df).collect()
    assert sum(r.text == t for r in kept) == 1 and any(r.text and r.text.startswith("another") for r in kept)
    assert near.near_report(df.limit(0)).count() == 0 and near.drop_near_duplicates(df.limit(0)).count() == 0


def test_samples_estimate_similarity():
    """Over many pairs the share of agreeing samples is the weighted similarity, and what is drawn is drawn by its weight."""
    rng = random.Random(1)
    idf = np.ones(near.SLOTS, np.float32)
    errors = []
    for i in range(60):
        words = [f"w{i}x{j}" for j in range(300)]
        cut = rng.randint(10, 150)
        a, b = " ".join(words[: 300 - cut]), " ".join(words[cut:])
        got = near.samples(*near.weighted_shingles(*text_bytes(pa.array([a, b])), idf), 2)
        x, y = sets_of([a, b], idf)
        errors.append((got[0] == got[1]).mean() - near.similarity(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08  # 56 samples have a deviation of 0.067 at most
    n, weighted = 20_000, np.array([1.0, 2.0, 5.0], np.float32)
    row, code = np.repeat(np.arange(n), 3), near.mix(np.arange(3 * n, dtype=np.uint64))
    heavier = np.tile(weighted, n)
    with_all = near.samples(row, code, heavier, n)[:, 0]
    for k, share in enumerate(weighted / weighted.sum()):
        less = np.delete(np.arange(3 * n), np.arange(k, 3 * n, 3))  # the sample changes exactly where the missing one was drawn
        without = near.samples(row[less], code[less], heavier[less], n)[:, 0]
        assert abs((with_all != without).mean() - share) < 0.015


def test_recall_by_similarity(spark):
    """Pairs of the table at the threshold and above are found, whatever their similarity."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    idf = near.inverse_frequencies(*near.document_frequencies(near.prepared(df, "text", "doc_id")))
    sets = sets_of([r.text for r in rows], idf)
    held = defaultdict(list)
    for i, (codes, _) in enumerate(sets):
        for c in codes.tolist():
            held[c].append(i)
    pairs = {(a, b) for v in held.values() if len(v) < 60 for a in v for b in v if a < b}
    label = {r.doc_id: r.class_id for r in near.near_report(df).collect()}
    bands = defaultdict(list)
    for a, b in pairs:
        if (s := near.similarity(sets[a], sets[b])) >= near.SIMILARITY:
            bands[min(int(s * 20), 19)].append(label[rows[a].doc_id] == label[rows[b].doc_id])
    print({k / 20: (len(v), sum(v)) for k, v in sorted(bands.items())})
    assert sum(map(len, bands.values())) > 50 and all(map(all, bands.values()))


def test_same_table_twice(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.class_id for r in near.near_report(df).collect()}
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    force = classes_by_force(texts, near.inverse_frequencies(*near.document_frequencies(near.prepared(df, "text", "doc_id"))))
    classes = defaultdict(set)
    for i, c in enumerate(force):
        classes[c].add(i)
    assert {i: min(classes[c]) for i, c in enumerate(force)} == got
