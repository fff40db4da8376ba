"""Suffix deduplication against brute force."""

import random

import brute
import numpy as np
import pytest

from helixmill.llm import suffix_dedup


def check(spark, texts, width, **options):
    rows = [(i, t, 1.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed double").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeats_report(df, width=width, words=8, **options).collect()}
    want = [(*x, n) for x, n in zip(brute.repeats(texts, width), brute.shared_words(texts, 8), strict=True)]
    assert got == dict(enumerate(want))
    assert any(x[1] and not x[4] for x in want) and any(x[4] and not x[1] for x in want)


def texts_with_repeats(seed, n=60):
    random.seed(seed)
    word = lambda: random.choice(["ab", "é", "xyz ", "q", "0 1", "\n"])
    passages = ["".join(word() for _ in range(random.randint(5, 60))) for _ in range(6)]
    out = [None, "", "a" * 500, "ab" * 300, passages[0] * 4]
    for _ in range(n):
        t = "".join(random.choice([word(), random.choice(passages)]) for _ in range(random.randint(0, 25)))
        out += [t] if random.random() < 0.8 else [t, t[: random.randint(0, len(t))], t + "!"]
    short = "a b c d e f g h i"  # a passage of words with fewer bytes than a window
    out += [f"one {short} two", f"three {short.upper()}, four", f"p {short} q {short} r", "x " * 40, "x " * 41, "y " * 40, "the b c d e f g h " * 3]
    base = "".join(word() for _ in range(120))
    for i in range(30):
        at = random.randint(0, len(base) - 1)
        out.append(base[:at] + chr(65 + i) + base[at + 1 :])
    return out


@pytest.mark.parametrize("task_runs, bitmap_bits", [(20_000, 1 << 27), (3, 1 << 27), (20_000, 0), (3, 0)])
def test_small_width(spark, task_runs, bitmap_bits):
    check(spark, texts_with_repeats(task_runs), 24, task_runs=task_runs, bitmap_bits=bitmap_bits)


def test_bitmap(spark):
    n = 5000
    shared = spark.range(n).selectExpr("xxhash64(id) AS g").repartition(4)
    bitmap, bits = suffix_dedup.bitmap_of(shared, "g", n, 1 << 20)
    want = np.zeros(1 << bits, np.uint8)
    for r in shared.collect():
        want[r.g & (1 << bits) - 1] = 1
    assert bits == 17 and (np.unpackbits(bitmap, bitorder="little") == want).all()
    assert suffix_dedup.bitmap_of(shared, "g", n, 1 << 16) is None


def test_passages(spark):
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(words)
    texts = [f"begin {passage} end", f"other, {passage.upper()}!", " ".join(words[:49]), f"{passage} {passage}", "no " * 200, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shared_words, r.n_removed) for r in suffix_dedup.repeats_report(df).collect()}
    assert len(passage) < 400 and got == {0: (60, 0), 1: (60, 0), 2: (0, 0), 3: (120, 0), 4: (0, 600), 5: (0, 0)}
    assert suffix_dedup.shared_passages(df).select("k1").distinct().count() == 3


def test_ids_and_empty(spark):
    t = "the same long string of more than twenty bytes"
    df = spark.createDataFrame([(None, t), (None, t + "x"), (1, t), (1, "z" + t), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.repeats_report(df, width=20).collect())
    n = len(t)
    assert got == [(False, 1, n, n), (False, 1, n + 1, n), (False, 2, 5, 0), (True, 0, n, n), (True, 0, n + 1, n)]
    assert suffix_dedup.repeats_report(df.limit(0)).count() == 0
    kept = suffix_dedup.remove_repeats(df, width=20).where("doc_id = 1 and n_bytes > n_removed").first().kept
    assert bytes(kept) == b"z"


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = df.collect()
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeats_report(df).collect()}
    texts = [r.text for r in rows]
    assert got == {r.doc_id: (*x, n) for r, x, n in zip(rows, brute.repeats(texts), brute.shared_words(texts, 50), strict=True)}
