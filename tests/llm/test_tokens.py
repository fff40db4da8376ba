"""Packing and token counts."""

import math
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import packing, token_counts


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = [None, "", "a", "Hello world's  end\n\n \t x", "é😀 ñandú 123456", "<|endoftext|> and <|endoftext|>", "word " * 5000, "x" * 3000, "one two " * 511]


def check_packing(spark, df, tokenizer, **options):
    rows = [r for r in packing.pack_documents(df, **options).collect()]
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    size = options.get("size", 1024)
    for r in df.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id] += [(i, *x) for i, x in enumerate(brute.pieces(ids, size))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    lengths = np.array([r.length for r in rows])
    return len(held), packing.lower_bound(lengths, size) if len(rows) else 0


def test_packing_edges(spark, tokenizer):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "x", 7), (3, TEXTS[3], 7)], "doc_id long, text string, length int")
    used, bound = check_packing(spark, df.drop("length"), tokenizer)
    assert used == bound
    assert packing.packing_report(df).count() == packing.packing_report(df.drop("length")).count()
    assert packing.packing_report(df.limit(0)).count() == 0


def test_packing_on_table(spark, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    used, bound = check_packing(spark, df, tokenizer)
    assert used <= 1.005 * bound
    used, bound = check_packing(spark, df, tokenizer, task_pieces=100)
    print("many partitions:", used, "bound", bound)
    assert used <= 1.01 * bound


def test_bounds():
    random.seed(5)
    for _ in range(200):
        size = 20
        lengths = np.array([random.randint(1, size - 1) for _ in range(random.randint(1, 12))])
        bins = packing.best_fit(lengths, size)
        assert np.bincount(bins, weights=lengths).max() <= size
        assert packing.lower_bound(lengths, size) <= bins.max() + 1
    assert packing.lower_bound(np.full(10, 600), 1024) == 10
    assert packing.lower_bound(np.full(10, 400), 1024) == 5


def best_by_force(token, scores):
    """Score and number of tokens: the best score, and the fewest tokens that reach it."""
    best = {0: (0.0, 0)}
    longest = max(map(len, scores))
    for end in range(1, len(token) + 1):
        best[end] = max((best[b][0] + scores[token[b:end]], best[b][1] - 1) for b in range(max(0, end - longest), end) if token[b:end] in scores)
    return best[len(token)][0], -best[len(token)][1]


def test_token_counts(spark):
    import regex

    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x y", 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_report(df).collect()}
    ranks, _ = token_counts.read_ranks(token_counts.vocabulary_path())
    scores = token_counts.piece_scores(ranks)
    find = regex.compile(token_counts.split_pattern()).findall
    for i, t in enumerate(TEXTS):
        tokens = find(t or "")
        assert "".join(tokens) == (t or "") and got[i].n_pretokens == len(tokens)
        forced = [(n, *best_by_force(k.encode(), scores)) for k, n in Counter(tokens).items()]
        assert math.isclose(got[i].log_score, sum(n * s for n, s, _ in forced), rel_tol=1e-9, abs_tol=1e-9)
        assert got[i].n_tokens == sum(n * c for n, _, c in forced)
    assert token_counts.token_report(df.limit(0)).count() == 0


def test_trie_counts_reconstruct():
    ranks, _ = token_counts.read_ranks(token_counts.vocabulary_path())
    scores = token_counts.piece_scores(ranks)
    words = [b" hello", b" help", b" helpful", b"helping", b" helpfulness", b"", b"\xff\xfe", b" h"]
    got = token_counts.trie_counts(words, scores, token_counts.lengths_by_end(scores))
    for w in words:
        score, count = best_by_force(w, scores)
        assert got[w][0] == count and math.isclose(got[w][1], score, abs_tol=1e-12)
    assert got[b""] == (0, 0.0) and got[b" hello"][0] == 1
    few = {b"a": -1.0, b"aa": -2.0, b"aaaa": -3.5, b"b": -1.0}  # equal scores take fewer tokens; no piece for c
    got = token_counts.trie_counts([b"aa", b"aaaab", b"aabaaa", b"aca"], few, token_counts.lengths_by_end(few))
    assert got == {b"aa": (1, -2.0), b"aaaab": (2, -4.5), b"aabaaa": (4, -6.0), b"aca": (0, float("-inf"))}


def test_token_counts_on_table(spark, monkeypatch):
    """All documents against the force, with tasks that hold on to few pre-tokens and with the usual ones."""
    import regex

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ranks, _ = token_counts.read_ranks(token_counts.vocabulary_path())
    scores = token_counts.piece_scores(ranks)
    find = regex.compile(token_counts.split_pattern()).findall
    rows = {r.doc_id: Counter(find(r.text or "")) for r in df.collect()}
    forced = {t: best_by_force(t.encode(), scores) for t in set().union(*rows.values())}
    for held, size in ((400_000, 8 << 20), (50, 1000)):
        monkeypatch.setattr(token_counts, "HELD_TOKENS", held)
        monkeypatch.setattr(token_counts, "TRIE_BYTES", size)
        got = {r.doc_id: r for r in token_counts.token_report(df).collect()}
        assert {i: (r.n_pretokens, r.n_tokens) for i, r in got.items()} == {i: (sum(c.values()), sum(n * forced[t][1] for t, n in c.items())) for i, c in rows.items()}


def test_packing_against_all_packings():
    """Best-fit with its bounds against the fewest sequences that any packing has."""
    rng = random.Random(11)

    def fewest(lengths, size):
        bins, best = [], len(lengths)

        def place(i):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for free in sorted({b for b in bins if b >= lengths[i]}):
                j = bins.index(free)
                bins[j] -= lengths[i]
                place(i + 1)
                bins[j] += lengths[i]
            bins.append(size - lengths[i])
            place(i + 1)
            bins.pop()

        place(0)
        return best

    more = 0
    for _ in range(150):
        lengths = sorted((rng.randint(1, 19) for _ in range(rng.randint(1, 11))), reverse=True)
        best, got = fewest(lengths, 20), int(packing.best_fit(np.array(lengths), 20).max()) + 1
        assert packing.lower_bound(np.array(lengths), 20) <= best <= got <= best + 1
        more += got > best
    assert more < 15
