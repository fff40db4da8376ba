"""Parameters, hashes, minimizers, clustering steps and Bloom filters against plain Python."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from helixmill.functions import hashing, parameters as par
from helixmill.functions.sequences import csv_field, genome_name
from helixmill.operators import bloom, classification as cl, clustering, similarity as sim
from helixmill.operators.minimizers import chunk_sequences, minimizer_set, minimizers
from helixmill.plans.index import FORMAT, coerced_fpp

CODE = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3}


def slow_minimizers(s, k):
    k, step, m = par.kmer_parameters(k)
    if len(s) < k:
        return set()
    codes = [CODE.get(c.upper()) for c in s]
    found = []
    for i in range(len(s) - m + 1):
        w = codes[i : i + m]
        if None in w:
            found.append(None)
            continue
        found.append(min(sum(c * 4 ** (m - 1 - j) for j, c in enumerate(w)), sum((3 - c) * 4**j for j, c in enumerate(w))))
    windows = [[x for x in found[i : i + step] if x is not None] for i in range(len(found) - step + 1)]
    return {min(w) for w in windows if w}


def fast(s, k, piece=1 << 21):
    k, step, _ = par.kmer_parameters(k)
    return set(minimizer_set(np.frombuffer(s.encode("ascii", "replace"), np.uint8), k, step, piece).tolist())


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTacgtUuN-", min_size=0, max_size=160), st.integers(8, 40), st.integers(1, 70))
def test_minimizers(s, k, piece):
    assert fast(s, k) == fast(s, k, piece) == slow_minimizers(s, k)


@settings(max_examples=30, deadline=None)
@given(st.text("ACGT", min_size=29, max_size=300))
def test_reverse_complement(s):
    assert fast(s, 29) == fast(s[::-1].translate(str.maketrans("ACGT", "TGCA")), 29) == fast(s.replace("T", "u").lower(), 29)


def test_minimizer_edges(spark):
    rng = random.Random(3)
    s = "".join(rng.choice("ACGT") for _ in range(5000))
    rows = [(0, s[:28]), (1, s[:29]), (2, "N" * 100), (3, None), (4, s), (5, s[:40] + "N" + s[40:80]), (6, ""), (None, s[:100])]
    df = spark.createDataFrame(rows, "genome_id int, seq string")
    got = {}
    for r in minimizers(df).collect():
        got.setdefault(r.genome_id, set()).add(r.mz)
    assert got == {i: slow_minimizers(s, 29) for i, s in rows if s and slow_minimizers(s, 29)}
    assert 1 <= len(got[1]) <= 2
    whole = df.where("genome_id = 4")
    for size in (100, 29, 4972, 7):
        chunked = minimizers(chunk_sequences(whole, "seq", size, 29)).distinct()
        assert {r.mz for r in chunked.collect()} == got[4]


def murmur2(data, seed):
    m, h = 0x5BD1E995, seed ^ len(data)
    for (k,) in struct.iter_unpack("<I", data):
        k = k * m & 0xFFFFFFFF
        k = (k ^ k >> 24) * m & 0xFFFFFFFF
        h = h * m & 0xFFFFFFFF ^ k
    h = (h ^ h >> 13) * m & 0xFFFFFFFF
    return h ^ h >> 15


def test_hashes(spark):
    rng = random.Random(1)
    values = [0, 1, -1, (1 << 63) - 1, -(1 << 63)] + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    h0, h1 = hashing.murmur2_pair(F.col("v"))
    for r in hashing.mixed(df.select("v", h0.alias("h0"), h1.alias("h1")), "v", "m").collect():
        assert (r.h0, r.h1) == (murmur2(struct.pack(">q", r.v), 0), murmur2(struct.pack(">q", r.v), 1))
        z = hashing.mix_seed((r.v & hashing.MASK64) ^ hashing.GOLDEN)
        assert r.m & hashing.MASK64 == z
    for seed in (0, 1):
        assert hashing.murmur2_array(np.array(values), seed).tolist() == [murmur2(struct.pack(">q", v), seed) for v in values]
    assert 0 <= hashing.unit(12345) < 1 and hashing.node_seed([1, 2], 3, 4) != hashing.node_seed([2, 1], 3, 4)


def test_text_functions(spark):
    df = spark.createDataFrame([('a,"b"',), ("plain",), ("x\ny",), (">n, m",)], "t string")
    got = df.select(csv_field(F.col("t")).alias("c"), genome_name(F.col("t")).alias("n")).collect()
    assert [r.c for r in got] == ['"a,""b"""', "plain", '"x\ny"', '">n, m"'] and got[3].n == ">n -  m"


def test_parameters(spark):
    assert [par.kmer_parameters(k) for k in (1, 10, 12, 16, 28, 29, 36, 37, 90)] == [(11, 2, 9), (11, 2, 9), (13, 2, 11), (17, 4, 13), (29, 4, 25), (29, 4, 25), (37, 6, 31), (37, 6, 31), (37, 6, 31)]
    rows = spark.range(0, 50).select("id", *[c.alias(f"c{i}") for i, c in enumerate(par.kmer_columns(F.col("id")))]).collect()
    assert all((r.c0, r.c1, r.c2) == par.kmer_parameters(r.id) for r in rows)
    grid = spark.range(20).selectExpr("id AS z").crossJoin(spark.range(20).selectExpr("id AS p"))
    out = grid.select("z", "p", par.growth_weight_column(F.col("z"), F.col("p")).alias("w"), par.leader_limit_column(F.col("z") * 9, F.col("z"), F.col("p")).alias("l"), par.adaptive_bound_column(F.col("z") * 50, F.col("p") / 20.0, F.col("z") / 30.0, F.lit(0.4), F.lit(0.1)).alias("a"))
    for r in out.collect():
        assert math.isclose(r.w, par.growth_weight(r.z, r.p), abs_tol=1e-12)
        assert r.l == par.leader_limit(9 * r.z, r.z, r.p) and r.a == par.adaptive_bound(50 * r.z, r.p / 20, r.z / 30, 0.4, 0.1)
    assert par.adaptive_bound(100, -1.0, -1.0, 0.4, 0.1) == math.ceil(math.log1p(100))
    assert [n for n in range(60) if par.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert par.bloom_parameters(89_617_968)[0] == 1 and par.bloom_parameters(89_700_000)[0] == 2
    with pytest.raises(ValueError):
        par.bloom_parameters(10**11)
    assert coerced_fpp(0) == coerced_fpp(7.0) == 1e-5 and coerced_fpp(0.01) == 0.01 and FORMAT["format"]


def test_bloom(spark):
    rng = random.Random(9)
    sets = {0: {rng.randrange(1 << 50) for _ in range(3000)}, 1: {rng.randrange(1 << 50) for _ in range(40)}}
    elements = spark.createDataFrame([(f, v) for f, s in sets.items() for v in s], "filter_id int, mz long")
    filters = bloom.filter_table(spark, elements.groupBy("filter_id").agg(F.count("*").alias("capacity")), 0.01)
    words = bloom.insert(elements, filters)
    assert bloom.contains(elements, filters, words).count() == elements.count()
    others = spark.createDataFrame([(0, rng.randrange(1 << 50, 1 << 51)) for _ in range(5000)], "filter_id int, mz long").distinct()
    wrong = bloom.contains(others, filters, words).count()
    assert abs(wrong - 50) < 3 * 7.1 + 5
    stats = {r.filter_id: r for r in bloom.statistics(filters, words, elements.groupBy("filter_id").agg(F.count("*").alias("inserted"))).collect()}
    assert abs(stats[0].estimate - 3000) < 90 and 0.005 < stats[0].rate < 0.015
    half = words.withColumn("filter_id", F.lit(0))
    assert bloom.statistics(filters.where("filter_id = 1"), half.limit(0)).first().estimate == 0


def test_similarity(spark):
    sets = {0: set(range(100)), 1: set(range(50, 150)), 2: set(range(1000, 1100)), 3: set(range(100))}
    mz = spark.createDataFrame([(g, v) for g, s in sets.items() for v in s], "genome_id int, mz long")
    got = {(r.a, r.b): r for r in sim.similarity(mz).collect()}
    assert set(got) == {(0, 1), (0, 3), (1, 3)} and got[0, 3].score == got[0, 3].jaccard == 1
    assert math.isclose(got[0, 1].score, 1 / (1 - math.log(0.5))) and math.isclose(got[0, 1].jaccard, 1 / 3)
    pairs = sim.sample_pairs(spark, 4, 100)
    assert pairs.count() == 6
    for mode in ("exact", "sketch"):
        scored = {(r.a, r.b): r.score for r in sim.similarity(mz, pairs, mode).collect()}
        assert len(scored) == 6 and scored[0, 2] == 0 and math.isclose(scored[0, 1], 1 / (1 - math.log(0.5)), rel_tol=0.02)
    counts = sim.calibration_counts(sim.pair_classes(sim.pair_counts(pairs, mz))).first()
    assert (counts.zero, counts.positive, counts.pairs) == (3, 3, 6)
    drawn = sim.sample_pairs(spark, 1000, 500).collect()
    assert len(drawn) == 500 and all(0 <= r.a < r.b < 1000 for r in drawn) and drawn == sim.sample_pairs(spark, 1000, 500).collect()
    assert sim.sample_pairs(spark, 1, 10).count() == 0
    ranks = sim.percentiles(spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.9), (4, 0.0)], "i int, score double"))
    assert {r.i: r.percentile for r in ranks.collect()} == {1: 2 / 3, 2: 2 / 3, 3: 1.0, 4: 0.0}
    one = sim.similarity_stats(sim.similarity(mz).where("a = 0 and b = 1")).first()
    assert (one.n, one["mean"], one["std"]) == (1, -1.0, -1.0)


def test_pair_counts_by_frequency(spark, monkeypatch):
    """Rare and frequent minimizers, counted by either road, give the pairs' shared numbers."""
    rng = random.Random(2)
    sets = {g: {rng.randrange(400) for _ in range(60)} | {1000, 1001} for g in range(20)}
    mz = spark.createDataFrame([(g, v) for g, s in sets.items() for v in s], "genome_id long, mz long")
    pairs = [(a, b) for a in range(22) for b in range(a + 1, 22) if (a + b) % 3]
    asked = spark.createDataFrame(pairs, "a long, b long")
    for rare in (0, 3, 64):
        monkeypatch.setattr(sim, "RARE", rare)
        got = {(r.a, r.b): r.shared for r in sim.pair_counts(asked, mz).collect()}
        assert got == {(a, b): len(sets.get(a, set()) & sets.get(b, set())) for a, b in pairs}


@pytest.mark.parametrize(("n", "target"), [(30, 434), (30, 400), (300, 5000), (1000, 1)])
def test_sample_is_whole(spark, n, target):
    first, i = {}, 0
    while len(first) < target:
        x, y = (int(hashlib.md5(f"9001:{i}:{z}".encode()).hexdigest()[:12], 16) % n for z in "xy")
        if x != y:
            first[min(x, y), max(x, y)] = i
        i += 1
    got = [tuple(r) for r in sim.sample_pairs(spark, n, target).collect()]
    assert len(got) == target and set(got) == set(first)


@settings(max_examples=25, deadline=None)
@given(st.integers(10, 80), st.integers(1, 9), st.integers(0, 1000))
def test_clusters_are_partitions(n, families, seed):
    similar = clustering.Similarities(lambda a, b: 0.9 if a % families == b % families else (0.0 if (a + b) % 3 else 0.05))
    tree = clustering.build_tree(range(n), similar, (0.4, 0.2), seed)
    again = clustering.build_tree(range(n), clustering.Similarities(similar.score), (0.4, 0.2), seed)
    assert tree.branches == again.branches
    ends = [b for b in tree.branches if b[3] is None]
    assert sorted(i for b in ends for i in b[4]) == list(range(n)) and all(len(b[4]) == 1 for b in ends)
    assert [b[2] for b in tree.branches] == list(range(len(tree.branches)))
    for node in {b[0] for b in tree.branches}:
        own = [b for b in tree.branches if b[0] == node]
        parent = next((b[4] for b in tree.branches if b[3] == node), list(range(n)))
        assert sorted(i for b in own for i in b[4]) == sorted(parent) and [b[1] for b in own] == list(range(len(own)))


def test_no_similarity_still_divides():
    tree = clustering.build_tree(range(25), clustering.Similarities(lambda a, b: 0.0), (-1.0, -1.0))
    assert sum(b[3] is None for b in tree.branches) == 25
    with pytest.raises(ValueError):
        clustering.build_tree(range(9), clustering.Similarities(lambda a, b: 0.0), (-1.0, -1.0))
    with pytest.raises(ValueError):
        clustering.check_partition([1, 2], [[1], [1, 2]])


def test_scores(spark):
    reads = spark.createDataFrame([("a", 0, 10), ("b", 0, 4)], "read_id string, node_id int, n_minimizers long")
    branches = spark.createDataFrame([(0, 5, 0, 100), (0, 6, 1, 100), (0, 7, 2, 200)], "node_id int, branch int, child_ord int, n_elements long")
    hits = spark.createDataFrame([("a", 0, 6, 4), ("a", 0, 5, 4), ("a", 0, 7, 4)], "read_id string, node_id int, branch int, hits long")
    every = cl.scored(hits, reads, branches)
    assert every.count() == 6
    best = {r.read_id: r for r in cl.best_branch(every).collect()}
    assert best["a"].branch == 5 and best["a"].score == np.float32(2 * 4 / 2.5) and best["b"].hits == 0 and best["b"].branch == 5
    assert cl.best_by_hits(hits, reads, branches).collect()[0].branch == 5
    rows = spark.createDataFrame([("a", 1, 6, 10, 3.0), ("b", None, 0, 4, None), ("c", 2, 0, 4, 0.0), ("d", 3, 5, 0, float("nan"))], "read_id string, genome_id int, hits long, n_minimizers long, score float")
    for threshold, want in ((0.5, {"a"}), (-3, {"a"}), (0, {"a", "d"}), (1, {"a", "d"}), (6, {"a"}), (7, set()), (0.75, {"a"}), (0.76, set())):
        assert {r.read_id for r in cl.accepted(rows, threshold).where("accepted").collect()} == want, threshold
