"""Reads against branches by parts and by blocks, and sets of many short sequences together."""

import random

import numpy as np
from pyspark.sql import functions as F

from helixmill.operators import meeting, minimizers, unions
from helixmill.operators.minimizers import minimizer_set
from helixmill.plans import queries

K, STEP = 29, 4


def set_of(text):
    return set(minimizer_set(np.frombuffer((text or "").encode(), np.uint8), K, STEP).tolist())


def test_sets_together(monkeypatch):
    rng = random.Random(1)
    for together in (1 << 18, 500):
        monkeypatch.setattr(minimizers, "TOGETHER", together)
        for k, step in ((29, 4), (11, 2), (37, 6)):
            texts = [None, ""] + ["".join(rng.choice("acgtNU" if rng.random() < 0.3 else "ac") for _ in range(rng.choice((5, k - 2, k - 1, k, k + 1, 60, 300, 900)))) for _ in range(200)]
            for text, got in zip(texts, minimizers.sets_of(texts, k, step), strict=True):
                assert got.tolist() == minimizer_set(np.frombuffer((text or "").encode(), np.uint8), k, step).tolist()


def example(spark):
    """Genomes of three nodes with copies and shared passages; reads are cuts of them, and foreign ones."""
    rng = random.Random(2)
    dna = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    common = dna(400)
    genomes = [(g, g % 3, dna(rng.choice((20, 200, 900))) + common[: rng.choice((0, 150, 400))]) for g in range(30)]
    genomes += [(g + 30, g % 3, seq) for g, _, seq in genomes[:9]]
    reads = [(n << 11, genomes[rng.randrange(39)][2][(p := rng.choice((0, 100))) : p + 300]) for n in range(60)] + [(1 << 40, dna(300)), (1 << 41, common), (1 << 42, "")]
    return genomes, reads, spark.createDataFrame(genomes, "genome_id int, node_id int, seq string"), spark.createDataFrame(reads, "read_key long, seq string")


def test_hits_by_parts(spark, monkeypatch):
    genomes, reads, held, asked = example(spark)
    sets = minimizers.minimizer_sets(held.withColumnRenamed("node_id", "filter_id"), ["filter_id"], "seq", K)
    own = {f: set().union(*(set_of(seq) for _, n, seq in genomes if n == f)) for f in range(3)}
    want = {(r, f): n for r, seq in reads for f in own if (n := len(set_of(seq) & own[f]))}
    for limit, parts in ((1 << 21, 128), (50, 256)):
        monkeypatch.setattr(meeting, "HELD", limit)
        monkeypatch.setattr(meeting, "COUNTED", limit)
        got = meeting.part_hits(asked, unions.packed_union(sets, parts=parts), K, parts).collect()
        assert len(got) == len(want) and {(r.read_key, r.branch): r.hits for r in got} == want
    assert meeting.parts_for(0) == 128 and meeting.parts_for((1 << 30) + 1) == 512


def test_best_by_blocks(spark):
    """Blocks of any size, equal genomes, reads that hit nothing: the best of the blocks' best is the best of all."""
    genomes, reads, held, asked = example(spark)
    sets = {g: (n, set_of(seq)) for g, n, seq in genomes}
    branches = held.select("node_id", F.col("genome_id").alias("branch"), "seq").join(spark.createDataFrame([(g, len(x)) for g, (_, x) in sets.items() if x], "branch int, n_elements long"), "branch")
    total = {n: sum(len(x) for m, x in sets.values() if m == n) for n in range(3)}
    for block in (1 << 24, 2000, 300):
        out = meeting.best_in_blocks(asked.withColumn("node_id", (F.col("read_key") / 2048 % 3).cast("int")), branches, K, block).collect()
        best = {}
        for r in out:
            n, own = len(set_of(dict(reads)[r.read_key])), sets[r.branch][1]
            assert r.hits == len(own & set_of(dict(reads)[r.read_key])) and r.node_id == sets[r.branch][0]
            score = np.float32(np.sqrt(float(r.hits)) * (r.hits / (float(n) * len(own) / total[r.node_id])))
            best[r.read_key] = max(best.get(r.read_key, (0, 0)), (score, -r.branch))
        for key, seq in reads:
            node, mine = int(key / 2048 % 3), set_of(seq)
            scores = [(np.float32(np.sqrt(float(h)) * (h / (float(len(mine)) * len(x) / total[n]))), -g) for g, (n, x) in sets.items() if n == node and (h := len(x & mine))]
            assert best.get(key) == (max(scores) if scores else None)


def test_descent_shuffles_no_minimizer_of_a_read(spark):
    """Before, each minimizer of a read was a row of both joins, beside the read's name."""
    for query in (queries.descended(spark, "/root/testdata/sf0.001")[0], queries.first_level(spark, "/root/testdata/sf0.001")[2]):
        plan = query._jdf.queryExecution().optimizedPlan().toString()
        assert not any("mz" in line for line in plan.splitlines() if "Join" in line or "Repartition" in line)
        assert "MapInArrow" in plan
