"""Minimizers of FASTA files in ranges against those of whole sequences."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions.parameters import kmer_parameters
from helixmill.operators.minimizers import minimizer_set, minimizers
from helixmill.plans.index import build_index
from helixmill.sources.fasta import read_fasta
from helixmill.sources.fasta_blocks import genome_sets, read_fasta_sets


def odd_file(rng):
    """Lines of records with blank, spaced and short lines, other letters, empty records, and text before the first header."""
    out = ["ACGTACGTAC" * 4] * rng.randrange(2)
    for i in range(rng.randrange(0, 5)):
        out.append(f">r{i},x")
        n = rng.choice([0, 1, 3, 9, 26])
        out += [rng.choice(["", " ", "\t"]) if rng.random() < 0.2 else "".join(rng.choice("ACGTacgtUN" if rng.random() < 0.02 else "ACGT") for _ in range(rng.choice([1, 2, 5, 30, 90]))) + " " * rng.randrange(2) for _ in range(n)]
    return out


def whole(lines, joined):
    """{record: (header, sequence)}"""
    out, n = {}, 0
    for line in lines:
        if line.startswith(">"):
            n += 1
            out.setdefault(1 if joined else n, [line, ""])
        elif n:
            out[1 if joined else n][1] += re.sub(r"\s+", "", line)
    return out


@pytest.mark.parametrize("k, joined, piece", [(29, False, 7), (29, True, 40), (16, True, 3), (20, False, 1 << 20)])
def test_ranges_of_any_size(spark, k, joined, piece):
    rng = random.Random(k + joined)
    files = {f"f{i:03}": odd_file(rng) for i in range(60)}
    rows = []
    for path, lines in files.items():
        block = 0
        for at, line in enumerate(lines):
            if at == 0 or rng.random() < rng.choice([0.05, 0.3, 0.9]):
                block = at
            rows.append((path, block, at, line))
    table = spark.createDataFrame(rows, "path string, block long, line_no long, line string").coalesce(1).sortWithinPartitions("path", "line_no")
    genomes, sets = genome_sets(table, k, joined, piece)
    want = {(p, r): (h, s) for p, lines in files.items() for r, (h, s) in whole(lines, joined).items()}
    assert {(r.path, r.record): (r.header, r.n_bases) for r in genomes.collect()} == {key: (h, len(s)) for key, (h, s) in want.items()}
    k, step, _ = kmer_parameters(k)
    mz = {(*key, m) for key, (_, s) in want.items() for m in minimizer_set(np.frombuffer(s.encode(), np.uint8), k, step).tolist()}
    got = [tuple(r) for r in sets.join(genomes, ["owner", "local"]).select("path", "record", "mz").collect()]
    assert len(got) == len(set(got)) and set(got) == mz and len(mz) > 500


@pytest.mark.parametrize("mode", ["record", "file"])
def test_files(spark, tmp_path, mode):
    """The ids, names and sets of reading whole sequences, and an index of the same filters."""
    rng = random.Random(5)
    for i in range(14):
        contigs = [f">g{i}c{j}\n" + "\n".join("".join(rng.choice("ACGT") for _ in range(60)) for _ in range(rng.randrange(1, 30))) for j in range(2)]
        (tmp_path / f"g{i:02}.fna").write_text("\n".join([*contigs, f">short{i}\nACGT\n"]))
    (tmp_path / "g_protein.faa").write_text(">p\n" + "ACGT" * 20)
    known = read_fasta(spark, str(tmp_path), mode=mode)
    genomes, sets = read_fasta_sets(spark, str(tmp_path), mode=mode, range_size=7, piece=100)
    assert sorted(map(tuple, genomes.collect())) == sorted(map(tuple, known.select("genome_id", "name").collect()))
    assert sorted(map(tuple, sets.collect())) == sorted(map(tuple, minimizers(known).collect()))
    if mode == "file":
        one = build_index(spark, known, str(tmp_path / "a.index"))
        two = build_index(spark, genomes, str(tmp_path / "b.index"), sets=sets)
        assert one["tree"] == two["tree"] and one["filters"] == two["filters"]
        bits = lambda x: sorted(map(tuple, spark.read.parquet(str(tmp_path / x / "filter_segments")).groupBy("filter_id").agg(F.sum("set_bits")).collect()))
        assert bits("a.index") == bits("b.index")
    few = read_fasta_sets(spark, str(tmp_path), mode=mode, limit=3)
    assert few[0].count() == 3 and few[1].select("genome_id").distinct().count() == 3


def test_nothing(spark, tmp_path):
    (tmp_path / "a.fa").write_text("")
    (tmp_path / "b.fa").write_text("no header\nACGT\n")
    for mode in ("record", "file"):
        genomes, sets = read_fasta_sets(spark, str(tmp_path), mode=mode)
        assert genomes.count() == 0 and sets.count() == 0
    with pytest.raises(ValueError):
        read_fasta_sets(spark, str(tmp_path), mode="contig")


def test_tasks_follow_the_bases(spark, tmp_path, monkeypatch):
    """Sets of divided sequences were made distinct in the session's number of tasks, whatever the input's size."""
    from helixmill.sources import fasta_blocks
    from helixmill.sources.fastq_ranges import range_lines

    rng = random.Random(3)
    (tmp_path / "a.fa").write_text("".join(f">g{i}\n" + "\n".join("".join(rng.choice("ACGT") for _ in range(50)) for _ in range(20)) + "\n" for i in range(10)))
    lines = range_lines(spark, [str(tmp_path / "a.fa")], 30)
    want = {tuple(r) for r in fasta_blocks.genome_sets(lines, 29, piece=100)[1].collect()}
    few = fasta_blocks.genome_sets(lines, 29, piece=100)[1].rdd.getNumPartitions()
    monkeypatch.setattr(fasta_blocks, "TASK_BASES", 500)
    sets = fasta_blocks.genome_sets(lines, 29, piece=100)[1]
    assert sets.rdd.getNumPartitions() >= few + 16 and {tuple(r) for r in sets.collect()} == want and len(want) > 1000
