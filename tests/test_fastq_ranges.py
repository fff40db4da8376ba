"""Parsing in ranges against parsing in one pass, over files made to mislead it."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixmill.sources import fastq_ranges as fr
from helixmill.sources.fastq import parse_fastq, read_fastq


def hostile(rng, n):
    """Lines of wrapped records with qualities that look like headers and separators, cut and stray ones."""
    out = []
    for i in range(n):
        kind = rng.randrange(12)
        seq = ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(0 if kind == 1 else 1, 7))) for _ in range(rng.randrange(1, 4))]
        qual = ["".join(rng.choice("@+AIC") for _ in s) for s in seq]
        if kind == 2:
            qual = [rng.choice(["@A", "+", "@", "AC", "", "@+"]) for _ in range(rng.randrange(4))]
        if kind == 3:
            qual = qual[:-1]
        if kind == 4:
            out += rng.choice([["stray"], ["ACGT"], ["+"], [""], ["ACGT", "+", "@x"], [" AC \t", "+"]])
        if kind == 5:
            seq = [f" {s}\t" for s in seq]
        out += [f"@r{i}", *seq, *([] if kind == 6 else ["+" + rng.choice(["", f"r{i}", "@"])]), *qual]
    return out[: len(out) - rng.randrange(4)]


def in_ranges(lines, cuts):
    """The reads by the functions, states and pieces of ranges, without Spark; and that both readings agree."""
    edges = [0, *sorted(set(cuts) - {0, len(lines)}), len(lines)]
    ranges = [fr.Range(pa.array(lines[a:b], pa.string())) for a, b in zip(edges, edges[1:])]
    state, owner, before, pieces = (fr.HEADER, 0), -1, 0, []
    for k, r in enumerate(ranges):
        run, follows = r.tail, False
        for other in ranges[k + 1 :]:
            run += other.lead
            if other.first != "all":
                follows = r.open and other.first == "plus" and 0 < run < fr.LOOK_AHEAD
                break
        key = {"kind": state[0], "value": state[1], "owner": owner, "before": before, "block": edges[k], "follows": follows}
        own = list(fr._pieces(r, lines[edges[k] : edges[k + 1]], key))
        pieces += own
        kind, value, header, begun = fr.followed(fr.unpacked(fr.packed(r.function(follows))), *state)
        assert begun == sum(p[2] is not None for p in own)
        state, before = (kind, value), before + begun
        owner = -1 if kind == fr.HEADER else owner if header == -2 else edges[k]
        assert header < 0 or lines[edges[k] + header] == own[-1][3]
    reads, open_ = {}, {}
    for of, _, turn, name, seq, qual, skipped, separated, whole in pieces:
        if whole:
            reads[turn] = (name, seq, qual, skipped)
            continue
        rec = open_.setdefault(of, {"seq": "", "qual": "", "separated": False})
        rec["seq"] += seq
        rec["qual"] += qual
        rec["separated"] |= separated
        if turn is not None:
            rec.update(turn=turn, name=name, skipped=skipped)
    reads |= {r["turn"]: (r["name"], r["seq"], r["qual"], r["skipped"]) for r in open_.values() if r["separated"]}
    out = []
    for turn in sorted(reads):
        name, seq, qual, skipped = reads[turn]
        said = ([f"skipped {skipped} lines"] if skipped else []) + ([f"sequence {len(seq)}, quality {len(qual)}"] if len(seq) != len(qual) else [])
        out.append((name, seq, qual, "; ".join(said) or None))
    assert sorted(reads) == list(range(len(reads)))
    return out


@pytest.mark.parametrize("seed", range(300))
def test_any_cuts_of_hostile_files(seed):
    rng = random.Random(seed)
    lines = hostile(rng, rng.randrange(1, 25))
    want = list(parse_fastq(lines))
    assert in_ranges(lines, []) == want
    assert in_ranges(lines, range(len(lines))) == want  # every line a range
    for _ in range(6):
        assert in_ranges(lines, [rng.randrange(len(lines) + 1) for _ in range(rng.randrange(1, 8))]) == want


def test_look_ahead_over_ranges(monkeypatch):
    """The limit of looking ahead counts the lines of all ranges."""
    monkeypatch.setattr(fr, "LOOK_AHEAD", 6)
    monkeypatch.setattr("helixmill.sources.fastq.LOOK_AHEAD", 6)
    for n in range(1, 10):
        lines = ["@a", "ACGT", "+", "@b", *["A"] * n, "+", "I" * n, "@c", "A", "+", "I"]
        want = list(parse_fastq(lines))
        for cuts in ([4], [5], [4, 6, 8], range(len(lines))):
            assert in_ranges(lines, cuts) == want, (n, cuts)


def test_files_in_many_splits(spark, tmp_path, monkeypatch):
    """A file in splits and ranges of few lines, against the same file whole; another one beside it."""
    rng = random.Random(5)
    for name, n in (("a.fastq", 3000), ("b.fq", 50)):
        (tmp_path / name).write_text("\n".join(hostile(rng, n)) + "\n")
    want = sorted(map(tuple, read_fastq(spark, str(tmp_path)).collect()))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = read_fastq(spark, str(tmp_path), whole_bytes=0)
        assert got.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, got.collect())) == want and len(want) > 2500
        monkeypatch.setattr(fr, "BROADCAST_RANGES", 0)
        assert sorted(map(tuple, read_fastq(spark, str(tmp_path), whole_bytes=0).collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    with pytest.raises(Exception, match="have changed between two readings"):
        lines = fr.range_lines(spark, [str(tmp_path / "a.fastq")])
        states = fr.range_states(fr.range_functions(lines)).withColumn("n", F.col("n") + 1)
        fr.range_pieces(lines.join(states, ["path", "block"])).count()


def test_many_small_files_in_one(spark, tmp_path):
    """Files that lie one after the other in few, over splits and in ranges of few lines, against each of them whole."""
    rng = random.Random(8)
    files = {f"f{i % 7}_{i}": hostile(rng, rng.randrange(1, 40)) for i in range(60)}
    want = sorted((name, i, *read) for name, lines in files.items() for i, read in enumerate(parse_fastq(lines)))
    for k in range(2):
        own = [f"{name}\t{line}" for name in list(files)[k::2] for line in files[name]]
        (tmp_path / f"{k}.txt").write_text("\n".join(own) + "\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for most in (5, 1 << 19):
            lines = fr.range_lines(spark, [str(tmp_path / f"{k}.txt") for k in range(2)], most, named=True)
            assert lines.rdd.getNumPartitions() > 5
            assert sorted(map(tuple, fr.reads_of_ranges(lines).collect())) == want and len(want) > 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_the_query_writes_few_files(spark):
    """A few documents were a file and a folder each, which listing, opening and committing followed."""
    from pathlib import Path

    from helixmill.functions.lineage import shared_dir
    from helixmill.plans.queries import fastq_files, fastq_ranges

    parts = lambda: set(Path(shared_dir(spark)).glob("helixmill-fastq-*/**/part-*"))
    before = parts()
    assert fastq_ranges(spark, "/root/testdata/sf0.001").select("path").distinct().count() == fastq_files(spark, "/root/testdata/sf0.001").count() > 50
    assert 0 < len(parts() - before) <= 8
