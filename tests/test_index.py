"""Sources, index and classification end to end, on small made files."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.operators import bloom, classification, clustering, similarity as sim
from helixmill.operators.minimizers import minimizers
from helixmill.plans.classify import classify, write_csv
from helixmill.plans.index import build_index, divided, open_index
from helixmill.sources.fasta import is_genome_file, read_fasta
from helixmill.sources.fastq import parse_fastq, read_fastq
from helixmill.streaming.reads import classify_arriving, genome_totals


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def changed(rng, s, share):
    return "".join(rng.choice("ACGT") if rng.random() < share else c for c in s)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng, folder = random.Random(7), tmp_path_factory.mktemp("data")
    families = [bases(rng, 3000) for _ in range(6)]
    genomes = [changed(rng, families[i % 6], 0.01) for i in range(30)]
    with open(folder / "all.fna", "w") as f:
        f.write("text before the first record\n")
        for i, g in enumerate(genomes):
            f.write(f">genome {i}, of family {i % 6}\n" + "\n".join(g[j : j + 70] for j in range(0, len(g), 70)) + "\n")
        f.write(">short\nACGT\n")
    index = str(folder / "index")
    metadata = build_index(spark, read_fasta(spark, str(folder / "all.fna")), index, k=28)
    reads = []
    for i in range(60):
        g = i % 30
        at = rng.randrange(2500)
        reads.append((f"@r{i} of {g}", genomes[g][at : at + 400]))
    reads += [(f"@x{i}", bases(rng, 300)) for i in range(10)] + [("@tiny", "ACGT")]
    with gzip.open(folder / "reads.fastq.gz", "wt") as f:
        for name, s in reads:
            f.write(f"{name}\n{s[:150]}\n{s[150:]}\n+\n{'@' * len(s)}\n" if len(s) > 150 else f"{name}\n{s}\n+\n{'I' * len(s)}\n")
    return folder, index, metadata, genomes, reads


def test_fasta(spark, made):
    folder, _, metadata, genomes, _ = made
    rows = read_fasta(spark, str(folder / "all.fna")).orderBy("genome_id").collect()
    assert [r.seq for r in rows] == genomes and [r.genome_id for r in rows] == list(range(30))
    assert rows[3].name == ">genome 3 -  of family 3"
    assert read_fasta(spark, str(folder / "all.fna"), limit=4).count() == 4
    assert metadata["k"] == 29 and metadata["genomes"] == 30


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.fa").write_text(">one\nACGTACGTACGTACGTACGTAC\n>two\nGG GG\nTT\n")
    (tmp_path / "a" / "b" / "y.FASTA").write_text(">y\n" + "ACGU" * 20 + "\n")
    (tmp_path / "a" / "z_protein.faa").write_text(">p\n" + "MKV" * 30 + "\n")
    rows = read_fasta(spark, str(tmp_path / "a"), mode="file").orderBy("genome_id").collect()
    assert [(r.genome_id, r.name, r.seq) for r in rows] == [(0, ">y", "ACGU" * 20)]  # x.fa has 28 bases, one less than a window takes
    (tmp_path / "a" / "w.fa").write_text(">one\nACGTACGTACGTACGTACGTACACGT\n>two\nGG GG\nTT\n")
    rows = read_fasta(spark, str(tmp_path / "a"), mode="file").orderBy("genome_id").collect()
    assert [(r.genome_id, r.name) for r in rows] == [(0, ">y"), (1, ">one")] and rows[1].seq == "ACGTACGTACGTACGTACGTACACGTGGGGTT"
    names = spark.createDataFrame([(n,) for n in ("g/x.fna", "g\\x.FA.GZ", "x.fas.gz", "x_cds_from_genomic.fna", "x.faa", "x_protein.fa", "x.txt")], "path string")
    assert [r[0] for r in names.where(is_genome_file(F.col("path"))).collect()] == ["g/x.fna", "g\\x.FA.GZ", "x.fas.gz"]


def test_ids_need_minimizers(spark, tmp_path):
    """Records of other letters take no id and don't count for the limit."""
    good = "ACGTTGCAACGGTCATTGCAACGGTACCAT"
    (tmp_path / "a.fa").write_text(f">n\n{'N' * 100}\n>a\n{good}\n>mixed\n{(good[:24] + 'N') * 5}\n>b\n{good.lower()}\n>c\n{good}\n")
    rows = read_fasta(spark, str(tmp_path / "a.fa")).orderBy("genome_id").collect()
    assert [(r.genome_id, r.name) for r in rows] == [(0, ">a"), (1, ">b"), (2, ">c")]
    assert [r.name for r in read_fasta(spark, str(tmp_path / "a.fa"), limit=2).orderBy("genome_id").collect()] == [">a", ">b"]
    every = spark.createDataFrame([(0, "N" * 100), (1, good), (2, (good[:24] + "N") * 5)], "genome_id int, seq string")
    assert {r.genome_id for r in minimizers(every).collect()} == {1}


def test_files_by_lines(spark, tmp_path):
    """Files beyond the size that is read whole give the same, whatever their line ends, gzipped or in many splits."""
    rng = random.Random(3)
    reads = [(f"@r{i}", bases(rng, rng.randint(1, 300))) for i in range(2000)]
    text = "".join(f"{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in reads)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.fastq").write_text(text)
    (tmp_path / "q" / "b.fastq").write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "q" / "c.fastq").write_bytes(text.replace("\n", "\r").encode())
    with gzip.open(tmp_path / "q" / "d.fastq.gz", "wt") as f:
        f.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        whole, lines = (sorted(map(tuple, read_fastq(spark, str(tmp_path / "q"), whole_bytes=n).collect())) for n in (None, 0))
        assert whole == lines and len(whole) == 8000 and [r[2:4] for r in sorted(whole)[:2000]] == reads
        (tmp_path / "g.fna").write_text("".join(f">{n}\n{s}\n{s}\n" for n, s in reads))
        whole, lines = (sorted(map(tuple, read_fasta(spark, str(tmp_path / "g.fna"), whole_bytes=n).collect())) for n in (None, 0))
        assert whole == lines and len(whole) > 1500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fastq_parser():
    parse = lambda text: list(parse_fastq(text.split("\n")))
    assert parse("@a\nAC\nGT\n+\nII\nII\n@b\nA\n+\nI") == [("@a", "ACGT", "IIII", None), ("@b", "A", "I", None)]
    assert parse("@a\nACGT\n+\n@II\n@\n@b\nC\n+\nI")[0] == ("@a", "ACGT", "@II@", None)
    assert parse("junk\nmore\n@a\nAC\n+\nII") == [("@a", "AC", "II", "skipped 2 lines")]
    assert parse("@a\nACGT\nCC") == []
    assert parse("@a\nACGT\n+\nII\n@b\nCC\n+\nII") == [("@a", "ACGT", "II", "sequence 4, quality 2"), ("@b", "CC", "II", None)]
    assert parse("@a\nAC\n+\nIIII\n@b\nCC\n+\nII")[0][3] == "sequence 2, quality 4"
    assert parse("") == []


def test_fastq(spark, made):
    folder, _, _, _, reads = made
    got = read_fastq(spark, str(folder / "reads.fastq.gz"))
    assert [(r.read_id, r.seq) for r in got.orderBy("read_ord").collect()] == reads and got.where("parse_warning is not null").count() == 0
    assert read_fastq(spark, str(folder / "reads.fastq.gz"), 0).count() == 0 and read_fastq(spark, str(folder / "reads.fastq.gz"), 5).count() == 5


def test_tree_and_filters(spark, made):
    _, index, metadata, _, _ = made
    _, tables = open_index(spark, index)
    ends = tables["tree"].where("child_node_id is null").select(F.explode("members").alias("g"))
    assert sorted(r.g for r in ends.collect()) == list(range(30))
    assert clustering.tree_paths(tables["tree"]).count() == 30
    assert sorted(int(x) for x in metadata["tree"].replace("(", " ").replace(")", " ").replace(",", " ").split()) == list(range(30))
    mz = spark.read.parquet(f"{index}/genome_minimizers")
    asked = tables["tree"].select("filter_id", F.explode("members").alias("genome_id")).join(mz, "genome_id").select("filter_id", "mz").distinct()
    assert bloom.contains(asked, tables["filters"], tables["filter_segments"]).count() == asked.count()  # no false negatives
    sizes = tables["filter_sizes"].join(tables["filters"], "filter_id").collect()
    assert all(abs(r.n_elements - r.capacity) <= 0.02 * r.capacity + 2 for r in sizes)


def check_rows(rows, reads):
    got = {r["readId"]: r for r in rows}
    assert len(got) == len(reads)
    right = sum(got[n]["genoId"].startswith(f">genome {n.split()[-1]} ") for n, _ in reads[:60])
    family = sum(f"family {int(n.split()[-1]) % 6}" in got[n]["genoId"] for n, _ in reads[:60])
    assert right >= 40 and family >= 57
    assert all(got[n]["genoId"] == "?" for n, _ in reads[60:])
    assert got["@tiny"]["genoMatches|readMinimizers"] == "0.0|0"


def test_classify(spark, made, tmp_path):
    folder, index, _, _, reads = made
    rows, summary = classify(spark, read_fastq(spark, str(folder / "reads.fastq.gz")), index)
    check_rows(rows.collect(), reads)
    genomes = summary.collect()
    assert all(0 < r.coverage <= 100 and r.depth >= 1 for r in genomes) and len(genomes) > 20
    write_csv(rows, summary, str(tmp_path / "out"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "out/reads"))
    assert back.count() == len(reads) and back.columns == ["readId", "genoId", "genoMatches|readMinimizers", "percMatch", "confidenceScore"]
    rows, _ = classify(spark, read_fastq(spark, str(folder / "reads.fastq.gz")), index, threshold=1000)
    assert rows.where("genoId <> '?'").count() == 0
    _, sketched = classify(spark, read_fastq(spark, str(folder / "reads.fastq.gz")), index, lg=30)
    exact = {r.genome_id: r.n_distinct for r in genomes}
    assert all(abs(r.n_distinct - exact[r.genome_id]) <= 0.05 * exact[r.genome_id] + 1 for r in sketched.collect())


def twins(made):
    """Two mates under one name, cut from genomes of different families, and a read that is there twice."""
    _, _, _, genomes, _ = made
    return [("@a", genomes[0][100:500]), ("@a", genomes[5][900:1300]), ("@b", genomes[7][50:450]), ("@b", genomes[7][50:450]), ("@tiny", "ACGT"), ("@tiny", "ACGT")]


def check_twins(rows):
    got = sorted((r["readId"], r["genoId"], r["genoMatches|readMinimizers"]) for r in rows)
    assert [g[0] for g in got] == ["@a", "@a", "@b", "@b", "@tiny", "@tiny"]
    assert "family 0" in got[0][1] and "family 5" in got[1][1] and "family 1" in got[2][1]
    assert got[2] == got[3] and got[4][1:] == ("?", "0.0|0")
    assert all(float(g[2].split("|")[1]) < 200 for g in got)  # no read has the other's minimizers


def test_reads_of_one_name(spark, made, tmp_path):
    _, index, _, _, _ = made
    alone = [classify(spark, spark.createDataFrame([r], "read_id string, seq string"), index)[0].collect()[0] for r in twins(made)]
    rows, summary = classify(spark, spark.createDataFrame(twins(made), "read_id string, seq string"), index)
    got = rows.collect()
    check_twins(got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, alone))
    family = {int(r.name.split("family ")[1]): r for r in summary.collect()}
    assert family[1].depth == 2.0 and family[0].depth == family[5].depth == 1.0
    arriving = tmp_path / "in"
    arriving.mkdir()
    (arriving / "reads.fastq").write_text("".join(f"{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in twins(made)))
    classify_arriving(spark, str(arriving), index, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    check_twins(spark.read.parquet(str(tmp_path / "out/reads")).collect())


def test_filters_by_rows_or_packed(spark, made, monkeypatch):
    """Filters too large to be packed are asked probe by probe, with equal answers; so are those that aren't broadcast."""
    _, index, _, genomes, _ = made
    _, tables = open_index(spark, index)
    rng = random.Random(1)
    values = [(i % 12, rng.randrange(1 << 50)) for i in range(3000)]
    mz = spark.read.parquet(f"{index}/genome_minimizers").limit(500).select((F.col("mz") % 12).cast("int").alias("filter_id"), "mz")
    asked = spark.createDataFrame(values, "filter_id int, mz long").union(mz).distinct()
    loose = bloom.filter_table(spark, tables["filters"].select("filter_id", "capacity"), 0.2)  # many false answers
    own = tables["tree"].select("filter_id", F.explode("members").alias("genome_id")).join(spark.read.parquet(f"{index}/genome_minimizers"), "genome_id").select("filter_id", "mz").distinct()
    words = bloom.insert(own, loose).persist()
    probed = bloom.probes(own, loose).select("filter_id", "shard", F.shiftright("bit", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int")).alias("v"))
    want = {(r[0], r[1], r[2]): r[3] for r in probed.groupBy("filter_id", "shard", "word").agg(F.bit_or("v")).collect()}
    assert {(r[0], r[1], r[2]): r[3] for r in words.collect()} == want
    answers = [sorted(map(tuple, bloom.contains(asked, loose, words, packed_bits=n).collect())) for n in (1 << 25, 0)]
    monkeypatch.setattr(bloom, "UNIT", 100)  # ranges of elements are groups of their own, and shards are sent to each
    answers.append(sorted(map(tuple, bloom.contains(asked, loose, bloom.segments_of(words), packed_bits=0).collect())))
    assert answers[0] == answers[1] == answers[2] and 500 < len(answers[0]) < asked.count()


@pytest.mark.parametrize("held", [50, 1 << 20])
def test_segments_by_force(monkeypatch, held):
    """Bits of filters of several sizes, gathered in turns, in sparse and dense segments, against sets of bits."""
    import pyarrow as pa

    monkeypatch.setattr(bloom, "SEGMENT_BITS", 128)
    monkeypatch.setattr(bloom, "HELD", held)
    rng = np.random.default_rng(3)
    known = {3: (1, 101, 3), 1: (4, 5003, 7), 9: (2, 1_000_003, 2)}
    rows = [(f, int(m)) for f in known for m in rng.integers(0, 1 << 50, 300)]
    rng.shuffle(rows)
    want, batches = {}, []
    for at in range(0, len(rows), 70):
        part = [tuple(map(int, r)) for r in rows[at : at + 70]]
        own = [known[f] for f, _ in part]
        batches.append(pa.RecordBatch.from_pydict({"mz": [m for _, m in part], "filter_id": pa.array([f for f, _ in part], pa.int32()), "shards": [o[0] for o in own], "bits": [o[1] for o in own], "hashes": pa.array([o[2] for o in own], pa.int32())}))
        for (f, m), (shards, bits, hashes) in zip(part, own):
            shard, first, step = (int(x[0]) for x in bloom.places(np.array([m]), shards, bits))
            want.setdefault((f, shard), set()).update((first + k * step) % bits for k in range(hashes))
    parts = sorted((r for b in bloom._gather(iter(batches)) for r in b.to_pylist()), key=lambda r: (r["filter_id"], r["shard"], r["segment"]))
    assert {r["dense"] for r in parts} == {True, False} and all(len(r["data"]) <= r["n_words"] * 8 for r in parts)
    if held > 50:
        assert len({(r["filter_id"], r["shard"], r["segment"]) for r in parts}) == len(parts)
    got = {}
    kinds = {"filter_id": pa.int32(), "shard": pa.int32(), "segment": pa.int64(), "n_words": pa.int32(), "dense": pa.bool_(), "data": pa.binary()}
    for batch in bloom._merge(iter([pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in parts[a : a + 9]], k) for c, k in kinds.items()}) for a in range(0, len(parts), 9)])):
        for r in batch.to_pylist():
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(r["words"], np.uint8), bitorder="little"))
            assert len(bits) == r["set_bits"]
            got.setdefault((r["filter_id"], r["shard"]), set()).update((bits + r["segment"] * 128).tolist())
    assert got == want


def test_size_of_a_filter_costs_nothing(spark):
    """What few elements put into a large filter is as little as in a small one, and is found there in streams."""
    own = spark.range(3000).select(F.lit(1).cast("int").alias("filter_id"), F.shiftrightunsigned(F.xxhash64("id"), 14).alias("mz"))
    sizes = {}
    for capacity in (100_000, 400_000_000):
        filters = bloom.filter_table(spark, spark.createDataFrame([(1, capacity)], "filter_id int, capacity long"), 1e-3)
        parts = own.join(filters, "filter_id").select("filter_id", "mz", "shards", "bits", "hashes").mapInArrow(bloom._gather, "filter_id int, shard int, segment long, n_words int, dense boolean, data binary")
        sizes[capacity] = parts.agg(F.sum(F.octet_length("data") + 40)).first()[0]
    assert all(n < 100 * 3000 for n in sizes.values()), sizes
    segments = bloom.insert_segments(own, filters).select("*").limit(0)
    assert bloom.contains(own, filters, segments).count() == 0


def test_sharded_filters(spark):
    """Filters of several shards hold what was put in, and little else."""
    filters = spark.createDataFrame([(0, 4000, 4, 24_001, 17), (1, 1000, 1, 24_001, 17)], bloom.FILTERS)
    own = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(1).cast("int").alias("filter_id"), F.shiftrightunsigned(F.xxhash64("id"), 14).alias("mz"))
    words = bloom.insert(own, filters)
    assert {r.shard for r in words.where("filter_id = 0").select("shard").distinct().collect()} == {0, 1, 2, 3}
    both = own.select("mz").crossJoin(filters.select("filter_id"))
    for n in (1 << 25, 0):
        found = bloom.contains(both, filters, words, packed_bits=n)
        assert found.join(own, ["filter_id", "mz"]).count() == 5000 and found.count() < 5005


def test_second_sketch_and_capacity(spark, made, tmp_path):
    folder, _, metadata, genomes, _ = made
    assert set(metadata["seconds"]) == {"minimizers", "sketches", "similarities", "tree", "capacities", "filters"}
    mz = spark.createDataFrame([(g, 1_000_003 * v) for g, values in ((0, range(3000)), (1, range(1000, 4000)), (2, range(9000, 9500)), (3, range(3000)), (4, range(5))) for v in values], "genome_id int, mz long")
    held = {r.genome_id: np.frombuffer(r.signature, np.uint8) for r in sim.signatures(mz).collect()}
    jaccard = lambda a, b: sim.signature_jaccard(float((held[a] == held[b]).mean()))
    assert jaccard(0, 3) == 1 and abs(jaccard(0, 1) - 0.5) < 0.06 and jaccard(0, 2) < 0.02 and all(len(x) == sim.SIGNATURE for x in held.values())
    # genomes that share nothing in their samples are placed by the second sketch
    zero, weak = lambda a, b: 0.6 if a // 12 == b // 12 and a % 12 < 11 and b % 12 < 11 else 0.0, lambda a, b: 0.4 if a // 12 == b // 12 else 0.0
    similar = clustering.Similarities(zero, None, weak)
    similar.register((a, b) for a in range(36) for b in range(a))
    positives, zeros = similar.calibration(set(range(36)))
    pairs, uncertain = 36 * 35 // 2, len(similar.uncertain)
    assert uncertain == 3 * 11 and len(positives) == 3 * 55 and zeros == pairs - uncertain - len(positives)
    parts = similar.divided([list(range(12)), list(range(12, 36))])
    assert [len(p.known) for p in parts] == [66, 276] and [len(p.uncertain) for p in parts] == [11, 22] and parts[1].calibration(set(range(12, 36)))[1] == 276 - 22 - 110
    classes = sim.pair_classes(spark.createDataFrame([(0, 1, 5, 0.0), (0, 2, 0, 0.3), (1, 2, 0, 0.0)], "a long, b long, shared long, weak double"))
    assert {(r.a, r.b): r["class"] for r in classes.collect()} == {(0, 1): 2, (0, 2): 3, (1, 2): 1}
    registry = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (1, 3)], "a long, b long")
    assert sim.calibration_counts(classes, None, registry).first().asDict() == {"zero": 1, "positive": 1, "pairs": 4, "uncertain": 1, "missing": 1}
    # clusters beyond a filter's capacity become siblings
    assert clustering.within_capacity({i: 40 for i in range(7)}, 100)(list(range(7))) == [[0, 1], [2, 3], [4, 5], [6]]
    assert clustering.within_capacity({0: 500, 1: 10}, 100)([0, 1]) == [[0], [1]]
    few = build_index(spark, read_fasta(spark, str(folder / "all.fna")), str(tmp_path / "small"), max_filter=3500)
    _, tables = open_index(spark, str(tmp_path / "small"))
    largest = tables["filters"].join(tables["tree"].where("size(members) > 1"), "filter_id").agg(F.max("capacity")).first()[0]
    assert few["genomes"] == 30 and (largest is None or largest <= 3500)
    ends = tables["tree"].where("child_node_id is null").select(F.explode("members").alias("g"))
    assert sorted(r.g for r in ends.collect()) == list(range(30))
    exact = {r[0]: r[1] for r in clustering.union_cardinalities(spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "filter_id int, genome_id int"), mz, ["filter_id"], sketch=True).collect()}
    assert abs(exact[0] - 4000) < 150 and exact[1] == 500


def test_counter_sizes(spark):
    assert [classification.coerced_lg(n) for n in (3, 9, 10, 21, 31, 32)] == [12, 12, 10, 21, 31, 12]


def test_streaming(spark, made, tmp_path):
    folder, index, _, _, reads = made
    arriving = tmp_path / "in"
    arriving.mkdir()
    (arriving / "reads.fastq.gz").write_bytes((folder / "reads.fastq.gz").read_bytes())
    classify_arriving(spark, str(arriving), index, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    check_rows(spark.read.parquet(str(tmp_path / "out/reads")).collect(), reads)


@pytest.mark.parametrize("lg", [None, 14])
def test_streamed_totals(spark, made, tmp_path, lg):
    """Totals over three batches, the last of them run again, are those of one batch with all reads."""
    folder, index, _, _, _ = made
    lines = gzip.open(folder / "reads.fastq.gz", "rt").read().split("\n@")
    records = [lines[0], *["@" + x for x in lines[1:]]]
    arriving = tmp_path / "in"
    arriving.mkdir()
    run = lambda name: classify_arriving(spark, str(arriving), index, str(tmp_path / name), str(tmp_path / f"{name}-marks"), lg=lg, files=1 if name == "many" else 100).awaitTermination()
    rows = lambda name: sorted(map(tuple, genome_totals(spark, str(tmp_path / name), index, lg).collect()))
    assert genome_totals(spark, str(tmp_path / "many"), index, lg) is None
    for k in range(3):
        (arriving / f"{k}.fastq").write_text("\n".join(records[k::3]) + "\n")
        run("many")
    want = rows("many")
    (tmp_path / "many-marks/commits/2").unlink()
    (tmp_path / "many-marks/commits/.2.crc").unlink(missing_ok=True)
    run("many")
    assert rows("many") == want
    run("once")
    assert rows("once") == want and len(want) > 20


def test_refusals(spark, made, tmp_path):
    folder, index, _, genomes, _ = made
    with pytest.raises(ValueError, match="10 genomes"):
        build_index(spark, read_fasta(spark, str(folder / "all.fna"), limit=9), str(tmp_path / "few"))
    with pytest.raises(ValueError, match="no complete index"):
        open_index(spark, str(tmp_path / "few"))
    with pytest.raises(ValueError, match="genome 1 is there 2 times"):
        build_index(spark, spark.createDataFrame([(i % 11, "x", genomes[0]) for i in range(1, 13)], "genome_id int, name string, seq string"), str(tmp_path / "twice"))
    _, index, metadata, _, _ = made
    for change, match in (({"complete": False}, "isn't complete"), ({"window": "other"}, "has window 'other'"), ({"k": "29"}, "no valid k and step"), ({"step": 29}, "no valid k and step"), ({"step": 0}, "no valid k and step")):
        path = tmp_path / f"changed{len(list(tmp_path.iterdir()))}"
        (path / "metadata").mkdir(parents=True)
        (path / "metadata" / "part.txt").write_text(json.dumps(metadata | change))
        with pytest.raises(ValueError, match=match):
            open_index(spark, str(path))


def test_divided(spark):
    mz = spark.createDataFrame([(g, v) for g, n in ((0, 1000), (1, 50), (2, 400)) for v in range(n)], "genome_id int, mz long")
    genomes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "genome_id int, name string")
    new, named = divided(mz, genomes, 300)
    sizes = {r[0]: r[1] for r in new.groupBy("genome_id").count().collect()}
    names = {r.genome_id: r.name for r in named.collect()}
    assert sum(sizes.values()) == 1450 and sizes[1] == 50 and set(sizes) == set(names) == set(range(7)) - ({6} if len(sizes) == 6 else set())
    assert [names[g] for g in (0, 1, 2)] == ["a", "b", "c"] and new.join(named.where("name = 'a'"), "genome_id").count() == 1000
    assert divided(mz, genomes)[0] is mz
