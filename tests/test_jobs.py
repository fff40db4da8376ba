"""The jobs: against SQL, over growing input, when run again, and after a batch that broke off."""

import os
import random
import subprocess
import sys

import pytest
from compare import compare

from jobs import arriving_reads, reference_catalog
from jobs.common import settings_of
from jobs.queries import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
TABLE = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name], SMALL) > 0


def bases(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("acgt") for _ in range(n))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def write(spark, rows, path, schema=TABLE):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_catalog_cases(spark, tmp_path):
    """Copies, shared ids, missing ids, short and null texts; a run over changed input replaces all."""
    a, b = bases(200, 1), bases(300, 2)
    rows = [(1, a, "s1"), (2, a, "s2"), (3, a + b, "s2"), (4, None, None), (5, "acgt", ""), (6, b, "s1"), (6, a, "s0"), (None, b, "s1"), (7, a, "s1")]
    write(spark, rows, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    bases_ = settings_of("reference_catalog") | {"alphabet": "bases"}
    said = reference_catalog.run(spark, str(tmp_path / "in"), out, bases_)
    assert said == {"read": 9, "catalog": 7, "sources": 4}
    got = {r.genome_id: r for r in reference_catalog.output_of(spark, out).where("genome_id is not null").collect()}
    assert {i: (r.source, r.n_bases, r.representative, r.n_copies) for i, r in got.items()} == {1: ("s1", 200, 1, 3), 2: ("s2", 200, 1, 3), 7: ("s1", 200, 1, 3), 3: ("s2", 500, 3, 1), 4: ("unknown", 0, 4, 1), 5: ("unknown", 4, 5, 1), 6: ("s0", 500, 6, 1)}
    assert got[1].n_own == 0 and 0 < got[3].n_own < got[3].n_minimizers and got[6].n_own == 0 and got[4].n_minimizers == 0
    first = rows_of(reference_catalog.output_of(spark, out))
    reference_catalog.run(spark, str(tmp_path / "in"), out, bases_)
    assert rows_of(reference_catalog.output_of(spark, out)) == first
    write(spark, [(8, bases(99, 3), "s9")], str(tmp_path / "other"))
    assert reference_catalog.run(spark, str(tmp_path / "other"), out) == {"read": 1, "catalog": 1, "sources": 1}
    assert [r.source for r in reference_catalog.output_of(spark, out).collect()] == ["s9", "s9"]


def test_catalog_of_nothing(spark, tmp_path):
    write(spark, [], str(tmp_path / "in"))
    assert reference_catalog.run(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"read": 0, "catalog": 0, "sources": 0}


@pytest.fixture
def panel(spark, tmp_path):
    genomes = {i: bases(2000, i) for i in range(5)}
    spark.createDataFrame([(i, s) for i, s in genomes.items()] + [(None, "acgt" * 50), (9, None)], "item_id long, text string").write.parquet(str(tmp_path / "panel"))
    return genomes


def arriving(genomes, number):
    """Sequences with pieces of the panel's genomes, the same ones in several batches."""
    rng = random.Random(number)
    rows = []
    for i in range(12):
        g = genomes[rng.randrange(5)]
        at = rng.randrange(1000)
        rows.append((number * 100 + i, bases(40, i) + g[at : at + rng.randrange(100, 900)], f"s{i % 3}" if i else None))
    return [*rows, (None, genomes[0], "s1"), (number * 100 + 50, None, "s1"), (number * 100 + 51, "acgt", ""), (7, genomes[1], "s1")]


def screen(spark, tmp_path, name, source="arriving", **settings):
    paths = {"arriving": str(tmp_path / source), "reference": str(tmp_path / "panel"), "output": str(tmp_path / f"out-{name}"), "checkpoint": str(tmp_path / f"marks-{name}")}
    return arriving_reads.run(spark, **paths, settings=settings_of("arriving_reads") | {"alphabet": "bases"} | settings), rows_of(arriving_reads.output_of(spark, paths["output"]))


def test_growing_input_equals_one_run(spark, tmp_path, panel):
    for number in range(2):
        write(spark, arriving(panel, number), str(tmp_path / "arriving"))
    said, first = screen(spark, tmp_path, "grown", files=1)
    assert said["batches"] == 2 and said["summary"] == 5
    assert screen(spark, tmp_path, "grown", files=1) == (said | {"batches": 0}, first)  # nothing new
    for number in range(2, 5):
        write(spark, arriving(panel, number), str(tmp_path / "arriving"))
    said, grown = screen(spark, tmp_path, "grown", files=2)
    assert said["batches"] == 2 and len(grown) > len(first)
    said, whole = screen(spark, tmp_path, "whole")
    assert said["batches"] == 1 and whole == grown
    assert sum(r[2] is not None and r[1] is not None for r in whole) > 60


@pytest.mark.parametrize("broken", [0, 1, 2])
def test_a_batch_that_broke_off_counts_once(spark, tmp_path, panel, broken):
    """The last batch ended without its commit (and without a half of what it had written): it is run again."""
    for number in range(broken + 1):
        write(spark, arriving(panel, number), str(tmp_path / "arriving"))
        want = screen(spark, tmp_path, "broken", files=1)[1]
    commits = tmp_path / "marks-broken" / "commits"
    for name in (f"{broken}", f".{broken}.crc"):
        (commits / name).unlink(missing_ok=True)
    said, got = screen(spark, tmp_path, "broken", files=1)
    assert said["batches"] == 1 and got == want


def test_a_later_panel_changes_nothing(spark, tmp_path, panel):
    write(spark, arriving(panel, 0), str(tmp_path / "arriving"))
    screen(spark, tmp_path, "x")
    write(spark, [(77, bases(500, 77))], str(tmp_path / "panel"), "item_id long, text string")
    write(spark, arriving(panel, 1), str(tmp_path / "arriving"))
    _, rows = screen(spark, tmp_path, "x")
    assert not any(r[2] == 77 for r in rows)


def test_nothing_arrived(spark, tmp_path, panel):
    (tmp_path / "arriving").mkdir()
    paths = {"arriving": str(tmp_path / "arriving"), "reference": str(tmp_path / "panel"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "marks")}
    assert arriving_reads.run(spark, **paths) == {"batches": 0, "reads": 0, "summary": 0}


def test_command_lines(tmp_path, spark, panel):
    write(spark, arriving(panel, 0), str(tmp_path / "arriving"))
    (tmp_path / "own.toml").write_text("k = 27\n")
    base = [sys.executable, "-m"]
    env = os.environ | {"PYTHONPATH": ROOT}
    calls = [
        ["jobs.reference_catalog", "--input", str(tmp_path / "arriving"), "--output", str(tmp_path / "catalog"), "--config", str(tmp_path / "own.toml")],
        ["jobs.arriving_reads", "--arriving", str(tmp_path / "arriving"), "--reference", str(tmp_path / "panel"), "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "marks")],
    ]
    for call in calls:
        done = subprocess.run(base + call, cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "rows: " in done.stderr
    assert reference_catalog.output_of(spark, str(tmp_path / "catalog")).count() > 10
    assert arriving_reads.output_of(spark, str(tmp_path / "out")).count() > 10


@pytest.mark.parametrize("parts,most,members,counted", [(256, 1 << 22, 1 << 12, 1 << 22), (2, 100, 3, 1)])
def test_catalog_shuffles_packed_parts(spark, parts, most, members, counted):
    """Rows of minimizers were shuffled three times; now none stands for a minimizer, and sources and genomes meet in any chunks."""
    rng = random.Random(parts)
    sets = [(i * 3 + i // 9, f"s{rng.randrange(4)}", sorted({rng.randrange(300) for _ in range(rng.randrange(12))})) for i in range(80)]
    df = spark.createDataFrame(sets, "row long, source string, mz array<long>").repartitionByRange(3, "row").sortWithinPartitions("row")
    packed = reference_catalog.in_parts(df, parts, most, members)
    assert packed.count() <= parts * len(sets)
    out = reference_catalog.held_by(packed, counted).groupBy("row", "source").sum("n_minimizers", "n_own").collect()
    holders = {}
    for row, source, mz in sets:
        for x in mz:
            holders.setdefault(x, []).append((row, source))
    own, of_source = {}, {}
    for held in holders.values():
        for source in {s for _, s in held}:
            n = of_source.setdefault(source, [0, 0])
            n[0], n[1] = n[0] + 1, n[1] + (len({s for _, s in held}) == 1)
        if len(held) == 1:
            own[held[0][0]] = own.get(held[0][0], 0) + 1
    assert {r[0]: r[3] for r in out if r[0] is not None} == own
    assert {r[1]: [r[2], r[3]] for r in out if r[0] is None} == of_source
