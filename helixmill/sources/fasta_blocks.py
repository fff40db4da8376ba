"""Minimizers of FASTA files without a string of a genome: lines are read in ranges, and ranges are cut into short pieces.

The k - 1 bases of a window may lie in two ranges, or in more where ranges are short. So a piece carries the k - 2 bases that
follow it: within a range they are at hand; at its end they come from the heads of the ranges behind it, of which each range
gives one row. The sets of pieces are then one set by genome. A task holds a piece at a time, and no window is made over bases.

Limits: a line is one string, so it ends at 2 GB. A gzipped file can't be split: one task reads it, in pieces too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixmill.functions.lineage import cut
from helixmill.functions.parameters import kmer_parameters
from helixmill.functions.sequences import clean_sequence, genome_name
from helixmill.operators.minimizers import BATCH_MINIMIZERS, INVALID, PIECE_BASES, canonical_mmers, window_minima
from helixmill.sources.fasta import by_size, is_genome_file, numbered_genomes
from helixmill.sources.fastq_ranges import RANGE_LINES, range_lines

#: Bases whose minimizers one task makes distinct, about.
TASK_BASES = 1 << 22
PIECES = "path string, block long, local long, header string, own long, need int, seq string, head string, closed boolean, headers long, whole boolean"


class _Range:
    """Cuts one range's lines into rows of PIECES.

    local is how many headers of the range stand before a row; need is how many bases are to come from the ranges behind. The
    last row has the range's head: its first bases that follow on what is before it, and whether a header ends them. whole: the
    row has all of its sequence, between two headers of the range.
    """

    def __init__(self, path: str, block: int, k: int, joined: bool, piece: int):
        self.key, self.halo, self.joined, self.piece = (path, block), k - 2, joined, piece
        self.headers, self.head, self.closed = 0, "", False
        self.parts: list[str] = []
        self.held = 0
        self.waiting: str | None = None  # what stood before the first header, where contigs are joined: its halo is behind it
        self.rows: list[tuple] = []
        self.alone = False  # nothing is given out of the sequence that the last header began

    def _row(self, local: int, header: str | None, seq: str, own: int, need: int, whole: bool = False) -> None:
        self.rows.append((*self.key, local, header, own, need, seq, None, None, None, whole))

    def _take(self) -> str:
        out = "".join(self.parts)
        self.parts, self.held = [], 0
        return out

    def add(self, line: str) -> None:
        if len(self.head) < self.halo and not self.closed:
            self.head += line[: self.halo - len(self.head)]
        self.parts.append(line)
        self.held += len(line)
        if self.waiting is not None and self.held >= self.halo:
            text = self._take()
            self._row(0, None, self.waiting + text[: self.halo], len(self.waiting), 0)
            self.waiting, self.parts, self.held = None, [text], len(text)
        if self.held >= 2 * self.piece + self.halo:
            text, at, self.alone = self._take(), 0, False
            while len(text) - at >= self.piece + self.halo:
                self._row(self.headers, None, text[at : at + self.piece + self.halo], self.piece, 0)
                at += self.piece
            self.parts, self.held = [text[at:]], len(text) - at

    def header(self, line: str) -> None:
        if not self.joined:
            self._flush(0, self.alone)
            self.closed = self.alone = True
        elif self.headers == 0 and self.held:
            self.waiting = self._take()
        self.headers += 1
        self._row(self.headers, line, "", 0, 0)

    def _flush(self, need: int, whole: bool = False) -> None:
        text = self._take()
        if self.waiting is not None:
            self._row(0, None, self.waiting + text, len(self.waiting), max(0, self.halo - len(text)))
            self.waiting = None
        if text:
            self._row(self.headers, None, text, len(text), need, whole)

    def end(self) -> None:
        self._flush(self.halo)
        self.rows.append((*self.key, 0, None, 0, 0, "", self.head, self.closed, self.headers, False))


def pieces_of(lines: DataFrame, k: int, joined: bool = False, piece: int = PIECE_BASES) -> DataFrame:
    """Rows of PIECES of a table (path, block, line_no, line) of ranges, as the reader of ranges gives it; joined: headers don't end a sequence."""
    names = [f.split(" ")[0] for f in PIECES.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, types[f.split(" ")[1]]) for c, f in zip(columns, PIECES.split(", "))], names=names)

    def run(batches):
        now: _Range | None = None
        for batch in batches:
            for path, block, line in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "line"))):
                if now is None or now.key != (path, block):
                    if now is not None:
                        now.end()
                        yield batch_of(now.rows)
                    now = _Range(path, block, k, joined, piece)
                if line.startswith(">"):
                    now.header(line)
                else:
                    now.add(line)
            if now is not None and now.rows:
                yield batch_of(now.rows)
                now.rows = []
        if now is not None:
            now.end()
            yield batch_of(now.rows)

    line = F.when(F.col("line").startswith(">"), F.col("line")).otherwise(clean_sequence(F.col("line")))
    return lines.select("path", "block", line.alias("line")).mapInArrow(run, PIECES)


def range_facts(pieces: DataFrame, k: int, joined: bool = False) -> DataFrame:
    """What each range has to know of the others, a row for each: (path, block, number, before, owner, owned, behind).

    before: headers in the file's ranges before it; (owner, owned): the key of the genome that its first bases go on with, by the
    range of its header and the place there; behind: the bases that follow the range, up to k - 2.
    """
    ranges = pieces.where("head is not null").select("path", "block", "head", "closed", "headers", F.monotonically_increasing_id().alias("number"))
    order = Window.partitionBy("path").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # ranges that neither go on nor end anything are passed over, so each of the next k - 2 others has a base at least or ends the sequence
    told = F.col("closed") | (F.col("head") != "")
    begun = F.when(F.col("headers") > 0, F.struct("number", F.lit(1).cast("long").alias("local") if joined else F.col("headers").alias("local")))
    owner = F.first(begun, ignorenulls=True) if joined else F.last(begun, ignorenulls=True)
    turned = ranges.select(
        "path", "block", "number", "headers", F.when(told, F.struct("head", "closed")).alias("next"), F.count_if(told).over(order).alias("turn"),
        F.coalesce(F.sum("headers").over(earlier), F.lit(0).cast("long")).alias("before"), owner.over(earlier).alias("begun"),
    )
    ahead = F.collect_list("next").over(Window.partitionBy("path").orderBy("turn").rangeBetween(1, max(1, k - 2)))
    behind = F.aggregate(
        "ahead",
        F.struct(F.lit("").alias("text"), F.lit(False).alias("closed")),
        lambda acc, x: F.when(acc["closed"], acc).otherwise(F.struct(F.concat(acc["text"], x["head"]).alias("text"), x["closed"].alias("closed"))),
        lambda acc: acc["text"],
    )
    return turned.withColumn("ahead", ahead).select("path", "block", "number", "before", F.col("begun.number").alias("owner"), F.col("begun.local").alias("owned"), behind.alias("behind"))


def with_halos(pieces: DataFrame, facts: DataFrame, joined: bool = False) -> DataFrame:
    """(owner, local, path, record, header, own, seq, whole) of pieces: (owner, local) is a genome's key, record counts a file's headers (1 for all where contigs are joined), seq has the bases behind it.

    Text before a file's first header is skipped.
    """
    known = pieces.where("head is null").join(facts, ["path", "block"]).withColumn("record", F.col("before") + F.col("local")).where("record > 0")
    goes_on = (F.col("before") > 0) if joined else F.col("local") == 0
    one = F.lit(1).cast("long")
    seq = F.when(F.col("need") > 0, F.concat("seq", F.expr("substring(behind, 1, need)"))).otherwise(F.col("seq"))
    return known.select(
        F.when(goes_on, F.col("owner")).otherwise(F.col("number")).alias("owner"),
        F.when(goes_on, F.col("owned")).otherwise(one if joined else F.col("local")).alias("local"),
        "path", (one if joined else F.col("record")).alias("record"), (F.when(F.col("record") == 1, F.col("header")) if joined else F.col("header")).alias("header"), "own", seq.alias("seq"), "whole",
    )


def piece_minimizers(pieces: DataFrame, k: int) -> DataFrame:
    """(owner, local, mz) of pieces with halos: those of all windows that begin in a piece."""
    k, step, m = kmer_parameters(k)

    def run(batches):
        for batch in batches:
            at, sets, held = [], [], 0

            def made():
                rows = pa.array(np.repeat(np.array(at, np.int64), [len(x) for x in sets]))
                return pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in ("owner", "local")] + [pa.array(np.concatenate(sets))], names=["owner", "local", "mz"])

            for i, text in enumerate(batch.column("seq")):
                found = np.unique(window_minima(canonical_mmers(np.frombuffer(text.as_py().encode("ascii", "replace"), np.uint8), m), step))
                at.append(i)
                sets.append(found[:-1] if len(found) and found[-1] == INVALID else found)
                held += len(sets[-1])
                if held >= BATCH_MINIMIZERS:
                    yield made()
                    at, sets, held = [], [], 0
            if sets:
                yield made()

    return pieces.select("owner", "local", "seq").where(F.length("seq") >= k - 1).mapInArrow(run, "owner long, local long, mz long")


def genome_sets(lines: DataFrame, k: int = 29, joined: bool = False, piece: int = PIECE_BASES, keep: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, DataFrame]:
    """(owner, local, path, record, header, n_bases) of all genomes, and (owner, local, mz) of their sets, from ranges of lines.

    A genome's key is two numbers, so no path stands beside each minimizer; only sets that are made from several pieces are
    shuffled. A genome of fewer than k bases has no minimizers.
    """
    k, _, _ = kmer_parameters(k)
    kept = keep(pieces_of(lines, k, joined, piece))
    pieces = with_halos(kept, keep(range_facts(kept, k, joined)), joined)
    genomes = keep(pieces.groupBy("owner", "local").agg(F.max("path").alias("path"), F.max("record").alias("record"), F.max("header").alias("header"), F.sum("own").alias("n_bases")))
    short = genomes.where(F.col("n_bases") == k - 1).select("owner", "local")  # a window has k - 1 bases; shorter ones have none
    done = piece_minimizers(pieces.where(F.col("whole") & (F.length("seq") >= k)), k)
    # as many tasks as the bases need, whatever the session's number, so what one sorts out is bounded
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(genomes.agg(F.sum("n_bases")).first()[0] or 0) // TASK_BASES))
    parts = piece_minimizers(pieces.where(~F.col("whole")), k).join(short, ["owner", "local"], "left_anti").repartition(tasks, "owner", "local", "mz").distinct()
    return genomes, done.unionByName(parts)


def read_fasta_sets(spark: SparkSession, path: str, mode: str = "record", limit: int | None = None, k: int = 29, range_size: int = RANGE_LINES, piece: int = PIECE_BASES) -> tuple[DataFrame, DataFrame]:
    """(genome_id, name) and (genome_id, mz) of FASTA files of any size, with the ids that reading them as whole sequences would give."""
    if mode not in ("record", "file"):
        raise ValueError(f"unknown mode {mode!r}")
    files = by_size(spark, path, -1)[1]
    if not files:
        return spark.createDataFrame([], "genome_id int, name string"), spark.createDataFrame([], "genome_id int, mz long")
    lines = range_lines(spark, files, range_size)
    genomes, sets = genome_sets(lines.where(is_genome_file(F.col("path"))) if mode == "file" else lines, k, mode == "file", piece)
    sets = cut(sets)
    some = genomes.join(sets.select("owner", "local").distinct(), ["owner", "local"], "left_semi")
    # the key travels in the place of the sequence
    listed = cut(numbered_genomes(some.withColumn("seq", F.struct("owner", "local")), ["path", "record"], limit))
    keys = listed.select("genome_id", "seq.owner", "seq.local")
    return listed.select("genome_id", "name"), sets.join(keys, ["owner", "local"]).select("genome_id", "mz")
