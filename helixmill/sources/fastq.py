"""FASTQ as a DataFrame of reads, leniently: stray lines are skipped, wrapped sequences and qualities are joined."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from helixmill.sources.fasta import by_size, streamed_lines, whole_files

#: A line of nothing but letters of sequences.
SEQUENCE_LINE = r"^[ACGTURYSWKMBDHVNacgturyswkmbdhvn.*-]+$"
_sequence_line = re.compile(SEQUENCE_LINE)
LOOK_AHEAD = 100_000
#: Bases of the reads that are passed on together, about.
BATCH_BASES = 1 << 24

READS = "path string, read_ord long, read_id string, seq string, qual string, parse_warning string"


class Lines:
    """Lines with some of the coming ones seen already."""

    def __init__(self, lines: Iterable[str]):
        self.rest, self.seen = iter(lines), deque()

    def take(self) -> str | None:
        return self.seen.popleft() if self.seen else next(self.rest, None)

    def coming(self) -> Iterator[str]:
        """The coming lines, which stay to be taken."""
        i = 0
        while True:
            if i == len(self.seen):
                line = next(self.rest, None)
                if line is None:
                    return
                self.seen.append(line)
            yield self.seen[i]
            i += 1

    def record_follows(self) -> bool:
        """Whether sequence lines and then a separator come next."""
        some = False
        for i, line in enumerate(self.coming()):
            if i == LOOK_AHEAD:
                return False
            if line.startswith("+"):
                return some
            if not _sequence_line.match(line):
                return False
            some = True
        return False


def parse_fastq(lines: Iterable[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """(header, sequence, quality, warning) of each read."""
    source = Lines(lines)
    line = source.take()
    while line is not None:
        skipped = 0
        while line is not None and not line.startswith("@"):
            line, skipped = source.take(), skipped + 1
        if line is None:
            return
        header, parts = line, []
        while (line := source.take()) is not None and not line.startswith("+"):
            parts.append(line.strip())
        if line is None:
            return  # no separator: the file ends within a record
        sequence, quality, line = "".join(parts), "", None
        while len(quality) < len(sequence):
            more = source.take()
            if more is None:
                break
            if more.startswith("@") and source.record_follows():
                line = more
                break
            quality += more
        warnings = ([f"skipped {skipped} lines"] if skipped else []) + ([f"sequence {len(sequence)}, quality {len(quality)}"] if len(quality) != len(sequence) else [])
        yield header, sequence, quality, "; ".join(warnings) or None
        line = source.take() if line is None else line


def _batch(path: str, first: int, reads: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*((path, first + i, *r) for i, r in enumerate(reads))))
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "read_ord", "read_id", "seq", "qual", "parse_warning"])


def _batches(path: str, lines: Iterable[str]) -> Iterator[pa.RecordBatch]:
    held, first, size = [], 0, 0
    for read in parse_fastq(lines):
        held.append(read)
        size += len(read[1])
        if len(held) == 10_000 or size > BATCH_BASES:
            yield _batch(path, first, held)
            held, first, size = [], first + len(held), 0
    if held:
        yield _batch(path, first, held)


def reads_of(files: DataFrame) -> DataFrame:
    """Reads of whole files (path, whole); a file is parsed within one task."""

    def run(batches):
        for batch in batches:
            for path, whole in zip(batch.column("path").to_pylist(), batch.column("whole").to_pylist()):
                yield from _batches(path, whole.replace("\r\n", "\n").replace("\r", "\n").split("\n"))

    return files.select("path", "whole").mapInArrow(run, READS)


def reads_of_lines(lines: DataFrame) -> DataFrame:
    """Reads of files of any size as lines (path, line_no, line); a file's lines pass through one task, sorted on its disk, and none holds them all."""

    def run(batches):
        rows = ((p, x) for batch in batches for p, x in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()))
        for path, own in groupby(rows, lambda r: r[0]):
            yield from _batches(path, (x for _, x in own))

    return lines.repartition("path").sortWithinPartitions("path", "line_no").select("path", "line").mapInArrow(run, READS)


def first_reads(reads: DataFrame, limit: int | None, order: tuple[str, ...] = ("path", "read_ord")) -> DataFrame:
    """The first reads in file order; a negative limit is none, 0 means no reads."""
    return reads if limit is None or limit < 0 else reads.orderBy(*order).limit(limit)


def read_fastq(spark: SparkSession, path: str, limit: int | None = None, whole_bytes: int | None = None) -> DataFrame:
    """Reads of the files below path, with equal results: small files whole, larger ones in ranges, and large gzipped ones, which can't be split, by their lines."""
    from helixmill.sources.fastq_ranges import range_lines, reads_of_ranges

    small, large = by_size(spark, path, whole_bytes)
    out = reads_of(whole_files(spark, small))
    if zipped := [p for p in large if p.endswith(".gz")]:
        out = out.unionByName(reads_of_lines(streamed_lines(spark, zipped)))
    if plain := [p for p in large if not p.endswith(".gz")]:
        out = out.unionByName(reads_of_ranges(range_lines(spark, plain)))
    return first_reads(out, limit)
