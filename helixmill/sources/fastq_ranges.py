"""FASTQ files of any size in parallel: ranges of lines are parsed for themselves, and give what one pass over the file gives.

What a parser makes of a line depends on where it stands: looking for a header (and how many lines it has skipped), in a
sequence (of so many letters so far), or in a quality that lacks so many. So a first reading makes, of each range, the state
that it ends in as a function of the state that it begins in. All of a range's chains of records end alike from some header
on, so the function of "quality lacks n" is a table of few steps. One more thing is open: whether a `@` line near the
end of a range begins a record depends on the lines behind it, so functions are made for both answers, and the first lines
of the ranges after it tell which holds. Then each file's functions, a row for each range, are followed from its start,
and in a second reading every range is parsed from the state that it really begins in. What a range has of a record that
began before it, or that ends behind it, is a piece; the pieces of such records, a few for each range, are joined.

Memory is some times a range's bytes, whatever the file's; of a record that spans ranges the pieces are joined in one row.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from helixmill.functions.lineage import cut
from helixmill.sources.fastq import BATCH_BASES, LOOK_AHEAD, SEQUENCE_LINE

HEADER, SEQUENCE, QUALITY = 0, 1, 2


#: What str.strip() takes away.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Lines of a range, at most.
RANGE_LINES = 1 << 19


class Range:
    """The lines of a range: where headers could be, separators, and letters up to each line."""

    def __init__(self, lines: pa.Array):
        numbers = lambda x: x.to_numpy(zero_copy_only=False)
        self.n = len(lines)
        self.at = np.flatnonzero(numbers(pc.starts_with(lines, "@")))
        is_plus = np.append(numbers(pc.starts_with(lines, "+")), False).astype(bool)
        self.plus = np.flatnonzero(is_plus)
        self.raw, self.bare = (np.concatenate([[0], np.cumsum(numbers(pc.utf8_length(x)))]).astype(np.int64) for x in (lines, pc.utf8_trim(lines, WHITE)))
        other = np.flatnonzero(~numbers(pc.match_substring_regex(lines, SEQUENCE_LINE)).astype(bool))  # a run of sequence lines ends there
        self.lead = int(other[0]) if len(other) else self.n
        self.first = "all" if not len(other) else "plus" if is_plus[other[0]] else "other"
        self.tail = self.n - 1 - int(other[-1]) if len(other) else self.n
        self.open = bool(len(self.at) and self.at[-1] == other[-1])  # a `@` line, and sequence lines alone behind it
        place = np.searchsorted(other, self.at, "right")
        end = np.append(other, self.n)[place]
        run = end - self.at - 1
        self.sure = is_plus[end] & (run > 0) & (run < LOOK_AHEAD)

    def resync(self, follows: bool) -> np.ndarray:
        """The `@` lines after which sequence lines and a separator come; follows: whether that holds of an open last one."""
        return np.append(self.at[self.sure], self.at[-1:]) if follows and self.open else self.at[self.sure]

    def quality(self, line, lacking, resync: np.ndarray):
        """(the line that looks for a header after a quality that begins at `line` and lacks so many letters; how many it lacks at the range's end). Arrays or numbers."""
        end = np.maximum(np.searchsorted(self.raw, self.raw[line] + lacking, "left"), line)  # behind the quality
        end = np.where(lacking <= 0, line, end)
        stop = np.append(resync, self.n + 1)[np.searchsorted(resync, line)]
        left = np.where(end > self.n, lacking - (self.raw[self.n] - self.raw[line]), 0)
        return np.where(stop < np.minimum(end, self.n), stop, end), np.where(stop < np.minimum(end, self.n), 0, left)

    def sequence(self, line):
        """(the separator's line, or n; the letters up to it) of a sequence that begins at `line`."""
        s = np.append(self.plus, self.n)[np.searchsorted(self.plus, line)]
        return s, self.bare[s] - self.bare[np.minimum(line, self.n)]

    def function(self, follows: bool) -> dict:
        """What followed() needs to tell the state at the end from that at the start."""
        resync = self.resync(follows)
        s, letters = self.sequence(self.at + 1)
        inside = s < self.n
        line, left = self.quality(np.minimum(s + 1, self.n), letters, resync)
        line = np.where(inside, line, self.n + 1)
        m = len(self.at)
        nxt = np.searchsorted(self.at, line).tolist()
        kind = np.where(~inside, SEQUENCE, np.where(line > self.n, QUALITY, HEADER)).tolist()
        value = np.where(~inside, letters, np.where(line > self.n, left, self.n - line)).tolist()
        header, count = self.at.tolist(), [1] * m
        for k in range(m - 1, -1, -1):
            if kind[k] == HEADER and nxt[k] < m:
                j = nxt[k]
                kind[k], value[k], header[k], count[k] = kind[j], value[j], header[j], count[j] + 1
            elif kind[k] == HEADER:
                header[k] = -1
        first = int(self.sequence(0)[0])
        begins = {"quality": 0, "sequence": min(first + 1, self.n)}
        stops = {name: int(np.append(resync, -1)[np.searchsorted(resync, line)]) for name, line in begins.items()}
        last = int(self.at[-1]) + 1 if m else 0
        return {
            "n": self.n, "at": self.at, "raw_at": self.raw[self.at], "kind": np.array(kind, np.int8), "value": np.array(value, np.int64), "header": np.array(header, np.int64), "count": np.array(count, np.int64),
            "behind": last, "raw_behind": self.raw[last:], "begins": {name: (line, int(self.raw[line]), stops[name], int(self.raw[stops[name]])) for name, line in begins.items()},
            "separated": first < self.n, "letters": int(self.sequence(0)[1]),
        }


def packed(f: dict) -> bytes:
    """A function in few bytes: its long arrays by their differences."""
    small = {k: np.diff(v, prepend=0).astype(np.int32) if k in ("at", "raw_at", "count", "raw_behind") and np.abs(np.diff(v, prepend=0)).max(initial=0) < 1 << 31 else v for k, v in f.items()}
    return zlib.compress(pickle.dumps(small), 1)


def unpacked(data: bytes) -> dict:
    f = pickle.loads(zlib.decompress(data))
    return {k: np.cumsum(v.astype(np.int64)) if isinstance(v, np.ndarray) and v.dtype == np.int32 else v for k, v in f.items()}


def followed(f: dict, kind: int, value: int) -> tuple[int, int, int, int]:
    """(kind, value, header, records begun) at a range's end, from the state at its start. header: the line that began the open record; -2 before the range, -1 where none is open."""

    def looking(k: int, line: int) -> tuple[int, int, int, int]:
        if k == len(f["at"]):
            return HEADER, f["n"] - line, -1, 0
        return tuple(int(f[c][k]) for c in ("kind", "value", "header", "count"))

    def from_line(line: int) -> tuple[int, int, int, int]:
        return looking(int(np.searchsorted(f["at"], line)), line)

    def lacking(name: str, n: int) -> tuple[int, int, int, int]:
        line, raw, stop, raw_stop = f["begins"][name]
        if n <= 0:
            return from_line(line)
        if stop >= 0 and raw + n > raw_stop:
            return from_line(stop)
        k = int(np.searchsorted(f["raw_at"], raw + n, "left"))
        if k < len(f["at"]):
            return looking(k, -1)
        end = int(np.searchsorted(f["raw_behind"], raw + n, "left"))
        if end < len(f["raw_behind"]):
            return HEADER, f["n"] - f["behind"] - end, -1, 0
        return QUALITY, n - int(f["raw_behind"][-1] - raw), -2, 0

    if kind == HEADER:
        found = from_line(0)
        return (HEADER, found[1] + value, -1, 0) if found[3] == 0 else found
    if kind == QUALITY:
        return lacking("quality", value)
    return lacking("sequence", value + f["letters"]) if f["separated"] else (SEQUENCE, value + f["letters"], -2, 0)


# ---- the passes ----

def range_lines(spark: SparkSession, paths: list[str], most: int = RANGE_LINES, named: bool = False) -> DataFrame:
    """(path, block, line_no, line) of files that Spark can split: block is the number of a range's first line, numbers go up from the split's first byte on; a range has `most` lines at most.

    named: many small files lie one after the other in these, each line behind its file's name and a tab; ranges are of one such file.
    """

    def number(batches):
        before, at, first = None, 0, 0
        for batch in batches:
            starts, names, files = batch.column("block").to_numpy(), batch.column("path").to_pylist(), batch.column("file").to_pylist()
            numbers, blocks = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            edge = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1] or starts[i] != starts[i - 1] or files[i] != files[i - 1]]
            for a, b in zip(edge, [*edge[1:], len(names)]):
                if (files[a], starts[a], names[a]) != before:
                    at = at if before and before[:2] == (files[a], starts[a]) else 0
                    before, first = (files[a], starts[a], names[a]), at
                places = np.arange(at, at + b - a)
                numbers[a:b], blocks[a:b] = starts[a] + places, starts[a] + first + (places - first) // most * most
                at += b - a
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(blocks), pa.array(numbers), batch.column("value")], names=["path", "block", "line_no", "line"])

    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    cut_at = F.instr("value", "\t")
    path, value = (F.substring_index("value", "\t", 1), F.substr("value", cut_at + 1)) if named else (F.col("file"), F.col("value"))
    return lines.select("file", path.alias("path"), "block", value.alias("value")).mapInArrow(number, "path string, block long, line_no long, line string")


def _ranges(batches) -> Iterator[tuple[dict, pa.Array]]:
    """Each range that a task reads, one after the other: its first row but the line, and its lines."""
    held: list[pa.Array] = []
    first, before = {}, None
    for batch in batches:
        keys = list(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()))
        edge = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, b in zip(edge, [*edge[1:], len(keys)]):
            if keys[a] != before:
                if held:
                    yield first, pa.concat_arrays(held)
                held, before, first = [], keys[a], {c: batch.column(c)[a].as_py() for c in batch.schema.names if c != "line"}
            held.append(batch.column("line").slice(a, b - a))
    if held:
        yield first, pa.concat_arrays(held)


def _schema(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in text.split(", "))])


FUNCTIONS = _schema("path string, block long, n long, lead long, first string, tail long, open boolean, closed binary, followed binary")
STATES = _schema("path string, block long, n long, kind int, value long, owner long, before long, follows boolean")


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), schema)], names=schema.names)


def range_functions(lines: DataFrame) -> DataFrame:
    """A row for each range of lines (path, block, line): its functions for both answers, and what its first and last lines are."""

    def run(batches):
        for key, own in _ranges(batches):
            r = Range(own)
            yield _batch([(key["path"], key["block"], r.n, r.lead, r.first, r.tail, r.open, packed(r.function(False)), packed(r.function(True)) if r.open else None)], FUNCTIONS)

    return lines.mapInArrow(run, FUNCTIONS)


def range_states(functions: DataFrame) -> DataFrame:
    """STATES: what each range begins in. A file's functions, a row for each range, pass through one task in order."""
    order = Window.partitionBy("path").orderBy("block")
    told = functions.select("path", "block", "lead", "first", "tail", "open").withColumn("upto", F.sum("lead").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ended = F.when(F.col("first") != "all", F.struct("first", "upto"))
    told = told.withColumn("next", F.first(ended, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    size = F.col("tail") + F.col("next.upto") - F.col("upto")  # of the run of sequence lines behind an open `@` line
    follows = F.coalesce(F.col("open") & (F.col("next.first") == "plus") & (size > 0) & (size < LOOK_AHEAD), F.lit(False))

    def run(batches):
        rows = ({c: batch.column(c)[i].as_py() for c in batch.schema.names} for batch in batches for i in range(len(batch)))
        for path, own in groupby(rows, lambda r: r["path"]):
            kind, value, owner, before, out = HEADER, 0, -1, 0, []
            for r in own:
                out.append((path, r["block"], r["n"], kind, value, owner, before, r["follows"]))
                kind, value, header, begun = followed(unpacked(r["followed"] if r["follows"] else r["closed"]), kind, value)
                before += begun
                owner = -1 if kind == HEADER else owner if header == -2 else r["block"]
                if len(out) == 10_000:
                    yield _batch(out, STATES)
                    out = []
            if out:
                yield _batch(out, STATES)

    ordered = functions.select("path", "block", "n", "closed", "followed").join(told.select("path", "block", follows.alias("follows")), ["path", "block"])
    return ordered.repartition("path").sortWithinPartitions("path", "block").mapInArrow(run, STATES)


PIECES = _schema("path string, owner long, block long, read_ord long, read_id string, seq string, qual string, skipped long, separated boolean, whole boolean")


def range_pieces(lines: DataFrame) -> DataFrame:
    """PIECES of lines (path, block, line, and the range's STATES): whole reads, and what the range has of others."""

    def run(batches):
        for key, own in _ranges(batches):
            out, size, r = [], 0, Range(own)
            if key["n"] != r.n:
                raise RuntimeError(f"{key['path']}: the range at {key['block']} has {r.n} lines, not {key['n']} as before; its splits have changed between two readings")
            for piece in _pieces(r, own.to_pylist(), key):
                out.append((key["path"], *piece))
                size += len(piece[4])
                if len(out) == 10_000 or size > BATCH_BASES:
                    yield _batch(out, PIECES)
                    out, size = [], 0
            if out:
                yield _batch(out, PIECES)

    return lines.mapInArrow(run, PIECES)


def _pieces(r: Range, text: list[str], key: dict) -> Iterator[tuple]:
    """(owner, block, read_ord, read_id, seq, qual, skipped, separated, whole)"""
    resync, n = r.resync(key["follows"]), r.n
    line, skipped, turn = 0, 0, key["before"]

    def sequence(at: int) -> tuple[int, str, bool]:
        s = int(r.sequence(at)[0])
        return s, "".join(x.strip() for x in text[at:s]), s < n

    def quality(at: int, lacking: int) -> tuple[int, str]:
        """(the line that looks for a header, above n if none of this range does; the letters)"""
        nxt = int(r.quality(at, lacking, resync)[0])
        return nxt, "".join(text[at : min(nxt, n)])

    if key["kind"] == HEADER:
        skipped = key["value"]
    else:
        letters, separated, lacking = "", True, key["value"]
        if key["kind"] == SEQUENCE:
            line, letters, separated = sequence(0)
            line, lacking = line + 1, lacking + len(letters)
        line, own = quality(line, lacking) if separated else (n + 1, "")
        yield key["owner"], key["block"], None, None, letters, own, None, separated, False
    while line <= n and (k := int(np.searchsorted(r.at, line))) < len(r.at):
        header = int(r.at[k])
        skipped += header - line
        s, letters, separated = sequence(header + 1)
        line, own = quality(s + 1, len(letters)) if separated else (n + 1, "")
        yield key["block"], key["block"], turn, text[header], letters, own, skipped, separated, line <= n
        turn, skipped = turn + 1, 0


#: Ranges whose states every task may hold.
BROADCAST_RANGES = 1 << 20


def reads_of_ranges(lines: DataFrame) -> DataFrame:
    """Reads of lines (path, block, line_no, line), of which each task reads whole ranges in order, and the same ones each time."""
    states = cut(range_states(cut(range_functions(lines))))
    if states.count() <= BROADCAST_RANGES:
        placed = lines.join(F.broadcast(states), ["path", "block"], "left")
    else:
        placed = lines.join(states, ["path", "block"], "left").sortWithinPartitions("path", "block", "line_no")
    pieces = range_pieces(placed)
    done = pieces.where("whole")
    parts = F.array_sort(F.collect_list(F.struct("block", "read_ord", "read_id", "seq", "qual", "skipped", "separated")))
    joined = pieces.where("not whole").groupBy("path", "owner").agg(parts.alias("p"), F.max("read_ord").alias("read_ord"), F.max("read_id").alias("read_id"), F.max("skipped").alias("skipped"), F.bool_or("separated").alias("separated"))
    text = lambda name: F.array_join(F.transform("p", lambda x: F.when(x["block"].isNotNull(), x[name])), "")
    joined = joined.where("separated").select("path", "read_ord", "read_id", text("seq").alias("seq"), text("qual").alias("qual"), "skipped")
    reads = done.select("path", "read_ord", "read_id", "seq", "qual", "skipped").unionByName(joined)
    lengths = F.length("seq") != F.length("qual")
    warnings = F.concat_ws("; ", F.when(F.col("skipped") > 0, F.format_string("skipped %d lines", "skipped")), F.when(lengths, F.format_string("sequence %d, quality %d", F.length("seq"), F.length("qual"))))
    return reads.select("path", "read_ord", "read_id", "seq", "qual", F.nullif(warnings, F.lit("")).alias("parse_warning"))
