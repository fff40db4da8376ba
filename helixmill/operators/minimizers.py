"""Canonical minimizers of sequences, as sets of longs.

A base is two bits, an m-mer the smaller of itself and its reverse complement; a window is `step` adjacent m-mers and
emits its smallest valid one. A sequence needs k bases to have windows, of which there are L - k + 2. Characters other
than A, C, G, T and U (either case) make the m-mers over them invalid, which windows skip.

The work is numpy over Arrow batches: m-mers are built by doubling, so a base costs a few vector operations. A long
sequence is cut into pieces that overlap by k - 1 bases, so a task's memory doesn't follow the longest genome, except
for the set itself.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from helixmill.functions.parameters import kmer_parameters

PIECE_BASES = 1 << 21
INVALID = np.int64(1 << 62)

CODES = np.full(256, 255, np.uint8)
for _letters, _code in (("Aa", 0), ("Cc", 1), ("Gg", 2), ("TtUu", 3)):
    for _c in _letters:
        CODES[ord(_c)] = _code


def canonical_mmers(data: np.ndarray, m: int) -> np.ndarray:
    """The canonical m-mer at each position of ASCII bases; INVALID over other characters."""
    code = CODES[data]
    bad = code == 255
    forward = {1: np.where(bad, 0, code).astype(np.int64)}
    reverse = {1: np.where(bad, 0, 3 - code).astype(np.int64)}

    def grow(a: int, b: int) -> None:
        n = len(data) - a - b + 1
        if n < 1:
            forward[a + b] = reverse[a + b] = np.zeros(0, np.int64)
            return
        forward[a + b] = (forward[a][:n] << (2 * b)) | forward[b][a : a + n]
        reverse[a + b] = (reverse[b][a : a + n] << (2 * a)) | reverse[a][:n]

    size = 1
    while 2 * size <= m:
        grow(size, size)
        size *= 2
    have = size
    while have < m:
        size //= 2
        if have + size <= m:
            grow(have, size)
            have += size
    out = np.minimum(forward[m], reverse[m])
    if bad.any():
        seen = np.concatenate([[0], np.cumsum(bad)])
        out[seen[m:] != seen[: len(seen) - m]] = INVALID
    return out


def window_minima(mmers: np.ndarray, step: int) -> np.ndarray:
    n = len(mmers) - step + 1
    if n < 1:
        return mmers[:0]
    out = mmers[:n].copy()
    for i in range(1, step):
        np.minimum(out, mmers[i : i + n], out=out)
    return out


def minimizer_set(data: np.ndarray, k: int, step: int, piece: int = PIECE_BASES) -> np.ndarray:
    """Distinct minimizers, ascending."""
    if len(data) < k:
        return np.zeros(0, np.int64)
    found = []
    for at in range(0, max(1, len(data) - k + 2), piece):
        # windows at..at+piece-1 span k - 1 bases each
        found.append(np.unique(window_minima(canonical_mmers(data[at : at + piece + k - 2], k - step), step)))
    out = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return out[:-1] if len(out) and out[-1] == INVALID else out


#: Bases of short sequences that are made to sets together; longer ones are made by themselves.
TOGETHER = 1 << 18


def sets_of(texts: Iterable[str | None], k: int, step: int, piece: int = PIECE_BASES):
    """The minimizer_set() of each text, in order; short ones in vector operations over many."""
    waiting: list[np.ndarray] = []
    size = 0
    for text in texts:
        data = np.frombuffer((text or "").encode("ascii", "replace"), np.uint8)
        if len(data) > min(TOGETHER, piece):
            yield from _together(waiting, k, step)
            waiting, size = [], 0
            yield minimizer_set(data, k, step, piece)
            continue
        waiting.append(data)
        size += len(data)
        if size >= TOGETHER:
            yield from _together(waiting, k, step)
            waiting, size = [], 0
    yield from _together(waiting, k, step)


def _together(parts: list[np.ndarray], k: int, step: int) -> list[np.ndarray]:
    size = np.array([len(x) for x in parts], np.int64)
    if not len(parts) or size.max() < k:
        return [np.zeros(0, np.int64)] * len(parts)
    found = window_minima(canonical_mmers(np.concatenate(parts), k - step), step)
    owner = np.repeat(np.arange(len(parts)), size)[: len(found)]
    place = np.arange(len(found)) - (np.cumsum(size) - size)[owner]
    # a text's windows are those that end in it
    inside = (size[owner] >= k) & (place <= size[owner] - k + 1) & (found != INVALID)
    found, owner = found[inside], owner[inside]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    edge = np.searchsorted(owner, np.arange(len(parts) + 1)).tolist()
    return [found[a:b] for a, b in zip(edge, edge[1:])]


#: Minimizers that one Arrow batch holds, at most (a sequence's set is not divided).
BATCH_MINIMIZERS = 1 << 20


def minimizers(sequences: DataFrame, id_column: str | list[str] = "genome_id", sequence: str = "seq", k: int = 29, piece: int = PIECE_BASES) -> DataFrame:
    """(id, mz), or (ids, mz): a row for each minimizer of each sequence; rows with null sequences have none."""
    return _sets(sequences, [id_column] if isinstance(id_column, str) else id_column, sequence, k, piece, False)


def minimizer_sets(sequences: DataFrame, id_columns: list[str], sequence: str = "seq", k: int = 29, piece: int = PIECE_BASES) -> DataFrame:
    """(ids, mz): a row for each sequence with its minimizers as an array, an empty one for null and short sequences."""
    return _sets(sequences, id_columns, sequence, k, piece, True)


def _sets(sequences: DataFrame, id_columns: list[str], sequence: str, k: int, piece: int, whole: bool) -> DataFrame:
    k, step, _ = kmer_parameters(k)
    own = sequences.select(*id_columns, sequence)
    schema = T.StructType([*[own.schema[c] for c in id_columns], T.StructField("mz", T.ArrayType(T.LongType()) if whole else T.LongType())])

    def made(batch, rows: list[int], sets: list[np.ndarray]):
        size = [len(x) for x in sets]
        at = pa.array(rows if whole else np.repeat(rows, size).astype(np.int64), pa.int64())
        values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
        mz = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values) if whole else values
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in id_columns], mz], names=schema.names)

    def run(batches):
        for batch in batches:
            rows, sets, held = [], [], 0
            # one text after the other: a batch's strings aren't held beside it
            for i, own in enumerate(sets_of((x.as_py() for x in batch.column(sequence)), k, step, piece)):
                rows.append(i)
                sets.append(own)
                held += len(sets[-1])
                if held >= BATCH_MINIMIZERS:
                    yield made(batch, rows, sets)
                    rows, sets, held = [], [], 0
            yield made(batch, rows, sets)

    return own.mapInArrow(run, schema)


def mmers(sequences: DataFrame, id_column: str, sequence: str, k: int = 29) -> DataFrame:
    """(id, pos from 1, mmer): valid canonical m-mers of the sequences that are long enough for windows."""
    k, step, m = kmer_parameters(k)
    own = sequences.select(id_column, sequence)
    schema = T.StructType([own.schema[id_column], T.StructField("pos", T.LongType()), T.StructField("mmer", T.LongType())])

    def run(batches):
        for batch in batches:
            for i, s in enumerate(batch.column(sequence)):
                text = s.as_py()
                if text is None or len(text) < k:
                    continue
                found = canonical_mmers(np.frombuffer(text.encode("ascii", "replace"), np.uint8), m)
                at = np.flatnonzero(found != INVALID)
                yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(np.full(len(at), i))), pa.array(at + 1), pa.array(found[at])], names=[id_column, "pos", "mmer"])

    return own.mapInArrow(run, schema)


def chunk_sequences(sequences: DataFrame, sequence: str, size: int, k: int) -> DataFrame:
    """Long sequences as overlapping rows, for more parallel work: the union of the chunks' sets is the sequence's set."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(sequence) - k, F.lit(0)), F.lit(size))
    return sequences.withColumn("chunk_start", F.explode(starts)).withColumn(sequence, F.substring(F.col(sequence), F.col("chunk_start") + 1, F.lit(size + k - 1)))
