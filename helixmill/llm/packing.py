"""Best-fit packing with certified bounds.

Documents become token ids plus an end id; those longer than a sequence are cut, the first piece taking the
remainder. Full pieces are sequences by themselves. The other pieces are dealt to partitions of bounded size, each
packed best-fit decreasing; dual feasible functions give a lower bound on each partition's sequences, which certifies
it where both agree. Partitions with a gap give the documents of their unfilled sequences to an exchange, which is
dealt anew and packed again, for a bounded number of rounds or until the count meets the bound over all pieces (whose
lengths are a histogram of `size` counts). An exchange that would not save a sequence is not taken over.

Ids and cuts come from one row-local pass; what is packed are rows of (piece, length), written once to the shared
folder so that piece numbers hold. Packing shuffles no text.

Defined cases: a null or empty text is the end id alone; repeated rows are separate documents; null ids pass through;
an empty table has no pieces; further columns are kept with each piece, but those named as the result's, which replace
them. Text that spells a special token is read as `tokenizers`
reads it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from helixmill.llm.common import append_columns, keep
from helixmill.llm.token_counts import parse_ranks, split_pattern, vocabulary_path

SIZE, END_ID = 1024, 2
#: Pieces that one packing task takes.
TASK_PIECES = 200_000
ROUNDS = 6

PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
PIECES = T.StructType([T.StructField("pieces", T.ArrayType(PIECE))])


def encoder(vocabulary: str, pattern: str):
    """ids(text) under the vocabulary file's content, as the tokenizers library gives them without added special tokens."""
    import tiktoken

    ranks, special = parse_ranks(vocabulary)
    fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    held: list = []

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            if not held:
                from tokenizers import Tokenizer

                held.append(Tokenizer.from_str(vocabulary))
            return held[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def cuts(n: int, size: int) -> list[int]:
    """Where the pieces of n ids begin, and the end."""
    if n <= size:
        return [0, n]
    return [0, *range(n % size or size, n + 1, size)]


def tokenized(docs: DataFrame, path: str | None, text: str, size: int, end_id: int) -> DataFrame:
    """A row for each piece: the columns of docs but text, piece, start, length, ids_crc32."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), split_pattern()))

    def start():
        ids = encoder(*sent.value)

        def work(data, offsets):
            whole = data.tobytes()
            out = []
            for a, b in zip(offsets, offsets[1:]):
                own = np.array([*ids(whole[a:b].decode("utf-8", "replace")), end_id], "<u4")
                at = cuts(len(own), size)
                out.append([{"piece": i, "start": x, "length": y - x, "ids_crc32": zlib.crc32(own[x:y].tobytes())} for i, (x, y) in enumerate(zip(at, at[1:]))])
            return [out]

        return work

    made = append_columns(docs, text, PIECES, start, (text,))
    return made.select("*", F.inline("pieces")).drop("pieces")


# ---- bounds and packing of lengths ----


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences that these lengths need at least: the best of several dual feasible functions."""
    counts = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    return bound_of_counts(counts, size)


def bound_of_counts(counts: np.ndarray, size: int) -> int:
    x = np.arange(size + 1, dtype=np.int64)
    n = counts.astype(object) if counts.sum() > 1 << 40 else counts
    best = -(-int((n * x).sum()) // size)
    for e in range(1, size // 2 + 1):  # long ones count whole, short ones not at all
        f = np.where(x > size - e, size, np.where(x < e, 0, x))
        best = max(best, -(-int((n * f).sum()) // size))
    for k in range(1, 60):  # rounded to k-ths
        whole = (x * (k + 1)) % size == 0
        f = np.where(whole, x * k, (x * (k + 1)) // size * size)  # in size * k-ths
        best = max(best, -(-int((n * f).sum()) // (size * k)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Each item's sequence (from 0), by best-fit decreasing."""
    bins_with: list[list[int]] = [[] for _ in range(size + 1)]
    open_ = 0  # bit i: some sequence has i free
    out = np.empty(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = bins_with[free].pop()
            if not bins_with[free]:
                open_ &= ~(1 << free)
        else:
            free, b = size, made
            made += 1
        out[i] = b
        if left := free - n:
            bins_with[left].append(b)
            open_ |= 1 << left
    return out


PACKED = T.StructType([T.StructField("pid", T.LongType()), T.StructField("length", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType())])


def pack_groups(items: DataFrame, groups: int, number: int, size: int) -> DataFrame:
    """(pid, length) packed within `groups` groups; open: of the sequences to exchange.

    Those are all unfilled ones of a group without certificate, and the emptiest of a group with one.
    """

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        whole = pa.concat_tables(tables)
        pid, length, group = (whole.column(c).to_numpy() for c in ("pid", "length", "group"))
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            at = at[np.argsort(pid[at], kind="stable")]
            n = length[at]
            bins = best_fit(n, size)
            order = np.lexsort((pid[at], bins))
            used = np.bincount(bins, weights=n).astype(np.int64)
            ends = np.cumsum(n[order])
            offset = np.empty(len(n), np.int64)
            offset[order] = ends - n[order] - np.repeat(np.concatenate([[0], np.cumsum(used)[:-1]]), np.bincount(bins))
            certified = len(used) == lower_bound(n, size)
            open_ = (bins == np.argmin(used)) & (used[bins] < size) if certified else used[bins] < size
            yield pa.RecordBatch.from_arrays([pa.array(pid[at]), pa.array(n), pa.array((number << 56) | (int(g) << 32) | bins), pa.array(offset), pa.array(open_)], names=PACKED.names)

    spread = items.withColumn("group", F.pmod(F.xxhash64("pid", F.lit(number)), F.lit(groups)))
    return spread.repartition(groups, "group").mapInArrow(run, PACKED)


def pack(items: DataFrame, size: int = SIZE, rounds: int = ROUNDS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """items (pid unique, length 1..size) with sequence_id and offset."""
    full = items.where(F.col("length") == size).select("pid", F.col("length").cast("long").alias("length"), ((F.lit(127 << 56)) + F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.where(F.col("length") < size).select("pid", F.col("length").cast("long").alias("length"))
    counts = np.zeros(size + 1, np.int64)
    for r in left.groupBy("length").count().collect():  # at most `size` rows
        counts[r["length"]] = r["count"]
    target, n = bound_of_counts(counts, size), int(counts.sum())

    def packed(pool: DataFrame, n: int, number: int) -> tuple[DataFrame, dict]:
        out = keep(pack_groups(pool, max(1, -(-n // task_pieces)), number, size), "packed")
        rows = out.groupBy("open").agg(F.count_distinct("sequence_id").alias("bins"), F.count("*").alias("pieces")).collect()
        return out, {r["open"]: (r["bins"], r["pieces"]) for r in rows}

    settled, settled_bins = [], 0
    current, stats = packed(left, n, 0)
    for number in range(1, rounds + 1):
        if True not in stats or settled_bins + sum(b for b, _ in stats.values()) <= target:
            break
        bins, pieces = stats[True]
        again, new = packed(current.where("open").select("pid", "length"), pieces, number)
        if sum(b for b, _ in new.values()) >= bins:
            break  # the exchange saves nothing: what stands stays
        settled.append(current.where("not open"))
        settled_bins += stats.get(False, (0, 0))[0]
        current, stats = again, new
    out = full
    for d in [*settled, current]:
        out = out.unionByName(d.select("pid", "length", "sequence_id", "offset"))
    return out


def pack_documents(docs: DataFrame, path: str | None = None, text: str = "text", size: int = SIZE, end_id: int = END_ID, rounds: int = ROUNDS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """A row for each piece: the other columns of docs, piece, start, length, ids_crc32, sequence_id, offset."""
    taken = [c for c in docs.columns if c == text or c.lower() not in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")]
    own = {c: f"own__{i}" for i, c in enumerate(taken)}
    pieces = tokenized(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]), path, own.pop(text), size, end_id)
    pieces = keep(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("pid", "length"), size, rounds, task_pieces)
    joined = pieces.join(placed.drop("length"), "pid")
    return joined.select(*[F.col(n).alias(c) for c, n in own.items()], "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest columns of the registered query."""
    return pack_documents(docs.select("doc_id", "text"), path).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
