"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Two suffixes belong together if they agree through `width` tokens; such groups are exactly the repeated windows. They
are found by most-significant-digit passes, each of which groups what the passes before left together and drops
what is alone:

1. The leading digit is the window's sampled core: of the shorter strings inside a window, the one with the smallest
   hash (the leftmost of equals). Equal windows have equal cores at equal places, and neighbouring windows mostly
   share theirs, so a digit stands for a run of suffixes and one row for about 3/8 of `width` of them. Digits that occur
   once are gone after a count of the digits alone: the rows of the others are made in a second reading, which a bitmap
   of the repeated digits (of a checked size; beyond it a join) lets through.
2. The next digit is all that the run's windows cover. Runs that agree here are repeated windows, all of them; of
   each distinct one a single representative goes on, and only in groups where some run is still alone.
3. The last digits are the windows themselves. Groups of up to TASK_RUNS representatives are sorted within a task;
   larger ones are split by further passes, over ever shorter blocks of windows, until they are small or the block is
   one window. Nothing is capped.

Tokens are bytes (what is removed) or words (`shared_passages`: passages of PASSAGE words and more that stand in
different documents, whatever their case and punctuation, and however few bytes they have).

Digits are compared as 64-bit hashes, each joined by the group's, so 128 bits and more decide about equality.
Texts are known by 120 bits of their SHA-256: copies share their result, and hot texts are joined, not grouped.

Defined cases: a null text is empty; texts shorter than a window lose nothing; repeated rows are repeated strings;
null and repeated ids pass through; further columns, whatever their names, are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from helixmill.llm.common import BYTE_CODES, chunks, keep, mix, rolling, text_bytes, text_key
from helixmill.llm.decontaminate import expand, words_of

WIDTH = 400
#: Words of a passage that tells when it stands in different documents.
PASSAGE = 50
#: Representatives of one group that one task sorts.
TASK_RUNS = 20_000
#: Text bytes that one pass over runs takes, so that its arrays stay in the processor's cache (a text is not divided).
RUN_BYTES = 1 << 16
#: Bytes of context that a task sorts at a time (a group is not divided).
SORT_BYTES = 2 << 20
#: Bits of the broadcast bitmap of repeated digits, at most; sixteen are wanted for a digit.
BITMAP_BITS = 1 << 27
BLOCK_BITS = 1 << 15
#: Runs (four numbers each) that are broadcast, at most; more are joined by a shuffle.
BROADCAST_RUNS = 200_000

HIGH, LOW = np.uint64(0xFFFFFFFFFF000000), np.uint64(0xFFFFFF)
STEP = 1 << 20


def leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes, where its smallest is (the leftmost of equals)."""
    n = len(h) - width + 1
    out = np.empty(max(n, 0), np.int64)
    for s in range(0, n, STEP):
        e = min(s + STEP, n)
        x = (h[s : e + width - 1] & HIGH) | np.arange(e - s + width - 1, dtype=np.uint64)
        rows = -(-len(x) // width)
        padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(x)] = x
        table = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        out[s:e] = (np.minimum(behind[: e - s], ahead[width - 1 : width - 1 + e - s]) & LOW).astype(np.int64) + s
    return out


@dataclass(frozen=True)
class Tokens:
    """What windows are made of: bytes, or words known by 64-bit hashes. apart: only what different texts share counts."""

    words: bool
    width: int
    apart: bool = False

    @property
    def core(self) -> int:
        return self.width // 4

    @property
    def size(self) -> int:
        """Bytes of a token in a context."""
        return 8 if self.words else 1

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a text column, and each row's first (n + 1 of them)."""
        return words_of(data, offsets) if self.words else (data, offsets)

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        return tokens if self.words else BYTE_CODES[tokens]

    def view(self, tokens: np.ndarray) -> memoryview:
        return memoryview(np.ascontiguousarray(tokens)).cast("B")

    def back(self, context: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and offsets of a column of contexts."""
        data, offsets = text_bytes(context.cast(pa.large_binary()).view(pa.large_string()))
        return (np.frombuffer(data.tobytes(), np.uint64), offsets // 8) if self.words else (data, offsets)


def digest(view, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    of = xxhash.xxh3_64_intdigest
    return np.fromiter((of(view[a:b]) for a, b in zip(begins.tolist(), ends.tolist())), np.uint64, len(begins))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def runs_of(tokens: np.ndarray, first: np.ndarray, kind: Tokens):
    """Each run of windows with one core: core's hash, row, first window, core's distance from it, windows; and the tokens that it covers."""
    width, core = kind.width, kind.core
    count = np.maximum(np.diff(first) - width + 1, 0)
    if not count.sum():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, none, none
    h, q = rolling(kind.codes(tokens))
    n = len(tokens) - core + 1
    hashed = (h[core:] - h[:n]) * q[:n]
    at = leftmost_minimum(hashed, width - core + 1)
    source = np.repeat(np.arange(len(count)), count)
    p = first[source] + np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
    anchor = at[p]
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (source[1:] != source[:-1])
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(p)))
    low, row, a = p[begin], source[begin], anchor[begin]
    return hashed[a], row, low - first[row], a - low, windows, low, low + windows - 1 + width


RUN = ["g", "u", "k1", "k2", "first", "core", "windows"]
RUNS = T.StructType([T.StructField(c, T.LongType()) for c in RUN])


def digits(docs: DataFrame, kinds: tuple[Tokens, ...]) -> DataFrame:
    """(kind, g): the leading digit of each run of windows of each text."""

    def work(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets, RUN_BYTES):
                for i, kind in enumerate(kinds):
                    g = runs_of(*kind.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), kind)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i, np.int8)), signed(g)], names=["kind", "g"])

    return docs.select("text").mapInArrow(work, "kind byte, g long")


def bitmap_of(df: DataFrame, column: str, n: int, most: int) -> tuple[np.ndarray, int] | None:
    """A bitmap in which the place is set that each value's low bits name, and how many bits; None if it would be too large.

    Values are evenly spread in their low bits (the high ones of sampled cores are small).
    """
    bits = max(16, (16 * max(n, 1) - 1).bit_length())
    if 1 << bits > most:
        return None
    low = (1 << bits) - 1

    def mark(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy() & low
            for block in np.unique(at // BLOCK_BITS).tolist():
                own = held.setdefault(block, np.zeros(BLOCK_BITS, bool))
                own[at[at // BLOCK_BITS == block] % BLOCK_BITS] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    dealt = df.select(F.col(column).alias("at")).repartition(F.shiftright(F.col("at").bitwiseAND(F.lit(low)), BLOCK_BITS.bit_length() - 1))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in dealt.mapInArrow(mark, "block int, bits binary").collect():  # `most` bits in all
        out[r["block"] * (BLOCK_BITS // 8) :][: BLOCK_BITS // 8] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out, bits


def inside(bitmap: tuple[np.ndarray, int], values: np.ndarray) -> np.ndarray:
    at = (values.view(np.uint64) & np.uint64((1 << bitmap[1]) - 1)).astype(np.int64)
    return (bitmap[0][at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def sieve(df: DataFrame, column: str, bitmap: tuple[np.ndarray, int], wanted: bool) -> DataFrame:
    """The rows of df whose value is (or is not) marked in the bitmap."""
    sent = df.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(inside(sent.value, batch.column(column).to_numpy()) == wanted))

    return df.mapInArrow(work, df.schema)


def runs(docs: DataFrame, kinds: tuple[Tokens, ...], bitmap: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """A row for each run of windows of each text whose digit may be a repeated one; docs holds k1, k2, text."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches):
        known = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for a, b in chunks(offsets, RUN_BYTES):
                for i, kind in enumerate(kinds):
                    tokens, first = kind.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    found = runs_of(tokens, first, kind)
                    if known:
                        ok = inside(known, found[0])
                        found = [x[ok] for x in found]
                    g, row, start, core, windows, low, high = found
                    u = digest(kind.view(tokens), low * kind.size, high * kind.size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i, np.int8)), signed(g), signed(u), pa.array(k1[a:b][row]), pa.array(k2[a:b][row]), pa.array(start), pa.array(core), pa.array(windows)], names=["kind", *RUN])

    return docs.select("k1", "k2", "text").mapInArrow(work, T.StructType([T.StructField("kind", T.ByteType()), *RUNS.fields]))


CONTEXT = T.StructType([*RUNS.fields, T.StructField("n", T.LongType()), T.StructField("m", T.LongType()), T.StructField("context", T.BinaryType())])
FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("k1", "k2", "start", "stop")])


def place(copy: Column) -> Column:
    """What tells a run from others, evenly spread in its low bits."""
    return F.col("u").bitwiseXOR(F.col("k1")).bitwiseXOR(F.col("first")).bitwiseXOR(F.xxhash64(copy))


def contexts(texts: DataFrame, wanted: DataFrame, n: int, kind: Tokens, most: int) -> DataFrame | None:
    """The runs of wanted (runs with __copy) with the tokens they cover, from a reading of all texts that shuffles none of them.

    n and m are null; some other runs come along, as a bitmap tells which are wanted. None if that would be too large.
    """
    bitmap = bitmap_of(wanted.select(place(F.col("__copy")).alias("at")), "at", n, most)
    if bitmap is None:
        return None
    owners = bitmap_of(wanted.select("k1").distinct(), "k1", n, most)
    sent = texts.sparkSession.sparkContext.broadcast((bitmap, owners))

    def work(batches):
        seen: set[int] = set()  # copies of a text give a run once in a task
        runs_wanted, texts_wanted = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(inside(texts_wanted, batch.column("k1").to_numpy())))
            data, offsets = text_bytes(batch.column("text"))
            k1, k2, copy = (batch.column(c).to_numpy() for c in ("k1", "k2", "copy"))
            for a, b in chunks(offsets, RUN_BYTES):
                tokens, first = kind.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                g, row, start, core, windows, low, high = runs_of(tokens, first, kind)
                view = kind.view(tokens)
                u = digest(view, low * kind.size, high * kind.size)
                at = u.view(np.int64) ^ k1[a:b][row] ^ start ^ copy[a:b][row]
                ok = np.flatnonzero(inside(runs_wanted, at))
                new = [i for i in ok.tolist() if at[i] not in seen and not seen.add(at[i])]
                column = {"g": g.view(np.int64), "u": u.view(np.int64), "k1": k1[a:b][row], "k2": k2[a:b][row], "first": start, "core": core, "windows": windows}
                none = pa.nulls(len(new), pa.int64())
                context = pa.array([bytes(view[x:y]) for x, y in zip((low[new] * kind.size).tolist(), (high[new] * kind.size).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(column[c][new]) for c in RUN], none, none, context], names=CONTEXT.names)

    return texts.select("k1", "k2", "text", F.xxhash64("__id").alias("copy")).mapInArrow(work, CONTEXT)


def joined_contexts(texts: DataFrame, wanted: DataFrame, kind: Tokens) -> DataFrame:
    """wanted (runs with n and m, by text) with the tokens they cover, by a join with one copy of their texts."""

    def work(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            ends = np.asarray(wanted.offsets) - np.asarray(wanted.offsets)[0]
            flat = wanted.flatten()
            for a, b in chunks(offsets, RUN_BYTES):
                tokens, first = kind.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                whole, part = kind.view(tokens), flat.slice(ends[a], ends[b] - ends[a])
                source = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                column = {c: part.field(c) for c in ("g", "u", "first", "core", "windows", "n", "m")}
                begin = column["first"].to_numpy() + first[source]
                end = begin + column["windows"].to_numpy() - 1 + kind.width
                key = {c: batch.column(c).take(pa.array(source + a)) for c in ("k1", "k2")}
                context = pa.array([bytes(whole[x:y]) for x, y in zip((begin * kind.size).tolist(), (end * kind.size).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*[(column | key)[c] for c in RUN], column["n"], column["m"], context], names=CONTEXT.names)

    grouped = wanted.groupBy("k1", "k2", "__copy").agg(F.collect_list(F.struct("g", "u", "first", "core", "windows", "n", "m")).alias("wanted"))
    same = [texts["k1"] == grouped["k1"], texts["k2"] == grouped["k2"]]
    joined = texts.join(grouped.hint("shuffle_hash"), same).where(texts["__id"].eqNullSafe(grouped["__copy"]))
    return joined.select(texts["k1"], texts["k2"], "text", "wanted").mapInArrow(work, CONTEXT)


def sorted_groups(entities: DataFrame, kind: Tokens) -> DataFrame:
    """Repeated windows of small groups: each task has whole groups, in order, and sorts the windows of some at a time.

    A run's n and its context may come in rows of their own; runs without either aren't asked for.
    """
    width = kind.width

    def solve(t: pa.Table):
        t = t.group_by(["g", "u", "k1", "k2", "first"], use_threads=False).aggregate([("windows", "max"), ("n", "max"), ("context", "min")])
        t = t.filter(pa.compute.and_(pa.compute.is_valid(t.column("n_max")), pa.compute.is_valid(t.column("context_min"))))
        windows, n = t.column("windows_max").to_numpy(), t.column("n_max").to_numpy()
        tokens, offsets = kind.back(t.column("context_min").combine_chunks())
        begins = np.cumsum(windows) - windows
        source = np.repeat(np.arange(len(windows), dtype=np.int32), windows)
        hashed = np.empty(len(source), np.uint64)
        g = mix(t.column("g").to_numpy().view(np.uint64))
        for a, b in chunks(offsets, RUN_BYTES):  # the windows' hashes, some runs at a time
            h, q = rolling(kind.codes(tokens[offsets[a] : offsets[b]]))
            at, own = expand(offsets[a:b] - offsets[a], windows[a:b])
            hashed[begins[a] : begins[a] + len(at)] = mix((h[at + width] - h[at]) * q[at]) ^ g[a + own]
        if kind.apart:  # in two texts, or in a run that two texts share
            _, which, times = np.unique(hashed, return_inverse=True, return_counts=True)
            key = np.column_stack([t.column(c).to_numpy() for c in ("k1", "k2")])
            text = np.unique(key, axis=0, return_inverse=True)[1].ravel()[source]
            low, high, known = np.full(len(times), len(key)), np.full(len(times), -1), np.zeros(len(times), n.dtype)
            np.minimum.at(low, which, text)
            np.maximum.at(high, which, text)
            np.maximum.at(known, which, n[source])
            again = ((low != high) | (known > 1))[which] & (n[source] == 1)
        else:
            order = np.sort(hashed)
            twice = np.unique(order[1:][order[1:] == order[:-1]])
            del order
            again = n[source] == 1
            if len(twice):
                again &= twice[np.minimum(np.searchsorted(twice, hashed), len(twice) - 1)] == hashed
            else:
                again[:] = False
        new = again.copy()
        new[1:] &= ~again[:-1] | (source[1:] != source[:-1])
        last = again.copy()
        last[:-1] &= ~again[1:] | (source[1:] != source[:-1])
        begin, end = np.flatnonzero(new), np.flatnonzero(last)
        own = source[begin]
        place = t.column("first").to_numpy()[own] + begin - begins[own]
        return pa.RecordBatch.from_arrays([t.column("k1").combine_chunks().take(pa.array(own)), t.column("k2").combine_chunks().take(pa.array(own)), pa.array(place), pa.array(place + end - begin + width)], names=FOUND.names)

    def work(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > SORT_BYTES:
                t = pa.Table.from_batches(held)
                g = t.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1], "left"))  # the last group may go on
                if cut:
                    yield solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(b.nbytes for b in held)
        if held and sum(len(b) for b in held):
            yield solve(pa.Table.from_batches(held))

    return entities.repartition("g").sortWithinPartitions("g").mapInArrow(work, FOUND)


def split(entities: DataFrame, block: int, kind: Tokens) -> DataFrame:
    """The next digit of large groups: what all windows of a block share joins the group, what the present ones cover is compared."""
    width, size = kind.width, kind.size

    def work(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                c, core = r["context"], r["core"]
                # windows by how far their core is from their start: the same block in all runs of the group
                near = core - r["windows"] + 1
                for b in range(near // block, core // block + 1):
                    far = min(core, (b + 1) * block - 1)
                    low = core - far
                    high = core - max(near, b * block)
                    inner = c[(core - b * block) * size : (core - (b + 1) * block + 1 + width) * size]
                    part = c[low * size : (high + width) * size]
                    g = xxhash.xxh3_64_intdigest(b"%d:%d:" % (r["g"], b) + inner)
                    u = xxhash.xxh3_64_intdigest(part, seed=high - low + 1)
                    rows.append((g - (g >> 63 << 64), u - (u >> 63 << 64), r["k1"], r["k2"], r["first"] + low, far, high - low + 1, r["n"], 0, part))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary() if i == 9 else pa.int64()) for i, x in enumerate(zip(*rows))] if rows else [pa.array([], pa.binary() if i == 9 else pa.int64()) for i in range(10)], names=CONTEXT.names)

    return entities.mapInArrow(work, CONTEXT)


def grouped(entities: DataFrame, carried: tuple[str, ...], kind: Tokens) -> tuple[DataFrame, DataFrame]:
    """One pass: the intervals of runs that agree with another, and the representatives that go on."""
    member = F.struct("k1", "k2", "first", "core", "windows", *carried)
    known = F.max("n") if "n" in entities.columns else F.lit(1)
    text = F.struct("k1", "k2")
    ends = {"lo": F.min(text), "hi": F.max(text), "low": F.min("first"), "high": F.max("first")} if kind.apart else {"lo": F.lit(0), "hi": F.lit(1), "low": F.lit(0), "high": F.lit(0)}
    kinds = entities.groupBy("g", "u").agg(F.count("*").alias("__members"), known.alias("__known"), F.min(member).alias("one"), *[c.alias(k) for k, c in ends.items()])
    several = (F.col("__members") > 1) & ((F.col("lo") != F.col("hi")) | (F.col("__known") > 1))
    kinds = keep(kinds.withColumn("__n", F.when(several | (F.col("__known") > 1), 2).otherwise(1).cast("long")).withColumn("several", several), "kinds")
    found = entities.join(kinds.where("several").select("g", "u"), ["g", "u"]).select("k1", "k2", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + kind.width).alias("stop"))
    # runs that one text has at several places go on with all of them: what they share with others, each of them does
    often = (F.col("__n") == 1) & (F.col("low") != F.col("high"))
    groups = kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.sum(F.when(often, F.col("__members")).otherwise(1)).alias("m"), F.min("__n").alias("least"), F.max("__n").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    unsettled = groups.where("kinds > 1 and least = 1 and (lo <> hi or most > 1)").select("g", "m")
    onward = kinds.where(~often).join(unsettled, "g").select("g", "u", "one.*", F.col("__n").alias("n"), "m")
    if kind.apart:
        more = keep(kinds.where(often).join(unsettled, "g").select("g", "u", F.col("__n").alias("n"), "m"), "often")
        if n := more.count():
            places = entities.drop("n", "m").join(F.broadcast(more) if n <= BROADCAST_RUNS else more, ["g", "u"])
            onward = onward.unionByName(places.select(*onward.columns).dropDuplicates(["g", "u", "k1", "k2", "first"]))
    return found, onward


def repeated(texts: DataFrame, copies: DataFrame, candidates: DataFrame, kind: Tokens, task_runs: int, bitmap_bits: int) -> DataFrame:
    """(k1, k2, start, stop): intervals of tokens in windows that repeat, overlaps included."""
    found, onward = grouped(candidates, (), kind)
    onward = keep(onward.join(copies, ["k1", "k2"]), "onward")
    n, most = onward.agg(F.count("*"), F.max("m")).first()
    if not n:
        return found
    some = contexts(texts, onward, n, kind, bitmap_bits)
    small = onward.where(F.col("m") <= task_runs)
    if some is None:
        located = joined_contexts(texts, onward, kind)
        located = located if most <= task_runs else keep(located, "located")
        small = located.where(F.col("m") <= task_runs)
    elif most <= task_runs:
        small = some.unionByName(small.drop("__copy"), allowMissingColumns=True)
    else:
        some, key = keep(some, "contexts"), ["g", "u", "k1", "k2", "first"]
        large = onward.where(F.col("m") > task_runs)
        groups = keep(large.select("g").distinct(), "large")
        groups = F.broadcast(groups) if groups.count() <= BROADCAST_RUNS else groups
        both = some.join(groups, "g", "left_semi").select(*CONTEXT.names).unionByName(large.drop("__copy"), allowMissingColumns=True)
        # a run's numbers and its context meet by a sum, which combines the copies of a run before it shuffles them
        located = both.groupBy(*key).agg(F.max("core").alias("core"), F.max("windows").alias("windows"), F.max("n").alias("n"), F.max("m").alias("m"), F.max("context").alias("context"))
        located = located.where("n is not null and context is not null").select(*CONTEXT.names)
        small = some.join(groups, "g", "left_anti").select(*CONTEXT.names).unionByName(small.drop("__copy"), allowMissingColumns=True)
    found = found.unionByName(sorted_groups(small, kind))
    block = (kind.width - kind.core) // 5 + 1
    while most > task_runs:
        parts = keep(split(located.where(F.col("m") > task_runs), block, kind), "parts")
        more, located = grouped(parts, ("context",), kind)
        found = found.unionByName(more)
        if block == 1:  # a block of one window has been compared whole
            break
        located = keep(located.select(*CONTEXT.names), "located")
        most = located.agg(F.max("m")).first()[0] or 0
        found = found.unionByName(sorted_groups(located.where(F.col("m") <= task_runs), kind))
        block = max(1, block // 5)
    return found


def repeated_spans(docs: DataFrame, kinds: tuple[Tokens, ...], text: str = "text", copy_id: str | None = None, task_runs: int = TASK_RUNS, bitmap_bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """docs as __id, text and its keys k1, k2; how often each text is there (k1, k2, __copy, copies); and for each kind its texts' repeated intervals (k1, k2, spans)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    k1, k2 = text_key(whole)
    texts = docs.select((F.col(copy_id) if copy_id else F.lit(0)).alias("__id"), whole.alias("text"), k1.alias("k1"), k2.alias("k2"))
    shared = keep(digits(texts, kinds).groupBy("kind", "g").agg(F.count("*").alias("c")).where("c > 1").select("kind", "g"), "shared")
    bitmap = bitmap_of(shared, "g", shared.count(), bitmap_bits)
    candidates = runs(texts, kinds, bitmap)
    candidates = keep(candidates if bitmap else candidates.join(shared, ["kind", "g"]), "candidates")
    copies = texts.groupBy("k1", "k2").agg(F.min("__id").alias("__copy"), F.count("*").alias("copies"))
    one = copies.select("k1", "k2", "__copy")
    found = [repeated(texts, one, candidates.where(F.col("kind") == i).drop("kind"), kind, task_runs, bitmap_bits) for i, kind in enumerate(kinds)]
    return texts, copies, [keep(f.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "found") for f in found]


def shared_passages(docs: DataFrame, text: str = "text", words: int = PASSAGE, **options) -> DataFrame:
    """(k1, k2, spans): where a text has `words` words and more that a different text has too, in words (start, stop; they overlap); texts are known by text_key()."""
    return repeated_spans(docs, (Tokens(True, words, True),), text, **options)[2][0]


RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("n_shared_words", T.LongType()), T.StructField("kept", T.BinaryType())])


def covered(intervals) -> tuple[list[tuple[int, int]], int]:
    """The intervals (dicts of start and stop), those that touch joined, and what they cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["stop"]) for x in intervals or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out, sum(b - a for a, b in out)


def plain_rows(texts: DataFrame, marked: tuple[np.ndarray, int], schema: T.StructType) -> DataFrame:
    """The result of texts that the bitmap doesn't mark: all of it stays."""
    whole = F.encode("text", "utf-8")
    none = F.lit(0).cast("long")
    columns = {schema.names[0]: F.col("__id"), "n_bytes": F.octet_length("text").cast("long"), "n_removed": none, "n_spans": none, "kept_sha256": F.sha2(whole, 256), "n_shared_words": none, "kept": whole}
    made = texts.select("k1", *[columns[c].alias(f"__{c}") for c in schema.names])
    return sieve(made, "k1", marked, False).select(*[F.col(f"__{c}").alias(c) for c in schema.names])


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = WIDTH, task_runs: int = TASK_RUNS, with_kept: bool = True, words: int = PASSAGE, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words and (unless left out) the remaining bytes of each text.

    n_shared_words: words of the text in windows of `words` words that another row's text has too, whatever their case
    and punctuation; what a text repeats of itself alone doesn't count.
    """
    kinds = (Tokens(False, width), Tokens(True, words, True))
    texts, copies, (gone, shared) = repeated_spans(docs, kinds, text, id_column, task_runs, bitmap_bits)
    fate = gone.withColumnRenamed("spans", "gone").join(shared.withColumnRenamed("spans", "shared"), ["k1", "k2"], "full").join(copies.where("copies > 1").select("k1", "k2", "copies"), ["k1", "k2"], "full")
    fate = keep(fate, "fate")
    schema = T.StructType([T.StructField(id_column, texts.schema["__id"].dataType), *RESULT.fields[: 6 if with_kept else 5]])
    # only texts that something is known of are shuffled
    marked = bitmap_of(fate, "k1", fate.count(), bitmap_bits)
    asked, plain = (sieve(texts, "k1", marked, True), plain_rows(texts, marked, schema)) if marked else (texts, None)
    same = [asked["k1"] == fate["k1"], asked["k2"] == fate["k2"]]
    joined = asked.join(fate.hint("shuffle_hash"), same, "left").select(asked["__id"], "text", "gone", "shared", "copies")

    def work(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            whole = data.tobytes()
            out = []
            for a, b, gone, shared, copies in zip(offsets.tolist(), offsets[1:].tolist(), *(batch.column(c).to_pylist() for c in ("gone", "shared", "copies"))):
                own, at, kept = whole[a:b], 0, []
                merged, removed = covered(gone)
                for x, y in merged:
                    kept.append(own[at:x])
                    at = y
                kept.append(own[at:])
                left = b"".join(kept)
                common = covered(shared)[1]
                if copies:
                    n = len(words_of(np.frombuffer(own, np.uint8), np.array([0, len(own)]))[0])
                    common = n if n >= words else 0
                out.append((len(own), removed, len(merged), hashlib.sha256(left).hexdigest(), common, left))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *[pa.array(c, k) for c, k in zip(columns[: len(schema) - 1], kinds)]], names=schema.names)

    out = joined.mapInArrow(work, schema)
    return out.unionByName(plain) if marked else out


def repeats_report(docs: DataFrame, **options) -> DataFrame:
    """The digest columns of the registered query."""
    return remove_repeats(docs.select("doc_id", "text"), with_kept=False, **options)
