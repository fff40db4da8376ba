"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of its five-word shingles (a shorter one is one shingle of all its words): a shingle
weighs its count times the mean inverse document frequency of its words, counted over all documents in a table of
fixed size (frequencies of the shingles themselves would tell the copies of a large group from each other by the little
that one of them has alone, and need a table that grows with the input). BANDS x ROWS consistent weighted samples are banded; documents that share a band are candidates, and
weighted Jaccard similarity on whole texts decides (SIMILARITY or more). Linked documents form a class.

Texts are the nodes, so exact copies are one node. In each bucket the member with the most bucket mates is the centre,
and members are verified against it; then classes are taken. Members outside their centre's class go on against all
members of other classes, after two tests within the join: what a text has in common with any other text in question,
part by part of the hash, bounds its similarity from above (near copies that each have edits of their own aren't near
each other), and samples that agree in fewer than MIN_AGREE of 56 places aren't worth a comparison (at similarity 0.8
that has a chance of one in a hundred million, far below that of sharing no band). So a group of near copies costs about one comparison each, no bucket is capped, and no group
meets in one task: joins are on texts and buckets and split by the skew-join rules. With SIMILARITY 0.8 a pair shares
a band with a probability of 1 - (1 - 0.8 ** 4) ** 14 = 0.9994, and more above.

Classes are found by label propagation with pointer jumping on tables in the shared folder; nothing but counts and
the frequency table comes to the driver.

Defined cases: null and wordless texts are alone in their class; repeated rows share a class; null ids get the class
of their text, whose id is the smallest known; further columns are ignored or kept, an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from helixmill.llm.common import chunks, fresh, keep, mix, text_bytes, text_number
from helixmill.llm.decontaminate import words_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
MIN_AGREE = 26
#: Hashed slots of the document-frequency table: its size is fixed, so it can be broadcast.
SLOTS = 1 << 18
SLOT_SHIFT = np.uint64(64 - 18)
#: Parts of the hash by which shareable weights are bounded; a power of two.
PARTS = 64
BLOCK = 1 << 12
#: Text bytes for one sampling pass: its arrays stay in the processor's cache.
PASS_BYTES = 1 << 18


# ---- document frequencies ----


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have a word of each slot, and how many have words, over all documents."""

    def count(batches):
        held, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets, PASS_BYTES):
                hashes, first = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row = np.repeat(np.arange(b - a), np.diff(first))
                seen = np.unique(row * SLOTS + (hashes >> SLOT_SHIFT).astype(np.int64))
                held += np.bincount(seen % SLOTS, minlength=SLOTS)
                n += int((np.diff(first) > 0).sum())
        if n:
            blocks = held.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(blocks)), -1], pa.int32()), pa.array([*(x.tobytes() for x in blocks), np.int64(n).tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                x = np.frombuffer(x, np.int64)
                total[k] = total[k] + x if k in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()  # SLOTS / BLOCK + 1 rows
    out, n = np.zeros(SLOTS, np.int64), 0
    for r in rows:
        x = np.frombuffer(bytes(r["counts"]), np.int64)
        if r["block"] < 0:
            n = int(x[0])
        else:
            out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = x
    return out, n


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + counts)) + 1).astype(np.float32)


# ---- weighted sets ----


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row, hash, weight; by row, then by hash."""
    hashes, first = words_of(data, offsets)
    per = np.diff(first)
    of_word = idf[(hashes >> SLOT_SHIFT).astype(np.int64)] if len(hashes) else np.zeros(0, np.float32)
    n = len(hashes)
    row = np.repeat(np.arange(len(per)), per)
    left = first[1:][row] - np.arange(n)  # words from here to the row's end
    length = np.minimum(per, SHINGLE)[row]
    begin = np.flatnonzero(left >= length)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    weights = np.concatenate([of_word, np.zeros(SHINGLE, np.float32)])
    code, total = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.float32)
    for k in range(SHINGLE):
        inside = k < length[begin]
        code = np.where(inside, mix(code * np.uint64(0x9FB21C651E98DF25) + padded[begin + k]), code)
        total += np.where(inside, weights[begin + k], 0)
    total /= np.maximum(length[begin], 1)
    r = row[begin]
    order = np.lexsort((code, r))
    r, code, total = r[order], code[order], total[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(r)))
    return r[at], code[at], total[at] * times.astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets as (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    least = float(np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64))
    return least / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - least)


SALTS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
UNIT = np.float32(1 / 65536)
LOW16 = np.uint64(0xFFFF)


def samples(row: np.ndarray, code: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """Consistent weighted samples of each row, as 64-bit codes (rows x BANDS * ROWS); rows without shingles get zeros."""
    out = np.zeros((n_rows, BANDS * ROWS), np.uint64)
    if not len(row):
        return out
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    of = row[begin]
    turn = np.cumsum(np.concatenate([[False], row[1:] != row[:-1]]))
    log_weight = np.log(weight.astype(np.float32))
    unit = lambda x, shift: ((x >> np.uint64(shift)) & LOW16).astype(np.float32) * UNIT + UNIT / 2
    for k in range(BANDS * ROWS):
        x = (code ^ SALTS[2 * k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        r = -np.log(unit(x, 0) * unit(x, 16))  # Gamma(2, 1)
        c = -np.log(unit(x, 32) * unit(x, 48))
        beta = ((x * SALTS[2 * k + 1]) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_weight / r + beta)
        a = np.log(c) - r * (t - beta + 1)
        low = np.minimum.reduceat(a, begin)
        hit = np.flatnonzero(a == low[turn])
        own = turn[hit]
        one = hit[np.concatenate([[True], own[1:] != own[:-1]])]
        out[of, k] = mix(code[one] + t[one].astype(np.int64).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
    return out


#: A text's number: 120 bits of its digest, so that no two texts of any corpus are taken for one.
NODE = T.DecimalType(38, 0)
SIGNATURES = T.StructType([T.StructField("node", NODE), T.StructField("id", T.StringType()), T.StructField("agree", T.ArrayType(T.ByteType())), T.StructField("weight", T.DoubleType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """node, id, one byte of each sample, and band keys; null for texts without words. docs holds node, id, text."""
    sent = docs.sparkSession.sparkContext.broadcast(idf)
    schema = T.StructType([docs.schema["node"], docs.schema["id"], *SIGNATURES.fields[2:]])

    def work(batches):
        table = sent.value
        band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets, PASS_BYTES):
                row, code, weight = weighted_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)
                got = samples(row, code, weight, b - a)
                some = np.bincount(row, minlength=b - a) > 0
                keys = np.zeros((b - a, BANDS), np.uint64)
                for k in range(ROWS):
                    keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + got[:, k::ROWS])
                keys = mix(keys + band)
                hidden = ~some
                per = lambda x, w, kind: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().view(kind)), w).cast(pa.list_(pa.from_numpy_dtype(kind)))
                agree, bands = per((got >> np.uint64(56)).astype(np.uint8), BANDS * ROWS, np.int8), per(keys, BANDS, np.int64)
                null = pa.array(hidden)
                blank = lambda x: pa.compute.if_else(null, pa.scalar(None, x.type), x)
                part = batch.slice(a, b - a)
                total = pa.array(np.bincount(row, weights=weight, minlength=b - a).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("id"), blank(agree), total, blank(bands)], names=schema.names)

    return docs.select("node", "id", "text").mapInArrow(work, schema)


# ---- verification ----


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """The pairs (x, y) of nodes whose texts are similar enough."""
    sent = pairs.sparkSession.sparkContext.broadcast(idf)

    def work(batches):
        table, held = sent.value, {}

        def of(node, text):
            if node not in held:
                if len(held) > 64:
                    held.clear()
                data, offsets = text_bytes(pa.array([text], pa.string()))
                held[node] = weighted_shingles(data, offsets, table)[1:]
            return held[node]

        for batch in batches:
            for at in range(0, len(batch), 64):  # few texts at a time outside Arrow's buffers
                part = batch.slice(at, 64)
                x, y, tx, ty = (part.column(c).to_pylist() for c in ("x", "y", "tx", "ty"))
                ok = pa.array([i for i in range(len(x)) if similarity(of(x[i], tx[i]), of(y[i], ty[i])) >= least], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("x").take(ok), part.column("y").take(ok)], names=["x", "y"])

    one = texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    other = texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))
    # the text of y comes last, so that equal centres stand together
    return pairs.join(one, "x").join(other, "y").select("x", "y", "tx", "ty").mapInArrow(work, "x decimal(38,0), y decimal(38,0)")


# ---- classes ----


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node it is linked to, over any number of steps); links is a kept table of (x, y).

    Ends when nothing moves; each round halves the way to the smallest node at least."""
    both = keep(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "edges")
    labels = keep(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("label", "near").alias("next"), "label")
        # a label is a node as well: take over what it has found
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = keep(hooked.join(jump, "next").select("node", F.least("next", "further").alias("label"), F.col("label").alias("before")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> before").isEmpty():
            return labels


def shareable_weights(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, free): the weight of those shingles that others of the texts have too, by PARTS parts of the hash.

    Two texts share at most the sum of the smaller weights of each part; what each has lost of a common original falls
    into different parts, so the bound is close.
    """
    sent = texts.sparkSession.sparkContext.broadcast(idf)

    def sets(batch):
        data, offsets = text_bytes(batch.column("text"))
        for a, b in chunks(offsets, PASS_BYTES):
            yield a, b, weighted_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], sent.value)

    def spread(batches):
        for batch in batches:
            for a, b, (row, code, weight) in sets(batch):
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row + a)), pa.array(code.view(np.int64)), pa.array(weight)], names=["node", "shingle", "weight"])

    def gather(batches):
        for batch in batches:
            own = batch.column("own").to_pylist()
            for a, b, (row, code, weight) in sets(batch):
                whole = np.bincount(row * PARTS + (code % np.uint64(PARTS)).astype(np.int64), weights=weight, minlength=(b - a) * PARTS).astype(np.float64).reshape(b - a, PARTS)
                for i in range(a, b):
                    for x in own[i] or ():
                        whole[i - a, x["part"]] -= x["weight"]
                free = pa.FixedSizeListArray.from_arrays(pa.array(np.maximum(whole, 0).astype(np.float32).ravel()), PARTS).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), free], names=["node", "free"])

    shingles = texts.select("node", "text").mapInArrow(spread, "node decimal(38,0), shingle long, weight float")
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.max("weight").alias("weight")).where("n = 1")
    own = alone.groupBy("node", F.col("shingle").bitwiseAND(F.lit(PARTS - 1)).cast("int").alias("part")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    own = own.groupBy("node").agg(F.collect_list(F.struct("part", "weight")).alias("own"))
    return texts.select("node", "text").join(own.hint("shuffle_hash"), "node", "left").mapInArrow(gather, "node decimal(38,0), free array<float>")


def near_labels(docs: DataFrame, idf: np.ndarray, least: float) -> tuple[DataFrame, DataFrame]:
    """(signatures of all documents; node and label of the nodes that may have company: equal labels are one class). docs holds node, id, text."""
    signed = keep(signatures(docs, idf), "signatures")
    nodes = signed.where("bands is not null")
    members = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    sizes = keep(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = keep(members.join(sizes, "bucket"), "members")
    some = members.groupBy("node").agg(F.sum("size").alias("mates"))
    marks = nodes.groupBy("node").agg(F.min("id").alias("__id"), F.max(F.struct("weight", "agree", "bands")).alias("of")).join(some, "node")
    marks = keep(marks.select("node", "__id", "mates", "of.weight", "of.agree", "of.bands"), "marks")
    chosen = marks.select("node", "__id").hint("shuffle_hash")
    texts = keep(docs.join(chosen, "node").where(F.col("id").eqNullSafe(F.col("__id"))).select("node", "text").dropDuplicates(["node"]), "texts")
    members = keep(members.select("bucket", "node").join(marks.drop("__id", "bands"), "node"), "marked")
    agreeing = F.size(F.filter(F.zip_with("ax", "ay", lambda a, b: a == b), lambda e: e)) >= MIN_AGREE

    def compare(few: DataFrame, many: DataFrame, condition) -> DataFrame:
        """Links between few (bucket, y, ay, ...) and members of their buckets (x, ax, ...); y stays the centre, so its text is prepared once."""
        pairs = many.join(few, "bucket").where((F.col("x") != F.col("y")) & agreeing & condition)
        return keep(verified(keep(pairs.select("x", "y").distinct(), "pairs"), texts, idf, least), "links")

    top = F.max(F.struct("mates", "node", "agree")).alias("top")
    centres = keep(members.groupBy("bucket").agg(top).select("bucket", F.col("top.node").alias("y"), F.col("top.agree").alias("ay")), "centres")
    links = compare(centres, members.select("bucket", F.col("node").alias("x"), F.col("agree").alias("ax")), F.lit(True))
    labels = components(links)
    placed = keep(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    all_labels = placed.select("node", "label").distinct()
    main = centres.select("bucket", F.col("y").alias("node")).join(all_labels, "node").select("bucket", F.col("label").alias("main"))
    ruled = keep(placed.join(main, "bucket"), "ruled")
    open_buckets = keep(ruled.where("label <> main").select("bucket").distinct(), "open")
    inside = ruled.join(open_buckets, "bucket", "left_semi")
    asked = keep(inside.select("node").distinct(), "asked")
    least_free = least - 1e-4  # room for single precision
    free = keep(shareable_weights(texts.join(asked, "node", "left_semi"), idf), "free")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    able = free.join(marks.select("node", "bands"), "node")
    bounded = keep(inside.join(able, "node").where(total("free") >= least_free * F.col("weight")), "bounded")
    shared = total(F.zip_with("fx", "fy", lambda a, b: F.least(a, b)))
    able = (F.col("lx") != F.col("ly")) & (shared * (1 + least_free) >= least_free * (F.col("wx") + F.col("wy")))
    able &= F.array_min(F.array_intersect("bx", "by")) == F.col("bucket")  # a pair comes up in the first bucket that it shares, not in each
    side = lambda df, s: df.select("bucket", F.col("node").alias(s), F.col("agree").alias(f"a{s}"), F.col("label").alias(f"l{s}"), F.col("weight").alias(f"w{s}"), F.col("free").alias(f"f{s}"), F.col("bands").alias(f"b{s}"))
    more = compare(side(bounded.where("label <> main"), "y"), side(bounded, "x"), able)
    between = more.join(all_labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), "x").join(all_labels.select(F.col("node").alias("y"), F.col("label").alias("ly")), "y")
    joined = components(keep(between.select(F.col("lx").alias("x"), F.col("ly").alias("y")), "between"))
    final = all_labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("whole")), "label", "left")
    return signed, keep(final.select("node", F.coalesce("whole", "label").alias("label")), "classes")


def prepared(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), whole.alias("text"), text_number(whole).alias("node"))


def near_classes(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """node (the text's number), id, class_id (the smallest id of the class), class_size, is_first; a row for each document."""
    own = prepared(docs, text, id_column)
    idf = inverse_frequencies(*document_frequencies(own))
    signed, labels = near_labels(own, idf, least)
    rows = signed.select("node", "id", F.col("bands").isNull().alias("alone")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "node")).alias("first")
    # kept, so that the join below has an exchange on either side, whose hot classes it can split
    classes = keep(rows.where("not alone").groupBy("label").agg(first, F.count("*").alias("size")), "class_sizes")
    joined = rows.join(classes, "label", "left")
    return joined.select(
        "node",
        "id",
        F.when(F.col("alone"), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.when(F.col("alone"), F.lit(1).cast("long")).otherwise(F.col("size")).alias("class_size"),
        (F.col("alone") | ((F.col("node") == F.col("first.node")) & F.col("id").eqNullSafe(F.col("first.id")))).alias("is_first"),
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class, that with the smallest id; texts without words stay. Of rows with one id and text one is left."""
    node, name = fresh(docs.columns, "__node", "__name")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chosen = near_classes(docs, text, id_column, least).where("is_first").select(F.col("node").alias(node), named("id").alias(name)).distinct()
    keyed = docs.withColumns({node: text_number(F.coalesce(F.col(text), F.lit(""))), name: named(id_column)})
    return keyed.join(chosen.hint("shuffle_hash"), [node, name]).dropDuplicates([node, name]).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return near_classes(docs.select("doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", "class_size")
