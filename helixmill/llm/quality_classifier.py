"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal, scored as sparse dot products.

Tokens are runs of letters and digits and runs of other visible characters. Features are hashes of token uni- and
bigrams and of their shapes (case pattern, or the marks themselves, and whether a token repeats its predecessor), as
shares of the document's n-grams, in a table of fixed size. Only the text enters a score.

Training takes at most MAX_TRAIN_ROWS labelled rows of MAX_TRAIN_BYTES of text (documented bounds, chosen by a hash of the
id), whose sparse features (not texts) go to the driver; the weights (SLOTS float32) are broadcast, and scoring is
row-local: no shuffle, no key.

Defined cases: a null, empty or blank text scores the intercept; repeated rows score alike and are learnt once; rows
without label or id are not trained on, an id with both labels or several texts is trained on with each; with no labelled
rows at all every score is 0.5; further columns are kept, but one named score or predicted, which the result's replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from helixmill.llm.common import LOWER, append_columns, lists, mix, span_hashes, spans

SLOTS = 1 << 18
#: Labelled rows, and bytes of their text, that training takes at most.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 6000, 64 << 20
FOLDS, THRESHOLD = 5, 0.3
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.3, 1.0, 1e-4, 1e-4, 4, 8.0

_class = np.full(256, 1, np.uint8)  # 0 space, 1 other visible, 2 word
_class[[*range(9, 14), 32, *range(0, 9), *range(14, 32), 127]] = 0
_class[48:58] = _class[65:91] = _class[97:123] = _class[128:] = 2


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, their shapes' hashes, whether they are words, and each row's first token (n + 1 of them)."""
    kind = _class[data]
    w = spans(kind == 2, offsets)
    m = spans(kind == 1, offsets)
    starts, ends = np.concatenate([w[0], m[0]]), np.concatenate([w[1], m[1]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    word = order < len(w[0])
    hashes = span_hashes(LOWER[data], starts, ends)
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    length = ends - starts
    upper, digit = capitals[ends] - capitals[starts], digits[ends] - digits[starts]
    first_upper = (capitals[np.minimum(starts + 1, len(data))] - capitals[starts]) > 0 if len(starts) else np.zeros(0, bool)
    shape = np.where(digit == length, 1, np.where(digit > 0, 2, np.where(upper == 0, 3, np.where((upper == 1) & first_upper, 4, np.where(2 * upper >= length, 5, 6)))))
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    shape = np.where(word, mix((shape * 2 + again).astype(np.uint64) + np.uint64(1)), hashes)
    return hashes, shape, word, np.searchsorted(starts, offsets)


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of all rows, and each row's count."""
    hashes, shape, _, first = tokens_of(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    inner = np.flatnonzero(row[1:] == row[:-1])
    salt = [np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xCBBB9D5DC1059ED8, 0x629A292A367CD507)]
    grams = [hashes * salt[0] | np.uint64(1), mix(hashes[inner] * salt[1] + hashes[inner + 1]), mix(shape ^ salt[2]), mix(shape[inner] * salt[3] + shape[inner + 1])]
    slots = np.concatenate([(mix(g) >> np.uint64(64 - 18)).astype(np.int64) for g in grams])
    rows = np.concatenate([row, row[inner], row, row[inner]])
    return slots, rows


FEATURES = T.StructType([T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def featurize(docs: DataFrame, text: str) -> DataFrame:
    """docs without text, with each row's distinct slots and their counts."""

    def start():
        def work(data, offsets):
            slots, rows = features_of(data, offsets)
            keys, counts = np.unique(rows * SLOTS + slots, return_counts=True)
            per = np.bincount(keys // SLOTS, minlength=len(offsets) - 1)
            return [lists((keys % SLOTS).astype(np.int32), per), lists(counts.astype(np.int32), per)]

        return work

    return append_columns(docs, text, FEATURES, start, (text,))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal over (slots, counts, label), in the given order; the last is the intercept."""
    z, n, w = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for _ in range(epochs):
        for slots, counts, label in rows:
            at = np.append(slots, SLOTS)
            x = np.append(SCALE * counts / max(1, counts.sum()), 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - label) * x
            n[at] = ni + g * g
            z[at] = zi + g - (np.sqrt(n[at]) - np.sqrt(ni)) / ALPHA * wi
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32)


def remainder(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def chosen_rows(docs: DataFrame, labels: DataFrame, text: str, label: str, most: int, most_bytes: int) -> list[tuple]:
    """(doc_id, text's hash, label) to learn from, in order: the first of all labelled rows outside the held-out fold by a hash of their id, up to `most` rows and `most_bytes` of text.

    Labels whose document isn't there go before anything is counted, so they take no row's place."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("__label")).where((remainder(F.col("doc_id")) != 0) & F.col("__label").isin(0, 1))
    turn = F.xxhash64("doc_id", F.lit(17)).alias("__turn")
    first = usable.distinct().join(docs.select("doc_id"), "doc_id", "left_semi").select("*", turn).orderBy("__turn", "doc_id", "__label").limit(most)  # a row of three numbers each
    sized = docs.select("doc_id", F.xxhash64(text).alias("__hash"), F.coalesce(F.octet_length(text), F.lit(0)).alias("__bytes"))
    rows = sized.join(F.broadcast(first), "doc_id").dropDuplicates(["doc_id", "__hash", "__label"]).orderBy("__turn", "doc_id", "__label", "__hash").limit(most).collect()
    out, held = [], 0
    for r in rows:
        held += r["__bytes"]
        if held > most_bytes and out:
            break
        out.append((r["doc_id"], r["__hash"], r["__label"]))
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", most: int = MAX_TRAIN_ROWS, most_bytes: int = MAX_TRAIN_BYTES) -> np.ndarray:
    """Weights from at most `most` labelled rows with `most_bytes` of text outside the held-out fold; equal rows count once."""
    spark, rows = docs.sparkSession, chosen_rows(docs, labels, text, label, most, most_bytes)
    if not rows:
        return ftrl([])
    kind = T.StructType([docs.schema["doc_id"], T.StructField("__hash", T.LongType()), T.StructField("__label", T.IntegerType()), T.StructField("__place", T.IntegerType())])
    chosen = F.broadcast(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], kind))  # few by the bound above
    wanted = docs.select("doc_id", F.xxhash64(text).alias("__hash"), F.col(text).alias("text")).join(chosen, ["doc_id", "__hash"]).dropDuplicates(["__place"])
    t = featurize(wanted.select("__place", "__label", "text"), "text").toArrow()  # flat arrays, not Python lists of numbers
    slots, counts = t.column("slots").combine_chunks(), t.column("counts").combine_chunks()
    place, label_of = t.column("__place").to_numpy(), t.column("__label").to_numpy()
    return ftrl([(slots[i].values.to_numpy(), counts[i].values.to_numpy(), int(label_of[i])) for i in np.argsort(place).tolist()])


SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with `score`, the estimated probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def start():
        w = sent.value

        def work(data, offsets):
            slots, rows = features_of(data, offsets)
            n = len(offsets) - 1
            total = np.bincount(rows, weights=w[slots], minlength=n)
            margin = SCALE * total / np.maximum(1, np.bincount(rows, minlength=n)) + w[-1]
            return [pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))]

        return work

    return append_columns(docs, text, SCORE, start, drop)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    return score(docs, train(docs, labels, text), text, drop).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classifier_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    out = classify(docs.select("doc_id", "text"), labels, drop=("text",))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
