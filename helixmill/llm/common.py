"""What several training-data operators share: table access, durable intermediate tables, byte-level word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixmill.functions.lineage import shared_dir

CHUNK_BYTES = 1 << 19  # text bytes that one numpy pass takes (its arrays take some hundred times that); a longer text is a chunk of its own


def fresh(columns, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, so a lost executor costs only what it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixmill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: list[str] = []


def drop_kept(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes the tables that keep() has written in this process from the number `since` on, but for the last `but`; for when the results made from them are stored."""
    jvm = spark.sparkContext._jvm
    gone = _kept[since : len(_kept) - but]
    del _kept[since : len(_kept) - but]
    for path in gone:
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def n_kept() -> int:
    return len(_kept)


def text_key(text: Column) -> tuple[Column, Column]:
    """120 bits of the text's SHA-256 as two numbers, never null."""
    hexed = F.sha2(text, 256)
    part = lambda i: F.coalesce(F.conv(F.substring(hexed, i, 15), 16, 10).cast("long"), F.lit(0))
    return part(1), part(17)


def text_number(text: Column) -> Column:
    """The same 120 bits as one number."""
    k1, k2 = text_key(text)
    return (k1.cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)")).cast("decimal(38,0)") + k2.cast("decimal(19,0)")


# ---- text columns of Arrow batches as bytes ----


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes (one row at least)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        to = min(max(to, row + 1), rows)
        yield row, to
        row = to


# ---- hashes ----

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


KEPT_POWERS = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses, modulo 2**64; kept up to the usual chunk length, so that one long text doesn't fill a worker for good."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def rolling(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums h and inverse powers q, so that (h[e] - h[s]) * q[s] is a hash of codes[s:e] alone."""
    p, q = powers(len(codes) + 1)
    h = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * p[:-1], out=h[1:])
    return h, q


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a row's start also ends a run."""
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h, q = rolling(BYTE_CODES[data])
    return mix((h[ends] - h[starts]) * q[starts] + (ends - starts).astype(np.uint64))


# ---- row-local Python operators ----


def map_in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name, which Spark itself looks up unquoted."""
    names = df.columns

    def renamed(batches):
        return run(pa.RecordBatch.from_arrays(batch.columns, names=names) for batch in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, schema)


def append_columns(docs: DataFrame, text: str, fields, start, drop: tuple[str, ...] = (), most: int = CHUNK_BYTES) -> DataFrame:
    """docs without `drop`, with the columns `fields` (a StructType) appended; they replace columns of their names.

    start() runs once in each task and returns work(data, offsets), which takes some rows' text as bytes and returns an
    Arrow array or a list for each field. Rows stay where they are; memory is bound by `most` bytes or the longest text.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    names = [f.name for f in fields]
    gone = {c.lower() for c in (*drop, *names)}
    kept = [c for c in docs.columns if c.lower() not in gone]
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([*[docs.schema[c] for c in kept], *fields])

    def run(batches):
        work = start()
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            made = [work(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, most)]
            if made:
                new = [pa.concat_arrays([pa.array(x[i], kinds[i]) if not isinstance(x[i], pa.Array) else x[i].cast(kinds[i]) for x in made]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*kept, *names])

    return map_in_arrow(docs, run, schema)


def lists(values, lengths) -> pa.Array:
    """An Arrow list column from its concatenated values and each row's length."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), values if isinstance(values, pa.Array) else pa.array(values))


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii()
