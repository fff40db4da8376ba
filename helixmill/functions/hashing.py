"""Hashes: 32-bit Murmur2 of a big-endian long as Column arithmetic, the 64-bit finalizer in numpy and Python, pair keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

MASK32, MASK64 = (1 << 32) - 1, (1 << 64) - 1
MURMUR2 = 0x5BD1E995
GOLDEN = 0x9E3779B97F4A7C15
FMIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _turned(word: Column) -> Column:
    """The bytes of a 32-bit word in the other order."""
    byte = lambda i: F.shiftright(word, 8 * i).bitwiseAND(F.lit(255))
    return F.shiftleft(byte(0), 24).bitwiseOR(F.shiftleft(byte(1), 16)).bitwiseOR(F.shiftleft(byte(2), 8)).bitwiseOR(byte(3))


def _times(word: Column) -> Column:
    # both factors are below 2**32 and the constant below 2**31, so the product stays within a signed long
    return (word * F.lit(MURMUR2)).bitwiseAND(F.lit(MASK32))


def murmur2(value: Column, seed: int) -> Column:
    """Murmur2 of the value's 8 bytes, most significant first, as 0 .. 2**32 - 1; words are read least significant byte first."""
    h = F.lit((seed ^ 8) & MASK32).cast("long")
    for word in (F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(MASK32))):
        k = _times(_turned(word))
        k = _times(k.bitwiseXOR(F.shiftright(k, 24)))
        h = _times(h).bitwiseXOR(k)
    h = _times(h.bitwiseXOR(F.shiftright(h, 13)))
    return h.bitwiseXOR(F.shiftright(h, 15))


def murmur2_pair(value: Column) -> tuple[Column, Column]:
    return murmur2(value, 0), murmur2(value, 1)


def murmur2_array(value: np.ndarray, seed: int) -> np.ndarray:
    """The same in numpy, as uint32."""
    words = np.ascontiguousarray(value, np.int64).astype(">i8").view("<u4").reshape(-1, 2)
    m, h = np.uint32(MURMUR2), np.full(len(words), (seed ^ 8) & MASK32, np.uint32)
    for i in range(2):
        k = words[:, i] * m
        k = (k ^ (k >> np.uint32(24))) * m
        h = h * m ^ k
    h = (h ^ (h >> np.uint32(13))) * m
    return h ^ (h >> np.uint32(15))


def mix_seed(z: int) -> int:
    """The 64-bit finalizer, on unsigned Python numbers."""
    z &= MASK64
    for factor in FMIX:
        z = (z ^ (z >> 33)) * factor & MASK64
    return z ^ (z >> 33)


def mix_array(values: np.ndarray) -> np.ndarray:
    """Seeded finalizer of signed longs, as signed longs."""
    z = np.ascontiguousarray(values, np.int64).view(np.uint64) ^ np.uint64(GOLDEN)
    for factor in FMIX:
        z = (z ^ (z >> np.uint64(33))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(33))).view(np.int64)


def node_seed(ids, tag: int, seed: int) -> int:
    z = (seed ^ tag) & MASK64
    for i in ids:
        z = mix_seed(z ^ i)
    return z


def unit(seed: int) -> float:
    """A number in [0, 1) from 53 bits of the mixed seed."""
    return (mix_seed(seed) >> 11) * 2.0**-53


def pair_key(a: Column, b: Column) -> Column:
    """The smaller id in the high half, the larger in the low half."""
    return F.shiftleft(F.least(a, b).cast("long"), 32).bitwiseOR(F.greatest(a, b).cast("long"))


def mixed(df, column: str, name: str):
    """df with the finalizer of a long column (wrapping arithmetic, so in numpy over Arrow batches)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mix_array(batch.column(column).to_numpy(zero_copy_only=False)))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))
