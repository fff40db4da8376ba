"""Sizes and limits that plans are built from: as Python functions, and as Column expressions where a frame asks for many."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

MIN_K, MAX_K = 11, 37
MIN_GENOMES = 10
DEFAULT_FPP = 1e-5
MAX_SHARD_BITS = (1 << 31) - 1
MAX_SHARDS = 128
LN2_SQUARED = math.log(2) ** 2


def kmer_parameters(k: int) -> tuple[int, int, int]:
    """(k, step, m): k odd and in range, step even, m = k - step odd."""
    k = min(max(k + 1 - k % 2, MIN_K), MAX_K)
    step = math.isqrt(k) // 2 * 2
    return k, step, k - step


def kmer_columns(k: Column) -> tuple[Column, Column, Column]:
    odd = F.least(F.greatest(k + 1 - F.abs(k % 2), F.lit(MIN_K)), F.lit(MAX_K)).cast("int")
    root = F.floor(F.sqrt(odd)).cast("int")
    step = (root - root % 2).cast("int")
    return odd, step, (odd - step).cast("int")


def sample_size(n: int) -> int:
    """Pairs to compare among n genomes for the global similarity statistics."""
    return int(1000 + n * math.log(n) ** 2) if n > 1 else 1000


def calibration_budget(n: int) -> int:
    return min(n * (n - 1) // 2, math.ceil(math.log(max(2, n)) ** 3))


def growth_weight(zero: int, positive: int) -> float:
    """How far the leader limit moves from sqrt(n) towards n, by the odds of related pairs."""
    if positive <= 0:
        return 0.0
    if zero <= 0:
        return 1.0
    odds = math.log(positive / zero)
    return 0.5 + 0.5 * odds / (1 + abs(odds))


def growth_weight_column(zero: Column, positive: Column) -> Column:
    odds = F.ln(positive / zero)
    return F.when(positive <= 0, F.lit(0.0)).when(zero <= 0, F.lit(1.0)).otherwise(0.5 + 0.5 * odds / (1 + F.abs(odds)))


def leader_limit(n: int, zero: int, positive: int) -> int:
    if n <= 1:
        return n
    root = math.sqrt(n)
    return max(1, min(n, math.ceil(root + (n - root) * growth_weight(zero, positive))))


def leader_limit_column(n: Column, zero: Column, positive: Column) -> Column:
    root = F.sqrt(n)
    grown = F.ceil(root + (n - root) * growth_weight_column(zero, positive))
    return F.when(n <= 1, n.cast("long")).otherwise(F.greatest(F.lit(1), F.least(n.cast("long"), grown)))


def adaptive_bound(n: int, mean: float, std: float, global_mean: float, global_std: float) -> int:
    """Most clusters of a node: ln(1 + n), more where the node is more diverse than the whole, at most sqrt(n)."""
    if n <= 1:
        return max(n, 0)
    base = math.log1p(n)
    usable = all(map(math.isfinite, (mean, std, global_mean, global_std))) and min(mean, std, global_mean) >= 0 and global_std > 0
    if not usable:
        return min(n, math.ceil(base))
    spread = 1 + max(0.0, (global_mean - mean) / global_std) + max(0.0, (std - global_std) / global_std)
    return min(n, max(2, math.ceil(min(spread * base, math.sqrt(n)))))


def adaptive_bound_column(n: Column, mean: Column, std: Column, global_mean: Column, global_std: Column) -> Column:
    base = F.log1p(n)
    usable = (mean >= 0) & (std >= 0) & (global_mean >= 0) & (global_std > 0)
    spread = 1 + F.greatest(F.lit(0.0), (global_mean - mean) / global_std) + F.greatest(F.lit(0.0), (std - global_std) / global_std)
    grown = F.greatest(F.lit(2), F.ceil(F.least(spread * base, F.sqrt(n))))
    return F.when(n <= 1, F.greatest(n.cast("long"), F.lit(0))).otherwise(F.least(n.cast("long"), F.when(usable, grown).otherwise(F.ceil(base))))


# ---- Bloom filters ----


def is_prime(n: int) -> bool:
    if n < 2:
        return False
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    for p in small:
        if n % p == 0:
            return n == p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in small:  # deterministic far beyond 64 bits' needs here
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def shard_capacity(fpp: float) -> int:
    """Elements that a shard of the most bits takes."""
    return int(MAX_SHARD_BITS * LN2_SQUARED / -math.log(fpp))


def bloom_parameters(capacity: int, fpp: float = DEFAULT_FPP) -> tuple[int, int, int, int]:
    """(shards, capacity of a shard, bits of a shard, hashes) of a filter."""
    if capacity < 1:
        raise ValueError("a Bloom filter needs a capacity of 1 at least")
    most = shard_capacity(fpp)
    shards = 1
    while shards * most < capacity:
        shards *= 2
    if shards > MAX_SHARDS:
        raise ValueError(f"{capacity} elements at {fpp} need more than {MAX_SHARDS} shards")
    own = -(-capacity // shards)
    bits = max(2, math.ceil(-(own * math.log(fpp)) / LN2_SQUARED))
    while not is_prime(bits):
        bits += 1
    if bits > MAX_SHARD_BITS:
        raise ValueError("a shard would need more bits than it can have")
    return shards, own, bits, math.ceil(bits / own * math.log(2))


def bloom_estimate(bits: Column, hashes: Column, set_bits: Column) -> Column:
    """Distinct elements, from the bits that are set."""
    full = F.lit((1 << 63) - 1)
    return F.when(set_bits == 0, F.lit(0).cast("long")).when(set_bits >= bits, full).otherwise(F.round(-bits / hashes * F.ln(1 - set_bits / bits)).cast("long"))


def bloom_fpp(bits: Column, hashes: Column, inserted: Column) -> Column:
    return F.pow(1 - F.exp(-hashes * inserted / bits), hashes)
