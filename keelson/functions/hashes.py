"""Bit-exact hashes and checksums, as vectorised functions and as Spark columns.

They run as Arrow batches in numpy, since Spark has no 64-bit wrap-around
multiplication and its crc32 is another polynomial.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of 64-bit FNV-1, and the reversed Castagnoli polynomial.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 1099511628211
CASTAGNOLI = 0x82F63B78
#: What a stored checksum is masked with: a rotation by 15 bits and this sum.
MASK_DELTA = 0xA282EAD8


def crc_table(polynomial: int = CASTAGNOLI) -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (polynomial if i & 1 else 0)
        out.append(i)
    return out


def crc32c_bytes(data: bytes, crc: int = 0) -> int:
    """Extend `crc` by the bytes."""
    table, c = _TABLE, crc ^ 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ table[(c ^ b) & 0xFF]
    return c ^ 0xFFFFFFFF


_TABLE = crc_table()


def mask_crc(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def unmask_crc(masked: int) -> int:
    rot = (masked - MASK_DELTA) & 0xFFFFFFFF
    return ((rot >> 17) | (rot << 15)) & 0xFFFFFFFF


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """All checksums at once: one step per byte position over the strings still that long."""
    size = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    data, start = np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size
    table, c = np.array(_TABLE, np.uint32), np.full(len(values), 0xFFFFFFFF, np.uint32)
    for i in range(int(size.max(initial=0))):
        live = order[: int(np.searchsorted(-size[order], -i))]
        c[live] = (c[live] >> 8) ^ table[(c[live] ^ data[start[live] + i]) & 0xFF]
    return c ^ np.uint32(0xFFFFFFFF)


def fnv64_many(values: np.ndarray) -> np.ndarray:
    """FNV over the eight bytes of each integer, least first, as unsigned numbers."""
    h, v = np.full(len(values), FNV_BASIS, np.uint64), values.astype(np.int64).view(np.uint64).copy()
    for _ in range(8):
        h = (h ^ (v & np.uint64(0xFF))) * np.uint64(FNV_PRIME)
        v >>= np.uint64(8)
    return h


def murmur_like(data: bytes, seed: int) -> int:
    """The 32-bit hash of Bloom filters."""
    # Multiplier and shifts of this hash.
    m, r = 0xC6A4A793, 24
    h = (seed ^ (len(data) * m)) & 0xFFFFFFFF
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (h + int.from_bytes(data[i : i + 4], "little")) * m & 0xFFFFFFFF
        h ^= h >> 16
    if rest := data[whole:]:
        h = (h + int.from_bytes(rest, "little")) * m & 0xFFFFFFFF
        h ^= h >> r
    return h


def bloom_hash(data: bytes) -> int:
    # Fixed value: the seed.
    return murmur_like(data, 0xBC9F1D34)


# Fixed value: a large prime below 2 ** 64.
PRIME64 = 18446744073709551557


def mul_hash_many(values: np.ndarray) -> np.ndarray:
    """The integer times a large prime, modulo 2 ** 64."""
    return values.astype(np.int64).view(np.uint64) * np.uint64(PRIME64)


def one_at_a_time(data: bytes) -> int:
    """Jenkins' 32-bit hash, a byte at a time."""
    h = 0
    for b in data:
        h = (h + b) * 1025 & 0xFFFFFFFF
        h ^= h >> 6
    h = h * 9 & 0xFFFFFFFF
    h ^= h >> 11
    return h * 32769 & 0xFFFFFFFF


def murmur3(data: bytes, seed: int = 0) -> int:
    """The public 32-bit hash, version 3."""
    # Multipliers and rotations of this hash.
    c1, c2 = 0xCC9E2D51, 0x1B873593
    turn = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    h = seed
    for i in range(0, len(data), 4):
        k = turn(int.from_bytes(data[i : i + 4], "little") * c1 & 0xFFFFFFFF, 15) * c2 & 0xFFFFFFFF
        h ^= k
        if i + 4 <= len(data):
            h = (turn(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def mul_hash(column: Column) -> Column:
    """The 64 bits of mul_hash_many() of a bigint column, as a bigint."""

    @F.pandas_udf("bigint")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(mul_hash_many(values.to_numpy()).view(np.int64))

    return run(column)


def text_hash(column: Column, kind: str = "murmur3") -> Column:
    """murmur3 or one_at_a_time of a string column's UTF-8; null for null.  Distinct values of a batch are hashed once."""
    of = {"murmur3": murmur3, "one_at_a_time": one_at_a_time}[kind]

    @F.pandas_udf("bigint")
    def run(values: pd.Series) -> pd.Series:
        known = {v: of(v.encode()) for v in values.dropna().unique()}
        return values.map(known).astype("Int64")

    return run(column)


def crc32c(column: Column) -> Column:
    """crc32c of a binary column; null for null."""

    @F.pandas_udf("bigint")
    def run(values: pd.Series) -> pd.Series:
        got = crc32c_many([bytes(v or b"") for v in values])
        return pd.Series(got.astype(np.int64)).where(~values.reset_index(drop=True).isna(), None)

    return run(column)


def fnv64(column: Column, modulo: int | None = None) -> Column:
    """FNV of a bigint column: its 64 bits as a bigint, or the unsigned number modulo `modulo`."""

    @F.pandas_udf("bigint")
    def run(values: pd.Series) -> pd.Series:
        h = fnv64_many(values.to_numpy())
        return pd.Series((h if modulo is None else h % np.uint64(modulo)).view(np.int64))

    return run(column)
