"""Scalar functions over keys and records, as column expressions where Spark has them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_key(x):
    """A Python key (str or bytes) as a binary literal; ``None`` stays ``None`` (unbounded)."""
    if x is None or isinstance(x, Column):
        return x
    return F.lit(bytes(x, "utf-8") if isinstance(x, str) else bytes(x))


def starts_with(key: Column, prefix: bytes | str) -> Column:
    """Byte prefix as a half-open range, so that file statistics prune the scan."""
    raw = prefix.encode() if isinstance(prefix, str) else bytes(prefix)
    text = isinstance(prefix, str)
    lit = (lambda b: F.lit(b.decode("utf-8", "strict"))) if text else F.lit
    low = key >= (F.lit(prefix) if text else F.lit(raw))
    bound = prefix_end(raw)
    if bound is None:
        return low & key.startswith(prefix if text else F.lit(raw))
    try:
        return low & (key < lit(bound)) & key.startswith(F.lit(prefix) if text else F.lit(raw))
    except UnicodeDecodeError:
        return low & key.startswith(F.lit(prefix))


def record_size(*cols: str | Column) -> Column:
    """Bytes of key, value and metadata; a null counts as empty."""
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total


def readable(col: str | Column, limit: int = 48) -> Column:
    """``(length) text`` with bytes outside 0x20..0x7d shown as dots, cut at ``limit``."""
    raw = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(F.decode(F.substring(raw, 1, limit), "ISO-8859-1"), r"[^\x20-\x7d]", ".")
    return F.concat(F.lit("("), F.octet_length(raw).cast("string"), F.lit(") "), text)


def to_hex(col: str | Column) -> Column:
    return F.lower(F.hex(col))


def from_hex(col: str | Column) -> Column:
    return F.unhex(col)


def checksum(*cols: str | Column) -> Column:
    """CRC-32 of each part, chained so that moving a byte between parts changes it."""
    parts = [F.crc32(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(b""))).cast("string") for c in cols]
    return F.crc32(F.concat_ws("/", *parts).cast("binary"))


def encode_double(col: str | Column) -> Column:
    """A double as 8 bytes whose unsigned order is the numeric order.

    Positive numbers get their sign bit flipped, negative ones are complemented;
    null stays null and NaN sorts last.
    """
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    bits = _double_bits(c)
    flipped = F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(2**63))))
    return F.when(c.isNull(), F.lit(None).cast("binary")).otherwise(F.unhex(F.lpad(F.hex(flipped), 16, "0")))


@F.pandas_udf(T.LongType())
def _double_bits(s: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series(np.ascontiguousarray(s.to_numpy(dtype="float64", na_value=float("nan"))).view("int64"))


def encode_long(col: str | Column) -> Column:
    """A long as 8 big-endian bytes with the sign bit flipped, so that order is kept."""
    c = (F.col(col) if isinstance(col, str) else col).cast("long")
    return F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def bucket(key: str | Column, buckets: int, hash_len: int = 0) -> Column:
    """Hash bucket of a key; ``hash_len`` bytes count, all of them when 0 or beyond the key.

    Uses Spark's own hash, so that ids differ from other systems'; see ``murmur32``.
    """
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.hash(F.substring(k, 1, hash_len) if hash_len > 0 else k), F.lit(buckets))


def murmur32_bytes(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit, from its published definition."""
    mask, h = 0xFFFFFFFF, seed
    whole = len(data) & ~3
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask
        k = ((k << 15) | (k >> 17)) & mask
        h ^= k * 0x1B873593 & mask
        h = ((h << 13) | (h >> 19)) & mask
        h = (h * 5 + 0xE6546B64) & mask
    if len(data) > whole:
        k = int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & mask
        k = ((k << 15) | (k >> 17)) & mask
        h ^= k * 0x1B873593 & mask
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & mask
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & mask
    return h ^ (h >> 16)


@F.pandas_udf(T.LongType())
def murmur32(s: pd.Series) -> pd.Series:
    """Exact seed-0 Murmur3 of a binary column, for those who need the standard bucket ids."""
    return s.map(lambda b: None if b is None else murmur32_bytes(bytes(b)))


def spark_hash(data: bytes, seed: int = 42) -> int:
    """What Spark's ``hash`` gives for a binary value: Murmur3 whose last bytes count one by one."""
    mask, h = 0xFFFFFFFF, seed
    whole = len(data) & ~3
    words = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)]
    for k in [*words, *((b - 256 if b > 127 else b) & mask for b in data[whole:])]:
        k = k * 0xCC9E2D51 & mask
        k = ((k << 15) | (k >> 17)) & mask
        h ^= k * 0x1B873593 & mask
        h = ((h << 13) | (h >> 19)) & mask
        h = (h * 5 + 0xE6546B64) & mask
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & mask
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def bucket_number(key: bytes, buckets: int, hash_len: int = 0) -> int:
    """``bucket`` of one key, without a Spark job."""
    return spark_hash(key[:hash_len] if hash_len > 0 else key) % buckets


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all with a prefix, None where there is none."""
    upper = prefix.rstrip(b"\xff")
    return upper[:-1] + bytes([upper[-1] + 1]) if upper else None
