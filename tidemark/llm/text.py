"""Words of Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: Bytes of text worked on at once; a longer single text is worked on whole.
SLICE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space and ASCII punctuation.
PUNCT = SPACE.copy()
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_rng = np.random.default_rng(20240229)
_T = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: The same bytes with ASCII capitals folded.
_TF = _T.copy()
_TF[65:91] = _T[97:123]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: first row, end row, bytes, offsets."""
    data, offs = raw(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE, signs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, in order; no word crosses a row.

    With ``signs``, each character between U+3000 and U+9FFF (the scripts of Chinese and
    Japanese, which put no space between words) and of Thai and Lao is a word.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = sep[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs[:-1]] = True
    first[-1] = True
    first[0] = True
    if signs:
        at = (data >= 0xE3) & (data <= 0xE9)
        thai = np.flatnonzero(data[:-1] == 0xE0)
        at[thai[(data[thai + 1] >= 0xB8) & (data[thai + 1] <= 0xBB)]] = True
        at = np.flatnonzero(at)
        first[at] = True
        first[np.minimum(at + 3, len(data))] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | first[1:])) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, rows


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE + (1 << 16))
        for k, b in (("p", _P), ("i", _PINV)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; it doesn't depend on where the span lies.

    With ``fold``, ASCII letters count alike in either case.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = _power(len(data) + 1)
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum((_TF if fold else _T)[data] * p[:-1], out=h[1:], dtype=np.uint64)
    length = (ends - starts).astype(np.uint64)
    return mix((h[ends] - h[starts]) * inv[starts] + length * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first-word indices of the n-grams that stay in one row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
    ok = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(acc[ok]), ok


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def free(columns: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that none of ``columns`` has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with long keys, and what they stand for.

    Integers stay as they are (None). Other keys are replaced by numbers in the same
    order, from a written table of the distinct keys; null stays null. That join moves
    the rows, which integer keys spare.
    """
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        return df.withColumn(key, F.col(key).cast("long")), None
    number, name = free(df.columns, "number", "name")
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias(name)).distinct()
    keys, _ = written(keys.repartitionByRange(name).sortWithinPartitions(name).withColumn(number, F.monotonically_increasing_id()), "keys")
    return df.join(keys, F.col(key) == F.col(name), "left").select(*[F.col(number).alias(c) if c == key else F.col(c) for c in df.columns]), keys.toDF("name", "number")


def named(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """``columns`` with the keys that their numbers stand for."""
    if names is None:
        return df
    for c in columns:
        by, name = free(df.columns, "number", "name")
        df = df.join(names.toDF(name, by), F.col(c) == F.col(by), "left").select(*[F.col(name).alias(x) if x == c else F.col(x) for x in df.columns])
    return df
