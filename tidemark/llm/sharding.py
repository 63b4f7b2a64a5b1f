"""A reproducible shuffle of row numbers, from which shard and slot can be computed.

Rows get global numbers 0..n-1 by (doc_id, row hash). A Feistel network on a grid of
a x b >= n cells, about square, permutes the numbers; results outside 0..n-1 walk on
along their cycle. All of it is column arithmetic, so rows never leave the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import written

PRIME = 2_147_483_647
ROUNDS = ((48271, 11, 69621), (16807, 1013, 39373), (69621, 7, 48271), (39373, 499, 16807), (630360016, 31, 48271), (742938285, 77, 69621))


def grid(n: int) -> tuple[int, int]:
    """Sides a, b with a * b >= n and little to spare."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, max(1, -(-max(n, 1) // a))


def _round(r, mul, key, mul2, seed, m):
    t = (r * mul + key + seed) % PRIME
    t = (t * t) % PRIME
    return ((t * mul2 + key) % PRIME) % m


def once(x: int, n: int, seed: int) -> int:
    """One pass of the network over an integer."""
    a, b = grid(n)
    left, right = x // b, x % b
    for i, (mul, key, mul2) in enumerate(ROUNDS):
        if i % 2 == 0:
            left = (left + _round(right, mul, key, mul2, seed, a)) % a
        else:
            right = (right + _round(left, mul, key, mul2, seed, b)) % b
    return left * b + right


def position(x: int, n: int, seed: int = 0) -> int:
    """Where row x of n goes."""
    x = once(x, n, seed)
    while x >= n:
        x = once(x, n, seed)
    return x


def row_at(p: int, n: int, seed: int = 0) -> int:
    """The row that goes to position p: the inverse of ``position``."""
    a, b = grid(n)

    def back(x):
        left, right = x // b, x % b
        for i in reversed(range(len(ROUNDS))):
            mul, key, mul2 = ROUNDS[i]
            if i % 2 == 0:
                left = (left - _round(right, mul, key, mul2, seed, a)) % a
            else:
                right = (right - _round(left, mul, key, mul2, seed, b)) % b
        return left * b + right

    p = back(p)
    while p >= n:
        p = back(p)
    return p


def locate(x: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of row x, without looking at any data."""
    p = position(x, n, seed)
    return p % shards, p // shards


def _once(x: Column, n: int, seed: int) -> Column:
    """The network as columns. Each half is a struct field, so that it is computed once a round."""
    a, b = grid(n)
    state = F.array(F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r")))
    for i, r in enumerate(ROUNDS):
        state = F.transform(state, _half(i % 2 == 0, r, a, b, seed))
    return state[0]["l"] * b + state[0]["r"]


def _half(to_left: bool, r: tuple[int, int, int], a: int, b: int, seed: int):
    mul, key, mul2 = (F.lit(v).cast("long") for v in r)
    m = F.lit(a if to_left else b).cast("long")

    def f(half: Column) -> Column:
        t = (half * mul + key + F.lit(seed).cast("long")) % PRIME
        return F.transform(F.array(t), lambda t: (((t * t) % PRIME) * mul2 + key) % PRIME % m)[0]

    def left(s: Column) -> Column:
        return F.struct(((s["l"] + f(s["r"])) % m).alias("l"), s["r"].alias("r"))

    def right(s: Column) -> Column:
        return F.struct(s["l"].alias("l"), ((s["r"] + f(s["l"])) % m).alias("r"))

    return left if to_left else right


def feistel(x: Column, n: int, seed: int) -> Column:
    """Permuted row number. A walk meets distinct cells outside 0..n-1 before it
    returns, so that a * b - n more steps always suffice; few rows need any."""
    a, b = grid(n)
    extra = a * b - n
    first = _once(x, n, seed)
    if not extra:
        return first
    steps = F.sequence(F.lit(1), F.lit(extra))
    walk = lambda p: F.aggregate(steps, p, lambda acc, _: F.when(acc < n, acc).otherwise(_once(acc, n, seed)))
    return F.transform(F.array(first), lambda p: F.when(p < n, p).otherwise(walk(p)))[0]


def number(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, int]:
    """Key and global row number in key order (nulls first, ties by a hash of the whole row).

    One range exchange of two longs; each sorted partition numbers itself, and a table
    with one row a partition carries the offsets.
    """
    cols = [F.col(c).cast("string") if t.startswith(("map", "variant")) else F.col(c) for c, t in docs.dtypes]
    d = docs.select(F.col(key).alias("_k"), F.xxhash64(*cols).alias("_h"))  # a new table of two columns: names can't clash
    d = d.repartitionByRange("_k", "_h").sortWithinPartitions(F.asc_nulls_first("_k"), "_h").withColumn("_m", F.monotonically_increasing_id())
    d, _ = written(d.select("_k", "_m"), "numbered")
    d = d.withColumn("_p", F.shiftright("_m", 33))
    sizes = {r[0]: r[1] for r in d.groupBy("_p").count().collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = d.sparkSession.createDataFrame(before, "_p long, _before long")
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return d.join(F.broadcast(offsets), "_p").select(F.col("_k").alias(key), (local + F.col("_before")).alias("row_number")), total


def shard(docs: DataFrame, rows_per_shard: int = 10_000, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """(key, row_number, position, shard, slot) for every row.

    Shard sizes differ by at most one row. Rows with a null key are numbered first;
    rows that repeat get a number each; an empty table gives an empty result; columns
    besides ``key`` only break ties, so that names can't clash. Texts aren't moved.
    """
    if not 0 <= seed < PRIME:
        raise ValueError("seed")
    d, n = number(docs, key)
    shards = max(1, -(-n // rows_per_shard))
    d = d.withColumn("position", feistel(F.col("row_number"), n, seed) if n else F.col("row_number"))
    return d.withColumn("shard", F.col("position") % shards).withColumn("slot", F.floor(F.col("position") / shards).cast("long"))


ROWS_PER_SHARD = 100


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), ROWS_PER_SHARD, 42)


def _sql() -> str:
    """The same network in DuckDB, with the walk as a list reduction."""

    def net(x: str) -> str:
        # nested one-row list transforms keep each half a single expression
        left, right = f"({x})//b", f"({x})%b"
        out = f"[{{'l': {left}, 'r': {right}}}]"
        for i, (mul, key, mul2) in enumerate(ROUNDS):
            half, m = ("s.r", "a") if i % 2 == 0 else ("s.l", "b")
            t = f"(({half}*{mul}+{key + 42})%{PRIME})"
            f = f"((({t}*{t})%{PRIME})*{mul2}+{key})%{PRIME}%{m}"
            pair = f"{{'l': (s.l+{f})%a, 'r': s.r}}" if i % 2 == 0 else f"{{'l': s.l, 'r': (s.r+{f})%b}}"
            out = f"list_transform({out}, lambda s: {pair})"
        return f"(list_transform({out}, lambda s: s.l*b+s.r)[1])"

    return f"""with recursive c as (select count(*) as n, greatest(1, floor(sqrt(count(*)))::bigint) as a from documents),
 g as (select n, a, greatest(1, (n+a-1)//a) as b, greatest(1, (n+{ROWS_PER_SHARD}-1)//{ROWS_PER_SHARD}) as shards from c),
 d as (select doc_id, (row_number() over(order by doc_id)-1)::bigint as row_number from documents),
 w as (select doc_id, row_number, n, a, b, shards, {net('row_number')} as position from d, g
   union all select doc_id, row_number, n, a, b, shards, {net('position')} from w where position >= n)
 select doc_id, row_number, position::bigint as position, (position%shards)::bigint as shard, (position//shards)::bigint as slot from w where position < n"""


ORACLE = _sql()
