"""Truncation, compaction, sampling and statistics as pure DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import record_size
from tidemark.operators import ordered
from tidemark.operators.resolve import by_key, latest, resolve
from tidemark.schema import COMMAND, DELETE, INSERT, InvalidParameters


def purge(log: DataFrame, upto: int) -> DataFrame:
    """Drops the head of the log without storing it anywhere."""
    return log.where(F.col("seq") > upto)


def rollback(log: DataFrame, upto: int) -> DataFrame:
    """Keeps ``seq <= upto``; numbering goes on from there."""
    return log.where(F.col("seq") <= upto)


def compact(log: DataFrame, last_level: bool = True, preserve_tombstones: bool = False, drop: Column | None = None, as_of: int | None = None) -> DataFrame:
    """One row a key. On the last level tombstones, and rows that ``drop`` holds for, go.

    A null verdict of ``drop`` keeps the row. A dropped newest version hides the older
    ones, as a tombstone does.
    """
    rows = latest(log, as_of)
    if not last_level or preserve_tombstones:
        return rows
    rows = rows.where(F.col("type") == INSERT)
    return rows if drop is None else rows.where(~F.coalesce(drop, F.lit(False)))


def merge(upper: DataFrame, lower: DataFrame, **options) -> DataFrame:
    """Two sorted runs into one; at equal keys the higher sequence number wins."""
    return compact(upper.unionByName(lower, allowMissingColumns=True), **options)


def stale_ratio(log: DataFrame) -> DataFrame:
    """Versions and deletions of each key: what decides which table to compact."""
    return log.where(F.col("type") != COMMAND).groupBy(*by_key(log)).agg(F.count(F.lit(1)).alias("versions"), F.sum((F.col("type") == DELETE).cast("long")).alias("dels"))


def key_ranges(rows: DataFrame, per_table: int, name: str = "tbl") -> DataFrame:
    """Cuts keys, in order, into tables of ``per_table`` and returns their bounds."""
    ranked = ordered.with_rank(rows.select("key"), "key", "_rank")
    return ranked.groupBy(F.floor(F.col("_rank") / per_table).cast("int").alias(name)).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n"))


def sequence_holes(log: DataFrame) -> DataFrame:
    """Sequence numbers that don't directly follow the one before."""
    return ordered.with_neighbours(log.select("seq"), "seq", prv="prev").where(F.col("seq") - F.col("prev") > 1)


def batch_faults(batch: DataFrame, order: str | None = None) -> DataFrame:
    """How many records of a batch don't exceed the one before them, in batch order."""
    if order is None:
        d = ordered.with_neighbours(batch.select("seq"), "seq", prv="prev")
        return d.agg(F.sum((F.col("seq") <= F.col("prev")).cast("long")).alias("bad"))
    d = ordered.with_neighbours(batch.select(order, "seq"), order, prv="_before")
    prev = batch.select(F.col(order).alias("_before"), F.col("seq").alias("prev"))
    return d.join(prev, "_before", "left").agg(F.sum((F.col("seq") <= F.col("prev")).cast("long")).alias("bad"))


def stats(log: DataFrame) -> DataFrame:
    """Approximate count (versions and tombstones count), bounds and number of keys."""
    return log.agg(F.count(F.lit(1)).alias("approx_num"), F.max("seq").alias("max_seq"), F.min("seq").alias("min_seq"), F.countDistinct("key").alias("n_keys"))


def sample_stride(log: DataFrame, stride: int, phase: int = 1, live_only: bool = True) -> DataFrame:
    """Keys at every ``stride``-th sequence number, each once, live ones when asked."""
    keys = log.where(F.col("seq") % stride == phase).select("key").distinct()
    return keys.join(resolve(log).select("key"), "key", "left_semi") if live_only else keys


def sample_keys(log: DataFrame, n: int, live_only: bool = False) -> DataFrame:
    """About ``n`` distinct keys by systematic sampling over the sequence numbers.

    Repeats and dead keys thin a sample, so the stride is halved until ``n`` distinct
    keys are met or every number has been visited.
    """
    if n <= 0:
        raise InvalidParameters("a sample needs a positive size")
    top = log.agg(F.max("seq")).first()[0]
    stride = max(1, ((top or 1) - 1) // n)
    while True:
        keys = sample_stride(log.where(F.col("type") != COMMAND), stride, 1 % stride, live_only)
        if stride == 1 or keys.limit(n).count() == n:
            return keys.orderBy(F.xxhash64("key")).limit(n)
        stride = max(1, stride // 2)


def table_stats(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Documents, bytes and key bounds by level and table, and what else is asked for."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("num_kvs"), F.sum(record_size("key", "meta", "value")).alias("bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), *more)


def latency_percentiles(df: DataFrame, col: str, points: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    return df.agg(*[F.percentile_approx(col, p, 10_000).alias(f"p{p * 100:g}".replace(".", "_")) for p in points])
