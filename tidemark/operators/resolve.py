"""The one view all reads share: the newest version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import COMMAND, INSERT


def by_key(log: DataFrame) -> list[str]:
    return ["kvs", "key"] if "kvs" in log.columns else ["key"]


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest non-command record of each key at or below ``as_of``, tombstones included.

    Planned as a top-1 group limit, which cuts each input partition to one row a key
    before the exchange: a key rewritten a million times costs one row per task.
    """
    if as_of is not None:
        log = log.where(F.col("seq") <= as_of)
    w = Window.partitionBy(*by_key(log)).orderBy(F.desc("seq"))
    return log.where(F.col("type") != COMMAND).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def resolve(log: DataFrame, as_of: int | None = None, tombstones: bool = False) -> DataFrame:
    """``latest`` with or without tombstones."""
    rows = latest(log, as_of)
    return rows if tombstones else rows.where(F.col("type") == INSERT)


def overwrite_by_commit(log: DataFrame, commit: str = "commit_id") -> DataFrame:
    """Where sequence numbers may be overwritten: the row of the newest commit of each."""
    w = Window.partitionBy(*(["kvs"] if "kvs" in log.columns else []), "seq").orderBy(F.desc(commit))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
