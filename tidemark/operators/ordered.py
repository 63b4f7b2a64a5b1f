"""Global order without a single-task window.

A window with no partition key runs in one task. Here rows are range-partitioned and
sorted once and written with their partition and place, so that the input is computed
once more than for the sample of its keys; every later step reads that table. Each
partition is solved by itself, and what crosses a border (a count, the last key before,
the first key after) is carried over from a table of one row a partition. The number of
partitions is that of any shuffle and grows with ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

_MASK = (1 << 33) - 1


def _laid_out(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in global order: partition ``__p`` and, in it, place ``__m``."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    d = d.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33).cast("int"))
    return written(d, "ordered")[0]


def with_rank(df: DataFrame, col: str | list[str], name: str) -> DataFrame:
    """Adds the 0-based global row number by ``col``; rows equal in it are numbered in some order."""
    d = _laid_out(df, *([col] if isinstance(col, str) else col))
    sizes = d.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row a partition
    d = d.join(F.broadcast(before), "__p").withColumn(name, F.col("__m").bitwiseAND(F.lit(_MASK)) + F.col("__before"))
    return d.drop("__p", "__m", "__before")


def with_arrival(df: DataFrame, name: str) -> DataFrame:
    """Adds the 0-based row number in the order in which the rows come."""
    d, _ = written(df.withColumn("__m", F.monotonically_increasing_id()), "arrived")
    d = d.withColumn("__p", F.shiftright("__m", 33).cast("int"))
    sizes = d.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row a partition
    d = d.join(F.broadcast(before), "__p").withColumn(name, F.col("__m").bitwiseAND(F.lit(_MASK)) + F.col("__before"))
    return d.drop("__p", "__m", "__before")


def with_neighbours(df: DataFrame, col: str, nxt: str | None = None, prv: str | None = None) -> DataFrame:
    """Adds the next and the previous value of ``col`` in global order; null at the ends."""
    d = _laid_out(df, col)
    ends = d.groupBy("__p").agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    w = Window.orderBy("__p")
    ends = ends.select("__p", F.lead("__lo").over(w).alias("__after"), F.lag("__hi").over(w).alias("__prior"))
    local = Window.partitionBy("__p").orderBy("__m")
    if nxt:
        d = d.withColumn(nxt, F.lead(col).over(local))
    if prv:
        d = d.withColumn(prv, F.lag(col).over(local))
    d = d.join(F.broadcast(ends), "__p")
    if nxt:
        d = d.withColumn(nxt, F.coalesce(nxt, "__after"))
    if prv:
        d = d.withColumn(prv, F.coalesce(prv, "__prior"))
    return d.drop("__p", "__m", "__after", "__prior")


def nearest(probes: DataFrame, rows: DataFrame, probe: str, key: str, how: str, payload: list[str] | None = None) -> DataFrame:
    """For each probe the nearest key of ``rows``: ``ge``, ``gt``, ``le`` or ``lt``.

    Both sides go into one sorted pass (an as-of join), so that the cost is that of
    a sort and not of a product. Probes without an answer get nulls; a null probe
    gets none. ``payload`` columns of the row found come along.
    """
    if how not in ("ge", "gt", "le", "lt"):
        raise ValueError(how)
    down = how in ("le", "lt")
    item = F.struct(F.col(key).alias("k"), *[F.col(c) for c in payload or []])
    # read downwards for le and lt, upwards for ge and gt: at equal keys a row comes before the probe when equality counts
    first = how in ("le", "gt")
    a = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(0 if first else 1).alias("_o"), item.alias("_item"), F.lit(False).alias("_probe"))
    b = probes.select(F.col(probe).alias("_k"), F.lit(1 if first else 0).alias("_o"), F.lit(None).cast(a.schema["_item"].dataType).alias("_item"), F.lit(True).alias("_probe"))
    u = _laid_out(a.unionByName(b), "_k", "_o")
    w = Window.partitionBy("__p").orderBy(F.asc("__m") if down else F.desc("__m")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = u.withColumn("_near", F.last("_item", ignorenulls=True).over(w)).where("_probe")
    edge = (F.max_by if down else F.min_by)("_item", F.when(F.col("_item").isNotNull(), F.col("__m")))
    w = Window.orderBy(F.asc("__p") if down else F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)
    carry = u.groupBy("__p").agg(edge.alias("_edge")).select("__p", F.last("_edge", ignorenulls=True).over(w).alias("_carry"))  # a row a partition
    out = found.join(F.broadcast(carry), "__p")
    near = F.when(F.col("_k").isNotNull(), F.coalesce("_near", "_carry"))
    return out.select(F.col("_k").alias(probe), near["k"].alias(key), *[near[c].alias(c) for c in payload or []])
