"""Token windows of near-equal fill by multiway Karmarkar-Karp differencing.

Texts longer than a window are cut into full windows and a rest; what is left is
packed by differencing: two partial partitions are merged so that the heavy windows
of one meet the light ones of the other, the most unequal ones first, until one
partition is left. When a window exceeds the capacity, one more window is tried.

A differencing over everything would be one task, so documents are dealt by a hash
into groups of a given volume of rests, each packed by itself: windows are near-equal
within a group, the number of groups follows the input, and a group rounds its number of
windows up by less than one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.sources.shared import written

SCHEMA = "window_id string, window_tokens long, piece int, doc_id {}, start long, tokens long"


def difference(sizes: np.ndarray, k: int, capacity: int | None = None) -> np.ndarray | int:
    """Window of each item for k windows, by largest differencing of whole partitions.

    With a capacity, a result that exceeds it is given up for the number of tokens
    beyond it in all windows.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    # a partial partition: its sums (descending, less the smallest, zeros left out) and how it came about
    order = np.argsort(-sizes, kind="stable")
    sums: list = [sizes[i : i + 1] for i in order]
    made: list = [None] * n
    heap = [(-int(sizes[i]), j) for j, i in enumerate(order)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, p = heapq.heappop(heap)
        _, q = heapq.heappop(heap)
        a, b = sums[p], sums[q]
        sums[p] = sums[q] = None
        slot = None
        if len(a) + len(b) <= k:  # nothing needs to meet: the sums stand side by side
            both = np.concatenate([a, b])
            slot = len(a)
        else:  # the heaviest of one meets the lightest of the other
            both = np.zeros(k, np.int64)
            both[: len(a)] = a
            both[k - len(b) :] += b[::-1]
        rank = (-both).argsort(kind="stable")
        new = both[rank]
        if len(new) == k:
            new = new - new[-1]
            new = new[: max(1, int(np.count_nonzero(new)))]
        made.append((p, q, rank, slot))
        sums.append(new)
        heapq.heappush(heap, (-int(new[0]), len(made) - 1))
    top = sums[heap[0][1]]
    if capacity is not None:
        base = (int(sizes.sum()) - int(top.sum())) // k
        over = int(np.maximum(top + base - capacity, 0).sum()) + max(0, base - capacity) * (k - len(top))
        if over > 0:
            return over
    # unwind: the window of each place of each partition
    out = np.zeros(n, np.int64)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        node, final = todo.pop()
        if made[node] is None:
            out[order[node]] = final[0]
            continue
        p, q, rank, slot = made[node]
        at = np.empty(k, np.int64)  # window of each place before ranking
        at[rank] = final[: len(rank)]
        at[len(rank) :] = final[len(rank) :]
        todo.append((p, at))
        todo.append((q, at[::-1] if slot is None else np.concatenate([at[slot:], at[:slot]])))
    return out


def fill(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of items no larger than the capacity, and their number."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        w = difference(sizes, k, capacity)
        if not isinstance(w, int):
            return w, k
        k += max(1, w // capacity)


def pack_group(doc: pa.Array, tokens: np.ndarray, capacity: int, name: str) -> pa.Table:
    """Rows of one group: every document's tokens, each in exactly one window."""
    full = tokens // capacity
    rest = tokens - full * capacity
    w, k = fill(rest[rest > 0].astype(np.int64), capacity)
    di = np.repeat(np.arange(len(doc)), full)
    start = tx.ragged(np.zeros(len(doc), np.int64), full) * capacity
    has = np.flatnonzero(rest > 0)
    window = np.concatenate([w, k + np.arange(len(di))])
    idx = np.concatenate([has, di])
    start = np.concatenate([full[has] * capacity, start])
    size = np.concatenate([rest[has], np.full(len(di), capacity)])
    order = np.lexsort((start, idx, window))
    window, idx, start, size = window[order], idx[order], start[order], size[order]
    total = np.bincount(window, size).astype(np.int64) if len(window) else np.zeros(0, np.int64)
    first = np.r_[True, window[1:] != window[:-1]] if len(window) else np.zeros(0, bool)
    at = np.arange(len(window)) - np.maximum.accumulate(np.where(first, np.arange(len(window)), 0))
    return pa.table({"window_id": pa.array([f"{name}-{x}" for x in window], pa.string()), "window_tokens": total[window] if len(window) else total, "piece": at.astype(np.int32), "doc_id": doc.take(pa.array(idx)), "start": start, "tokens": size})


def lengths(docs: DataFrame, column: str, key: str) -> DataFrame:
    """Key, number of words (runs of anything but ASCII white space) and a salt of each text.

    The salt is 0 but for null keys, which it spreads over the groups.
    """

    def count(batches) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for lo, hi, data, offs in tx.slices(b.column(1)):
                _, _, rows = tx.words(data, offs)
                n[lo:hi] = np.bincount(rows, minlength=hi - lo)
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.where(null, seen + np.cumsum(null), 0))], ["doc_id", "tokens", "salt"])
            seen += int(null.sum())

    d = docs.select(F.col(key).alias("doc_id"), F.col(column).cast("string").alias("text"))
    return d.mapInArrow(count, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, tokens long, salt long")


def pack(docs: DataFrame, capacity: int = 2048, windows_per_group: int = 128, column: str = "text", key: str = "doc_id", tokens: str | None = None) -> DataFrame:
    """Windows of at most ``capacity`` tokens: a row for each piece of a text in a window.

    Tokens are the words of ``column``, or their number stands in the column ``tokens``
    (such as ``n_tokens`` of the byte-pair encoder), and ``column`` isn't read. Columns of the result: window, its
    fill, place in the window, document, first token and number of tokens. Null, empty
    and blank texts have no tokens and so no rows; very long texts fill windows of their
    own and a rest; keys keep their type, and a null key stays null; repeated rows are
    packed once each; equal sizes are ordered by key, so that equal input gives equal
    windows (rows with null keys are dealt by their place in the input); other columns
    are not read, so that their names can't clash; an empty table gives an empty result.
    Only keys and lengths are shuffled.
    """
    if capacity < 1 or windows_per_group < 1:
        raise ValueError("capacity and windows_per_group must be positive")
    if tokens is None:
        d = lengths(docs, column, key)
    else:
        salt = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(0)
        d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens"), salt.alias("salt"))
    d, _ = written(d.where("tokens > 0"), "lengths")
    rest, full = d.agg(F.sum(F.col("tokens") % capacity), F.sum(F.floor(F.col("tokens") / capacity))).first()
    # rests are what is packed; full windows cost next to nothing, but their rows must fit a task
    groups = max(1, -(-(rest or 0) // (capacity * windows_per_group)), -(-int(full or 0) // (1000 * windows_per_group)))

    def work(keys: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("tokens", "ascending"), ("doc_id", "ascending")])
        return pack_group(t.column("doc_id").combine_chunks(), t.column("tokens").to_numpy(), capacity, f"{keys[0].as_py():08d}")

    grouped = d.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(groups)).alias("g")).groupBy("g")
    return grouped.applyInArrow(work, SCHEMA.format(d.schema["doc_id"].dataType.simpleString()))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
