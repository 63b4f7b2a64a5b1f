"""Point, nearest, prefix, range, sequence and cursor reads over a changelog DataFrame.

Keys may be strings or binary. Bounds are inclusive; ``None`` is unbounded. Which
reads show tombstones: meta-only, nearest, prefix and sequence reads do; value
reads and key scans do not. Command records show in sequence reads only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.keys import starts_with
from tidemark.operators import ordered
from tidemark.operators.resolve import latest, resolve
from tidemark.schema import COMMAND, DELETE, INSERT, InvalidParameters, KeyNotFound, NotKvPair, OutOfRange, SeqnumNotFound

_NEAR = {"GREATER_OR_EQUAL": "ge", "GREATER": "gt", "SMALLER_OR_EQUAL": "le", "SMALLER": "lt"}


def newest(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """At most one row: the newest version of one key (a top-1, no shuffle of the table)."""
    rows = log.where((F.col("key") == F.lit(key)) & (F.col("type") != COMMAND))
    return (rows if as_of is None else rows.where(F.col("seq") <= as_of)).orderBy(F.desc("seq")).limit(1)


def get(log: DataFrame, key, as_of: int | None = None):
    """The live value of a key; ``KeyNotFound`` when absent or deleted."""
    return get_record(log, key, as_of)["value"]


def get_record(log: DataFrame, key, as_of: int | None = None, meta_only: bool = False) -> Row:
    """The whole record; with ``meta_only`` no value is read and tombstones are returned."""
    rows = newest(log.drop("value") if meta_only else log, key, as_of).collect()
    if not rows or (rows[0]["type"] != INSERT and not meta_only):
        raise KeyNotFound(repr(key))
    return rows[0]


def meta_only(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    return newest(log.drop("value"), key, as_of)


def multi_get(log: DataFrame, keys: DataFrame, key: str = "key", as_of: int | None = None) -> DataFrame:
    """Extension: many keys at once; a row for each, nulls where no live record exists.

    The log is cut to the asked keys before versions are resolved.
    """
    probes = keys.select(F.col(key).alias("key"))
    hit = resolve(log.join(probes.distinct(), "key", "left_semi"), as_of)
    return probes.join(hit, "key", "left")


def by_seq(log: DataFrame, *seqs: int, above: int = 0) -> DataFrame:
    """Records of these sequence numbers that are still in the log section (``seq > above``)."""
    return log.where(F.col("seq").isin(*seqs) & (F.col("seq") > above))


def get_by_seq(log: DataFrame, seq: int, above: int = 0, any_type: bool = False) -> Row:
    rows = by_seq(log, seq, above=above).collect()
    if not rows:
        raise SeqnumNotFound(str(seq))
    if rows[0]["type"] != INSERT and not any_type:
        raise NotKvPair(str(seq))
    return rows[0]


def nearest(log: DataFrame, key, option: str = "GREATER_OR_EQUAL", as_of: int | None = None, meta_only: bool = False) -> Row:
    """The record whose key is nearest in the given direction, tombstones included."""
    if option not in _NEAR:
        raise InvalidParameters(f"option {option}")
    how, c, k = _NEAR[option], F.col("key"), F.lit(key)
    cond = {"ge": c >= k, "gt": c > k, "le": c <= k, "lt": c < k}[how]
    order = [F.asc("key"), F.desc("seq")] if how[0] == "g" else [F.desc("key"), F.desc("seq")]
    rows = (log.drop("value") if meta_only else log).where((F.col("type") != COMMAND) & cond)
    if as_of is not None:
        rows = rows.where(F.col("seq") <= as_of)
    found = rows.orderBy(*order).limit(1).collect()
    if not found:
        raise KeyNotFound(repr(key))
    return found[0]


def nearest_many(log: DataFrame, probes: DataFrame, probe: str, option: str = "GREATER_OR_EQUAL", as_of: int | None = None, payload: list[str] | None = None) -> DataFrame:
    """Extension: nearest key for every probe (an as-of join in one sorted pass)."""
    if option not in _NEAR:
        raise InvalidParameters(f"option {option}")
    rows = latest(log.select("seq", "type", "key", *[c for c in payload or [] if c not in ("seq", "type", "key")]), as_of)
    return ordered.nearest(probes, rows, probe, "key", _NEAR[option], payload)


def prefix(log: DataFrame, p, as_of: int | None = None, limit: int | None = None, order: bool = True) -> DataFrame:
    """All keys with a prefix, one row each, in key order, tombstones included."""
    rows = latest(log.where(starts_with(F.col("key"), p)), as_of)
    rows = rows.orderBy("key") if order or limit is not None else rows
    return rows if limit is None else rows.limit(limit)


def for_each_prefix(log: DataFrame, p, decide: Callable[[Row], bool], as_of: int | None = None) -> int:
    """Hands rows to ``decide`` in key order until it returns False; rows stream to the driver."""
    n = 0
    for row in prefix(log, p, as_of).toLocalIterator():
        n += 1
        if decide(row) is False:
            break
    if not n:
        raise KeyNotFound(repr(p))
    return n


def between(c: Column, low, high) -> Column:
    cond = F.lit(True)
    if low is not None and low != b"" and low != "":
        cond = cond & (c >= F.lit(low))
    if high is not None and high != b"" and high != "":
        cond = cond & (c <= F.lit(high))
    return cond


def range_scan(log: DataFrame, low=None, high=None, as_of: int | None = None, descending: bool = False, order: bool = True) -> DataFrame:
    """Live rows with ``low <= key <= high``; the key filter reaches the file scan."""
    rows = resolve(log.where(between(F.col("key"), low, high)), as_of)
    return rows.orderBy(F.desc("key") if descending else F.asc("key")) if order else rows


def seq_scan(log: DataFrame, low: int | None = None, high: int | None = None, flushed: int = 0, order: bool = True) -> DataFrame:
    """Every version above the flush point, and one row a key at or below it."""
    rows = log if flushed <= 0 else log.where(F.col("seq") > flushed).unionByName(latest(log, flushed))
    rows = rows.where(between(F.col("seq"), low, high))
    return rows.orderBy("seq") if order else rows


def neighbours(log: DataFrame, as_of: int | None = None, nxt: str = "nxt", prv: str = "prv") -> DataFrame:
    """Each live key with the next and the previous one (cursor moves as a relation)."""
    return ordered.with_neighbours(resolve(log.drop("value", "meta"), as_of).select("key"), "key", nxt, prv)


class Cursor:
    """A bidirectional cursor over a fixed snapshot of the log, by key or by sequence number.

    ``next`` and ``prev`` at an end raise ``OutOfRange`` and leave the cursor on the
    last row. Rows come in pages of ``page``, each a top-n over what lies beyond the
    current position, so that the driver never holds a whole table.
    """

    def __init__(self, log: DataFrame, low=None, high=None, by: str = "key", as_of: int | None = None, flushed: int = 0, page: int = 256):
        self.by, self.page = by, page
        self.rows = range_scan(log, low, high, as_of, order=False) if by == "key" else seq_scan(log if as_of is None else log.where(F.col("seq") <= as_of), low, high, flushed, order=False)
        self._buf: list[Row] = []
        self._at = 0
        self.goto_begin(quiet=True)

    def _load(self, cond: Column, descending: bool) -> list[Row]:
        c = F.col(self.by)
        return self.rows.where(cond).orderBy(c.desc() if descending else c.asc()).limit(self.page).collect()

    def _at_edge(self, descending: bool) -> bool:
        pos = self._buf[self._at][self.by]
        c = F.col(self.by)
        more = self._load(c < F.lit(pos) if descending else c > F.lit(pos), descending)
        if not more:
            return True
        self._buf, self._at = (more[::-1], len(more) - 1) if descending else (more, 0)
        return False

    def get(self) -> Row:
        if not self._buf:
            raise KeyNotFound("no cursor")
        return self._buf[self._at]

    def next(self) -> Row:
        if not self._buf:
            raise OutOfRange()
        if self._at + 1 < len(self._buf):
            self._at += 1
        elif self._at_edge(False):
            raise OutOfRange()
        return self.get()

    def prev(self) -> Row:
        if not self._buf:
            raise OutOfRange()
        if self._at > 0:
            self._at -= 1
        elif self._at_edge(True):
            raise OutOfRange()
        return self.get()

    def seek(self, pos, option: str = "GREATER") -> Row:
        """The exact position, or the nearest one in the direction of ``option``."""
        down = option.startswith("SMALLER")
        c = F.col(self.by)
        rows = self._load(c <= F.lit(pos) if down else c >= F.lit(pos), down)
        if not rows:
            raise OutOfRange(repr(pos))
        self._buf, self._at = (rows[::-1], len(rows) - 1) if down else (rows, 0)
        return self.get()

    def goto_begin(self, quiet: bool = False) -> Row | None:
        self._buf, self._at = self._load(F.lit(True), False), 0
        return None if quiet and not self._buf else self.get()

    def goto_end(self) -> Row:
        rows = self._load(F.lit(True), True)
        self._buf, self._at = rows[::-1], len(rows) - 1
        return self.get()

    def close(self) -> None:
        self._buf = []

    def __iter__(self) -> Iterator[Row]:
        return self.rows.orderBy(self.by).toLocalIterator()


__all__ = ["DELETE", "Cursor", "between", "by_seq", "for_each_prefix", "get", "get_by_seq", "get_record", "meta_only", "multi_get", "nearest", "nearest_many", "neighbours", "newest", "prefix", "range_scan", "seq_scan"]
