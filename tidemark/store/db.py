"""A store: Parquet segments and tables under one versioned manifest.

Layout under a path: ``manifest/<version>.json`` (the newest is the truth),
``log/<id>`` segments in sequence order and ``table/<id>`` directories, each table
one row a key. A write of more than ``FILES`` tables puts neighbours into one file, whose
rows carry the table's number, so that files don't grow in number as small tables do.
Files never change; a commit writes the next manifest by an atomic create, so that
readers hold a version and a second writer of the same version fails. ``vacuum`` removes
files that no kept manifest names.

There is one writer at a time; its pending rows live in the driver until ``sync``.
Bulk work (``append``, flush, compaction) runs as Spark jobs and never collects rows.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions.keys import bucket, bucket_number, prefix_end, record_size
from tidemark.operators import maintenance as M
from tidemark.operators import ordered
from tidemark.operators import reads as R
from tidemark.operators.resolve import latest, overwrite_by_commit, resolve
from tidemark.sources.shared import hadoop, new_path, remove

SEP = "/"

#: Tables of one write that get a file each; of more, neighbours share files.
FILES = 64

#: Rows of a file that tables share, at most.
FILE_ROWS = 1_000_000

_ROWS = "seq long, type byte, key binary, meta binary, value binary, commit_id long"


@dataclass(frozen=True)
class Config:
    num_buckets: int = 4
    max_checkpoints: int = 10
    mode: str = "table"  # or "log": no tables at all
    allow_overwrite: bool = False
    drop_tombstones_on_last_level: bool = True
    seq_index: bool = True
    read_only: bool = False
    hash_len: int = 0
    table_rows: int = 4_000_000
    stale_percent: int = 300
    level_tables: int = 64
    keep_manifests: int = 20
    flush_gap: int = 1_000_000
    segment_limit: int = 512

    def __post_init__(self):
        if self.max_checkpoints < 1:
            object.__setattr__(self, "max_checkpoints", 1)
        if self.mode not in ("table", "log") or self.num_buckets < 1 or self.table_rows < 1:
            raise S.InvalidParameters("config")


@dataclass
class State:
    """What a manifest says of one key-value space."""

    segments: list[dict] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)
    flushed: int = 0
    max_seq: int = 0
    checkpoints: list[int] = field(default_factory=list)
    next_table: int = 0
    commit: int = 0


class _Spans:
    """Tables by their key bounds: which overlap one, and how many, without a look at all."""

    def __init__(self, tables: list[dict]):
        order = sorted((i for i, t in enumerate(tables) if t["min_key"] is not None), key=lambda i: tables[i]["min_key"])
        self.at, self.tables = order, [tables[i] for i in order]
        self.mins, self.maxs = [t["min_key"] for t in self.tables], sorted(t["max_key"] for t in self.tables)
        self.reach = list(accumulate((t["max_key"] for t in self.tables), max))

    def count(self, t: dict) -> int:
        return bisect_right(self.mins, t["max_key"]) - bisect_left(self.maxs, t["min_key"])

    def overlapping(self, t: dict) -> list[dict]:
        """In the order in which the tables were given."""
        if t["min_key"] is None:
            return []
        found, i = [], bisect_right(self.mins, t["max_key"]) - 1
        while i >= 0 and self.reach[i] >= t["min_key"]:
            if self.tables[i]["max_key"] >= t["min_key"]:
                found.append(i)
            i -= 1
        return [self.tables[i] for i in sorted(found, key=self.at.__getitem__)]


def _bytes(x):
    return None if x is None else x.encode() if isinstance(x, str) else bytes(x)


class Manifest:
    """Versioned JSON files; the driver reads and writes them through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.dir = spark, f"{path}{SEP}manifest"

    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, self.dir)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def load(self, version: int | None = None) -> dict | None:
        """The asked version, or the newest one that can be read (older ones are the backup)."""
        found = self.versions() if version is None else [version]
        for v in reversed(found):
            fs, p = hadoop(self.spark, f"{self.dir}{SEP}{v:012d}.json")
            stream = fs.open(p)
            try:
                raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                doc = json.loads(raw)
            except ValueError:
                continue
            if doc.get("complete"):
                return doc
        if found:
            raise S.FileCorruption(self.dir)
        return None

    def store(self, doc: dict, keep: int) -> None:
        """Publishes a version: of two writers of one version, the second gets an error.

        A whole file is moved to its final name by an operation that fails if the name
        is taken: a hard link locally, elsewhere a rename without overwriting, which is
        as atomic as the file system makes it.
        """
        v, jvm = doc["version"], self.spark._jvm
        fs, final = hadoop(self.spark, f"{self.dir}{SEP}{v:012d}.json")
        _, tmp = hadoop(self.spark, f"{self.dir}{SEP}.{v}-{uuid.uuid4().hex}")
        raw = json.dumps(doc | {"complete": True}).encode()
        try:
            if fs.getScheme() == "file":
                here, there = (str(p.toUri().getPath()) for p in (tmp, final))
                os.makedirs(os.path.dirname(here), exist_ok=True)
                with open(here, "wb") as f:
                    f.write(raw)
                    os.fsync(f.fileno())
                try:
                    os.link(here, there)
                finally:
                    os.unlink(here)
            else:
                out = fs.create(tmp, True)
                out.write(bytearray(raw))
                out.close()
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, final, none)
        except FileExistsError:
            raise S.OperationInProgress(f"manifest {v} was written by another") from None
        except Py4JJavaError as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise S.OperationInProgress(f"manifest {v} was written by another") from None
        for old in self.versions()[:-keep]:
            fs.delete(hadoop(self.spark, f"{self.dir}{SEP}{old:012d}.json")[1], False)


class Group:
    """Several named key-value spaces under one path and one manifest."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, as_group: bool = True, version: int | None = None, read_only: bool = False):
        if not path:
            raise S.InvalidParameters("empty path")
        self.spark, self.path, self.lock = spark, path.rstrip("/"), threading.RLock()
        self.manifest = Manifest(spark, self.path)
        doc = self.manifest.load(version)
        self.config = config or Config(**((doc or {}).get("config") or {}))
        if read_only:
            self.config = replace(self.config, read_only=True)
        if doc and doc["group"] != as_group:
            raise S.InvalidHandleUsage("opened as a group and as a single store")
        self.pinned = version is not None
        self.doc = doc or {"version": 0, "group": as_group, "kvs": {}, "config": asdict(self.config), "complete": True}
        self._open: dict[str, Store] = {}

    def default(self) -> Store:
        return self.open("")

    def open(self, name: str, config: Config | None = None) -> Store:
        """The store of a name, created on first use; the same handle for the same name."""
        with self.lock:
            if name not in self._open:
                state, own = self.doc["kvs"].get(name), self.doc.get("configs", {}).get(name)
                found = config or (replace(Config(**own), read_only=self.config.read_only) if own else self.config)
                self._open[name] = Store(self, name, State(**json.loads(json.dumps(state))) if state else State(), found)
            return self._open[name]

    def refresh(self) -> bool:
        """Takes up a newer manifest, if there is one; stores with pending rows are an error."""
        with self.lock:
            doc = self.manifest.load()
            if self.pinned or not doc or doc["version"] <= self.doc["version"]:
                return False
            if any(db.pending for db in self._open.values()):
                raise S.OperationInProgress("pending rows")
            self.doc = doc
            for name, db in self._open.items():
                if name in doc["kvs"]:
                    db.state = State(**json.loads(json.dumps(doc["kvs"][name])))
                    db._next = db.state.max_seq
            return True

    def names(self) -> list[str]:
        return sorted(self.doc["kvs"])

    def commit(self, states: dict[str, State], epochs: dict[str, int] | None = None) -> None:
        """All of ``states`` in one manifest, seen together or not at all, and with them the
        numbers of the stream batches that they hold."""
        if self.config.read_only or self.pinned:
            raise S.WriteViolation(self.path)
        with self.lock:
            doc = json.loads(json.dumps(self.doc))
            doc["version"] += 1
            for k, s in states.items():
                doc["kvs"][k] = asdict(s)
                if k in self._open:
                    doc.setdefault("configs", {})[k] = asdict(replace(self._open[k].config, read_only=False))
            doc["epochs"] = doc.get("epochs", {}) | (epochs or {})
            self.manifest.store(doc, self.config.keep_manifests)
            self.doc = doc

    def vacuum(self) -> list[str]:
        """Removes directories that no kept manifest names, and parts of those it names in part."""
        used = set()
        for v in self.manifest.versions():
            for s in self.manifest.load(v)["kvs"].values():
                used |= {x["path"] for x in [*s["segments"], *s["tables"]]}
        roots = {SEP.join(x.split(SEP)[:2]) for x in used}
        gone = []
        for kind in ("log", "table"):
            fs, p = hadoop(self.spark, f"{self.path}{SEP}{kind}")
            for st in fs.listStatus(p) if fs.exists(p) else []:
                rel = f"{kind}{SEP}{st.getPath().getName()}"
                if rel not in roots:
                    fs.delete(st.getPath(), True)
                    gone.append(rel)
                elif rel not in used:
                    for part in fs.listStatus(st.getPath()):
                        sub = f"{rel}{SEP}{part.getPath().getName()}"
                        if part.isDirectory() and sub not in used:
                            fs.delete(part.getPath(), True)
                            gone.append(sub)
        return gone

    def close(self) -> None:
        self._open.clear()


class Snapshot:
    """Reads frozen at a sequence number.

    ``rows`` gives the versions of keys between two bounds (inclusive, None is
    unbounded), or of one key; the store leaves out tables that can't hold them.
    """

    def __init__(self, rows: Callable[..., DataFrame], seq: int, flushed: int = 0):
        self._rows, self.seq, self.flushed = rows, seq, flushed

    @property
    def log(self) -> DataFrame:
        return self._rows()

    def live(self) -> DataFrame:
        return resolve(self.log, self.seq)

    def get(self, key):
        """The value of a live key: bytes, or None where a null was stored."""
        return _bytes(R.get(self._rows(key=_bytes(key)), _bytes(key), self.seq))

    def get_record(self, key, meta_only: bool = False):
        return R.get_record(self._rows(key=_bytes(key)), _bytes(key), self.seq, meta_only)

    def nearest(self, key, option: str = "GREATER_OR_EQUAL", meta_only: bool = False):
        k = _bytes(key)
        rows = self._rows(low=k) if option.startswith("GREATER") else self._rows(high=k)
        return R.nearest(rows, k, option, self.seq, meta_only)

    def prefix(self, p, limit: int | None = None) -> DataFrame:
        p = _bytes(p)
        return R.prefix(self._rows(low=p, high=prefix_end(p)), p, self.seq, limit)

    def for_each_prefix(self, p, decide: Callable) -> int:
        p = _bytes(p)
        return R.for_each_prefix(self._rows(low=p, high=prefix_end(p)), p, decide, self.seq)

    def range(self, low=None, high=None, descending: bool = False) -> DataFrame:
        low, high = _bytes(low), _bytes(high)
        return R.range_scan(self._rows(low=low, high=high), low, high, self.seq, descending)

    def cursor(self, low=None, high=None) -> R.Cursor:
        low, high = _bytes(low), _bytes(high)
        return R.Cursor(self._rows(low=low, high=high), low, high, "key", self.seq)

    def multi_get(self, keys: DataFrame, key: str = "key") -> DataFrame:
        return R.multi_get(self.log, keys, key, self.seq)

    def close(self) -> None:
        self._rows = None


#: Stores that are open for writing in this process, by session and path.
_HANDLES: dict[tuple[str, str], Group] = {}


class Store:
    """One ordered map and its changelog."""

    def __init__(self, group: Group, name: str, state: State, config: Config):
        self.group, self.name, self.state, self.config = group, name, state, config
        self.spark = group.spark
        self.pending: list[tuple] = []
        self._next = state.max_seq
        self._busy = threading.Lock()
        self._rolling_back = False
        self._pool = ThreadPoolExecutor(1)
        self._queued: dict | None = None  # the flush that waits behind the running one

    # -- opening ---------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None, version: int | None = None, read_only: bool = False) -> Store:
        """The store at a path, with the configuration stored there unless one is given.

        One process has one writing handle of a path: opening it again gives the same
        one. A version, ``read_only`` or another configuration gives a handle of its own.
        """
        key = (spark.sparkContext.applicationId, path.rstrip("/"))
        known = _HANDLES.get(key)
        if known and version is None and not read_only and config in (None, known.config):
            return known.default()
        group = Group(spark, path, config, as_group=False, version=version, read_only=read_only)
        if version is None and not group.config.read_only:
            _HANDLES[key] = group
        return group.default()

    @classmethod
    def from_log(cls, spark: SparkSession, log: DataFrame, path: str | None = None, config: Config | None = None) -> Store:
        """A new store holding a changelog whose columns may be strings or numbers."""
        db = cls.open(spark, path or new_path(spark, "store"), config)
        db.append(log.select("seq", "type", "key", "meta", "value"))
        return db

    @classmethod
    def bulk_build(cls, spark: SparkSession, path: str, rows: DataFrame, config: Config | None = None) -> Store:
        """Rows of key and value straight into range tables, past the log, numbered from 1 in key order."""
        db = cls.open(spark, path, config)
        db._check_write()
        cols = {c: F.col(c).cast("binary") for c in ("key", "value")}
        meta = F.col("meta").cast("binary") if "meta" in rows.columns else F.lit(None).cast("binary")
        d = ordered.with_rank(rows.select(cols["key"].alias("key"), meta.alias("meta"), cols["value"].alias("value")), "key", "_r")
        d = d.select((F.col("_r") + 1).alias("seq"), F.lit(S.INSERT).cast("byte").alias("type"), "key", "meta", "value")
        s = replace(db.state)
        s.tables = db._write_ranges(d, 1, s)
        s.max_seq = s.flushed = max([0, *(t["max_seq"] for t in s.tables)])
        db._commit(s)
        return db

    @classmethod
    def from_tables(cls, spark: SparkSession, path: str, tables: list[str], config: Config | None = None) -> Store:
        """Registers existing table directories (relative to ``path``) as level 1."""
        db = cls.open(spark, path, config)
        s = replace(db.state)
        for i, rel in enumerate(tables):
            s.tables.append(db._describe(rel, 1, i, None))
        s.tables.sort(key=lambda t: t["min_key"] or "")
        s.next_table = max(s.next_table, len(tables))
        s.max_seq = s.flushed = max([0, *(t["max_seq"] for t in s.tables)])
        db._commit(s)
        return db

    def clone_manifest(self) -> Store:
        """Another handle, read-only, on the same files at this very version (log mode only)."""
        if self.config.mode != "log":
            raise S.InvalidMode("cloning needs the log-only mode")
        return Store.open(self.spark, self.group.path, replace(self.config, read_only=True), self.group.doc["version"])

    @staticmethod
    def is_log_mode(spark: SparkSession, path: str) -> bool:
        doc = Manifest(spark, path.rstrip("/")).load()
        return bool(doc) and doc["config"]["mode"] == "log"

    @property
    def path(self) -> str:
        return self.group.path

    @property
    def read_only(self) -> bool:
        return self.config.read_only or self.group.pinned

    def close(self) -> None:
        self._pool.shutdown(wait=True)
        self.group._open.pop(self.name, None)
        for key in [k for k, g in _HANDLES.items() if g is self.group]:
            del _HANDLES[key]

    # -- reading files ---------------------------------------------------

    def _frame(self, rels: Iterable[dict]) -> DataFrame:
        """Rows of segments or tables; of a file some of whose tables are asked for, theirs."""
        files: dict[str, list[dict]] = {}
        for x in rels:
            files.setdefault(x["path"], []).append(x)
        if not files:
            return self.spark.createDataFrame([], S.LOG_SCHEMA).drop("kvs").withColumn("commit_id", F.lit(0).cast("long"))
        part = {p: own for p, own in files.items() if len(own) < own[0].get("shared", 1)}
        read = lambda schema, paths: self.spark.read.schema(schema).parquet(*[f"{self.path}{SEP}{p}" for p in paths])
        found = []
        if len(part) < len(files):
            found.append(read(_ROWS, [p for p in files if p not in part]))
        if part:
            numbers = ",".join(str(x["idx"]) for own in part.values() for x in own)
            found.append(read(f"{_ROWS}, _table int", part).where(f"_table in ({numbers})").drop("_table"))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def _pending_frame(self) -> DataFrame | None:
        if not self.pending:
            return None
        return self.spark.createDataFrame(self.pending, _ROWS)

    def log_section(self) -> DataFrame:
        """Records above the flush point, in every version."""
        return self._log().drop("commit_id")

    def _log(self) -> DataFrame:
        d = self._frame(x for x in self.state.segments if x["max_seq"] > self.state.flushed).where(F.col("seq") > self.state.flushed)
        p = self._pending_frame()
        d = d if p is None else d.unionByName(p)
        return overwrite_by_commit(d) if self.config.allow_overwrite else d

    def tables(self, level: int | None = None) -> DataFrame:
        return self._tables(t for t in self.state.tables if level is None or t["level"] == level).drop("commit_id")

    def _tables(self, tables: Iterable[dict]) -> DataFrame:
        """Rows of tables; where numbers may be overwritten, the newest commit's of each."""
        d = self._frame(tables)
        return overwrite_by_commit(d) if self.config.allow_overwrite else d

    def _may_hold(self, t: dict, key: bytes | None, low: bytes | None, high: bytes | None) -> bool:
        """Whether a table's bounds, or the bucket of the key, allow for a row."""
        if key is not None:
            low = high = key
            if t["bucket"] is not None and t.get("of") and bucket_number(key, t["of"], self.config.hash_len) != t["bucket"]:
                return False
        return not (low and t["max_key"] is not None and bytes.fromhex(t["max_key"]) < low) and not (high and t["min_key"] is not None and bytes.fromhex(t["min_key"]) > high)

    def rows(self, key: bytes | None = None, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Log section and tables together: what ``resolve`` works on.

        Tables that the manifest shows to hold nothing of a key, or between two bounds,
        are not opened. Where numbers may be overwritten none is left out, as the row
        that overwrites another may have another key.
        """
        if self.config.allow_overwrite:
            return overwrite_by_commit(self._log().unionByName(self._frame(self.state.tables))).drop("commit_id")
        return self.log_section().unionByName(self._tables(t for t in self.state.tables if self._may_hold(t, key, low, high)).drop("commit_id"))

    def live(self) -> DataFrame:
        return resolve(self.rows())

    def _snap(self) -> Snapshot:
        return Snapshot(self.rows, self._next, self.state.flushed)

    def get(self, key):
        return self._snap().get(key)

    def get_record(self, key, meta_only: bool = False):
        return self._snap().get_record(key, meta_only)

    def get_by_seq(self, seq: int, any_type: bool = False):
        """Records still in the log section; tables keep no superseded versions to look up."""
        if seq <= self.state.flushed:
            raise S.AlreadyPurged(str(seq))
        return R.get_by_seq(self.log_section(), seq, self.state.flushed, any_type)

    def nearest(self, key, option: str = "GREATER_OR_EQUAL", meta_only: bool = False):
        return self._snap().nearest(key, option, meta_only)

    def prefix(self, p, limit: int | None = None) -> DataFrame:
        return self._snap().prefix(p, limit)

    def range(self, low=None, high=None, descending: bool = False) -> DataFrame:
        return self._snap().range(low, high, descending)

    def cursor(self, low=None, high=None) -> R.Cursor:
        return self._snap().cursor(low, high)

    def seq_cursor(self, low: int | None = None, high: int | None = None) -> R.Cursor:
        return R.Cursor(self._seq_rows(low), low, high, "seq")

    def seq_scan(self, low: int | None = None, high: int | None = None) -> DataFrame:
        return R.seq_scan(self._seq_rows(low), low, high)

    def _seq_rows(self, low: int | None) -> DataFrame:
        """All that ``low`` or more can show: older tables hold no such row and hide none."""
        if not self.config.seq_index:
            raise S.SeqindexUnavailable()
        held = [t for t in self.state.tables if low is None or t["max_seq"] >= low]
        return self.log_section().unionByName(latest(self._tables(held).drop("commit_id"))) if held else self.log_section()

    # -- writing ---------------------------------------------------------

    def _check_write(self) -> None:
        if self.read_only:
            raise S.WriteViolation(self.path)
        if self._rolling_back:
            raise S.RollbackInProgress()

    def _assign(self, seq: int | None) -> int:
        if seq is None:
            self._next += 1
            return self._next
        if not 0 < seq <= S.MAX_SEQ:
            raise S.InvalidSeqnum(str(seq))
        if seq <= self._next and not self.config.allow_overwrite:
            raise S.InvalidSeqnum(f"{seq} isn't above {self._next}")
        self._next = max(self._next, seq)
        return seq

    def set(self, key, value, meta=None, seq: int | None = None, kind: int = S.INSERT) -> int:
        """Writes one record and returns its sequence number (the next one, unless given)."""
        self._check_write()
        if kind not in (S.INSERT, S.DELETE, S.COMMAND):
            raise S.InvalidParameters(f"type {kind}")
        with self.group.lock:
            n = self._assign(seq)
            self.pending.append((n, kind, bytearray(_bytes(key)), _bytes(meta), None if kind == S.DELETE else _bytes(value), self.state.commit * 10**9 + len(self.pending)))
            return n

    def delete(self, key, meta=None, seq: int | None = None) -> int:
        """A tombstone; an absent key makes no difference."""
        return self.set(key, None, meta, seq, S.DELETE)

    def set_batch(self, records: list[dict]) -> None:
        """All records or none; sequence numbers all unset, or increasing above the maximum."""
        self._stage_batch(records)
        self.sync()

    def _stage_batch(self, records: list[dict]) -> None:
        self._check_write()
        if not records:
            raise S.EmptyBatch()
        seqs = [r.get("seq") for r in records]
        if any(s is not None for s in seqs):
            if any(s is None for s in seqs) or seqs[0] <= self._next or any(b <= a for a, b in zip(seqs, seqs[1:])):
                raise S.InvalidSeqnum("batch")
        for r in records:
            self.set(r["key"], r.get("value"), r.get("meta"), r.get("seq"), r.get("type", S.INSERT))

    def append(self, df: DataFrame, epochs: dict[str, int] | None = None) -> None:
        """A DataFrame of records as one segment and one commit.

        Without a ``seq`` column, numbers follow the order in which rows arrive, from the
        current maximum on, so that of records of one key the last one wins; with one,
        they must be unique and above it. ``epochs`` are committed with the rows.
        """
        self._check_write()
        self.sync()
        meta = F.col("meta").cast("string").cast("binary") if dict(df.dtypes).get("meta") not in (None, "binary") else (F.col("meta") if "meta" in df.columns else F.lit(None).cast("binary"))
        kind = F.col("type").cast("byte") if "type" in df.columns else F.lit(S.INSERT).cast("byte")
        as_bin = lambda c: F.col(c) if dict(df.dtypes)[c] == "binary" else F.col(c).cast("string").cast("binary")
        base = self._next
        if "seq" not in df.columns:
            df = ordered.with_arrival(df, "_rank").withColumn("seq", F.col("_rank") + base + 1)
        d = df.select(F.col("seq").cast("long").alias("seq"), kind.alias("type"), as_bin("key").alias("key"), meta.alias("meta"), F.when(kind != S.DELETE, as_bin("value")).alias("value"), F.lit(self.state.commit * 10**9).cast("long").alias("commit_id"))
        rel = self._write_segment(d)
        seg = self._describe_segment(rel)
        if seg["rows"] == 0:
            raise S.EmptyBatch()
        if not self.config.allow_overwrite and (seg["min_seq"] <= base or seg["distinct"] != seg["rows"]):
            remove(self.spark, f"{self.path}{SEP}{rel}")
            raise S.InvalidSeqnum("appended records")
        self._commit(self._with_segment(seg), epochs)
        self._next = self.state.max_seq

    def _with_segment(self, seg: dict) -> State:
        """The state with one more segment; rows at or below the flush point move it back,
        so that they are read, and flushed again, from the log."""
        return replace(self.state, segments=[*self.state.segments, seg], max_seq=max(self.state.max_seq, seg["max_seq"]), flushed=min(self.state.flushed, seg["min_seq"] - 1))

    def _write_segment(self, d: DataFrame) -> str:
        rel = f"log{SEP}{uuid.uuid4().hex}"
        d.write.option("compression", "zstd").parquet(f"{self.path}{SEP}{rel}")
        return rel

    def _describe_segment(self, rel: str) -> dict:
        r = self._frame([{"path": rel}]).agg(F.count(F.lit(1)), F.min("seq"), F.max("seq"), F.countDistinct("seq")).first()
        return {"path": rel, "rows": r[0], "min_seq": r[1] or 0, "max_seq": r[2] or 0, "distinct": r[3]}

    def _commit(self, s: State, epochs: dict[str, int] | None = None) -> None:
        s.commit = self.state.commit + 1
        self.group.commit({self.name: s}, epochs)
        self.state = s
        self._next = max(self._next, s.max_seq)

    def _stage(self) -> State | None:
        if not self.pending:
            return None
        rel = self._write_segment(self._pending_frame().coalesce(1).sortWithinPartitions("seq"))
        seqs = [p[0] for p in self.pending]
        seg = {"path": rel, "rows": len(seqs), "min_seq": min(seqs), "max_seq": max(seqs), "distinct": len(set(seqs))}
        return self._with_segment(seg)

    def sync(self, wait: bool = True) -> None:
        """Pending rows into a segment and a manifest; without ``wait``, busy is an error."""
        if not self._busy.acquire(blocking=wait):
            raise S.OperationInProgress()
        try:
            with self.group.lock:
                s = self._stage()
                if s is not None:
                    self._commit(s)
                    self.pending = []
        finally:
            self._busy.release()

    def discard_dirty(self, seq_begin: int) -> int:
        """Drops pending records from ``seq_begin`` on; synced ones can't be dropped."""
        with self.group.lock:
            if seq_begin <= self.state.max_seq:
                raise S.InvalidSeqnum("already synced")
            kept = [p for p in self.pending if p[0] < seq_begin]
            n = len(self.pending) - len(kept)
            self.pending = kept
            self._next = max([self.state.max_seq, *(p[0] for p in kept)])
            return n

    # -- sequence numbers and checkpoints -----------------------------------

    def max_seq(self) -> int:
        if not self._next:
            raise S.LogNotExist()
        return self._next

    def min_seq(self) -> int:
        if self.state.flushed:
            return self.state.flushed + 1
        found = [x["min_seq"] for x in self.state.segments] + [p[0] for p in self.pending]
        if not found:
            raise S.LogNotExist()
        return min(found)

    def flushed_seq(self) -> int:
        if not self.state.flushed:
            raise S.InvalidSeqnum("nothing flushed")
        return self.state.flushed

    def synced_seq(self) -> int:
        if not self.state.max_seq:
            raise S.InvalidSeqnum("nothing synced")
        return self.state.max_seq

    def available_seqs(self) -> tuple[int, int]:
        return self.state.flushed + 1, self._next

    def segment_numbers(self) -> dict[str, int]:
        done = sum(x["max_seq"] <= self.state.flushed for x in self.state.segments)
        return {"flushed": done, "synced": len(self.state.segments)}

    def checkpoint(self) -> int | None:
        """Marks the current maximum; the same number twice is one checkpoint, none when empty."""
        self._check_write()
        self.sync()
        if not self.state.max_seq:
            return None
        at = self.state.max_seq
        marks = sorted({*self.state.checkpoints, at})[-self.config.max_checkpoints :]
        if marks != self.state.checkpoints:
            self._commit(replace(self.state, checkpoints=marks))
        return at

    def checkpoints(self) -> list[int]:
        return list(self.state.checkpoints)

    def snapshot(self, at: int | None = None) -> Snapshot:
        """Frozen at a checkpoint (which must exist), or at the current maximum."""
        if at is None:
            return self._snap()
        if at not in self.state.checkpoints:
            raise S.InvalidCheckpoint(str(at))
        return Snapshot(self.rows, at, self.state.flushed)

    # -- truncation ---------------------------------------------------------

    def flush(self, upto: int | None = None, purge_only: bool = False) -> None:
        """The log up to a sequence number into level-0 tables, one per key bucket.

        Tables keep, besides the newest version of a key, the newest one at or below
        each checkpoint, so that no snapshot loses rows. ``purge_only``, and the log
        mode, drop the head of the log and store nothing.
        """
        self._check_write()
        if upto == 0:
            raise S.InvalidSeqnum("0")
        self.sync()
        if not self.state.max_seq:
            raise S.LogNotSynced()
        upto = min(upto or self.state.max_seq, self.state.max_seq)
        if upto <= self.state.flushed:
            raise S.AlreadyFlushed(str(upto))
        s = replace(self.state, flushed=upto, tables=list(self.state.tables))
        if not purge_only and self.config.mode == "table":
            d = self._versions(self._log().where(F.col("seq") <= upto))
            s.tables += self._write_buckets(d, s)
        s.segments = [x for x in s.segments if x["max_seq"] > upto]
        self._commit(s)

    def flush_async(self, upto: int | None = None, handler: Callable | None = None, **options) -> Future:
        """The same in the background; ``handler`` gets the error or None.

        A request that comes while another waits joins it: one flush up to the larger
        number answers both, and every handler is called.
        """
        with self.group.lock:
            q = self._queued
            if q and q["options"] == options:
                q["upto"] = None if None in (q["upto"], upto) else max(q["upto"], upto)
                q["handlers"].append(handler)
                return q["future"]
            q = self._queued = {"upto": upto, "options": options, "handlers": [handler]}

            def work():
                with self.group.lock:
                    if self._queued is q:
                        self._queued = None
                err = None
                try:
                    self.flush(q["upto"], **options)
                except Exception as e:  # noqa: BLE001 - the handler is told of any failure
                    err = e
                for h in q["handlers"]:
                    if h:
                        h(err)
                return err

            q["future"] = self._pool.submit(work)
            return q["future"]

    def rollback(self, upto: int) -> None:
        """Log mode only: forgets what came after ``upto``; numbering resumes there.

        What was purged can't come back, so a number below the purge point is refused.
        """
        if self.config.mode != "log":
            raise S.InvalidMode("rollback needs the log-only mode")
        self._check_write()
        if upto < self.state.flushed:
            raise S.InvalidSeqnum(f"{upto} is below the purge point {self.state.flushed}")
        self._rolling_back = True
        try:
            self.pending = [p for p in self.pending if p[0] <= upto]
            segs = []
            for x in self.state.segments:
                if x["max_seq"] <= upto:
                    segs.append(x)
                elif x["min_seq"] <= upto:
                    segs.append(self._describe_segment(self._write_segment(M.rollback(self._frame([x]), upto))))
            self._commit(replace(self.state, segments=segs, max_seq=min(self.state.max_seq, upto), checkpoints=[c for c in self.state.checkpoints if c <= upto]))
            self._next = max([self.state.max_seq, *(p[0] for p in self.pending)])
        finally:
            self._rolling_back = False

    def truncate_holes(self) -> int | None:
        """Log mode only: drops segments from the first one that doesn't follow its predecessor."""
        if self.config.mode != "log":
            raise S.InvalidMode("numbers may be sparse where tables are")
        self._check_write()
        segs = sorted(self.state.segments, key=lambda x: x["min_seq"])
        for i in range(1, len(segs)):
            if segs[i]["min_seq"] != segs[i - 1]["max_seq"] + 1:
                last = segs[i - 1]["max_seq"]
                self._commit(replace(self.state, segments=segs[:i], max_seq=last))
                self._next = last
                return last
        return None

    def should_flush(self) -> bool:
        return self._next - self.state.flushed > self.config.flush_gap or len(self.state.segments) > self.config.segment_limit

    # -- tables and compaction -------------------------------------------------

    def _versions(self, d: DataFrame) -> DataFrame:
        """The newest version of each key overall and as of each checkpoint, in one pass.

        Of the versions between two checkpoints, the newest is all that is ever seen.
        """
        if not self.state.checkpoints:
            return latest(d)
        w = Window.partitionBy("key", self._epoch()).orderBy(F.desc("seq"))
        return d.where(F.col("type") != S.COMMAND).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    def _epoch(self) -> Column:
        """The first checkpoint at or above a row's number, null after the last one."""
        c = F.lit(None).cast("long")
        for mark in sorted(self.state.checkpoints, reverse=True):
            c = F.when(F.col("seq") <= mark, F.lit(mark)).otherwise(c)
        return c

    def _write_split(self, d: DataFrame, part: Column, level: int, s: State, kind: str, share: int = 1, tables: int | None = None, rows: int | None = None) -> list[dict]:
        """One Spark job writes a directory per ``share`` values of ``part``, each value a table;
        their bounds come from one aggregate. ``tables`` and ``rows`` are how many there are, if known."""
        base, first = f"table{SEP}{uuid.uuid4().hex}", s.next_table
        out = f"{self.path}{SEP}{base}"
        d = d.withColumn("_table", part)
        d = d.withColumn("_part", F.floor(F.col("_table") / share).cast("int")).withColumn("_table", F.col("_table") + first)
        if "commit_id" not in d.columns:
            d = d.withColumn("commit_id", F.lit(0).cast("long"))
        d = d.drop("_rank")
        d = d.repartition(-(-tables // share), "_part") if tables else d.repartition("_part")
        w = d.sortWithinPartitions("_part", "_table", "key").write.option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true")
        if tables and rows:  # else each file has a filter of the greatest size
            w = w.option("parquet.bloom.filter.expected.ndv#key", str(max(1, -(-rows // tables) * share)))
        w.partitionBy("_part").parquet(out)
        got = self.spark.read.schema(f"{_ROWS}, _table int, _part int").parquet(out)
        facts = M.table_stats(got, ["_part", "_table"], F.max("seq").alias("max_seq"), F.min("seq").alias("min_seq")).orderBy("_table").collect()
        held, made = Counter(r["_part"] for r in facts), []
        for r in facts:
            shared = {"shared": held[r["_part"]]} if held[r["_part"]] > 1 else {}
            made.append({"path": f"{base}{SEP}_part={r['_part']}", "level": level, "idx": r["_table"], "bucket": r["_part"] if kind == "bucket" else None, "of": self.config.num_buckets if kind == "bucket" else None, "min_key": bytes(r["min_key"]).hex(), "max_key": bytes(r["max_key"]).hex(), "rows": r["num_kvs"], "bytes": r["bytes"], "min_seq": r["min_seq"], "max_seq": r["max_seq"]} | shared)
            s.next_table = r["_table"] + 1
        return made

    def _write_buckets(self, d: DataFrame, s: State) -> list[dict]:
        return self._write_split(d, bucket("key", self.config.num_buckets, self.config.hash_len), 0, s, "bucket")

    def _write_ranges(self, d: DataFrame, level: int, s: State, tables: int | None = None) -> list[dict]:
        """Tables of equal row count in key order; versions of a key may lie on both sides of a border."""
        ranked = ordered.with_rank(d.select("seq", "type", "key", "meta", "value", *(c for c in d.columns if c == "commit_id")), ["key", "seq"], "_rank")
        n = ranked.count()
        if not n:
            return []
        per = max(1, -(-n // tables)) if tables else self.config.table_rows
        many = -(-n // per)
        share = max(1, min(-(-many // FILES), FILE_ROWS // per))
        return self._write_split(ranked, F.floor(F.col("_rank") / per).cast("int"), level, s, "range", share, many, n)

    def _describe(self, rel: str, level: int, idx: int, b: int | None) -> dict:
        r = self._frame([{"path": rel}]).agg(F.count(F.lit(1)), F.sum(record_size("key", "meta", "value")), F.min("key"), F.max("key"), F.min("seq"), F.max("seq")).first()
        return {"path": rel, "level": level, "idx": idx, "bucket": b, "min_key": bytes(r[2]).hex() if r[2] is not None else None, "max_key": bytes(r[3]).hex() if r[3] is not None else None, "rows": r[0], "bytes": r[1] or 0, "min_seq": r[4] or 0, "max_seq": r[5] or 0}

    def levels(self) -> list[int]:
        return sorted({t["level"] for t in self.state.tables})

    def _last_level(self) -> int:
        return max([1, *self.levels()])

    def _compacted(self, d: DataFrame, into_last: bool, drop: Column | None, preserve: bool) -> DataFrame:
        """What a compaction keeps: the newest versions, and those that checkpoints show.

        On the last level tombstones go, and newest versions that ``drop`` holds for (a
        null verdict keeps them). Where an older version stays for a checkpoint, either
        stays as a tombstone, or the older one would come back to life; and a version
        that a checkpoint shows is never dropped.
        """
        rows = self._versions(d)
        if not into_last or preserve or not self.config.drop_tombstones_on_last_level:
            return rows
        gone = F.col("type") == S.DELETE
        if not self.state.checkpoints:
            return rows.where(~gone & (F.lit(True) if drop is None else ~F.coalesce(drop, F.lit(False))))
        if drop is not None:
            out = ~gone & self._epoch().isNull() & F.coalesce(drop, F.lit(False))
            rows = rows.withColumn("_out", out)
            rows = rows.withColumn("type", F.when(F.col("_out"), F.lit(S.DELETE).cast("byte")).otherwise(F.col("type"))).withColumn("value", F.when(~F.col("_out"), F.col("value"))).drop("_out")
        oldest = F.min(F.when(F.col("type") == S.INSERT, F.col("seq"))).over(Window.partitionBy("key"))
        return rows.withColumn("_oldest", oldest).where(~gone | (F.col("_oldest") < F.col("seq"))).drop("_oldest")

    def _replace(self, gone: list[dict], make: Callable[[State], list[dict]]) -> None:
        out = {(t["path"], t["idx"]) for t in gone}
        s = replace(self.state, tables=[t for t in self.state.tables if (t["path"], t["idx"]) not in out])
        s.tables = [*s.tables, *make(s)]
        self._commit(s)

    def _need_tables(self) -> None:
        self._check_write()
        if self.config.mode == "log":
            raise S.TablesAreDisabled()

    def compact_l0(self, buckets: list[int] | None = None, drop: Column | None = None, preserve_tombstones: bool = False) -> None:
        """Level-0 buckets (all, or some) merged with level 1 and rewritten as ranges."""
        self._need_tables()
        l0 = [t for t in self.state.tables if t["level"] == 0 and (buckets is None or t["bucket"] in buckets)]
        if not l0:
            return
        l1 = self._overlapping(l0, 1)
        d = self._tables([*l0, *l1])
        whole = self._last_level() == 1 and len(l0) == sum(t["level"] == 0 for t in self.state.tables)
        self._replace([*l0, *l1], lambda s: self._write_ranges(self._compacted(d, whole, drop, preserve_tombstones), 1, s))

    def _overlapping(self, tables: list[dict], level: int) -> list[dict]:
        low, high = min(t["min_key"] for t in tables), max(t["max_key"] for t in tables)
        return [t for t in self.state.tables if t["level"] == level and t["min_key"] <= high and t["max_key"] >= low]

    def _level(self, level: int) -> list[dict]:
        if level < 1 or level not in self.levels():
            raise S.InvalidLevel(str(level))
        return [t for t in self.state.tables if t["level"] == level]

    def compact_level(self, level: int, drop: Column | None = None, preserve_tombstones: bool = False) -> None:
        """The stalest table of a level merged into what it overlaps one level below."""
        self._need_tables()
        victim = self.pick_victim(level)
        below = self._overlapping([victim], level + 1)
        d = self._tables([victim, *below])
        last = level + 1 >= self._last_level()
        self._replace([victim, *below], lambda s: self._write_ranges(self._compacted(d, last, drop, preserve_tombstones), level + 1, s))

    def compact_inplace(self, level: int, drop: Column | None = None, preserve_tombstones: bool = False) -> None:
        """Rewrites a level within its bounds."""
        self._need_tables()
        own = self._level(level)
        d = self._tables(own)
        self._replace(own, lambda s: self._write_ranges(self._compacted(d, level == self._last_level(), drop, preserve_tombstones), level, s))

    def migrate_level(self, level: int) -> None:
        """Tables of the last level one level down, by manifest alone."""
        own = self._level(level)
        if level != self._last_level():
            raise S.InvalidLevel(str(level))
        self._replace(own, lambda s: [{**t, "level": level + 1} for t in own])

    def split_level(self, level: int, parts: int = 2) -> None:
        """The largest table of a level as several of equal key count."""
        self._need_tables()
        big = max(self._level(level), key=lambda t: t["bytes"])
        self._replace([big], lambda s: self._write_ranges(self._tables([big]), level, s, parts))

    def merge_level(self, level: int) -> None:
        """The smallest table of a level and its left neighbour (or right, at the start) as one."""
        self._need_tables()
        own = sorted(self._level(level), key=lambda t: t["min_key"])
        if len(own) < 2:
            return
        i = min(range(len(own)), key=lambda k: own[k]["bytes"])
        pair = [own[i], own[i - 1 if i else 1]]
        self._replace(pair, lambda s: self._write_ranges(self._tables(pair), level, s, 1))

    def compact_upto(self, idx: int) -> int:
        """Rewrites, in their level, all range tables numbered ``idx`` or less."""
        self._need_tables()
        old = [t for t in self.state.tables if t["idx"] <= idx and t["level"] > 0]
        for level in sorted({t["level"] for t in old}):
            own = [t for t in old if t["level"] == level]
            d = self._tables(own)
            self._replace(own, lambda s, d=d, level=level: self._write_ranges(self._compacted(d, level == self._last_level(), None, False), level, s))
        return len(old)

    def set_buckets(self, n: int) -> None:
        """Drains level 0 into level 1; later flushes, also after reopening, use ``n`` buckets."""
        if n < 1:
            raise S.InvalidParameters("buckets")
        self.compact_l0()
        self.update_config(num_buckets=n)

    def update_config(self, **changes) -> None:
        """Changes settings of an open store and stores them in the manifest."""
        self._check_write()
        if "num_buckets" in changes and any(t["level"] == 0 for t in self.state.tables):
            raise S.InvalidParameters("level 0 isn't empty")
        before, self.config = self.config, replace(self.config, **changes)
        try:
            self._commit(replace(self.state))
        except BaseException:
            self.config = before
            raise

    def stale_percent(self, t: dict) -> float:
        """Percent of rows written since a table was made, of its own, that its keys share in.

        What the levels above hold between its bounds, by its share of their key range
        (counted in tables), against its own rows: 100 and that is what a merge can save.
        """
        return self._stale_percents([t])[0]

    def _stale_percents(self, tables: list[dict]) -> list[float]:
        """``stale_percent`` of tables of one level."""
        level, by_level = tables[0]["level"], {}
        for x in self.state.tables:
            by_level.setdefault(x["level"], []).append(x)
        own = _Spans(by_level.get(level, []))
        above = [_Spans(by_level[x]) for x in sorted(by_level) if x < level]
        share = {id(x): x["rows"] / max(1, own.count(x)) for spans in above for x in spans.tables}
        return [100 * (1 + sum(share[id(x)] for spans in above for x in spans.overlapping(t)) / max(1, t["rows"])) for t in tables]

    def pick_victim(self, level: int) -> dict:
        """The stalest table of a level, the largest of equals, then the oldest."""
        own = self._level(level)
        stale = self._stale_percents(own)
        return own[min(range(len(own)), key=lambda i: (-stale[i], -own[i]["rows"], own[i]["idx"]))]

    def pick_action(self) -> tuple[str, int] | None:
        """What to do next, and on which level, most urgent first.

        Level 0 with more tables than buckets is drained; a level beyond its size limit
        goes down, in whole by the manifest alone where nothing lies below; a table of
        twice the size is split; a stale table is merged down (in place on the last
        level); neighbours that together are small are merged.
        """
        if sum(t["level"] == 0 for t in self.state.tables) > self.config.num_buckets:
            return "compact_l0", 0
        for level in [x for x in self.levels() if x > 0]:
            own = self._level(level)
            if len(own) > self.level_limit(level):
                return ("migrate_level" if level == self._last_level() else "compact_level"), level
            if max(t["rows"] for t in own) > 2 * self.config.table_rows:
                return "split_level", level
            if self.stale_percent(self.pick_victim(level)) > self.config.stale_percent:
                return ("compact_inplace" if level == self._last_level() else "compact_level"), level
            rows = [t["rows"] for t in sorted(own, key=lambda t: t["min_key"])]
            if len(rows) > 1 and min(a + b for a, b in zip(rows, rows[1:])) < self.config.table_rows // 4:
                return "merge_level", level
        return None

    def level_limit(self, level: int) -> int:
        """Tables of a level before it counts as too large: ten times more on each."""
        return self.config.level_tables * 10 ** (level - 1)

    def maintain(self, most: int = 16) -> list[str]:
        """Carries out what ``pick_action`` asks for until nothing is left, ``most`` at once."""
        done = []
        while len(done) < most and (found := self.pick_action()):
            action, level = found
            (self.compact_l0() if action == "compact_l0" else getattr(self, action)(level))
            done.append(action)
        return done

    # -- statistics -----------------------------------------------------------

    def stats(self) -> dict:
        """Approximate count: table rows plus the span of the log section."""
        rows = sum(t["rows"] for t in self.state.tables)
        return {"num_kvs": rows + max(0, self._next - self.state.flushed), "working_set_bytes": sum(t["bytes"] for t in self.state.tables), "num_tables": len(self.state.tables), "min_table": min([t["idx"] for t in self.state.tables], default=None), "max_table": max([t["idx"] for t in self.state.tables], default=None)}

    def exact_count(self) -> int:
        return self.live().count()

    def hierarchy(self) -> DataFrame:
        cols = "level int, idx int, bucket int, min_key string, max_key string, rows long, bytes long, min_seq long, max_seq long"
        return self.spark.createDataFrame([tuple(t[c.split()[0]] for c in cols.split(", ")) for t in self.state.tables], cols)

    def level_size(self, level: int) -> int:
        return sum(t["bytes"] for t in self.state.tables if t["level"] == level)

    def sample_keys(self, n: int, live_only: bool = False) -> DataFrame:
        return M.sample_keys(self.rows(), n, live_only)


def global_batch(batches: list[tuple[Store, list[dict]]]) -> None:
    """Batches for several stores: those of one group become visible in one manifest.

    Read-only stores and a store's second batch are skipped. All batches are checked
    before any row is staged. Groups commit in path order.
    """
    seen: dict[int, tuple[Store, list[dict]]] = {}
    for db, records in batches:
        if not db.read_only and id(db) not in seen:
            seen[id(db)] = (db, records)
    staged: list[Store] = []
    try:
        for db, records in sorted(seen.values(), key=lambda x: (x[0].path, x[0].name)):
            db.sync()
            db._stage_batch(records)
            staged.append(db)
    except S.StoreError:
        for db in [x for x, _ in seen.values()]:
            if db.pending:
                db.discard_dirty(db.state.max_seq + 1)
        raise
    groups: dict[int, list[Store]] = {}
    for db in staged:
        groups.setdefault(id(db.group), []).append(db)
    for stores in groups.values():
        states = {}
        for db in stores:
            s = db._stage()
            s.commit = db.state.commit + 1
            states[db.name] = s
        stores[0].group.commit(states)
        for db in stores:
            db.state, db.pending = states[db.name], []
