"""Passages that repeat across documents, by a column-wise multi-document suffix order.

Every window of ``LENGTH`` words holds a chosen word n-gram (winnowing: the least hash
of its n-grams), the same one wherever the window occurs. N-grams chosen once can't lie
in a repeat, and the rest split the suffixes into independent collections: all texts
around one n-gram, the only ones that are indexed. That is exact, as every occurrence of
a window lies in the collection of its n-gram. Each collection is indexed column by
column: every round puts one more symbol in front of every text and finds the place of
the longer suffix by its rank in the Burrows-Wheeler transform so far. The transform is
kept by symbol (symbol, place), so that the rank of a symbol before a place is a binary
search; it and the common prefixes go from one sequential file to the next, and nothing
but the texts' own places stays in memory between rounds. Neighbours with LENGTH symbols
in common are occurrences of one passage; the first (by document, then place) is kept.

An n-gram with more than ``HOT`` places would make a collection that no task holds. Its
texts are split by the longest context that a window can have, the whole window: each
window around it goes by its hash to a sorted run, whose first row is the first
occurrence, so that nothing is held at all.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import text as tx
from tidemark.sources.shared import arrow_folder, gone_at_exit, new_path, remove, written

LENGTH, GRAM = 50, 25
#: Places of an n-gram beyond which its windows are told apart by their hashes.
HOT = 16_000
#: Symbols indexed together, unless one n-gram alone has more.
CHUNK = 1_200_000


class Spool:
    """Sequential files in a folder that all machines share: one per round, the last one kept."""

    def __init__(self, folder: str):
        self.fs, root = arrow_folder(folder)
        self.root = f"{root}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.root, recursive=True)
        self.last: str | None = None

    def put(self, *arrays: np.ndarray) -> None:
        name = f"{self.root}/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(name, compression=None) as f:
            for a in arrays:
                f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
        if self.last:
            self.fs.delete_file(self.last)
        self.last = name

    def get(self, n: int, *kinds) -> list[np.ndarray]:
        with self.fs.open_input_stream(self.last, compression=None) as f:
            return [np.frombuffer(f.read(n * np.dtype(k).itemsize), k) for k in kinds]

    def close(self) -> None:
        self.fs.delete_dir(self.root)


def _range_min(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of a[lo..hi], both ends included."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), a.dtype)
    cur, width = a, 1
    order = np.argsort(level, kind="stable")
    cut = np.searchsorted(level[order], np.arange(int(level.max()) + 2)) if len(level) else [0]
    for lv in range(len(cut) - 1):
        q = order[cut[lv] : cut[lv + 1]]
        if len(q):
            out[q] = np.minimum(cur[lo[q]], cur[hi[q] - width + 1])
        if lv + 2 < len(cut):
            cur = np.minimum(cur[:-width], cur[width:])
            width *= 2
    return out


def index(texts: list[np.ndarray] | tuple[np.ndarray, np.ndarray], spool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of a collection: text, suffix length, common prefix with the one before, transform.

    ``texts`` are symbols >= 1 one after the other and their lengths. Every text has an
    end of its own that comes before all symbols and equals no other end.
    """
    flat, size = texts if isinstance(texts, tuple) else (np.concatenate(texts), np.array([len(t) for t in texts]))
    m = len(size)
    end = np.cumsum(size)
    small = np.uint8 if size.max(initial=0) < 250 else np.uint32
    place = np.arange(m)  # of each text's longest suffix so far
    # the transform by symbol: entry i, the i-th suffix, begins with sym[i] and is that symbol before the suffix at tail[i]
    n = m
    spool.put(np.zeros(m, np.int32), np.arange(m), np.zeros(m, small), np.arange(m, dtype=np.int32), np.zeros(m, small))
    for r in range(1, int(size.max(initial=0)) + 1):
        sym, tail, lcp, who, length = spool.get(n, np.int32, np.int64, small, np.int32, small)
        active = np.flatnonzero(size >= r)
        c = flat[end[active] - r].astype(np.int64)
        # rank of c before the place, with those of all lesser symbols
        span = n + 1
        key = c * span + place[active]
        o = np.argsort(key)
        new = np.searchsorted(sym.astype(np.int64) * span + tail, key[o]) + np.arange(len(active))
        total = n + len(active)
        old = np.ones(total, bool)
        old[new] = False
        where = np.flatnonzero(old)  # new place of each old suffix

        def joined(a, b, old=old, new=new, total=total):
            out = np.empty(total, a.dtype)
            out[old] = a
            out[new] = b
            return out

        sym, tail, who, length = joined(sym, c[o]), joined(tail, place[active][o]), joined(who, active[o]), joined(length, r)
        lcp2 = joined(lcp, 0)
        touched = np.unique(np.concatenate([new, new + 1]))
        touched = touched[(touched < total) & (touched > 0)]
        same = (sym[touched] == sym[touched - 1]) & (sym[touched] > 0)
        lcp2[touched[~same]] = 0
        q = touched[same]
        if len(q):
            lcp2[q] = _range_min(lcp, tail[q - 1] + 1, tail[q]) + 1
        tail = where[tail]
        tail[sym == 0] = np.flatnonzero(sym == 0)
        spool.put(sym, tail, lcp2, who, length)
        place = where[place]
        place[active[o]] = new
        n = total
    sym, tail, lcp, who, length = spool.get(n, np.int32, np.int64, small, np.int32, small)
    bwt = np.zeros(n, np.int32)
    bwt[tail[sym > 0]] = sym[sym > 0]
    return who, length, lcp, bwt


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chosen n-grams: hash, row and word place within the row; and the words of each row."""
    starts, ends, rows = tx.words(data, offs)
    n_rows = len(offs) - 1
    words = np.bincount(rows, minlength=n_rows)
    h = tx.hashes(data, starts, ends)
    n, w = len(h), length - gram + 1
    z = np.zeros(0, np.int64)
    if n < length:
        return z.astype(np.uint64), z, z, words
    p, inv = tx._power(n + 1)
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:n], dtype=np.uint64)])
    g = tx.mix((s[gram:] - s[:-gram]) * inv[: n - gram + 1]) | np.uint64(1)
    low = _sliding(g, w, np.minimum)
    low[rows[: len(low)] != rows[length - 1 :]] = 0  # windows that would cross a row
    pad = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_sliding(pad, w, np.maximum) == g)
    return g[at], rows[at], at - np.concatenate([[0], np.cumsum(words)])[rows[at]], words


def _sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over each run of w values."""
    width = 1
    cur = a
    while width * 2 <= w:
        cur = f(cur[:-width], cur[width:])
        width *= 2
    n = len(a) - w + 1
    return f(cur[:n], cur[w - width : w - width + n])


def repeats_in(who_doc: np.ndarray, begin: np.ndarray, flat: np.ndarray, size: np.ndarray, spool, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences after the first of each window: document number, word place, document of the first.

    Document numbers must be in the order of preference. Equal texts are indexed once.
    """
    _, codes = np.unique(flat, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    end = np.cumsum(size)
    p, inv = tx._power(len(codes) + 1)
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(codes.astype(np.uint64)) * p[: len(codes)], dtype=np.uint64)])
    name = tx.mix((s[end] - s[end - size]) * inv[end - size] + size.astype(np.uint64))
    _, one, cls = np.unique(name, return_index=True, return_inverse=True)
    order = np.argsort(cls, kind="stable")
    cut = np.searchsorted(cls[order], np.arange(len(one) + 1))
    who, ln, lcp, _ = index((codes[tx.ragged(end[one] - size[one], size[one])], size[one]), spool)
    group = np.cumsum(lcp < length)
    ok = np.flatnonzero(ln >= length)
    who, ln, group = who[ok], ln[ok].astype(np.int64), group[ok]
    copies = np.diff(cut)[who]
    occ = order[tx.ragged(cut[who], copies)]  # every text in which the window lies
    group = np.repeat(group, copies)
    place = begin[occ] + size[occ] - np.repeat(ln, copies)
    doc = who_doc[occ]
    o = np.lexsort((place, doc, group))
    group, place, doc = group[o], place[o], doc[o]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    again = np.zeros(len(group), bool)  # one window seen twice, around two places of one n-gram
    again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    isfirst = (doc == doc[lead]) & (place == place[lead])
    keep = ~isfirst & ~again
    return doc[keep], place[keep], doc[lead][keep]


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, start, end, first_doc_id): spans of words that repeat earlier text.

    A word counts if it lies in a window of ``length`` words whose words all occur, in
    that order, before: in a document of lesser key, or earlier in the same one. Words
    are runs between ASCII white space. Keys may be of any type that has an order. Null
    keys, null, empty and blank texts take no part; rows equal in key and text are one
    document, rows of one key with other texts are ordered by a hash of the text; very
    long texts are read whole, one at a time; other columns aren't read, so that their
    names can't clash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "columns")
    gone_at_exit(spark, folder)
    d = docs.select(F.col(key).alias("doc_id"), F.col(column).cast("string").alias("text")).where("doc_id is not null and text is not null")
    d, names = tx.numbered(d, "doc_id")
    d = d.withColumn("t", F.xxhash64("text", F.length("text")))

    def choose(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in tx.slices(b.column(2)):
                g, row, at, words = anchors(data, offs, length, gram)
                ids, t = b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
                # a row for each chosen n-gram, and one with the number of words for each text long enough
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([ids.take(take), t.take(take), pa.array(g.view(np.int64)), pa.array(at.astype(np.int32))], ["doc_id", "t", "g", "at"])
                long = np.flatnonzero(words >= length)
                take = pa.array(long)
                yield pa.RecordBatch.from_arrays([ids.take(take), t.take(take), pa.nulls(len(long), pa.int64()), pa.array(words[long].astype(np.int32))], ["doc_id", "t", "g", "at"])

    chosen, chosen_path = written(d.select("doc_id", "t", "text").mapInArrow(choose, "doc_id long, t long, g long, at int"), "ngrams")
    # equal texts: the least key stands for all, the others repeat it whole
    whole = chosen.where("g is null").select("doc_id", "t", "at")
    first = whole.groupBy("t", "at").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).where("rep <> other").drop("other")
    whole, _ = written(whole.join(first, ["t", "at"]).where("doc_id <> rep").select("doc_id", "t", F.col("at").alias("words"), "rep").distinct(), "whole")
    seen = chosen.where("g is not null").repartition("g").groupBy("g", "t", "at").agg(F.min("doc_id").alias("doc_id"))
    # with the exchange by g in place, this is one sort; rows are four numbers, and beyond memory they spill
    shared = seen.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g"))).where("n > 1").withColumn("hot", F.col("n") > HOT)
    places, places_path = written(shared.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("at", "g", "hot"))).alias("at")), "places")
    remove(spark, chosen_path)

    fields = ["g", "doc_id", "t", "begin", "words"]

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, offs = tx.raw(b.column(2).slice(i, 1))
                starts, ends, _ = tx.words(data, offs)
                full = tx.hashes(data, starts, ends)
                h = (full >> np.uint64(32)).astype(np.uint32)
                at = b.column(3)[i].values
                g, pos = at.field("g").to_numpy(), np.asarray(at.field("at"), np.int64)
                hot = at.field("hot").to_numpy(zero_copy_only=False)
                who = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                yield from _windows(full, pos[hot], who, length, gram)
                g, pos = g[~hot], pos[~hot]
                lo = np.maximum(pos - (length - gram), 0)
                size = np.minimum(pos + length, len(h)) - lo
                for k in range(0, len(pos), 20_000):
                    e = min(k + 20_000, len(pos))
                    off = np.concatenate([[0], np.cumsum(size[k:e])])
                    body = h[tx.ragged(lo[k:e], size[k:e])]
                    yield pa.RecordBatch.from_arrays([pa.array(g[k:e]), pa.array(np.full(e - k, who[0], np.int64)), pa.array(np.full(e - k, who[1], np.int64)), pa.array(lo[k:e].astype(np.int32)), pa.Array.from_buffers(pa.binary(), e - k, [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])], fields)

    def _windows(full: np.ndarray, pos: np.ndarray, who: tuple[int, int], length: int, gram: int) -> Iterator[pa.RecordBatch]:
        # a row without words for each window around a hot n-gram, by the window's hash
        lo, hi = np.maximum(pos - (length - gram), 0), np.minimum(pos, len(full) - length)
        begin = np.unique(tx.ragged(lo, np.maximum(hi - lo + 1, 0)))
        if not len(begin):
            return
        p, inv = tx._power(len(full) + 1)
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(full * p[: len(full)], dtype=np.uint64)])
        name = tx.mix((s[begin + length] - s[begin]) * inv[begin])
        n = len(begin)
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.full(n, who[0], np.int64)), pa.array(np.full(n, who[1], np.int64)), pa.array(begin.astype(np.int32)), pa.nulls(n, pa.binary())], fields)

    around = d.join(places, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "text", "at")
    around = around.mapInArrow(cut, "g long, doc_id long, t long, begin int, words binary").withColumn("window", F.col("words").isNull())
    around = around.repartition("window", "g").sortWithinPartitions("window", "g", "doc_id", "t", "begin").select(*fields)
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("src", pa.int64())])

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, hs = t.column("doc_id").to_numpy(), t.column("t").to_numpy()
        docs_, doc = np.unique(np.stack([ids, hs], 1), axis=0, return_inverse=True)
        flat, off = tx.raw(t.column("words"))
        size = np.diff(off) // 4
        spool = Spool(folder)
        try:
            dn, place, src = repeats_in(doc.ravel(), t.column("begin").to_numpy().astype(np.int64), flat.view(np.uint32), size, spool, length)
        finally:
            spool.close()
        o = np.lexsort((src, place, dn))
        dn, place, src = dn[o], place[o], src[o]
        if not len(dn):
            return
        one = np.r_[True, (dn[1:] != dn[:-1]) | (place[1:] != place[:-1])]  # the least source
        dn, place, src = dn[one], place[one], src[one]
        new = np.r_[True, (dn[1:] != dn[:-1]) | (src[1:] != src[:-1]) | (place[1:] != place[:-1] + 1)]
        lo = np.flatnonzero(new)
        hi = np.r_[lo[1:], len(dn)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(docs_[dn[lo], 0]), pa.array(docs_[dn[lo], 1]), pa.array(place[lo].astype(np.int32)), pa.array((place[hi] + length).astype(np.int32)), pa.array(docs_[src[lo], 0])], schema=schema)

    def again(batches) -> Iterator[pa.RecordBatch]:
        # rows of windows by hash, then place: the first of each hash is the first occurrence
        last = before = None  # the last row, and the document of the first of its hash
        for b in batches:
            g, doc, t, at = (b.column(i).to_numpy() for i in range(4))
            if not len(g):
                continue
            rows = np.stack([g, doc, t, at.astype(np.int64)], 1)
            prior = np.concatenate([last if last is not None else rows[:1] - 1, rows[:-1]])
            new, twice = rows[:, 0] != prior[:, 0], (rows == prior).all(1)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            src = np.where(lead >= 0, doc[lead], before if before is not None else 0)
            keep = np.flatnonzero(~new & ~twice)
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(t[keep]), pa.array(at[keep]), pa.array(at[keep] + np.int32(length)), pa.array(src[keep])], schema=schema)
            last, before = rows[-1:], src[-1]

    def gather(batches) -> Iterator[pa.RecordBatch]:
        """A partition's rows: those with words, then those of windows."""
        batches, rest = iter(batches), []

        def with_words() -> Iterator[pa.RecordBatch]:
            for b in batches:
                k = b.num_rows - b.column(4).null_count
                if k:
                    yield b.slice(0, k)
                if k < b.num_rows:
                    rest.append(b.slice(k))
                    return

        yield from texts(with_words())
        yield from again(itertools.chain(rest, batches))

    def texts(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column("words").nbytes // 4
            if size < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            lo = int(np.flatnonzero(g == g[-1])[0])
            if lo:  # the last n-gram may go on in the next batch
                yield from _blocks(t.slice(0, lo))
                t = t.slice(lo).combine_chunks()
            held, size = t.to_batches(), t.column("words").nbytes // 4
        if held:
            yield from _blocks(pa.Table.from_batches(held))

    def _blocks(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        g = t.column("g").to_numpy()
        edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        used = np.concatenate([[0], np.cumsum(np.diff(tx.raw(t.column("words"))[1]) // 4)])[edge]
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(used, used[i] + CHUNK, "right")) - 1)
            yield from solve(t.slice(edge[i], edge[j] - edge[i]).combine_chunks())
            i = j

    runs, runs_path = written(around.mapInArrow(gather, "doc_id long, t long, lo int, hi int, src long"), "runs")
    remove(spark, places_path)
    remove(spark, folder)
    # windows of one document: overlapping or touching ones make one span
    order = Window.partitionBy("doc_id", "t").orderBy("lo", F.desc("hi"))
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = runs.withColumn("new", (reach.isNull() | (F.col("lo") > reach)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.groupBy("doc_id", "t", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("end"), F.min(F.struct("lo", "src")).alias("s")).select("doc_id", "t", "start", "end", F.col("s.src").alias("first_doc_id"))
    spans, _ = written(spans, "spans")
    remove(spark, runs_path)
    begins = spans.where("start = 0").select(F.col("doc_id").alias("rep"), "t", F.col("first_doc_id").alias("earlier"))
    copied = whole.join(begins, ["rep", "t"], "left").select("doc_id", "t", F.lit(0).alias("start"), F.col("words").alias("end"), F.coalesce("earlier", "rep").alias("first_doc_id"))
    return tx.named(spans.unionByName(copied).withColumnRenamed("t", "text_hash"), names, "doc_id", "first_doc_id")


def drop_repeats(docs: DataFrame, length: int = LENGTH, column: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the spans that repeat earlier text; rows of which no word is left go.

    Rows without spans (among them those with null keys or null, empty or blank texts)
    come back as they were; of others the text is cut, and ``n_chars`` (where there is
    such a column) follows. Rows equal in key and text are cut alike. Columns keep names
    and order, whatever they are called; an empty table stays empty.
    """
    k, t, cuts, own, new = tx.free(docs.columns, "rep_key", "rep_text", "rep_spans", "rep_hash", "rep_new")
    spans = repeated(docs, length, column=column, key=key)
    spans = spans.groupBy(F.col("doc_id").alias(k), F.col("text_hash").alias(t)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
    text = F.col(column).cast("string")
    d = docs.withColumn(own, F.xxhash64(text, F.length(text))).join(spans, (F.col(key) == F.col(k)) & (F.col(own) == F.col(t)), "left")
    hit = F.col(cuts).isNotNull()
    d = d.withColumn(new, F.when(hit, _cut(text, F.col(cuts))).otherwise(text)).where(~hit | F.col(new).rlike(r"[^\x09-\x0d\x1c-\x20]"))
    cols = []
    for c in docs.columns:
        if c == column:
            cols.append(F.col(new).alias(c))
        elif c == "n_chars":
            cols.append(F.when(hit, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return d.select(*cols)


def _without(texts: pd.Series, lists: pd.Series) -> pd.Series:
    out = []
    for x, s in zip(texts, lists):
        if x is None or s is None:
            out.append(x)
            continue
        raw = np.frombuffer(x.encode(), np.uint8)
        starts, _, _ = tx.words(raw, np.array([0, len(raw)]))
        keep = np.ones(len(raw), bool)
        for span in s:
            a, b = span["start"], span["end"]
            keep[starts[a] : starts[b] if b < len(starts) else len(raw)] = False
        out.append(raw[keep].tobytes().decode())
    return pd.Series(out)


def _cut(text, spans):
    return F.pandas_udf(_without, T.StringType())(text, spans)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "end", "first_doc_id")


ORACLE = f"""with d as (select doc_id, list_filter(regexp_split_to_array(text, '[\\x09-\\x0d\\x1c-\\x20]+'), lambda x: x<>'') as ws from documents where text is not null and doc_id is not null),
 w as (select doc_id, ws, unnest(range(0, len(ws)-{LENGTH - 1})) as p from d),
 k as (select doc_id, p, array_to_string(ws[p+1:p+{LENGTH}], ' ') as s from w),
 f as (select doc_id, p, first_value(doc_id) over v as src, row_number() over v as rn from k window v as (partition by s order by doc_id, p)),
 g as (select doc_id, p, src, case when p - lag(p) over (partition by doc_id order by p) <= {LENGTH} then 0 else 1 end as new from f where rn>1),
 i as (select *, sum(new) over (partition by doc_id order by p) as island from g)
 select doc_id, min(p)::int as start, (max(p)+{LENGTH})::int as "end", arg_min(src, p) as first_doc_id from i group by doc_id, island"""
