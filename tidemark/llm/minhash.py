"""Near-duplicate documents by one-permutation MinHash.

One hash of each word n-gram gives both a bin and a value; a bin keeps its least value,
and empty bins borrow from others by a 2-universal walk (optimal densification). Bands
of the signature are bucket keys. In a bucket every document is compared with the least
one alone (a star), so n documents make n - 1 pairs. Where some fail, the bucket is
searched further: up to ``FEW`` of them are compared with all others of the bucket;
where more fail, its documents are sorted by their signatures from ``ORDERS`` different
places on, and each is compared with the ``WINDOW`` before it. So a bucket of n documents
makes n times a constant pairs, however large it is and however unlike they are.
Connected components of the pairs that agree are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.sources.shared import remove, written

BINS, BANDS, GRAM, THRESHOLD = 160, 40, 3, 0.45
#: Documents failing against a bucket's least one that are compared with all others.
FEW = 64
#: Sort orders of a bucket in which more fail, and the neighbours in each that are compared.
ORDERS, WINDOW = 8, 8


def signatures(data: np.ndarray, offs: np.ndarray, bins: int = BINS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """32-bit signatures (rows x bins) and which rows have words at all.

    Words are runs between white space and ASCII punctuation, ASCII case folded; in
    scripts without spaces each character is one. Texts shorter than an n-gram count as
    one gram.
    """
    n = len(offs) - 1
    starts, ends, rows = tx.words(data, offs, tx.PUNCT, signs=True)
    h = tx.hashes(data, starts, ends, fold=True)
    g, at = tx.grams(h, rows, gram)
    r = rows[at]
    words = np.bincount(rows, minlength=n)
    short = np.flatnonzero((words > 0) & (words < gram))
    if len(short):
        first = np.searchsorted(rows, short)
        acc = np.zeros(len(short), np.uint64)
        for j in range(gram - 1):
            has = words[short] > j
            acc[has] = acc[has] * np.uint64(31) + h[first[has] + j]
        g, r = np.concatenate([g, tx.mix(acc)]), np.concatenate([r, short])
    b = ((g >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    slot = r * bins + b.astype(np.int64)
    sig = np.full(n * bins, 0xFFFFFFFF, np.uint32)
    np.minimum.at(sig, slot, (g & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    return densify(sig.reshape(n, bins)), words > 0


def densify(sig: np.ndarray) -> np.ndarray:
    """Each empty bin takes the value of the first filled bin on its own walk."""
    bins = sig.shape[1]
    empty = sig == 0xFFFFFFFF
    rows, cols = np.nonzero(empty & ~empty.all(1)[:, None])
    out, tries = sig.copy(), 0
    while len(rows):
        tries += 1
        step = tx.mix(cols.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(tries * 0x85EBCA77C2B2AE63 % 2**64))
        to = (step % np.uint64(bins)).astype(np.int64)
        ok = ~empty[rows, to]
        # borrowed values are marked by the try, so that they agree only if both walks ended together
        out[rows[ok], cols[ok]] = sig[rows[ok], to[ok]] ^ np.uint32(tries & 1)
        rows, cols = rows[~ok], cols[~ok]
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit bucket key for each row and band."""
    n, bins = sig.shape
    x = sig.reshape(n, bands, bins // bands).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
    for j in range(x.shape[2]):
        key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
    return key


def sign(docs: DataFrame, column: str, key: str) -> DataFrame:
    """Key, signature, band keys and a 128-bit name of the signature, for texts with words."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in tx.slices(b.column(1)):
                sig, ok = signatures(data, offs)
                ids = b.column(0).slice(lo, hi - lo).filter(pa.array(ok))
                sig = sig[ok]
                n = len(sig)
                keys = band_keys(sig)
                one = tx.mix(keys.sum(1, dtype=np.uint64))
                two = tx.mix((keys * np.arange(1, 2 * BANDS, 2, dtype=np.uint64)).sum(1, dtype=np.uint64))
                cut = pa.array((np.arange(n + 1) * BANDS).astype(np.int32))
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS * 4), n, [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()) if n else pa.array([], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, raw, pa.ListArray.from_arrays(cut, pa.array(keys.ravel().view(np.int64))), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["doc_id", "sig", "bands", "s1", "s2"])

    d = docs.select(F.col(key).alias("doc_id"), F.col(column).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return d.mapInArrow(work, f"doc_id {_kind(d, 'doc_id')}, sig binary, bands array<long>, s1 long, s2 long")


def _kind(d: DataFrame, column: str) -> str:
    return d.schema[column].dataType.simpleString()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal signature places: an estimate of the Jaccard similarity."""
    return (a == b).mean(-1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1) if len(column) else np.zeros((0, BINS), np.uint32)


def _agree(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (columns a, b and both signatures) with their verdict."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(agreement(_matrix(t.column(2)), _matrix(t.column(3))) >= threshold)], ["a", "b", "same"])

    return pairs.mapInArrow(work, f"a {_kind(pairs, 'a')}, b {_kind(pairs, 'b')}, same boolean")


def _runs(batches, column: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of rows equal in a column, cut at batches, and whether each begins anew."""
    last = object()
    for b in batches:
        v = b.column(column).to_numpy()
        edge = np.flatnonzero(np.r_[True, v[1:] != v[:-1], True]) if len(v) else []
        for lo, hi in zip(edge[:-1], edge[1:]):
            yield v[lo] != last, b.slice(lo, hi - lo)
            last = v[lo]


def _edges(a: pa.Array, b: pa.Array, at: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a.take(pa.array(at)), b.take(pa.array(to))], ["a", "b"])


def against_few(batches, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs that agree of each bucket's failed documents with one another and with the rest.

    Rows (bucket, doc_id, failed, sig), of a bucket the failed ones first. Only these are held.
    """
    few = sig = None
    for new, b in _runs(batches, 0):
        if new:
            few, sig = b.column(1).slice(0, 0), np.zeros((0, BINS), np.uint32)
        failed, x = b.column(2).to_numpy(zero_copy_only=False), _matrix(b.column(3))
        for i in np.flatnonzero(failed):
            to = np.flatnonzero(agreement(sig, x[i]) >= threshold)
            if len(to):
                yield _edges(b.column(1), few, np.full(len(to), i), to)
            few, sig = pa.concat_arrays([few, b.column(1).slice(i, 1)]), np.concatenate([sig, x[i : i + 1]])
        rest = np.flatnonzero(~failed)
        for j in range(len(sig) if len(rest) else 0):
            at = rest[agreement(x[rest], sig[j]) >= threshold]
            if len(at):
                yield _edges(b.column(1), few, at, np.full(len(at), j))


def along_order(batches, threshold: float, window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Pairs that agree of each document with the ``window`` before it in its run.

    Rows (run, doc_id, sig), sorted within a run. Only a window is held.
    """
    ids = sig = None
    for new, b in _runs(batches, 0):
        if new or ids is None:
            ids, sig = b.column(1).slice(0, 0), np.zeros((0, BINS), np.uint32)
        ids, sig = pa.concat_arrays([ids, b.column(1)]), np.concatenate([sig, _matrix(b.column(2))])
        begin = len(ids) - b.num_rows
        for w in range(1, window + 1):
            at = np.arange(max(begin, w), len(ids))
            at = at[agreement(sig[at], sig[at - w]) >= threshold]
            if len(at):
                yield _edges(ids, ids, at, at - w)
        ids, sig = ids.slice(max(0, len(ids) - window)), sig[-window:]


def further(members: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs that agree in buckets where documents failed against the least one.

    ``members`` are (bucket, doc_id, failed, fails): all documents of such buckets but
    the least, whether each failed, and how many did.
    """
    out = f"a {_kind(members, 'doc_id')}, b {_kind(members, 'doc_id')}"
    rows = members.join(sigs, "doc_id")
    small = rows.where(F.col("fails") <= FEW).select("bucket", "doc_id", "failed", "sig").repartition("bucket").sortWithinPartitions("bucket", F.desc("failed"), "doc_id")
    small = small.mapInArrow(lambda b: against_few(b, threshold), out)
    step = BINS // ORDERS * 4
    turn = F.expr(f"concat(substring(sig, t * {step} + 1), substring(sig, 1, t * {step}))")
    large = rows.where(F.col("fails") > FEW).withColumn("t", F.explode(F.array(*[F.lit(i) for i in range(ORDERS)])))
    # documents that agree in the first two places of an order are one run
    large = large.withColumn("turned", turn).select(F.xxhash64("bucket", "t", F.substring("turned", 1, 8)).alias("run"), "doc_id", "sig", "turned")
    large = large.repartition("run").sortWithinPartitions("run", "turned", "doc_id").select("run", "doc_id", "sig")
    return small.unionByName(large.mapInArrow(lambda b: along_order(b, threshold), out))


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of each node but the roots: alternating large and small stars.

    Each round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest chain.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = written(e, "edges")
    mark = None
    while True:
        facts = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if (mark == tuple(facts) or facts[0] == facts[2]) and mark is not None or not facts[0]:
            roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            # a forest of stars: no root is a node
            if not facts[0] or not roots.join(roots.select(F.col("node").alias("root")), "root", "left_semi").limit(1).count():
                return roots, path
        mark = tuple(facts)
        both = e.union(e.select("b", "a"))
        w = Window.partitionBy("a")
        large = both.withColumn("m", F.least("a", F.min("b").over(w))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.withColumn("m", F.min("b").over(w))
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new, new_path = written(small, "edges")
        remove(e.sparkSession, path)
        e, path = new, new_path


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, kept): each document that is a near copy, and the least key of its group.

    Copies are texts whose estimated Jaccard similarity over word 3-grams reaches the
    threshold, directly or through others. The search is approximate: two texts that
    share no bucket, or share only buckets that are searched along sort orders and lie
    far apart in all of these, are missed. Keys may be of any type that has an order. Null keys and
    null or wordless texts take no part; rows that share a key count as one document,
    compared by the least of their signatures; very long texts are read whole, one at a
    time; ties go to the least key; other columns aren't read, so that their names can't
    clash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    s, s_path = written(sign(docs, column, key), "signatures")
    # texts with one signature are one document from here on: thousands of copies fill no bucket
    rep = s.groupBy("s1", "s2").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    exact, exact_path = written(s.select(F.col("doc_id").alias("a"), "s1", "s2").join(rep, ["s1", "s2"]).where("a <> b").select("a", "b").distinct(), "exact")
    reps = s.join(exact.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_anti")
    rows = reps.select("doc_id", F.explode("bands").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).where("hub <> other").drop("other")
    stars, stars_path = written(rows.join(hubs, "bucket").where("hub <> doc_id"), "stars")
    pairs = stars.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    need = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sigs, sigs_path = written(s.select("doc_id", "sig").join(need, "doc_id").groupBy("doc_id").agg(F.min("sig").alias("sig")), "compared")
    remove(spark, s_path)
    joined = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b")
    verdict, verdict_path = written(_agree(joined.select("a", "b", "x", "y"), threshold), "verdicts")
    failed = verdict.where("not same").select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), F.lit(True).alias("failed"))
    told = stars.distinct().join(failed, ["doc_id", "hub"], "left").select("bucket", "doc_id", F.coalesce("failed", F.lit(False)).alias("failed"))
    told, told_path = written(told, "told")
    fails = told.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("fails")).where("fails > 0 and n > 1").drop("n")
    more, more_path = written(further(told.join(fails, "bucket"), sigs, threshold), "further")
    roots, _ = components(exact.unionByName(verdict.where("same").select("a", "b")).unionByName(more))
    for p in (exact_path, stars_path, sigs_path, verdict_path, told_path, more_path):
        remove(spark, p)
    return roots.select(F.col("node").alias(key), F.col("root").alias("kept"))


def drop_copies(docs: DataFrame, threshold: float = THRESHOLD, column: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near copies: the document of least key of each group stays.

    Of rows that share a key one stays. Rows that take no part in the search (null keys,
    null or wordless texts) all stay. Columns keep their names, whatever these are; an
    empty table gives an empty result.
    """
    out, again = tx.free(docs.columns, "gone", "again")
    gone = near_duplicates(docs, threshold, column, key).select(F.col(key).alias(out))
    rest = docs.join(gone, F.col(key) == F.col(out), "left_anti")
    repeated = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(again)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(again)
    once = rest.join(repeated, F.col(key) == F.col(again), "left_anti")
    twice = rest.join(repeated, F.col(key) == F.col(again), "left_semi").dropDuplicates([key])
    return once.unionByName(twice)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
