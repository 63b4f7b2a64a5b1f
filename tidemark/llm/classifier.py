"""A quality score learned from preferences (Bradley-Terry) and cut at a quantile.

A labelled document that is of quality and not toxic is preferred to one that isn't.
The chance that a beats b is the logistic function of w . (x_a - x_b); w minimises the
mean logistic loss over pairs with a small ridge. Features are the presence of words
that tell the classes apart and a few measures of style. Weights come from a sample, the
cut from all documents: it is the quantile of their scores at which the fewest of all
labelled ones not used in fitting are judged wrongly, a preferred one lost counting
``care`` times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import text as tx

STYLE = 9
#: Bins of the score's unit in which documents are counted; a power of two, so edges are exact.
BINS = 512
_UPPER, _LOWER, _DIGIT, _SYMBOL = (np.zeros(256, np.int32) for _ in range(4))
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_DIGIT[48:58] = 1
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-"]] = 1


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # of words, then of style
    mean: np.ndarray
    scale: np.ndarray
    threshold: float
    level: float  # share of all documents' scores below the threshold
    held_out_accuracy: float
    judged: int  # labelled documents the threshold was chosen on
    fitted: int  # those the weights come from


def _sum(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask)])
    return (c[offs[1:]] - c[offs[:-1]]).astype(float)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, word hash) pairs, style measures and number of words of each row."""
    starts, ends, rows = tx.words(data, offs, tx.PUNCT)
    h = tx.hashes(data, starts, ends, fold=True)
    order = np.lexsort((h, rows))
    r, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    n = len(offs) - 1
    count = np.bincount(rows, minlength=n).astype(float)
    distinct = np.bincount(r[new], minlength=n)
    size = np.maximum(np.diff(offs), 1)
    upper, lower = _sum(_UPPER[data], offs), _sum(_LOWER[data], offs)
    share = lambda x, y, e=0.01: np.log(x / np.maximum(y, 1) + e)
    style = np.stack([
        share(upper, upper + lower), share(_sum(_DIGIT[data], offs), size), share(_sum(_SYMBOL[data], offs), size), share(_sum(data == 124, offs), size),
        np.log1p(count), distinct / np.maximum(count, 1) + 0.08 * np.log1p(count), np.log1p(_sum(ends - starts, np.searchsorted(rows, np.arange(n + 1))) / np.maximum(count, 1)),
        share(_sum(data == 10, offs), np.maximum(count, 1)), share(_sum(data >= 128, offs), size),
    ], 1) if n else np.zeros((0, STYLE))
    return r[new], h[new], style, count


def score_slice(m: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    r, h, style, count = features(data, offs)
    k = len(m.words)
    z = np.clip((style - m.mean) / m.scale, -6, 6)
    s = z @ m.weights[k:]
    if k:
        at = np.minimum(np.searchsorted(m.words, h), k - 1)
        hit = m.words[at] == h
        s = s + np.bincount(r[hit], m.weights[at[hit]], len(offs) - 1)
    s[count == 0] = np.nan
    return s


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int, ridge: float, seed: int, steps: int = 250) -> np.ndarray:
    """Weights that minimise the logistic loss of feature differences over drawn pairs."""
    rng = np.random.default_rng(seed)
    g, b = np.flatnonzero(good), np.flatnonzero(~good)
    a, c = rng.choice(g, pairs), rng.choice(b, pairs)
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = x @ w
        res = 1 / (1 + np.exp(np.clip(s[a] - s[c], -40, 40)))  # what is missing to certainty
        push = np.bincount(a, res, len(x)) - np.bincount(c, res, len(x))
        grad = ridge * w - (x.T @ push.astype(x.dtype)) / pairs
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 8000, max_words: int = 2000, least_df: int = 8, pairs: int = 40_000, ridge: float = 1e-4, care: float = 4.0, seed: int = 7, column: str = "text", key: str = "doc_id") -> Model | None:
    """Weights from at most ``max_train`` labelled rows, half of each class and chosen by
    a hash of the key, and a threshold from all documents.

    The sample bounds the model: its words are the ``max_words`` that tell the classes
    apart best, of those in ``least_df`` rows of the sample or more, and its ``pairs``
    are drawn from the sample's rows. Only these rows' features and counts by score bin
    reach the driver. A document is preferred if no label of its key says otherwise;
    null keys and null qualities are no labels, a null toxicity is none. Null, empty and
    wordless texts play no part; very long ones count whole. Rows that share a key are
    one document in the sample (its least text) and each count for the threshold. Ties
    in the choice of words go to the lesser hash, of thresholds the middle one is taken.
    Keys may be of any type. Other columns aren't read, so that their names can't clash.
    None when a class is missing from all labelled documents, or the tables are empty.
    """
    lab = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("good"))
    ids = docs.select(F.col(key).alias("doc_id"), F.col(column).cast("string").alias("text"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    have = ids.where(F.col("text").isNotNull()).select("doc_id", "h").join(lab, "doc_id").distinct()
    share = [max_train - max_train // 2, max_train // 2]
    chosen = [have.where(c).orderBy("h", "doc_id").limit(n) for c, n in zip(("good", "not good"), share)]
    chosen = chosen[0].unionByName(chosen[1]).drop("h")
    sample = ids.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h", "good").agg(F.min("text").alias("text")).select("h", "text", "good")  # bounded by max_train

    def work(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in tx.slices(b.column(1)):
                r, h, style, count = features(data, offs)
                cut = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array((np.arange(hi - lo + 1) * STYLE).astype(np.int32)), pa.array(style.ravel()))], ["h", "good", "words", "style"])

    from tidemark.sources.shared import remove, written

    made, path = written(sample.mapInArrow(work, "h long, good boolean, words array<long>, style array<double>"), "sample")
    n_good, n_bad = (made.where("good").count(), made.where("not good").count())
    if not n_good or not n_bad:
        return None
    df = made.select("good", F.explode("words").alias("w")).groupBy("w").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    p = (F.col("g") + F.col("b")) / (n_good + n_bad)
    z = F.abs(F.col("g") / n_good - F.col("b") / n_bad) / F.sqrt(p * (1 - p) * (1 / n_good + 1 / n_bad) + 1e-12)
    top = df.where(F.col("g") + F.col("b") >= least_df).orderBy(z.desc(), "w").limit(max_words).select("w").collect()
    words = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    wanted = set(words.view(np.int64).tolist())

    def thin(batches) -> Iterator[pa.RecordBatch]:
        keep = pa.array(sorted(wanted), pa.int64())
        for b in batches:
            lists = b.column(2)
            flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
            hit = pc.is_in(flat, value_set=keep)
            v, q = flat.filter(hit), parent.filter(hit).to_numpy()
            cut = np.searchsorted(q, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(cut), v), b.column(3)], ["h", "good", "words", "style"])

    rows = made.mapInArrow(thin, "h long, good boolean, words array<long>, style array<double>").toArrow().sort_by("h")
    remove(docs.sparkSession, path)
    good = rows.column("good").to_numpy()
    ids_, n = rows.column("h").to_numpy(), rows.num_rows
    style = np.array(rows.column("style").combine_chunks().flatten()).reshape(n, STYLE)
    mean, scale = style.mean(0), style.std(0) + 1e-6
    x = np.zeros((n, len(words) + STYLE), np.float32)
    lists = rows.column("words").combine_chunks()
    flat = np.asarray(lists.flatten()).view(np.uint64)
    x[np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets))), np.searchsorted(words, flat)] = 1
    x[:, len(words) :] = np.clip((style - mean) / scale, -6, 6)
    held = tx.mix(np.array(ids_, np.int64).view(np.uint64)) % np.uint64(5) == 0
    if good[~held].all() or not good[~held].any():
        held[:] = False
    w = fit_pairs(x[~held], good[~held], pairs, ridge, seed)
    m = Model(words, w, mean, scale, -np.inf, 0.0, 0.0, 0, int((~held).sum()))
    return cut(ids, lab, m, ids_[~held], care)


def cut(ids: DataFrame, lab: DataFrame, m: Model, fitted: np.ndarray, care: float) -> Model | None:
    """``m`` with the threshold at which all labelled documents but ``fitted`` cost least.

    Where these lack a class, the fitted ones count too; None if
    one is missing even then.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        known = pa.array(fitted, pa.int64())
        for b in batches:
            used = pc.is_in(b.column(2), value_set=known)
            for lo, hi, data, offs in tx.slices(b.column(1)):
                s = score_slice(m, data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.floor(s * BINS), mask=np.isnan(s)), used.slice(lo, hi - lo)], ["doc_id", "bin", "used"])

    scored = ids.mapInArrow(work, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, bin double, used boolean").where(F.col("bin").isNotNull())
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    good, fresh = F.col("good"), ~F.col("used")
    got = scored.join(lab, "doc_id", "left").groupBy("bin").agg(F.count(F.lit(1)), count(good & fresh), count(~good & fresh), count(good), count(~good)).toArrow()
    if not got.num_rows:
        return None
    cols = np.stack([np.asarray(c) for c in got.columns], 1)
    edges, n, *by = cols[np.argsort(cols[:, 0])].T
    g, b = by[:2] if by[0].any() and by[1].any() else by[2:]
    if not g.any() or not b.any():
        return None
    # cutting before bin i rejects all below: preferred ones lost, others kept
    below = lambda x: np.concatenate([[0], np.cumsum(x)])
    cost = care * below(g) + b.sum() - below(b)
    best = np.flatnonzero(cost == cost.min())
    i = int(best[len(best) // 2])
    right = (g[i:].sum() + b[:i].sum()) / (g.sum() + b.sum())
    return replace(m, threshold=float(np.append(edges, edges[-1] + 1)[i] / BINS), level=float(n[:i].sum() / n.sum()), held_out_accuracy=float(right), judged=int(g.sum() + b.sum()))


def score(docs: DataFrame, m: Model | None, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, keep) for every row: kept are scores at or above the threshold.

    Null, empty and wordless texts have no score and aren't kept. Without a model (one
    class or no labels) the others are kept unscored. Very long texts are scored whole.
    Ties at the threshold are kept. Repeated rows are scored each; a null key stays null,
    keys may be of any type; other columns aren't read, so that their names can't clash;
    an empty table gives an empty result.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in tx.slices(b.column(1)):
                if m is None:
                    s = np.full(hi - lo, np.nan)
                    ok = features(data, offs)[3] > 0
                else:
                    s = score_slice(m, data, offs)
                    ok = s >= m.threshold
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s, mask=np.isnan(s)), pa.array(ok)], ["doc_id", "score", "keep"])

    d = docs.select(F.col(key).alias("doc_id"), F.col(column).cast("string").alias("text"))
    return d.mapInArrow(work, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, keep boolean").withColumnRenamed("doc_id", key)


def keep_preferred(docs: DataFrame, m: Model | None, column: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with the same columns; nothing is shuffled.

    Null, empty and wordless texts go; repeated rows stay or go together; rows with null
    keys are judged like any other; an empty table stays empty.
    """

    def work(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offs in tx.slices(texts):
            out.append(features(data, offs)[3] > 0 if m is None else score_slice(m, data, offs) >= m.threshold)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(F.arrow_udf(work, T.BooleanType())(F.col(column).cast("string")))


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
