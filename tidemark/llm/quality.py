"""Quality rules from how a public tokenizer takes a text apart.

Three measures of a text under a byte-fallback vocabulary: characters per token, the
share of tokens that are bare bytes, and the entropy of its tokens as a share of the
most that its length allows. Each must lie in a band for the text's language (its
script, where the language is missing) and length class. Bands come from all texts of
the group: quartiles widened by a multiple of their distance, so that ordinary texts of
any corpus pass and only the far outliers are rejected. Quartiles come from counts in
narrow bins, so that they don't depend on how the table is partitioned, and those of a
small group lean towards those of its language and of the whole corpus.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import text as tx
from tidemark.llm.bpe import TOKENIZERS
from tidemark.sources.shared import remove, written

VOCABULARY = "piece_bpe_32k.model"
REMEMBER = 400_000
MEASURES = ("chars_per_token", "byte_share", "entropy_share")
#: Quartile distances by which a band goes beyond its quartiles.
REACH = 2.5
#: Texts that a group's language (and the corpus, for a language) weighs in its quartiles.
LEAN = 20
#: Bins of a measure's unit in which texts are counted.
BINS = 1000
#: Least widths of the bands, so that a group of near-equal texts rejects no ordinary one.
FLOOR = {"chars_per_token": 0.5, "byte_share": 0.06, "entropy_share": 0.06}


class Pieces:
    """Tokens of texts by their chunks; no piece of the vocabulary reaches from a
    non-space over a space, and none holds a line end, so chunks are independent."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.size = n
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens = np.empty(1 << 20, np.int32)
        self.start, self.len, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _add(self, chunks: list[str]) -> None:
        # a chunk after a space: the model puts one before any text, and keeps those given
        for c, t in zip(chunks, self.model.encode(chunks, num_threads=1)):
            k = len(self.known)
            while self.used + len(t) > len(self.tokens):
                self.tokens = np.concatenate([self.tokens, np.empty_like(self.tokens)])
            if k == len(self.start):
                self.start, self.len = np.concatenate([self.start, np.zeros(k, np.int64)]), np.concatenate([self.len, np.zeros(k, np.int64)])
            self.tokens[self.used : self.used + len(t)] = t
            self.start[k], self.len[k] = self.used, len(t)
            self.used += len(t)
            self.known[c] = k

    def encode(self, text: str) -> np.ndarray:
        """Token ids of the whole text."""
        if not text:
            return np.zeros(0, np.int32)
        chunks = text.split(" ")
        if "" in chunks or "▁" in text:
            return np.array(self.model.encode(text), np.int32)
        if len(self.known) > REMEMBER:
            self.clear()
        get = self.known.get
        ids = [get(c) for c in chunks]
        if None in ids:
            self._add(list({c: 0 for c, k in zip(chunks, ids) if k is None}))
            ids = [get(c) for c in chunks]
        at = np.array(ids, np.int64)
        return self.tokens[tx.ragged(self.start[at], self.len[at])]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def measure(text: str, p: Pieces) -> tuple[int, float | None, float | None, float | None]:
    """Tokens, characters per token, share of byte tokens, share of the possible entropy.

    The entropy of n tokens is at most log2(n); of one token it says nothing (null).
    """
    t = p.encode(text)
    n = len(t)
    if not n:
        return 0, None, None, None
    c = np.bincount(t) if n > 4096 else np.unique(t, return_counts=True)[1]
    c = c[c > 0] / n
    h = float(-(c * np.log2(c)).sum())
    return n, len(text) / n, float(p.is_byte[t].mean()), max(0.0, h) / float(np.log2(n)) if n > 1 else None


def script(c: Column) -> Column:
    """The script of most letters in a text, of the larger ones."""
    scripts = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}", "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}", "thai": r"\p{IsThai}"}
    best = F.greatest(*[F.struct(F.regexp_count(c, F.lit(rx)).alias("n"), F.lit(name).alias("s")) for name, rx in scripts.items()])
    return F.when(best["n"] > 0, best["s"]).otherwise("none")


def _measured(path: str):
    kind = pa.struct([("n_tokens", pa.int64()), *((c, pa.float64()) for c in MEASURES)])

    def work(texts: pa.Array) -> pa.Array:
        p = pieces(path)
        got = [measure(t or "", p) for t in texts.to_pylist()]
        cols = zip(*got) if got else ((),) * (1 + len(MEASURES))
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], fields=list(kind))

    return F.arrow_udf(work, T.StructType([T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in MEASURES)]))


def measures(docs: DataFrame, path: str, column: str = "text", lang: str = "lang", name: str = "measured") -> DataFrame:
    """``docs`` with a column ``name``: language group and measures of each text."""
    (tmp,) = tx.free([*docs.columns, name], "taken")
    text = F.col(column).cast("string")
    group = F.coalesce(F.col(lang).cast("string"), F.concat(F.lit("script:"), script(F.coalesce(text, F.lit("")))))
    d = docs.withColumn(tmp, _measured(path)(text))
    return d.withColumn(name, F.struct(group.alias("lang"), f"{tmp}.*")).drop(tmp)


def _quartiles(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, c, n, q1, q3): number of texts and quartiles of each measure, from counts by bin."""
    w = Window.partitionBy(*by, "c")
    below = F.sum("n").over(w.orderBy("bin"))
    d = hist.groupBy(*by, "c", "bin").agg(F.sum("n").alias("n")).select(*by, "c", "bin", below.alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda p: (F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("bin"))) / BINS)
    return d.groupBy(*by, "c").agg(F.max("total").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def bands(m: DataFrame, reach: float, lean: int) -> DataFrame:
    """(lang, len_class, measure_low, measure_high, ...) for each language and length class.

    A class's quartiles are the mean of its own, weighing as many as its texts, and its
    language's, weighing ``lean``; a language's are the like of its own and the corpus's.
    """
    m = m.where("n_tokens > 0").withColumn("len_class", length_class(F.col("n_tokens")))
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.round(F.col(c) * BINS).cast("long").alias("bin")) for i, c in enumerate(MEASURES)])
    hist = m.select("lang", "len_class", F.explode(each).alias("x")).where("x.bin is not null").groupBy("lang", "len_class", "x.c", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    hist, path = written(hist, "bins")
    every, by_lang, fine = _quartiles(hist, []), _quartiles(hist, ["lang"]), _quartiles(hist, ["lang", "len_class"])
    mean = lambda q: (F.col("n") * F.col(q) + lean * F.col(f"p{q}")) / (F.col("n") + lean)

    def lean_on(d: DataFrame, above: DataFrame, by: list[str]) -> DataFrame:
        up = above.select(*by, F.col("q1").alias("pq1"), F.col("q3").alias("pq3"))
        return d.join(up, by).withColumn("q1", mean("q1")).withColumn("q3", mean("q3")).drop("pq1", "pq3")

    got = lean_on(fine, lean_on(by_lang, every, ["c"]), ["lang", "c"])
    width = F.greatest(reach * (F.col("q3") - F.col("q1")), F.element_at(F.array(*[F.lit(FLOOR[c]) for c in MEASURES]), F.col("c") + 1))
    got = got.select("lang", "len_class", "c", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))
    pick = [F.max(F.when(F.col("c") == i, F.col(x))).alias(f"{c}_{x}") for i, c in enumerate(MEASURES) for x in ("low", "high")]
    # a few rows a language, written as both the counts and their lineage go
    out, _ = written(got.groupBy("lang", "len_class").agg(*pick), "bands")
    remove(m.sparkSession, path)
    return out


def length_class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def _reasons(m: DataFrame, reach: float, lean: int, name: str, reason: str) -> DataFrame:
    """``m`` (with measures ``name``) with the column ``reason``: null for texts within all bands."""
    q = F.col(name)
    by, cls, band = tx.free([*m.columns, reason], "lang", "len_class", "band")
    limits = [f"{c}_{x}" for c in MEASURES for x in ("low", "high")]
    b = bands(m.select(q["lang"].alias("lang"), *[q[c].alias(c) for c in ("n_tokens", *MEASURES)]), reach, lean)
    b = b.select(F.col("lang").alias(by), F.col("len_class").alias(cls), F.struct(*limits).alias(band))
    d = m.join(b, (q["lang"] == F.col(by)) & (length_class(q["n_tokens"]) == F.col(cls)), "left")
    why = F.when(q["n_tokens"] == 0, "empty")
    for c in MEASURES:
        why = why.when((q[c] < F.col(band)[f"{c}_low"]) | (q[c] > F.col(band)[f"{c}_high"]), c)
    return d.withColumn(reason, why).drop(by, cls, band)


def judge(docs: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}", reach: float = REACH, lean: int = LEAN, column: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(key, lang, n_tokens, measures, keep, reason) for every row.

    ``reason`` names the first measure out of its band. Null, empty and tokenless texts
    are rejected as ``empty``. A null language is judged with its script. A measure
    that isn't defined (entropy of one token) rejects nothing. Very long texts are
    measured whole. Ties at a bound are kept. Repeated rows are judged each and count
    each; null keys stay null, keys may be of any type; other columns are not read, so
    that their names can't clash; an empty table gives an empty result.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.col(column).alias("text"), F.col(lang).alias("lang"))
    m, _ = written(measures(d, path).select("doc_id", "measured"), "measures")
    d = _reasons(m, reach, lean, "measured", "reason")
    return d.select(F.col("doc_id").alias(key), "measured.*", F.col("reason").isNull().alias("keep"), "reason")


def keep_good(docs: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}", reach: float = REACH, lean: int = LEAN, column: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with the same columns, whatever their names.

    Null, empty and tokenless texts go; repeated rows stay or go together; ties at a
    bound stay; an empty table stays empty. Texts are taken apart once: rows and
    measures are written together, so no join brings verdicts back to texts.
    """
    name, reason = tx.free(docs.columns, "measured", "reason")
    m, _ = written(measures(docs, path, column, lang, name), "measured")
    return _reasons(m, reach, lean, name, reason).where(F.col(reason).isNull()).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
