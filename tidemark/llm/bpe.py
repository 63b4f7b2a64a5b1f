"""Byte-pair encoding by backtracking over longest matches, and decoding by offsets.

An Aho-Corasick pass finds the longest token at every byte. The encoder takes it if
the pair with the token before is one that merging itself would leave side by side
(the pair-compatibility table), else a shorter prefix token, else it steps back; each
position is left at most once, so that the time is linear. The result is that of
applying the merges by rank; the pair test follows the published backtracking algorithm
for exact byte-pair encoding in linear time. Texts are first split as the vocabulary asks for, and the
tokens of a piece seen before are looked up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import text as tx

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose tokens a worker remembers before it starts anew.
REMEMBER = 600_000
#: Token pairs whose compatibility is remembered before the table starts anew.
PAIRS = 1_000_000


class Encoder:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.rank = ranks
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.bytes[i] = b
        lens = np.array([len(b) for b in self.bytes], np.int64)
        #: Decoding: token i is blob[offsets[i]:offsets[i + 1]].
        self.offsets = np.concatenate([[0], np.cumsum(lens)])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.pattern = regex.compile(pattern)
        self._split()
        self.auto = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.auto.add_word(b.decode("latin-1"), (len(b), i))
        self.auto.make_automaton()
        self._next_prefix: dict[int, int] = {}
        self._fits: dict[int, bool] = {}
        self._first: dict[str, int] = {}
        self._clear()

    def _split(self) -> None:
        """For each token the two tokens whose merge makes it; a single byte is its own halves."""
        size = len(self.bytes)
        self.left, self.right = list(range(size)), list(range(size))
        self.pair: dict[int, int] = {}
        self._fits = {}
        for b, i in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(b) == 1:
                continue
            parts = self.merge(b, i)
            if len(parts) == 2:
                self.left[i], self.right[i] = parts
                self.pair[parts[0] << 20 | parts[1]] = i

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """The definition: join the adjacent pair of lowest rank, again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (below is None or r < below):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging would leave a and b side by side: undo merges at the border, latest first,
        and see whether a pair would have merged across it before."""
        key = a << 20 | b
        known = self._fits.get(key)
        if known is not None:
            return known
        left, right, pair = self.left, self.right, self.pair
        limit, ok = 1 << 40, True
        while True:
            c = pair.get(a << 20 | b)
            if c is not None and c < limit:
                ok = False
                break
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        break
            else:
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        break
        if len(self._fits) >= PAIRS:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        p = self._next_prefix.get(token)
        if p is None:
            b, p = self.bytes[token], -1
            for n in range(len(b) - 1, 0, -1):
                if b[:n] in self.rank:
                    p = self.rank[b[:n]]
                    break
            self._next_prefix[token] = p  # at most one entry a token
        return p

    def piece(self, b: bytes) -> list[int]:
        """Tokens of one piece."""
        whole = self.rank.get(b)
        if whole is not None:
            return [whole]
        n = len(b)
        longest = [-1] * n
        for end, (size, token) in self.auto.iter(b.decode("latin-1")):
            longest[end - size + 1] = token  # later ends are longer
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token, sizes, fits = 0, longest[0], self.bytes, self.fits
        while token >= 0:
            end = pos + len(sizes[token])
            if open_at[end] and (not out or fits(out[-1], token)):
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
                continue
            short = self.shorter(token)
            if short >= 0:
                token = short
                continue
            open_at[pos] = 0
            token = out.pop()
            pos -= len(sizes[token])
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.pattern.findall(text):
            out += self.piece(p.encode("utf-8", "surrogatepass"))
        return out

    # Many texts: a text falls into chunks at single spaces, where a piece always begins.

    def _clear(self) -> None:
        self._chunk: dict[str, int] = {}
        self._tokens = np.empty(1 << 20, np.int32)
        self._used = 0
        self._start, self._len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _remember(self, chunk: str) -> int:
        t = self.encode(chunk)
        k = len(self._chunk)
        while self._used + len(t) > len(self._tokens):
            self._tokens = np.concatenate([self._tokens, np.empty_like(self._tokens)])
        if k == len(self._start):
            self._start, self._len = np.concatenate([self._start, np.zeros(k, np.int64)]), np.concatenate([self._len, np.zeros(k, np.int64)])
        self._tokens[self._used : self._used + len(t)] = t
        self._start[k], self._len[k] = self._used, len(t)
        self._used += len(t)
        self._chunk[chunk] = k
        return k

    def encode_array(self, text: str) -> np.ndarray:
        """As ``encode``, as an array."""
        if not text:
            return np.zeros(0, np.int32)
        if "  " in text or _mixed.search(text):  # runs of white space: a space may not begin a piece
            chunks = self.pattern.findall(text)
        else:
            parts = text.split(" ")
            chunks = [" " + p for p in parts]
            chunks[0] = parts[0]
            if not parts[0]:
                del chunks[0]
        if len(self._chunk) > REMEMBER:
            self._clear()
        get = self._chunk.get
        ids = [get(c) for c in chunks]
        if None in ids:
            for i, k in enumerate(ids):
                if k is None:
                    c = chunks[i]
                    ids[i] = k if (k := get(c)) is not None else self._remember(c)
        at = np.array(ids, np.int64)
        return self._tokens[tx.ragged(self._start[at], self._len[at])]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of tokens, by the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        return self.blob[tx.ragged(self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids])].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


import re  # noqa: E402

_mixed = re.compile(r"\s \s|\s\s $| $")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    return Encoder(path)


def encode(docs: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}", column: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, tokens, n_tokens, round_trip) for every row.

    ``round_trip`` says whether decoding gives back the text's bytes. A null text has
    null tokens, an empty one none; very long texts are encoded whole; a null key stays
    null, keys may be of any type; repeated rows give repeated rows; other columns are
    not read, so that their names can't clash; an empty table gives an empty result. The
    vocabulary file must be at ``path`` on every executor.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for lo, hi, data, offs in tx.slices(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo)
                arrays = [e.encode_array(t or "") for t in texts.to_pylist()]
                size = np.array([len(a) for a in arrays], np.int64)
                flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
                at = flat.astype(np.int64)
                n_bytes = e.offsets[at + 1] - e.offsets[at]
                decoded = e.blob[tx.ragged(e.offsets[at], n_bytes)]
                edge = np.concatenate([[0], np.cumsum(n_bytes)])[np.concatenate([[0], np.cumsum(size)])]
                same = np.diff(edge) == np.diff(offs)
                if len(decoded) == len(data) and same.all():
                    wrong = np.flatnonzero(decoded != data)
                    same[np.searchsorted(offs, wrong, "right") - 1] = False
                else:
                    same &= np.array([decoded[edge[i] : edge[i + 1]].tobytes() == data[offs[i] : offs[i + 1]].tobytes() for i in range(hi - lo)])
                null = texts.is_null().to_numpy(zero_copy_only=False)
                bounds = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.r_[null, False])
                ids = pa.ListArray.from_arrays(bounds, pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids, pa.array(size, mask=null), pa.array(same, mask=null)], ["doc_id", "tokens", "n_tokens", "round_trip"])

    d = docs.select(F.col(key).alias("doc_id"), F.col(column).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(work, f"doc_id {kind}, tokens array<int>, n_tokens long, round_trip boolean").withColumnRenamed("doc_id", key)


def decode(tokens: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}", column: str = "tokens", key: str = "doc_id") -> DataFrame:
    """(key, text) of token lists; null tokens give a null text, empty ones an empty text.

    Null keys stay null, repeated rows give repeated rows, other columns aren't read, an
    empty table gives an empty result; bytes that aren't UTF-8 become U+FFFD.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = [None if not t.is_valid else e.decode(np.asarray(t.values)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    d = tokens.select(F.col(key).alias("doc_id"), F.col(column))
    return d.mapInArrow(work, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string").withColumnRenamed("doc_id", key)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
