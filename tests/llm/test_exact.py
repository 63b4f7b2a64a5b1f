"""Operators against brute force over whole tables, and on keys, names and sizes that are awkward."""

import math
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, classifier, hmm, minhash, packing, quality, sharding, suffixes, warc
from tidemark.llm import text as tx

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def table(spark, rows):
    """Rows of key and text with columns whose names operators might use themselves."""
    kind = "string" if any(isinstance(r[0], str) for r in rows) else "long"
    d = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    for c in ("__m", "__quality", "__rep_k", "measured", "reason", "band", "rep_key", "gone", "again", "number", "name", "_g", "bucket", "sig"):
        d = d.withColumn(c, F.lit("kept"))
    return d.withColumn("lang", F.lit("en"))


@pytest.fixture(scope="module")
def copies():
    a, p = prose(1, 200), prose(9, 60)
    return [("d1", a), ("d2", a), ("d3", a.replace("w7 ", "zz ", 2)), ("d4", prose(2, 90) + " " + p), ("d5", prose(3, 90) + " " + p), ("d6", None), ("d7", ""), (None, a), ("d4", prose(2, 90) + " " + p)]


def test_string_keys_and_clashing_names(spark, copies):
    d = table(spark, copies)
    assert {(r[0], r[1]) for r in minhash.near_duplicates(d).collect()} == {("d2", "d1"), ("d3", "d1")}
    for out in (minhash.drop_copies(d), suffixes.drop_repeats(d), quality.keep_good(d), classifier.keep_preferred(d, None)):
        assert out.columns == d.columns and {r["__m"] for r in out.collect()} == {"kept"}
    assert sorted(r["doc_id"] or "" for r in minhash.drop_copies(d).collect()) == ["", "d1", "d4", "d5", "d6", "d7"]
    spans = {(r["doc_id"], r["start"], r["end"], r["first_doc_id"]) for r in suffixes.repeated(d).collect()}
    assert ("d2", 0, 200, "d1") in spans and ("d5", 90, 150, "d4") in spans and all(isinstance(x[0], str) for x in spans)
    got = {r["doc_id"] for r in packing.pack(d, 64, 4).collect()}
    assert got == {"d1", "d2", "d3", "d4", "d5", None}
    assert {r["doc_id"]: r["keep"] for r in quality.judge(d).collect()}["d6"] is False
    assert sharding.shard(d, 3).count() == 9 and hmm.language_model(d, states=2, top=20, classes=4, iterations=1).count() == 9
    lab = spark.createDataFrame([("d1", 1, 0), ("d2", 1, 0), ("d4", 0, 0), ("d5", 0, 0), (None, 0, 0)], "doc_id string, quality int, toxic int")
    m = classifier.fit(d, lab, least_df=1)
    assert m is not None and classifier.score(d, m).count() == 9
    v = spark.createDataFrame([(f"v{i}", [float(i), 0.0], "x") for i in range(9)] + [(None, [0.0, 0.0], "x")], "vec_id string, embedding array<float>, id string")
    near = {(r["vec_id"], r["neighbour"]) for r in ann.neighbours(v, 1).collect()}
    assert len(near) == 9 and ("v0", "v1") in near and all(abs(int(a[1:]) - int(b[1:])) == 1 for a, b in near)


def test_packing_keeps_large_ids_beside_null_keys(spark):
    ids = [2**60 + 1, 2**60 + 3, None, None, None]
    got = packing.pack(table(spark, [(i, prose(k, 40)) for k, i in enumerate(ids)]), 64, 1).collect()
    assert sorted((r["doc_id"] or 0, r["tokens"]) for r in got) == [(0, 40)] * 3 + [(2**60 + 1, 40), (2**60 + 3, 40)]


def test_packing_covers_every_token_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = {r["doc_id"]: len([w for w in re.split(r"[\x09-\x0d\x1c-\x20]+", r["text"] or "") if w]) for r in docs.collect()}
    counted = spark.createDataFrame(list(size.items()), "doc_id long, n long")
    for got in (packing.pack(docs, 512, 16).collect(), packing.pack(counted, 512, 16, tokens="n").collect()):
        parts, fill = defaultdict(list), defaultdict(int)
        for r in got:
            parts[r["doc_id"]].append((r["start"], r["tokens"]))
            fill[r["window_id"]] += r["tokens"]
        for doc, p in parts.items():
            at = 0
            for start, n in sorted(p):
                assert start == at
                at += n
            assert at == size[doc]
        assert set(parts) == {k for k, n in size.items() if n} and max(fill.values()) <= 512
        assert sum(fill.values()) / len(fill) > 0.9 * 512


def grams(text):
    w = [x for x in "".join(c.lower() if c.isascii() and (c.isalnum()) or not c.isascii() else " " for c in text).split()]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}


def test_minhash_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    g = {r["doc_id"]: grams(r["text"]) for r in docs.collect() if r["text"] and r["text"].strip()}
    root = {i: i for i in g}
    root |= {r[0]: r[1] for r in minhash.near_duplicates(docs).collect()}
    ids, best = sorted(g), defaultdict(float)
    pairs = found = 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            j = len(g[a] & g[b]) / len(g[a] | g[b])
            best[a], best[b] = max(best[a], j), max(best[b], j)
            if j >= 0.6:
                pairs, found = pairs + 1, found + (root[a] == root[b])
    assert pairs and found == pairs
    assert all(best[i] > 0.3 for i in ids if root[i] != i)


def test_minhash_reads_scripts_without_spaces(spark):
    rng = np.random.default_rng(5)
    a = "".join(chr(0x4E00 + x) for x in rng.integers(0, 800, 300))
    b = "".join(chr(0x3041 + x) for x in rng.integers(0, 80, 300))
    d = table(spark, [(1, a), (2, a[:150] + "国" + a[150:]), (3, b), (4, b[5:]), (5, a[::-1])])
    assert {(r[0], r[1]) for r in minhash.near_duplicates(d).collect()} == {(2, 1), (4, 3)}


def test_minhash_100_000_unlike_documents_in_one_bucket(spark):
    def signatures(ids):
        # unlike ones that share one band; of ids i and i + 50,000 for i below 300, four fifths
        out = np.empty((len(ids), minhash.BINS), np.uint32)
        for k, i in enumerate(ids):
            own = np.random.default_rng(int(i)).integers(0, 2**32, minhash.BINS, dtype=np.uint32)
            if 50_000 <= i < 50_300:
                other = np.random.default_rng(int(i) - 50_000).integers(0, 2**32, minhash.BINS, dtype=np.uint32)
                own = np.where(np.arange(minhash.BINS) % 5 > 0, other, own)
            own[:4] = 7
            out[k] = own
        return out

    def make(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in signatures(b.column(0).to_numpy())], pa.binary())], ["doc_id", "sig"])

    n = 100_000
    sigs = spark.range(n).mapInArrow(make, "doc_id long, sig binary")
    members = spark.range(n).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("doc_id"), F.lit(True).alias("failed"), F.lit(n).cast("long").alias("fails"))
    got = {(min(r), max(r)) for r in minhash.further(members, sigs, minhash.THRESHOLD).collect()}
    assert got == {(i, i + 50_000) for i in range(300)}


def test_minhash_compares_a_bounded_number_of_pairs(monkeypatch):
    seen = [0]
    real = minhash.agreement
    monkeypatch.setattr(minhash, "agreement", lambda a, b: (seen.__setitem__(0, seen[0] + max(np.atleast_2d(a).shape[0], np.atleast_2d(b).shape[0])), real(a, b))[1])
    n = 3000
    x = np.random.default_rng(0).integers(0, 2**32, (n, minhash.BINS), dtype=np.uint32)
    raw = pa.array([r.tobytes() for r in x], pa.binary())
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), raw], ["run", "doc_id", "sig"])
    list(minhash.along_order([rows.slice(i, 500) for i in range(0, n, 500)], 0.45))
    assert n <= seen[0] <= n * minhash.WINDOW
    seen[0], failed = 0, np.arange(n) < minhash.FEW
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(failed), raw], ["bucket", "doc_id", "failed", "sig"])
    list(minhash.against_few([rows.slice(i, 500) for i in range(0, n, 500)], 0.45))
    assert seen[0] <= n * minhash.FEW


def test_minhash_meets_failures_with_those_that_agreed():
    x = np.random.default_rng(1).integers(0, 2**32, (2, minhash.BINS), dtype=np.uint32)
    far = np.where(np.arange(minhash.BINS) < 100, x[0], x[1])  # like both, which are unlike
    raw = pa.array([r.tobytes() for r in (x[0], far, x[1])], pa.binary())
    rows = pa.RecordBatch.from_arrays([pa.array([5, 5, 5]), pa.array([9, 3, 4]), pa.array([True, False, False]), raw], ["bucket", "doc_id", "failed", "sig"])
    got = [tuple(r.values()) for b in minhash.against_few([rows.slice(0, 1), rows.slice(1)], 0.45) for r in b.to_pylist()]
    assert got == [(3, 9)]


@pytest.mark.parametrize("hot", [0, 2, 10**9])
def test_suffixes_over_a_table_for_hot_n_grams(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(map(tuple, suffixes.op8_suffixes(spark, sf).collect()))
    assert got and got == sorted(con.sql(suffixes.ORACLE).fetchall())


def test_suffixes_one_passage_in_thousands_of_texts(spark):
    p = prose(77, 55)
    d = spark.range(20_000).withColumn("text", F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(f" {p} "), F.md5(F.col("id").cast("string"))))
    got = suffixes.repeated(d, key="id")
    assert got.where(f"start = 1 and end = 56 and first_doc_id = 0").count() == 19_999 == got.count()


def test_sharding_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    cols = ["doc_id", "row_number", "position", "shard", "slot"]
    assert sorted(map(tuple, sharding.op5_sharding(spark, sf).select(*cols).collect())) == sorted(con.sql(sharding.ORACLE).fetchall())


def test_hmm_scores_are_those_of_the_recursion(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    m, encoded, _ = hmm.train(docs, states=3, top=300, classes=16, grow=0, iterations=2)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def hashes(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        s, e, _ = tx.words(raw, np.array([0, len(raw)]))
        return tx.hashes(raw, s, e)

    count = defaultdict(int)
    for t in texts.values():
        for h in hashes(t).tolist():
            count[h] += 1
    for r in hmm.score(encoded, m).collect():
        h = hashes(texts[r["doc_id"]])
        s, ll, a = m.symbols(h), 0.0, None
        for x, word in zip(s.tolist(), h.tolist()):
            a = (m.start if a is None else a @ m.move) * m.emit[x]
            ll += math.log(a.sum()) + (math.log(count[word] / m.mass[x]) if x >= len(m.top) else 0)
            a = a / a.sum()
        assert r["n_words"] == len(h) and r["log_likelihood"] == pytest.approx(ll, rel=1e-9, abs=1e-9)


def test_hmm_long_texts_go_block_by_block():
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(9), 4).T.copy()
    s = rng.integers(0, 9, 1003).astype(np.int32)
    for a, b in zip(hmm.expect(hmm.Columns([s]), start, move, emit, 9), hmm.expect_long(s, start, move, emit, 9, 100)):
        assert np.allclose(a, b)
    whole = np.log(hmm.forward(hmm.Columns([s]), start, move, emit)[1]).sum()
    assert sum(np.log(x[3]).sum() for x in hmm.blocks(s, start, move, emit, 100)) == pytest.approx(whole)


def test_quality_verdicts_are_those_of_the_bands(spark, sf):
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet").repartition(3)).collect()
    again = {r["doc_id"]: r["reason"] for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet").repartition(7)).collect()}
    assert {r["doc_id"]: r["reason"] for r in got} == again  # partitions don't matter
    groups = defaultdict(list)
    for r in got:
        if r["n_tokens"]:
            for g in ((), (r["lang"],), (r["lang"], int(math.log2(r["n_tokens"])))):
                groups[g].append(r)

    def quartiles(g, c):
        v = sorted(math.floor(r[c] * quality.BINS + 0.5) for r in groups[g] if r[c] is not None)
        own = [v[max(0, math.ceil(p * len(v)) - 1)] / quality.BINS for p in (0.25, 0.75)] if v else [0, 0]
        if not g:
            return own
        up = quartiles(g[:-1], c)
        return [(len(v) * o + quality.LEAN * u) / (len(v) + quality.LEAN) for o, u in zip(own, up)]

    for r in got:
        want = None if r["n_tokens"] else "empty"
        for c in quality.MEASURES if r["n_tokens"] else ():
            q1, q3 = quartiles((r["lang"], int(math.log2(r["n_tokens"]))), c)
            w = max(quality.REACH * (q3 - q1), quality.FLOOR[c])
            if r[c] is not None and not q1 - w <= r[c] <= q3 + w:
                want = want or c
        assert r["reason"] == want and r["keep"] == (want is None)


def test_warc_saved_bundles(spark, tmp_path):
    pages = spark.createDataFrame([(f"p{i}", f"http://x/{i}", "b" * (i * 97)) for i in range(50)] + [(None, None, None)], "page_id string, url string, html string").repartition(3)
    made = warc.bundle(pages, frame_bytes=5000, bundle_bytes=1000).cache()
    folder = f"file://{tmp_path}/warc"
    index = warc.save(made, folder)
    rows = {r["record_id"]: r for r in index.collect()}
    assert len(rows) == 51 and {r["page_id"] for r in rows.values()} == {None, *(f"p{i}" for i in range(50))}
    for r in warc.fetch(spark.createDataFrame(list(rows.values()), index.schema), folder).collect():
        head, body = warc.parse(bytes(r["record"]))
        assert head["WARC-Record-ID"] == f"<{r['record_id']}>" and body == b"b" * (97 * int((rows[r["record_id"]]["page_id"] or "p0")[1:]))
    assert warc.records(made).select("url", "html").exceptAll(pages.selectExpr("url", "coalesce(html, '') html")).count() == 0 and warc.records(made).count() == 51
    none = warc.bundle(pages.limit(0))
    assert warc.save(none, folder).count() == 0 and warc.records(none).count() == 0
