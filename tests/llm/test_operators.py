"""Each operator against a brute-force version, and on awkward input."""

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, classifier, hmm, minhash, packing, quality, sharding, suffixes, warc
from tidemark.llm import text as tx

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket long, _k string, sig string"


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    a = prose(1, 300)
    t = [a, a, a.replace("w7 ", "zz ", 2), prose(2, 200), None, "", " \n\t ", "one", "x" * 50_000, prose(3, 40_000), "日本語 テキスト é", prose(4, 30) + " " + prose(9, 60), prose(5, 30) + " " + prose(9, 60)]
    out = [(i, x, None if i == 3 else "en", "s", None, 5, "k", None) for i, x in enumerate(t)]
    return [*out, out[3], (None, prose(6, 80), "en", None, 3, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_hashes():
    data = np.frombuffer("a b  ab\nb".encode() + "b".encode(), np.uint8)
    s, e, r = tx.words(data, np.array([0, 9, 10]))
    assert [bytes(data[i:j]) for i, j in zip(s, e)] == [b"a", b"b", b"ab", b"b", b"b"] and r.tolist() == [0, 0, 0, 0, 1]
    h = tx.hashes(data, s, e)
    assert h[1] == h[3] == h[4] and len(set(h.tolist())) == 3


def test_hmm_likelihood_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    k, v = 3, 5
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T.copy()
    seqs = [np.array(x, np.uint16) for x in ([0, 1, 4, 2, 2], [3, 3, 1], [2])]
    _, scale = hmm.forward(c := hmm.Columns(seqs), start, move, emit)
    got = np.bincount(c.doc, np.log(scale))
    total = np.zeros((k, k))
    for i, s in enumerate(seqs):
        ways = {p: start[p[0]] * emit[s[0], p[0]] * math.prod(move[a, b] * emit[o, b] for a, b, o in zip(p, p[1:], s[1:])) for p in itertools.product(range(k), repeat=len(s))}
        assert got[i] == pytest.approx(math.log(sum(ways.values())))
        for p, w in ways.items():
            for a, b in zip(p, p[1:]):
                total[a, b] += w / sum(ways.values())
    counts, pairs, first, ll = hmm.expect(c, start, move, emit, v)
    assert np.allclose(pairs, total) and counts.sum() == pytest.approx(9) and first.sum() == pytest.approx(3) and ll == pytest.approx(got.sum())


def test_hmm(spark, docs, none):
    m, enc, _ = hmm.train(docs.select("doc_id", "text"), states=3, top=50, classes=16, iterations=4)
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(m.log_likelihood, m.log_likelihood[1:]))
    got = hmm.language_model(docs, states=3, top=50, classes=16, iterations=1).collect()
    assert len(got) == 15
    by = {r["doc_id"]: r for r in got}
    for i in (4, 5, 6):
        assert by[i]["n_words"] == 0 and by[i]["log_likelihood"] == 0 and by[i]["perplexity"] is None
    assert by[9]["n_words"] == 40_000 and by[0]["log_likelihood"] == pytest.approx(by[1]["log_likelihood"], rel=1e-6) and by[0]["log_likelihood"] < 0
    assert hmm.language_model(none, states=2, iterations=1).count() == 0


def test_hmm_learns_states_until_it_gains_no_more(spark):
    rng = np.random.default_rng(3)
    two = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]]
    # words of two kinds take turns: a unigram can't tell, two states can
    data = [(i, " ".join(two[(i + j) % 2][k] for j, k in enumerate(rng.integers(0, 30, 200)))) for i in range(60)]
    m, enc, _ = hmm.train(spark.createDataFrame(data, "doc_id long, text string"), states=2, top=100, classes=16)
    n = 60 * 200
    got = hmm.score(enc, m).agg({"log_likelihood": "sum"}).collect()[0][0] / n
    assert got > -math.log(60) + 0.6 and (m.log_likelihood[-1] - m.log_likelihood[-2]) / n < hmm.TOLERANCE


def test_hmm_words_of_a_class_have_their_own_shares(spark):
    # one state: a word's chance is its share of all words, own symbol or not
    data = [(i, t) for i, t in enumerate(["a a a a a a b b b c"] * 10 + ["a", "b", "c"])]
    d = spark.createDataFrame(data, "doc_id long, text string")
    m, enc, _ = hmm.train(d, states=1, top=0, classes=1, grow=0, smooth=1e-9)
    got = {r["doc_id"]: r["log_likelihood"] for r in hmm.score(enc, m).collect()}
    assert [got[i] for i in (10, 11, 12)] == pytest.approx([math.log(k / 103) for k in (61, 31, 11)], abs=1e-5)
    m, _, _ = hmm.train(spark.createDataFrame([(0, prose(1, 4000))], "doc_id long, text string"), states=1, top=10, classes=1)
    assert len(m.top) == int(2 * 4000**0.5)  # grows with the corpus


def test_minhash(docs, none):
    got = {(r["doc_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert {(1, 0), (2, 0)} <= got and not {3, 7, 8, 9, 10} & {a for a, _ in got}
    left = [r["doc_id"] for r in minhash.drop_copies(docs).collect()]
    assert left.count(3) == 1 and 0 in left and 1 not in left and 2 not in left and None in left and 4 in left
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_copies(none).count() == 0


def test_minhash_estimates_jaccard():
    a, b = prose(1, 400), prose(1, 400).replace("w1", "q1")
    data = np.frombuffer((a + b).encode(), np.uint8)
    sig, _ = minhash.signatures(data, np.array([0, len(a), len(a) + len(b)]))
    g = [set(zip(*(x.split()[j:] for j in range(3)))) for x in (a, b)]
    assert abs(minhash.agreement(sig[0], sig[1]) - len(g[0] & g[1]) / len(g[0] | g[1])) < 0.15


def test_components(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(100, 50), (60, 50)], "a long, b long")
    got = {r["node"]: r["root"] for r in minhash.components(e)[0].collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 50, 60: 50}


def test_packing(docs, none):
    got = packing.pack(docs, 128, 8).collect()
    fill, seen = {}, {}
    for r in got:
        fill[r["window_id"]] = fill.get(r["window_id"], 0) + r["tokens"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["tokens"]
    assert max(fill.values()) <= 128 and all(fill[r["window_id"]] == r["window_tokens"] for r in got)
    assert seen[9] == 40_000 and seen[3] == 400 and seen[None] == 80 and not {4, 5, 6} & set(seen)
    assert packing.pack(none).count() == 0


def test_differencing_is_near_the_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        z, k = rng.integers(1, 40, 7), 3
        best = min(max(np.bincount(p, z, k)) for p in map(list, itertools.product(range(k), repeat=7)))
        w = packing.difference(z, k)
        assert np.bincount(w, z, k).sum() == z.sum() and np.bincount(w, z, k).max() <= best * 4 / 3
    assert packing.fill(np.array([100, 100, 100]), 150)[1] == 3


def test_quality(spark, docs, none):
    import sentencepiece

    path = f"{quality.TOKENIZERS}/{quality.VOCABULARY}"
    p, m = quality.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in ("a b", " a  b ", "x\ny z", "日本 é", "▁ a b", prose(1, 50)):
        assert p.encode(t).tolist() == m.encode(t)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got[4]["reason"] == got[5]["reason"] == "empty" and got[0]["keep"] and got[3]["lang"] == "script:latin"
    assert quality.judge(none).count() == 0 and quality.keep_good(docs).columns == docs.columns
    junk = spark.createDataFrame([(i, prose(i, 100), "en") for i in range(80)] + [(99, "aa " * 100, "en")], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in quality.judge(junk).where("not keep").collect()] == [99]


def test_quality_bands_catch_bad_texts_and_spare_good_ones(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4)
    got = quality.judge(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg({"*": "count", "reason": "count"}).collect()
    out = {r["quality"]: r["count(reason)"] / r["count(1)"] for r in got}
    assert out[0] > 0.45 and out[1] < 0.01


def test_sharding(spark, docs, none):
    got = sharding.shard(docs, 4, 9).collect()
    assert sorted(r["position"] for r in got) == list(range(15)) == sorted(r["row_number"] for r in got)
    for r in got:
        assert r["position"] == sharding.position(r["row_number"], 15, 9) and sharding.row_at(r["position"], 15, 9) == r["row_number"]
        assert (r["shard"], r["slot"]) == sharding.locate(r["row_number"], 15, 4, 9)
    assert sharding.shard(none).count() == 0


def test_classifier(spark, docs, none):
    rng = np.random.default_rng(1)
    data = [(i, prose(i, 60) + (" awful" if i % 4 == 0 else "")) for i in range(2000)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in rng.permutation(2000).tolist()[:1500]], "doc_id long, quality int, toxic int")
    m = classifier.fit(d, lab)
    got = {r["doc_id"]: r["keep"] for r in classifier.score(d, m).collect()}
    assert m.held_out_accuracy > 0.95 and np.mean([got[i] == (i % 4 != 0) for i in range(2000)]) > 0.97
    by = {r["doc_id"]: r for r in classifier.score(docs, m).collect()}
    assert by[4]["score"] is None and not by[4]["keep"] and not by[5]["keep"]
    assert classifier.fit(d, lab.where("toxic = 0")) is None and classifier.fit(none, lab) is None
    assert classifier.score(docs, None).where("keep").count() == 12 and classifier.keep_preferred(docs, None).count() == 12


def test_classifier_cuts_on_all_documents(spark):
    rng = np.random.default_rng(2)
    data = [(i, prose(i, 60) + (" awful" if i % 4 == 0 and rng.random() < 0.8 else "")) for i in range(2000)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1500)], "doc_id long, quality int, toxic int")
    m = classifier.fit(d, lab, max_train=300)
    assert m.judged == 1500 - m.fitted and 200 < m.fitted <= 300
    s = [r["score"] for r in classifier.score(d, m).collect()]
    assert m.level == pytest.approx(np.mean([x < m.threshold for x in s]), abs=1e-9) and 0 < m.level < 1


def test_bpe(docs, none):
    e = bpe.encoder(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    for t in ("", " a  b ", "it's 123!!\n\n x", "日本語 é\t", "aaaaaaaaaaaaaaaaaaaaaaaa", "supercalifragilistic thththth", prose(1, 40)):
        ids = e.encode_array(t).tolist()
        assert ids == [x for p in e.pattern.findall(t) for x in e.merge(p.encode())] and e.decode(ids) == t
    enc = bpe.encode(docs)
    got = {r["doc_id"]: r for r in enc.collect()}
    assert got[4]["tokens"] is None and got[5]["tokens"] == [] and all(r["round_trip"] for r in got.values() if r["tokens"] is not None)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(enc).collect()}
    assert all(back[r["doc_id"]] == r["text"] for r in docs.collect())
    assert bpe.encode(none).count() == 0


class Memory:
    def put(self, *a):
        self.a = a

    def get(self, n, *kinds):
        return list(self.a)


def test_suffix_order():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 4, rng.integers(1, 12)) for _ in range(15)]
    who, size, lcp, bwt = suffixes.index(texts, Memory())
    got = [(tuple(texts[w][len(texts[w]) - n :]), w) for w, n in zip(who, size.astype(int))]
    assert [g[0] for g in got] == sorted(g[0] for g in got) and len(got) == sum(len(t) + 1 for t in texts)
    for i, ((s, w), n) in enumerate(zip(got, size.astype(int))):
        assert bwt[i] == (texts[w][len(texts[w]) - n - 1] if n < len(texts[w]) else 0)
        if i:
            p = got[i - 1][0]
            same = next((j for j, (a, b) in enumerate(zip(p, s)) if a != b), min(len(p), len(s)))
            assert lcp[i] == same


def test_suffixes(spark, docs, none, rows):
    got = {(r["doc_id"], r["start"], r["end"], r["first_doc_id"]) for r in suffixes.repeated(docs).collect()}
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list({(r[0], r[1]) for r in rows if r[0] is not None}))
    assert got == {tuple(r) for r in con.sql(suffixes.ORACLE).fetchall()} and (1, 0, 300, 0) in got and (12, 30, 90, 11) in got
    left = {r["doc_id"]: r["text"] for r in suffixes.drop_repeats(docs).collect()}
    assert 1 not in left and left[12].split() == prose(5, 30).split() and left[11] == rows[11][1] and left[4] is None and left[5] == ""
    assert suffixes.repeated(none).count() == 0 and suffixes.drop_repeats(docs).columns == docs.columns


def test_warc(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n", "p" * (i * 997)) for i in range(60)] + [(None, None, None), (1, "http://x/1\r\n", "p" * 997)], "page_id long, url string, html string").repartition(2)
    got = warc.bundle(pages, frame_bytes=20_000, bundle_bytes=2_000).collect()
    import zstandard

    n = 0
    for b in got:
        data = bytes(b["data"])
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        for r in b["records"]:
            h, body = warc.parse(rec := warc.read_record(data, r["frame"], r["offset"], r["bytes"]))
            assert h["WARC-Record-ID"] == f"<{r['record_id']}>" and body == b"p" * ((r["page_id"] or 0) * 997) and rec in whole
            n += 1
    assert n == 62 and warc.bundle(pages.limit(0)).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    extra = [(700, None), (701, [1.0]), (702, [float("nan")] * 16), (None, [0.0] * 16), (703, [0.0] * 3)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + extra + [(0, x[0].tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(d, 5, words=8).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbour"])
    dist = ann.distances(x, x)
    np.fill_diagonal(dist, np.inf)
    want = np.argsort(dist, 1)[:, :5]
    assert set(got) == set(range(600)) and np.mean([len(got[i] & set(want[i])) / 5 for i in range(600)]) >= 0.9
    assert ann.neighbours(d.limit(0)).count() == 0
    order = ann.traverse(np.array([3.0, 1.0]), np.array([2.0, 5.0, 1.0]), np.ones((2, 3), int), 6)
    assert [s for _, _, s in order] == sorted(a + b for a in (3, 1) for b in (2, 5, 1))


def test_ann_of_every_fiftieth_row(spark):
    got = {}
    for r in ann.op10_ann(spark, sf := "/root/testdata/sf0.1").orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append(r)
    t = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toArrow()
    ids, x = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), np.float32)
    at = np.flatnonzero(ids % 50 == 0)
    dist = ann.distances(x[at], x)
    dist[np.arange(len(at)), at] = np.inf
    want = ids[np.argsort(dist, 1, kind="stable")[:, :10]]
    assert sorted(got) == ids[at].tolist() and all([r["rank"] for r in v] == list(range(1, 11)) for v in got.values())
    assert len({r["neighbour"] for v in got.values() for r in v if r["neighbour"] % 50}) > 100
    assert np.mean([len({r["neighbour"] for r in got[i]} & set(w)) / 10 for i, w in zip(ids[at].tolist(), want)]) >= 0.9
    for i, v in got.items():
        assert [r["distance"] for r in v] == pytest.approx([((x[ids == i] - x[ids == r["neighbour"]]) ** 2).sum() for r in v], abs=1e-5)


def test_ann_of_some_rows(spark):
    d = spark.createDataFrame([(f"k{i}", [float(i), 0.0], i < 2) for i in range(6)] + [("k5", [9.0, 9.0], True), (None, [0.0, 0.0], True)], "vec_id string, embedding array<float>, me boolean")
    got = {(r["vec_id"], r["rank"]): r["neighbour"] for r in ann.neighbours(d, 2, asks=F.col("me")).collect()}
    assert got == {("k0", 1): "k1", ("k0", 2): "k2", ("k1", 1): "k0", ("k1", 2): "k2", ("k5", 1): "k4", ("k5", 2): "k3"}
    assert ann.neighbours(d, 2, asks=F.lit(False)).count() == ann.neighbours(d, 2, asks=F.lit(None).cast("boolean")).count() == 0


def test_ann_visits_and_keeps_the_same_as_brute_force():
    rng = np.random.default_rng(6)
    one, two, x = (rng.normal(size=s).astype(np.float32) for s in ((5, 3), (5, 3), (40, 6)))
    sizes = rng.integers(0, 4, 25)
    filled = np.flatnonzero(sizes)
    got = ann.last_sums(ann.cell_sums(x, one, two, filled), sizes[filled], 17)
    for q in range(len(x)):
        visits = ann.traverse(*(ann.distances(x[q : q + 1, s], b)[0] for s, b in ((slice(3), one), (slice(3, 6), two))), sizes.reshape(5, 5), 17)
        assert got[q] == pytest.approx(max(s for i, j, s in visits if sizes[i * 5 + j]), rel=1e-5)
    y = rng.integers(0, 3, (3000, 4)).astype(np.float32)  # many ties
    near = ann.Nearest(y[:90], np.arange(90), 7)
    for lo in range(0, 3000, 700):
        near.add(np.arange(90), ann.Nearest.entries(y[lo : lo + 700]), np.arange(lo, min(lo + 700, 3000)), np.zeros(700, np.int32))
    dist = ann.distances(y[:90], y)
    np.fill_diagonal(dist, np.inf)
    assert near.best()[1].tolist() == np.argsort(dist, 1, kind="stable")[:, :7].ravel().tolist()


def test_hmm_pass_emits_for_so_many_tasks(spark):
    d = spark.createDataFrame([(i, np.array([i % 5, 3], np.int32).tobytes()) for i in range(400)], "uid long, sym binary").repartition(40)
    # counts, and how many tasks emitted: not one for each partition of the table
    total = hmm._summed(d, 3, lambda seqs: np.stack([np.bincount(np.concatenate(seqs), minlength=5), np.ones(5)], 1), 5, 2)
    assert total.tolist() == [[80, 3], [80, 3], [80, 3], [480, 3], [80, 3]]


def test_hmm_counts_of_rare_moves_and_symbols_stay_finite():
    rng = np.random.default_rng(5)
    k, v = 4, 30
    start, move, emit = rng.dirichlet(np.ones(k)), np.where(np.eye(k) > 0, 1 - 3e-9, 1e-9), np.where(np.arange(v)[:, None] % k == np.arange(k), 1e-9, 1e-18)
    seqs = [rng.integers(0, v, n) for n in (40, 39, 39, 17, 3, 2, 1)]  # each symbol needs a move of chance 1e-9
    want = hmm.expect(hmm.Columns(seqs), start, move, emit, v)
    got = hmm.expect(hmm.Columns(seqs), *(x.astype(np.float32) for x in (start, move, emit)), v)
    alone = [hmm.expect_long(s, start, move, emit, v, 10) for s in seqs]
    for i, (w, g) in enumerate(zip(want, got)):
        assert np.allclose(w, sum(x[i] for x in alone), rtol=1e-6) and np.allclose(w, g, rtol=1e-3, atol=1e-4)


def test_hmm_starts_from_a_share_and_ends_on_all_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {}
    for least in (1e18, 1e5):
        monkeypatch.setattr(hmm, "LEAST", least, raising=False)
        m, enc, _ = hmm.train(docs)
        found[least] = m.log_likelihood
        n = hmm.score(enc, m).agg({"n_words": "sum"}).collect()[0][0]
    cold, warm = found.values()
    assert len(warm) <= len(cold) // 2  # passes over all texts
    assert warm[-1] > cold[-1] - 0.005 * n and (warm[-1] - warm[-2]) / n < hmm.TOLERANCE


def test_hmm_share_without_its_words_changes_nothing(spark):
    d = spark.createDataFrame([(i, bytes(4 * i), False) for i in range(4)], "uid long, sym binary, long boolean")
    model = (np.full(2, 0.5), np.full((2, 2), 0.5), np.full((3, 2), 1 / 3))
    run = lambda some, tasks, *m: (*m[:3], np.zeros((3, 2)), [0.0])
    assert hmm.warm(d, 0.25, 100, model, np.ones(3), run) is model
    half = np.array([[9.0, 1.0], [0.0, 0.0], [10.0, 10.0]])
    _, _, emit = hmm.warm(d, 0.25, 100, model, np.array([10.0, 5.0, 85.0]), lambda *_: (*model, half, [0.0]))
    assert emit.sum(0) == pytest.approx([1, 1]) and emit[0, 0] > 5 * emit[0, 1]
    assert emit[1, 0] / emit[2, 0] == pytest.approx(5 / 85)  # one the share lacks divides as before
