"""The same assertions in several physical states of a store."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.cli import run as cli
from tidemark.store.db import Config, Group, Store, global_batch
from tidemark.streaming.ingest import ingest


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/db"


def fill(db):
    for i in range(0, 100, 10):
        db.set(f"key{i:05d}", f"v{i}", meta=f"m{i}")
    db.delete("key00030", meta="gone")
    db.set("key00040", "new")
    db.set("cmd", "x", kind=S.COMMAND)
    db.sync()


STATES = {
    "pending": lambda db: None,
    "log": lambda db: db.sync(),
    "mixed": lambda db: db.flush(6),
    "table": lambda db: db.flush(),
    "compacted": lambda db: (db.flush(), db.compact_l0(preserve_tombstones=True)),
    "deep": lambda db: (db.flush(), db.compact_l0(preserve_tombstones=True), db.migrate_level(1), db.split_level(2)),
}


@pytest.mark.parametrize("state", STATES)
def test_reads(spark, path, state):
    db = Store.open(spark, path)
    fill(db)
    STATES[state](db)
    assert db.get("key00040") == b"new"
    with pytest.raises(S.KeyNotFound):
        db.get("key00030")
    gone = db.get_record("key00030", meta_only=True)
    assert gone["type"] == S.DELETE and bytes(gone["meta"]) == b"gone"
    assert bytes(db.nearest("key00025")["key"]) == b"key00030"  # tombstones count
    assert bytes(db.nearest("key00030", "GREATER")["key"]) == b"key00040"
    assert bytes(db.nearest("key00030", "SMALLER")["key"]) == b"key00020"
    assert bytes(db.nearest("key00035", "SMALLER_OR_EQUAL")["key"]) == b"key00030"
    with pytest.raises(S.InvalidParameters):
        db.nearest("a", "EQUAL")
    assert [bytes(r["key"]) for r in db.prefix("key0000").collect()] == [b"key00000"]
    assert db.prefix("key").count() == 10
    assert [bytes(r["key"]) for r in db.range("key00010", "key00050").collect()] == [b"key00010", b"key00020", b"key00040", b"key00050"]
    assert db.live().count() == 9
    c = db.cursor()
    assert bytes(c.get()["key"]) == b"key00000"
    with pytest.raises(S.OutOfRange):
        c.prev()
    assert bytes(c.next()["key"]) == b"key00010"
    assert bytes(c.seek("key00030")["key"]) == b"key00040"
    assert bytes(c.seek("key00030", "SMALLER")["key"]) == b"key00020"
    assert bytes(c.goto_end()["key"]) == b"key00090"
    with pytest.raises(S.OutOfRange):
        c.next()
    assert bytes(c.get()["key"]) == b"key00090"


def test_reopen_and_sequence_reads(spark, path):
    db = Store.open(spark, path)
    fill(db)
    db = Store.open(spark, path)
    assert db.max_seq() == 13 and db.min_seq() == 1
    with pytest.raises(S.NotKvPair):
        db.get_by_seq(11)
    assert db.get_by_seq(13, any_type=True)["type"] == S.COMMAND
    with pytest.raises(S.SeqnumNotFound):
        db.get_by_seq(99)
    assert [r["seq"] for r in db.seq_scan(10, 13).collect()] == [10, 11, 12, 13]
    db.flush(12)
    with pytest.raises(S.AlreadyPurged):
        db.get_by_seq(3)
    with pytest.raises(S.AlreadyFlushed):
        db.flush(5)
    assert (db.flushed_seq(), db.min_seq(), db.max_seq()) == (12, 13, 13)
    assert [r["seq"] for r in db.seq_scan().collect()] == [1, 2, 3, 6, 7, 8, 9, 10, 11, 12, 13]


def test_sequence_rules(spark, path):
    db = Store.open(spark, path)
    with pytest.raises(S.LogNotExist):
        db.max_seq()
    assert db.set("a", "1", seq=5) == 5 and db.set("b", "2") == 6
    for bad in (0, 6, 2**63):
        with pytest.raises(S.InvalidSeqnum):
            db.set("c", "3", seq=bad)
    db.sync()
    assert db.delete("never") == 7
    with pytest.raises(S.InvalidSeqnum):
        db.discard_dirty(6)
    assert db.discard_dirty(7) == 1 and db.max_seq() == 6
    with pytest.raises(S.EmptyBatch):
        db.set_batch([])
    with pytest.raises(S.InvalidSeqnum):
        db.set_batch([{"key": "x", "value": "1", "seq": 9}, {"key": "y", "value": "1", "seq": 8}])
    db.set_batch([{"key": "x", "value": "1"}, {"key": "y", "value": "1"}])
    assert db.max_seq() == 8
    with pytest.raises(S.WriteViolation):
        Store.open(spark, path, Config(read_only=True)).set("a", "b")


def test_overwriting_a_sequence_number(spark, path):
    db = Store.open(spark, path, Config(allow_overwrite=True))
    db.set("a", "1", seq=1)
    db.sync()
    db.set("a", "2", seq=1)
    assert db.get("a") == b"2" and db.seq_scan().count() == 1


def test_checkpoints_survive_compaction(spark, path):
    db = Store.open(spark, path, Config(max_checkpoints=2))
    assert db.checkpoint() is None
    db.set("k", "1")
    db.set("d", "1")
    a = db.checkpoint()
    assert db.checkpoint() == a and db.checkpoints() == [a]
    db.set("k", "2")
    db.delete("d")
    for step in (lambda: None, db.flush, db.compact_l0, lambda: db.compact_inplace(1)):
        step()
        s = db.snapshot(a)
        assert s.get("k") == b"1" and s.get("d") == b"1"
        assert db.get("k") == b"2" and db.live().count() == 1
    with pytest.raises(S.InvalidCheckpoint):
        db.snapshot(99)
    db.set("z", "1")
    b = db.checkpoint()
    db.set("z", "2")
    c = db.checkpoint()
    assert db.checkpoints() == [b, c]


def test_log_mode(spark, path):
    db = Store.open(spark, path, Config(mode="log"))
    for i in range(10):
        db.set(f"k{i}", str(i))
        if i % 4 == 3:
            db.sync()
    db.sync()
    twin = db.clone_manifest()
    db.rollback(6)
    assert db.max_seq() == 6 and db.live().count() == 6 and db.set("n", "x") == 7
    assert twin.live().count() == 10 and Store.is_log_mode(spark, path)
    with pytest.raises(S.WriteViolation):
        twin.set("a", "b")
    with pytest.raises(S.TablesAreDisabled):
        db.compact_l0()
    db.flush(3)
    assert db.live().count() == 4
    db.set("far", "x", seq=50)
    db.sync()
    assert db.truncate_holes() == 7
    with pytest.raises(S.InvalidMode):
        Store.open(spark, f"{path}2").rollback(1)


def test_compaction_filter_levels_and_stats(spark, path):
    rows = spark.range(200).select(F.format_string("k%06d", "id").alias("key"), F.col("id").cast("string").alias("value"))
    db = Store.bulk_build(spark, path, rows, Config(table_rows=60))
    assert len(db.state.tables) == 4 and db.max_seq() == 200 and db.hierarchy().count() == 4
    db.merge_level(1)
    assert len(db.state.tables) == 3
    db.set("k000000", "new")
    db.delete("k000001")
    db.flush()
    db.compact_l0(drop=F.col("value").cast("string") == "7")
    assert db.exact_count() == 198 and db.get("k000000") == b"new"
    with pytest.raises(S.InvalidLevel):
        db.compact_level(5)
    db.compact_level(1)
    assert db.exact_count() == 198 and db.levels() == [1, 2]
    assert db.compact_upto(10**6) and db.exact_count() == 198
    assert db.stats()["num_tables"] == len(db.state.tables) and db.level_size(2) > 0
    assert db.sample_keys(20).count() == 20
    with pytest.raises(S.InvalidParameters):
        db.sample_keys(0)
    again = Store.from_tables(spark, path + "3", [], None)
    assert again.live().count() == 0
    db.group.config = Config(keep_manifests=1)
    db.set("last", "1")
    db.sync()
    assert db.group.vacuum() and db.exact_count() == 199
    assert any("num_kvs" in x for x in cli(spark, [path, "getstats"]))
    assert len(list(cli(spark, [path, "getrecord", "k00000", "-p"]))) == 8  # ten keys, one deleted, one filtered out
    assert len(list(cli(spark, [path, "tableinfo"]))) == len(db.state.tables)


def test_groups_and_global_batches(spark, path):
    g = Group(spark, path)
    a, b = g.open("a"), g.open("b")
    before = g.doc["version"]
    global_batch([(a, [{"key": "x", "value": "1"}]), (b, [{"key": "x", "value": "2"}]), (a, [{"key": "ignored", "value": ""}])])
    assert g.doc["version"] == before + 1
    assert (a.get("x"), b.get("x"), g.names()) == (b"1", b"2", ["a", "b"])
    with pytest.raises(S.EmptyBatch):
        global_batch([(a, [{"key": "y", "value": "1"}]), (b, [])])
    assert a.live().count() == 1
    with pytest.raises(S.InvalidHandleUsage):
        Store.open(spark, path)
    assert Group(spark, path).open("b").get("x") == b"2"


def test_async_flush_and_stream(spark, path, tmp_path):
    db = Store.open(spark, path)
    src = str(tmp_path / "in")
    d = spark.range(20).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("key"), F.col("id").cast("string").alias("value"))
    d.write.parquet(src)
    for _ in range(2):  # the second run replays nothing
        q = ingest(spark.readStream.schema(d.schema).parquet(src), db, str(tmp_path / "ck"), availableNow=True)
        q.awaitTermination()
    assert db.live().count() == 20 and db.max_seq() == 20
    said = []
    assert db.flush_async(handler=said.append).result() is None and said == [None]
    assert db.flushed_seq() == 20
    db.close()


def test_nulls_and_handles(spark, path):
    db = Store.open(spark, path)
    db.set("n", None)
    assert db.get("n") is None
    twin = Store.open(spark, path)
    assert twin is db  # one writing handle a path and process
    twin.set("b", "2")
    db.sync()
    twin.sync()
    other = Group(spark, path, as_group=False)
    other.default().set("late", "1")
    db.set("c", "3")
    db.sync()
    with pytest.raises(S.OperationInProgress):
        other.default().sync()
    reader = Store.open(spark, path, read_only=True)
    db.set("d", "4")
    db.sync()
    assert reader.group.refresh() and reader.get("d") == b"4" and not reader.group.refresh()


def test_overwriting_below_the_flush_point(spark, path):
    db = Store.open(spark, path, Config(allow_overwrite=True))
    db.set("a", "1", seq=1)
    db.set("b", "1", seq=2)
    db.flush()
    db.set("a", "2", seq=1)
    assert db.get("a") == b"2"
    db.sync()
    assert db.get("a") == b"2" and db.get("b") == b"1"
    db.flush()
    assert db.get("a") == b"2" and db.live().count() == 2
    db.compact_l0()
    assert Store.open(spark, path).get("a") == b"2" and db.live().count() == 2
    assert len(list(cli(spark, [path, "dumpkv"]))) == 2


def test_a_filter_beside_a_checkpoint(spark, path):
    db = Store.open(spark, path)
    db.set("k", "1")
    at = db.checkpoint()
    db.set("k", "7")
    db.flush()
    db.compact_l0(drop=F.col("value").cast("string") == "7")
    with pytest.raises(S.KeyNotFound):
        db.get("k")
    assert db.snapshot(at).get("k") == b"1"
    db.compact_inplace(1, drop=F.col("value").cast("string") == "1")
    assert db.snapshot(at).get("k") == b"1"


def test_holes_and_rollback_are_guarded(spark, path):
    db = Store.open(spark, path)
    db.set("a", "1", seq=1)
    db.sync()
    db.set("b", "1", seq=50)
    db.sync()
    with pytest.raises(S.InvalidMode):
        db.truncate_holes()
    assert db.live().count() == 2
    log = Store.open(spark, path + "log", Config(mode="log"))
    for i in range(1, 7):
        log.set(f"k{i}", "x")
    log.flush(4)
    with pytest.raises(S.InvalidSeqnum):
        log.rollback(2)
    log.rollback(5)
    assert log.set("n", "x") == 6 and log.live().count() == 2


def test_records_of_one_key_keep_their_order_of_arrival(spark, path):
    db = Store.open(spark, path)
    d = spark.range(0, 50, 1, 3).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("value"))
    db.append(d)
    assert db.get("k") == b"49" and db.max_seq() == 50


def test_a_batch_whose_write_failed_is_stored_on_replay(spark, path, tmp_path, monkeypatch):
    db = Store.open(spark, path)
    db.set("pending", "1")
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    d = spark.range(5).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("value"))
    d.write.parquet(src)

    def broken(*a):
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr(Store, "_write_segment", broken)
        with pytest.raises(Exception):
            ingest(spark.readStream.schema(d.schema).parquet(src), db, ck, availableNow=True).awaitTermination()
    ingest(spark.readStream.schema(d.schema).parquet(src), db, ck, availableNow=True).awaitTermination()
    assert Store.open(spark, path, read_only=True).live().count() == 6


def test_reads_open_only_tables_that_may_hold_the_rows(spark, path):
    rows = spark.range(200).select(F.format_string("k%06d", "id").alias("key"), F.col("id").cast("string").alias("value"))
    db = Store.bulk_build(spark, path, rows, Config(table_rows=10))
    assert len(db.state.tables) == 20 and len(db.rows().inputFiles()) == 20
    assert len(db.rows(key=b"k000055").inputFiles()) == 1 and db.get("k000055") == b"55"
    assert len(db.rows(low=b"k000055", high=b"k000071").inputFiles()) == 3
    assert bytes(db.nearest("k0000555", "GREATER")["key"]) == b"k000056"
    assert len(db.prefix("k00001").inputFiles()) == 1
    plan = db.range("k000055", "k000071")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThanOr" in plan
    for i in range(40):
        db.set(f"n{i}", "x")
    db.flush()
    assert len(db._seq_rows(201).inputFiles()) <= 4 and [r["seq"] for r in db.seq_scan(239).collect()] == [239, 240]
    buckets = [t for t in db.state.tables if t["level"] == 0]
    assert len(buckets) == 4 and sum(db._may_hold(t, b"n7", None, None) for t in buckets) == 1 and db.get("n7") == b"x"


def test_many_small_tables_share_files(spark, path, monkeypatch):
    rows = spark.range(200).select(F.format_string("k%06d", "id").alias("key"), F.col("id").cast("string").alias("value"))
    db = Store.bulk_build(spark, path, rows, Config(table_rows=1, keep_manifests=1))
    assert len(db.state.tables) == 200 and len(db.rows().inputFiles()) <= 64
    assert sorted(bytes(r["key"]) for r in db._frame(t for t in db.state.tables if t["idx"] in (55, 71, 199)).collect()) == [b"k000055", b"k000071", b"k000199"]
    assert len(db.rows(key=b"k000055").inputFiles()) == 1 and db.get("k000055") == b"55"
    assert db.range("k000055", "k000071").count() == 17 and db.prefix("k00001").count() == 10
    assert bytes(db.nearest("k0000555", "GREATER")["key"]) == b"k000056"
    db.compact_level(1)  # one table of a shared file moves down, and what takes its place hides its rows
    assert db.levels() == [1, 2] and db.tables(1).count() == 199 and db.tables(2).count() == 1
    moved = db.tables(2).first()["key"]
    db.set(bytes(moved), "new")
    db.delete("k000150")
    db.flush()
    db.compact_l0()
    db.merge_level(1)
    db.split_level(1)
    assert db.group.vacuum() and db.get(bytes(moved)) == b"new" and db.live().count() == 199
    db.close()
    again = Store.open(spark, path)
    assert again.live().count() == 199 and sum(t["rows"] for t in again.state.tables) == again.tables().count()
    assert len({t["idx"] for t in again.state.tables}) == len(again.state.tables)
    monkeypatch.setattr("tidemark.store.db.FILE_ROWS", 2)
    again.compact_upto(10**6)
    assert again.live().count() == 199 and max(t.get("shared", 1) for t in again.state.tables) == 2


def test_a_small_table_has_a_small_file(spark, path):
    rows = spark.range(40).select(F.format_string("k%06d", "id").alias("key"), F.lit("v").alias("value"))
    db = Store.bulk_build(spark, path, rows, Config(table_rows=20))
    assert all(os.path.getsize(f.removeprefix("file:").replace("//", "/")) < 10_000 for f in db.rows().inputFiles())


def test_staleness_of_all_tables_at_once_is_that_of_each(spark, path):
    import random

    rng, db = random.Random(5), Store.open(spark, path)
    for i in range(300):
        low, level = rng.randrange(1000), rng.choice((0, 1, 1, 2, 2, 2))
        high = rng.randrange(low, 1000) if level == 0 else min(999, low + rng.randrange(20))
        db.state.tables.append({"level": level, "idx": i, "min_key": f"{low:04x}", "max_key": f"{high:04x}", "rows": rng.randrange(1, 50)})

    def meets(x, y):
        return x["min_key"] <= y["max_key"] and x["max_key"] >= y["min_key"]

    for level in (0, 1, 2):
        own = [t for t in db.state.tables if t["level"] == level]
        above = [t for t in db.state.tables if t["level"] < level]
        want = [100 * (1 + sum(x["rows"] / max(1, sum(meets(x, y) for y in own)) for x in above if meets(x, t)) / t["rows"]) for t in own]
        assert db._stale_percents(own) == pytest.approx(want) and db.stale_percent(own[3]) == pytest.approx(want[3])


def test_bucket_numbers_are_spark_s(spark):
    from tidemark.functions.keys import bucket, bucket_number

    ks = [b"", b"a", b"abcd", b"abcde", b"\xff\x80z", b"user000007"]
    d = spark.createDataFrame([(bytearray(k),) for k in ks], "k binary")
    assert [r[0] for r in d.select(bucket("k", 7)).collect()] == [bucket_number(k, 7) for k in ks]
    assert [r[0] for r in d.select(bucket("k", 7, 2)).collect()] == [bucket_number(k, 7, 2) for k in ks]


def test_settings_are_stored_and_maintenance_picks_actions(spark, path):
    db = Store.open(spark, path, Config(num_buckets=2, table_rows=20, level_tables=2, stale_percent=150))
    for n in range(2):
        db.append(spark.range(60).select(F.format_string("k%03d", "id").alias("key"), F.lit(str(n)).alias("value")))
        db.flush()
    assert db.pick_action() == ("compact_l0", 0)
    db.compact_l0()
    assert db.pick_action() == ("migrate_level", 1)
    assert db.maintain() == ["migrate_level"] and db.live().count() == 60 and db.levels() == [2]
    db.append(spark.range(60).select(F.format_string("k%03d", "id").alias("key"), F.lit("9").alias("value")))
    db.flush()
    assert db.stale_percent(db.pick_victim(2)) > 150 and db.pick_action() == ("compact_inplace", 2)
    db.set_buckets(3)
    db.close()
    again = Store.open(spark, path)
    assert again.config.num_buckets == 3 and again.live().count() == 60 and again.get("k001") == b"9"


def test_async_flushes_join(spark, path):
    import threading

    db = Store.open(spark, path)
    for i in range(6):
        db.set(f"k{i}", "x")
    db.sync()
    gate, said = threading.Event(), []
    db._pool.submit(gate.wait)
    a, b = db.flush_async(2, said.append), db.flush_async(5, said.append)
    assert a is b
    gate.set()
    assert a.result() is None and said == [None, None] and db.flushed_seq() == 5


def test_checksums(spark, sf):
    import zlib

    from tidemark.plans.catalogue import QUERIES
    from tidemark.sources.events import changelog

    want = {}
    for r in changelog(spark, sf).select("seq", "key", "meta").collect():
        parts = "/".join(str(zlib.crc32((r[c] or "").encode())) for c in ("key", "meta"))
        want[r["seq"]] = zlib.crc32(parts.encode())
    assert {r["seq"]: r["crc"] for r in QUERIES["record_checksums"](spark, sf).collect()} == want
