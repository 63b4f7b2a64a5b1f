"""The queries of the changelog, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import checksum, readable, record_size
from tidemark.operators import maintenance as M
from tidemark.operators import ordered
from tidemark.operators import reads as R
from tidemark.operators.resolve import latest, resolve
from tidemark.sources.events import changelog, probes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_LOG = """log as (select event_id+1 as seq,
  case event_type when 'error' then 1 when 'signup' then 2 else 0 end as type,
  'user'||lpad(cast(user_id as varchar),6,'0') as key, props as meta,
  case when event_type='error' then null else value end as value from events)"""


def _latest(name: str, where: str = "true") -> str:
    return f"{name} as (select * from (select *, row_number() over(partition by key order by seq desc) rn from log where type<>2 and {where}) t where rn=1)"


_P = "p as (select distinct 'user'||lpad(cast(c_custkey as varchar),6,'0') as k from customer where c_custkey<300)"


def _sql(body: str, *ctes: str) -> str:
    return f"with {', '.join([_LOG, *ctes])} {body}"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_L = _latest("l")


@query("live_view", _sql("select key,seq,value from l where type=0", _L))
def live_view(spark, d):
    return resolve(changelog(spark, d)).select("key", "seq", "value")


@query("latest_with_tombstones", _sql("select key,seq,type,value from l", _L))
def latest_with_tombstones(spark, d):
    return latest(changelog(spark, d)).select("key", "seq", "type", "value")


@query("multi_get", _sql("select p.k as key,r.seq,r.value from p left join (select * from l where type=0) r on p.k=r.key", _L, _P))
def multi_get(spark, d):
    return R.multi_get(changelog(spark, d), probes(spark, d), "k").select("key", "seq", "value")


@query("point_get", _sql("select value from l where key='user000007' and type=0", _L))
def point_get(spark, d):
    return R.newest(changelog(spark, d), "user000007").where("type = 0").select("value")


@query("meta_only_get", _sql("select key,seq,type,meta from l where key='user000013'", _L))
def meta_only_get(spark, d):
    return R.meta_only(changelog(spark, d), "user000013").select("key", "seq", "type", "meta")


@query("get_by_seq", _sql("select seq,key,type,value from log where seq in (1,7,500)"))
def get_by_seq(spark, d):
    return R.by_seq(changelog(spark, d), 1, 7, 500).select("seq", "key", "type", "value")


def _near(name: str, option: str, agg: str, op: str) -> None:
    @query(name, _sql(f"select p.k as probe,{agg}(l.key) as key from p join l on l.key{op}p.k group by p.k", _L, _P))
    def near(spark, d):
        p = probes(spark, d).withColumnRenamed("k", "probe")
        return R.nearest_many(changelog(spark, d), p, "probe", option).where("key is not null")


_near("nearest_ge", "GREATER_OR_EQUAL", "min", ">=")
_near("nearest_gt", "GREATER", "min", ">")
_near("nearest_le", "SMALLER_OR_EQUAL", "max", "<=")
_near("nearest_lt", "SMALLER", "max", "<")


@query("prefix_scan", _sql("select key,seq,type from l where key like 'user00001%'", _L))
def prefix_scan(spark, d):
    return R.prefix(changelog(spark, d), "user00001").select("key", "seq", "type")


@query("prefix_stop", _sql("select key,seq from l where key like 'user0000%' order by key limit 7", _L))
def prefix_stop(spark, d):
    return R.prefix(changelog(spark, d), "user0000", limit=7).select("key", "seq")


@query("range_scan", _sql("select key,seq,value from l where type=0 and key between 'user000002' and 'user000009'", _L))
def range_scan(spark, d):
    return R.range_scan(changelog(spark, d), "user000002", "user000009").select("key", "seq", "value")


@query("seek_ge", _sql("select key,seq from l where type=0 and key>='user000050' order by key limit 1", _L))
def seek_ge(spark, d):
    return R.range_scan(changelog(spark, d), "user000050").limit(1).select("key", "seq")


@query("goto_end", _sql("select key,seq from l where type=0 order by key desc limit 1", _L))
def goto_end(spark, d):
    return R.range_scan(changelog(spark, d), descending=True).limit(1).select("key", "seq")


@query("seq_scan", _sql("select seq,type,key,value from log where seq between 100 and 200"))
def seq_scan(spark, d):
    return R.seq_scan(changelog(spark, d), 100, 200).select("seq", "type", "key", "value")


@query("cursor_neighbours", _sql("select key,lead(key) over(order by key) as nxt,lag(key) over(order by key) as prv from l where type=0", _L))
def cursor_neighbours(spark, d):
    return R.neighbours(changelog(spark, d))


@query("snapshot_live", _sql("select key,seq,value from l where type=0", _latest("l", "seq<=500")))
def snapshot_live(spark, d):
    return resolve(changelog(spark, d), 500).select("key", "seq", "value")


@query("snapshot_prefix", _sql("select key,seq,type from l where key like 'user00001%'", _latest("l", "seq<=500")))
def snapshot_prefix(spark, d):
    return R.prefix(changelog(spark, d), "user00001", as_of=500).select("key", "seq", "type")


@query("seq_scan_after_flush", _sql("select seq,key,type from log where seq>500 union all select seq,key,type from l", _latest("l", "seq<=500")))
def seq_scan_after_flush(spark, d):
    return R.seq_scan(changelog(spark, d), flushed=500, order=False).select("seq", "key", "type")


@query("tail_holes_found", _sql("select seq,prev from (select seq,lag(seq) over(order by seq) as prev from log where seq%7<>3) t where seq-prev>1"))
def tail_holes_found(spark, d):
    return M.sequence_holes(changelog(spark, d).where("seq % 7 <> 3")).select("seq", "prev")


@query("compact_filter", _sql("select key,seq,value from l where type=0 and not (value<50)", _L))
def compact_filter(spark, d):
    return M.compact(changelog(spark, d), drop=F.col("value") < 50).select("key", "seq", "value")


@query("merge_runs", _sql("select key,seq,value from l where type=0", _L))
def merge_runs(spark, d):
    log = changelog(spark, d)
    return M.merge(log.where("seq > 300"), M.compact(log.where("seq <= 300"), last_level=False)).select("key", "seq", "value")


@query("stale_ratio", _sql("select key,count(*) as versions,sum(case when type=1 then 1 else 0 end)::bigint as dels from log where type<>2 group by key"))
def stale_ratio(spark, d):
    return M.stale_ratio(changelog(spark, d))


@query("level_bounds", _sql("select cast(floor(rk/16) as int) as tbl,min(key) as min_key,max(key) as max_key,count(*) as n from (select key,row_number() over(order by key)-1 as rk from l) t group by 1", _L))
def level_bounds(spark, d):
    return M.key_ranges(latest(changelog(spark, d)), 16)


@query("stats", _sql("select count(*) as approx_num,max(seq) as max_seq,min(seq) as min_seq,count(distinct key) as n_keys from log"))
def stats(spark, d):
    return M.stats(changelog(spark, d))


@query("live_sample", _sql("select distinct key from log where seq%97=1 and key in (select key from l where type=0)", _L))
def live_sample(spark, d):
    return M.sample_stride(changelog(spark, d), 97)


@query("key_sample", _sql("select distinct key from log where seq%97=1"))
def key_sample(spark, d):
    return M.sample_stride(changelog(spark, d), 97, live_only=False)


@query("record_sizes", _sql("select seq,(strlen(key)+coalesce(strlen(meta),0))::int as bytes from log where seq<=2000"))
def record_sizes(spark, d):
    return changelog(spark, d).where("seq <= 2000").select("seq", record_size("key", "meta").alias("bytes"))


@query("readable_keys", _sql("select distinct '('||strlen(key)||') '||key as shown from log"))
def readable_keys(spark, d):
    return changelog(spark, d).select(readable(F.col("key").cast("binary")).alias("shown")).distinct()


@query("record_checksums")
def record_checksums(spark, d):
    return changelog(spark, d).select("seq", checksum("key", "meta").alias("crc"))


@query("key_rank", _sql("select key,row_number() over(order by key)-1 as rk from l", _L))
def key_rank(spark, d):
    return ordered.with_rank(latest(changelog(spark, d)).select("key"), "key", "rk").select("key", "rk")


@query("batch_validity", _sql("select sum(case when seq<=prev then 1 else 0 end)::bigint as bad from (select seq,lag(seq) over(order by seq%7,seq) as prev from log) t"))
def batch_validity(spark, d):
    """Faults of a batch that comes in another order than its numbers."""
    batch = changelog(spark, d).withColumn("at", F.col("seq") % 7 * 10**9 + F.col("seq"))
    return M.batch_faults(batch, "at")


def _store(spark, d, upto: int | None = None, **config):
    """A store of the log's head."""
    from tidemark.store.db import Config, Store

    log = changelog(spark, d)
    return Store.from_log(spark, log if upto is None else log.where(F.col("seq") <= upto), config=Config(**config))


def _more(db, spark, d, low: int, high: int) -> None:
    db.append(changelog(spark, d).where(F.col("seq").between(low, high)).select("seq", "type", "key", "meta", "value"))


def _shown(rows, *extra):
    """Store rows as the log has them."""
    return rows.select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").cast("double").alias("value"), *extra)


@query("checkpoint_list", _sql("select max(seq) as seq from log where seq<=600 group by (seq-1)//200"))
def checkpoint_list(spark, d):
    db = _store(spark, d, 200)
    db.checkpoint()
    for low in (201, 401):
        _more(db, spark, d, low, low + 199)
        db.checkpoint()
    return spark.createDataFrame([(c,) for c in db.checkpoints()], "seq long")


@query("log_purge", _sql("select seq,key,type from log where seq>500"))
def log_purge(spark, d):
    db = _store(spark, d)
    db.flush(500, purge_only=True)
    return db.rows().select("seq", F.col("key").cast("string").alias("key"), F.col("type").cast("int").alias("type"))


@query("store_rollback", _sql("select key,seq,value from l where type=0", _latest("l", "seq between 101 and 400")))
def store_rollback(spark, d):
    db = _store(spark, d, mode="log")
    db.flush(100)
    db.rollback(400)
    return _shown(db.live())


@query("store_holes", _sql("select key,seq,value from l where type=0", _latest("l", "seq<=300")))
def store_holes(spark, d):
    """A log cut at the first hole between its segments."""
    db = _store(spark, d, 300, mode="log")
    _more(db, spark, d, 320, 500)
    db.truncate_holes()
    return _shown(db.live())


@query("seq_bounds", _sql("select max(seq) as max_seq,501::bigint as min_seq,500::bigint as flushed,max(seq) as synced,501::bigint as first_available from log"))
def seq_bounds(spark, d):
    db = _store(spark, d)
    db.flush(500)
    row = (db.max_seq(), db.min_seq(), db.flushed_seq(), db.synced_seq(), db.available_seqs()[0])
    return spark.createDataFrame([row], "max_seq long, min_seq long, flushed long, synced long, first_available long")


@query("store_overwrite", _sql("select key,seq,case when seq%10=0 then 1.0 else value end as value from l where type=0", _latest("l", "seq<=500")))
def store_overwrite(spark, d):
    """Numbers at or below the flush point written once more, read, and flushed again."""
    db = _store(spark, d, 500, allow_overwrite=True)
    db.flush()
    again = changelog(spark, d).where("seq <= 500 and seq % 10 = 0")
    db.append(again.select("seq", "type", "key", "meta", F.when(F.col("type") != 1, F.lit(1.0)).alias("value")))
    db.flush()
    db.compact_l0()
    return _shown(db.live())


@query("store_filter_checkpoint", _sql("select key,seq,value from l where type=0 and not (seq>300 and value<50)", _latest("l", "seq<=600")))
def store_filter_checkpoint(spark, d):
    """A compaction filter beside a checkpoint: what it drops doesn't bring older versions back."""
    return _shown(_filtered(spark, d).live())


@query("store_snapshot_kept", _sql("select key,seq,value from l where type=0", _latest("l", "seq<=300")))
def store_snapshot_kept(spark, d):
    """The checkpoint under the same filter shows all that it did."""
    return _shown(_filtered(spark, d).snapshot(300).live())


def _filtered(spark, d):
    db = _store(spark, d, 300)
    db.checkpoint()
    _more(db, spark, d, 301, 600)
    db.flush()
    db.compact_l0(drop=F.col("value").cast("string").cast("double") < 50)
    return db


@query("store_levels", _sql("select key,seq,value from l where type=0", _L))
def store_levels(spark, d):
    """The live view after tables were moved, split, merged and compacted over levels."""
    db = _store(spark, d, table_rows=40)
    db.flush(db.max_seq() // 3)
    db.compact_l0()
    db.migrate_level(1)
    db.flush(2 * db.max_seq() // 3)
    db.compact_l0()
    db.compact_level(1)
    db.split_level(2)
    db.merge_level(2)
    db.compact_inplace(2)
    db.flush()
    db.compact_upto(10**6)
    db.set_buckets(2)
    return _shown(db.live())


def _tabled(spark, d):
    db = _store(spark, d, table_rows=20)
    db.flush(db.max_seq() - 50)
    db.compact_l0(preserve_tombstones=True)
    return db


@query("store_point_get", _sql("select key,seq,value from l where key='user000007' and type=0", _L))
def store_point_get(spark, d):
    """One key: only tables whose bounds or bucket allow for it are opened."""
    return _shown(R.newest(_tabled(spark, d).rows(key=b"user000007"), b"user000007").where("type = 0"))


@query("store_range", _sql("select key,seq,value from l where type=0 and key between 'user000002' and 'user000009'", _L))
def store_range(spark, d):
    return _shown(_tabled(spark, d).range("user000002", "user000009"))


@query("store_prefix", _sql("select key,seq,value,type from l where key like 'user00001%'", _L))
def store_prefix(spark, d):
    return _shown(_tabled(spark, d).prefix("user00001"), F.col("type").cast("int").alias("type"))


@query("store_nearest", _sql("select max(key) as key from l where key<='user0000055'", _L))
def store_nearest(spark, d):
    found = _tabled(spark, d).nearest("user0000055", "SMALLER_OR_EQUAL")
    return spark.createDataFrame([(bytes(found["key"]).decode(),)], "key string")


@query("store_groups", _sql("select key,seq,value from l where type=0", _L))
def store_groups(spark, d):
    """The log dealt to two named spaces of one group."""
    from tidemark.sources.shared import new_path
    from tidemark.store.db import Group

    g, log = Group(spark, new_path(spark, "group")), changelog(spark, d).select("seq", "type", "key", "meta", "value")
    odd = F.crc32(F.col("key").cast("binary")) % 2 == 1
    for name, cond in (("odd", odd), ("even", ~odd)):
        g.open(name).append(log.where(cond))
        g.open(name).flush()
    again = Group(spark, g.path)
    return _shown(again.open("odd").live()).unionByName(_shown(again.open("even").live()))


@query("stream_replay", _sql("select key,seq,value from l where type=0", _L))
def stream_replay(spark, d):
    """A stream into a store, run again from its start: stored batches are told by the manifest."""
    from tidemark.sources.shared import new_path
    from tidemark.store.db import Store
    from tidemark.streaming.ingest import ingest

    log = changelog(spark, d).select("seq", "type", "key", "meta", "value")
    src, ck = new_path(spark, "stream"), new_path(spark, "progress")
    log.where("seq % 2 = 1").orderBy("seq").write.parquet(src)
    log.where("seq % 2 = 0").write.mode("append").parquet(src)
    db = Store.open(spark, new_path(spark, "store"))
    for _ in range(2):
        ingest(spark.readStream.schema(log.schema).parquet(src), db, ck, availableNow=True).awaitTermination()
    db.group.refresh()
    return _shown(db.live())


@query("store_live", _sql("select key,seq,value from l where type=0", _L))
def store_live(spark, d):
    """The same live view after the log went through segments, a flush and a compaction."""
    db = _store(spark, d)
    top = db.max_seq()
    db.flush(top // 2)
    db.compact_l0()
    return db.live().select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").cast("double").alias("value"))
