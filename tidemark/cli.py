"""Inspection from a shell: ``python -m tidemark.cli PATH COMMAND [ARGS]``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import readable, to_hex
from tidemark.store.db import Store

LIMIT = 100


def run(spark: SparkSession, args: list[str]) -> Iterator[str]:
    """Lines that a command prints: of dumps all records, of lookups at most 100."""
    return iter(lines(spark, args))


def lines(spark: SparkSession, args: list[str]) -> Iterable[str]:
    p = argparse.ArgumentParser("tidemark")
    p.add_argument("path")
    p.add_argument("command", choices=["getstats", "getrecord", "getmeta", "dumpvalue2file", "tableinfo", "compactupto", "overview", "logmeta", "dumplog", "kvmeta", "dumpkv", "loglevel"])
    p.add_argument("arg", nargs="?")
    p.add_argument("-x", "--hex", action="store_true", help="the key is in hexadecimal")
    p.add_argument("-p", "--prefix", action="store_true")
    p.add_argument("-i", "--first", type=int, help="first n records from the key on")
    p.add_argument("-s", "--seq", action="store_true", help="the argument is a range low-high of sequence numbers")
    p.add_argument("-o", "--out")
    a = p.parse_args(args)
    if a.command == "loglevel":
        spark.sparkContext.setLogLevel(a.arg or "WARN")
        return [a.arg or "WARN"]
    db = Store.open(spark, a.path, read_only=a.command != "compactupto")
    if a.command == "getstats":
        return [f"{k}: {v}" for k, v in db.stats().items()]
    if a.command in ("tableinfo", "kvmeta"):
        return [json.dumps(t) for t in db.state.tables]
    if a.command in ("overview", "logmeta"):
        s = db.state
        return [json.dumps({"version": db.group.doc["version"], "flushed": s.flushed, "max_seq": s.max_seq, "checkpoints": s.checkpoints, **({"segments": s.segments} if a.command == "logmeta" else {})})]
    if a.command == "compactupto":
        return [f"{db.compact_upto(int(a.arg))} tables"]
    if a.command == "dumplog":
        rows = db.log_section().orderBy("seq")
    elif a.command == "dumpkv":
        rows = db.range()
    elif a.seq:
        low, _, high = a.arg.partition("-")
        rows = db.seq_scan(int(low), int(high or low)).limit(LIMIT)
    else:
        key = bytes.fromhex(a.arg) if a.hex else a.arg.encode()
        if a.prefix:
            rows = db.prefix(key).limit(LIMIT)
        elif a.first:
            rows = db.range(key).limit(min(a.first, LIMIT))
        else:
            rows = db.range(key, key)
    if a.command == "dumpvalue2file":
        found = rows.select("value").collect()
        with open(a.out, "wb") as f:
            f.writelines(bytes(r[0] or b"") for r in found)
        return [f"{len(found)} values"]
    shown = ["seq", "type", readable("key").alias("key"), to_hex("meta").alias("meta")]
    if a.command != "getmeta":
        shown.append(readable("value").alias("value"))
    return (json.dumps(r.asDict()) for r in rows.select(*shown, F.octet_length("value").alias("value_bytes")).toLocalIterator())


if __name__ == "__main__":
    import sys

    for line in run(SparkSession.builder.getOrCreate(), sys.argv[1:]):
        print(line)
