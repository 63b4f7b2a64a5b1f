import math
import random

from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.schema import STATUS, status_name


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_binary_order(spark):
    ks = [b"", b"a", b"ab", b"b", b"\x7f", b"\x80", b"\xff"]
    random.seed(1)
    mixed = random.sample(ks, len(ks))
    d = spark.createDataFrame([(bytearray(k),) for k in mixed], "k binary").orderBy("k")
    assert [bytes(r[0]) for r in d.collect()] == ks


def test_doubles_and_longs_keep_their_order(spark):
    xs = [-math.inf, -1e9, -1.5, -0.0, 0.0, 1e-300, 2.0, math.inf]
    d = spark.createDataFrame([(x,) for x in xs], "x double").select("x", K.encode_double("x").alias("k"))
    assert [r["x"] for r in d.orderBy("k", "x").collect()] == xs
    ns = [-(2**63), -1, 0, 1, 2**63 - 1]
    d = spark.createDataFrame([(x,) for x in ns], "x long").orderBy(K.encode_long("x"))
    assert [r[0] for r in d.collect()] == ns
    assert one(spark, K.encode_double(F.lit(None).cast("double"))) is None


def test_murmur(spark):
    assert K.murmur32_bytes(b"") == 0
    assert K.murmur32_bytes(b"hello") == 0x248BFA47
    assert K.murmur32_bytes(b"hello, world") == 0x149BBB7F
    d = spark.createDataFrame([(bytearray(b"hello"),)], "k binary")
    assert d.select(K.murmur32("k")).first()[0] == 0x248BFA47


def test_small_functions(spark):
    assert one(spark, K.readable(F.lit(b"a\x00b~"))) == "(4) a.b."
    assert one(spark, K.record_size(F.lit(b"ab"), F.lit(None).cast("binary"), F.lit(b"c"))) == 3
    assert one(spark, K.to_hex(F.lit(b"\x01\xff"))) == "01ff"
    assert one(spark, K.checksum(F.lit(b"a"), F.lit(b"b"))) != one(spark, K.checksum(F.lit(b"ab"), F.lit(b"")))
    d = spark.createDataFrame([(bytearray(k),) for k in (b"\xff", b"\xff\xffa", b"\xfe")], "k binary")
    assert d.where(K.starts_with(F.col("k"), b"\xff")).count() == 2
    b = d.select(K.bucket("k", 4, 1).alias("b")).collect()
    assert b[0] == b[1] and all(0 <= r[0] < 4 for r in b)


def test_every_status_has_a_name():
    assert all(status_name(v) == k for k, v in STATUS.items())
