import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import maintenance as M
from tidemark.operators import ordered


@pytest.fixture
def many_parts(spark):
    """Small tables stay in several partitions, so that borders are crossed."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("how", ["ge", "gt", "le", "lt"])
def test_nearest_over_many_parts(spark, many_parts, how):
    random.seed(3)
    keys = sorted(random.sample(range(0, 4000, 2), 300))
    asked = [*random.sample(range(-10, 4020), 200), keys[0], keys[-1]]
    d = ordered.nearest(spark.createDataFrame([(a,) for a in asked] + [(None,)], "p long"), spark.createDataFrame([(k, str(k)) for k in keys], "k long, v string"), "p", "k", how, ["v"])
    for r in d.collect():
        if r["p"] is None:
            assert r["k"] is None
            continue
        i = {"ge": bisect.bisect_left, "gt": bisect.bisect_right, "le": bisect.bisect_right, "lt": bisect.bisect_left}[how](keys, r["p"])
        i -= how in ("le", "lt")
        want = keys[i] if 0 <= i < len(keys) else None
        assert r["k"] == want and r["v"] == (None if want is None else str(want))


def test_rank_and_neighbours(spark, many_parts):
    keys = random.Random(5).sample(range(10_000), 400)
    d = spark.createDataFrame([(f"{k:05d}",) for k in keys], "k string")
    s = sorted(f"{k:05d}" for k in keys)
    assert {r["k"]: r["r"] for r in ordered.with_rank(d, "k", "r").collect()} == {k: i for i, k in enumerate(s)}
    n = {r["k"]: (r["a"], r["b"]) for r in ordered.with_neighbours(d, "k", "a", "b").collect()}
    assert all(n[k] == (s[i + 1] if i + 1 < len(s) else None, s[i - 1] if i else None) for i, k in enumerate(s))


def test_nothing(spark):
    d = spark.createDataFrame([], "k string")
    assert ordered.with_rank(d, "k", "r").count() == 0
    assert ordered.nearest(spark.createDataFrame([("a",)], "p string"), d, "p", "k", "ge").collect()[0]["k"] is None


def test_batch_faults_in_order(spark):
    d = spark.createDataFrame([(0, 5), (1, 6), (2, 6), (3, 4)], "i long, seq long")
    assert M.batch_faults(d, "i").first()[0] == 2


def test_arrival_order(spark, many_parts):
    d = spark.range(0, 500, 1, 7).withColumn("key", F.lit("same"))
    got = ordered.with_arrival(d, "at").collect()
    assert sorted((r["at"], r["id"]) for r in got) == [(i, i) for i in range(500)]
    twice = ordered.with_rank(d, ["key", "id"], "r").collect()
    assert all(r["r"] == r["id"] for r in twice)
