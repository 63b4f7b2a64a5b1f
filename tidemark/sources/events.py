"""The test tables reinterpreted as a changelog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log: errors delete, signups are commands, the rest insert."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.when(kind == "error", 1).when(kind == "signup", 2).otherwise(0).alias("type"),
        user_key(F.col("user_id")).alias("key"),
        F.col("props").alias("meta"),
        F.when(kind != "error", F.col("value")).alias("value"),
    )


def user_key(c):
    return F.concat(F.lit("user"), F.lpad(c.cast("string"), 6, "0"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_custkey") < 300)
    return c.select(user_key(F.col("c_custkey")).alias("k")).distinct()
