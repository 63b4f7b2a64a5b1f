"""The folder all machines share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes that Spark hands to Python at once within ``small_batches``; a longer row goes alone.
BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set.

    A machine-local folder would lose data with its machine, so outside of local mode
    an unset folder is an error. The path comes back with its scheme, so that every
    reader takes it for the same place.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return qualified(spark, named.rstrip("/"))
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    atexit.register(lambda: __import__("shutil").rmtree(own[7:], ignore_errors=True))
    sc.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system and path objects of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Hadoop's configuration gives it."""
    fs, p = hadoop(spark, path)
    return fs.makeQualified(p).toString()


def arrow_folder(path: str):
    """Arrow's file system and path of a qualified path, for work on executors.

    Hadoop writes ``file:/x`` and ``s3a://``, Arrow ``file:///x`` and ``s3://``. A path
    without a scheme is an error: it could mean the executor's own disk.
    """
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{path} has no scheme")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """What still lies there is removed when the driver ends."""
    fs, p = hadoop(spark, path)
    fs.deleteOnExit(p)


def written(df: DataFrame, name: str, by: list[str] | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, and where it is.

    A lost executor costs a re-read, never a recomputation of what came before. The
    caller removes the folder once nothing reads it; the driver's end removes the rest.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH) -> Iterator[None]:
    """What runs within it hands at most about ``limit`` bytes to Python at a time.

    Spark's own limit is 64 MB, which a task holds several times over, in the JVM beside
    its heap and in Python. A smaller limit that the session has set stays; the session's
    setting comes back at the end, so what is only planned within isn't bounded.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, now = spark.conf.get(name, None), spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= limit:
        spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
