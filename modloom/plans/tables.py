"""Intermediate tables: plans are cut by writing Parquet to the folder all executors share, so that lost executors cost no lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Folders written and not yet deleted.
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); one of our own only where that is unset. What
    is left of it is deleted when the driver's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/modloom-checkpoints"  # one machine: every folder is shared
    path = f"{base.rstrip('/')}/modloom-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_delete_rest)
    _WRITTEN.add(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._modloom_path = path
    return out


def materialise_by(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """materialise in n buckets of a key, if not given as many as shuffle partitions: joins and sums by the key then move no row of the table."""
    spark = df.sparkSession
    path, n = shared_dir(spark), n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"modloom_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).mode("overwrite").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._modloom_path, out._modloom_name = path, name
    return out


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is executed inside deletes its shuffle files when it ends, not only when the driver collects garbage. For plans that
    share no shuffle with another one."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialise() that nothing will read again: what was made from them is itself written."""
    for t in tables:
        if hasattr(t, "_modloom_name"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._modloom_name}")
        sc = t.sparkSession.sparkContext
        delete(t._modloom_path, sc._jsc.hadoopConfiguration())


def delete(path: str, conf=None) -> None:
    jvm = SparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf or jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
    _WRITTEN.discard(path)


def _delete_rest() -> None:
    """Results that were still to be read when they were returned."""
    for path in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the JVM may have ended before
            delete(path)
