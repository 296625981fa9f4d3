"""Durable intermediate tables in the folder that all executors share.

A lineage is cut by writing a table there, never by ``localCheckpoint``: a lost executor then costs a
re-read, not the job. The folder is the session's ``spark.checkpoint.dir``. Only a local session that
has none gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_KEY = "spark.vitrine.scratch.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as the cluster names it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get(_OWN_KEY, None)
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="vitrine-")
    _delete_on_exit(spark, own)
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set(_OWN_KEY, own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is removed when the session ends."""
    path = f"{shared_dir(spark)}/vitrine-{label}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def materialize(df: DataFrame, label: str = "table", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return the read of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, path: str) -> str:
    """Write ``df`` as the next version below ``path``: first beside it, then in place by one rename."""
    spark = df.sparkSession
    draft = f"{path.rstrip('/')}/_draft-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(draft)
    place = f"{path.rstrip('/')}/version-{len(versions(spark, path)):06d}"
    src, fs = _fs(spark, draft)
    dst, _ = _fs(spark, place)
    if fs.exists(dst) or not fs.rename(src, dst):
        raise FileExistsError(f"{place} appeared meanwhile")
    return place


def versions(spark: SparkSession, path: str) -> list[str]:
    """The published versions below ``path``, oldest first."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("version-"))


def remove(spark: SparkSession, path: str) -> None:
    """Drop a scratch path before the session ends."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.deleteOnExit(p)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for work that is heavy per row.

    A scan of many files stays as it is; a few files, which one task each would read, are dealt out by round robin.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
