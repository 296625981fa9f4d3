"""Tables derived from others, built once and read by every query that needs them.

A derived table lies in the shared folder under a name made of what it is and of the path, length and time of
every file it comes from, so changed inputs give another table. It appears by one rename.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from vitrine.scratch import _delete_on_exit, _fs, shared_dir


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A hash of path, length and modification time of every file below ``paths``."""
    seen = hashlib.sha256()
    for path in paths:
        p, fs = _fs(spark, path)
        files = fs.listFiles(p, True)
        rows = []
        while files.hasNext():
            status = files.next()
            rows.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
        seen.update("\n".join(sorted(rows)).encode())
    return seen.hexdigest()


def derived(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame], bucket_by: str | None = None, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """The table ``name`` of ``inputs``: read if it is there, else built, written (by ``write`` if it is given) and read.
    It is removed with the session."""
    place = f"{shared_dir(spark)}/vitrine-{name}-{fingerprint(spark, inputs)[:24]}"
    target, fs = _fs(spark, place)
    if not fs.exists(target):
        draft = f"{shared_dir(spark)}/vitrine-draft-{uuid.uuid4().hex}"
        df = build()
        if bucket_by:
            df = df.repartition(bucket_by).sortWithinPartitions(bucket_by)
        if write:
            write(df, draft)
        else:
            df.write.option("compression", "zstd").parquet(draft)
        source, _ = _fs(spark, draft)
        if not fs.exists(target):
            fs.rename(source, target)
        else:
            fs.delete(source, True)
        _delete_on_exit(spark, place)
    return spark.read.parquet(place)
