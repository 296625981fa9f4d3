"""Table sources: Parquet, CSV with a declared schema, JSON lines and whole files with checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """A file, folder, glob or list of them; only ``columns`` are read if given."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header. The schema is declared; a row that does not fit it is an error, not a null."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checksums(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """``path``, ``bytes``, ``sha256`` of every file below ``path``, hashed where the files are read, a chunk at a time."""
    # the contents are not among the selected columns, so this reads only the listing
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))

    def run(batches):
        import hashlib
        import re

        import pyarrow as pa
        import pyarrow.fs as pafs

        for batch in batches:
            digests = []
            for uri in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri)))
                seen = hashlib.sha256()
                with fs.open_input_stream(at) as source:
                    while block := source.read(chunk):
                        seen.update(block)
                digests.append(seen.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])

    return files.repartitionByRange(max(1, min(10_000, files.count())), "path").mapInArrow(run, "path string, bytes bigint, sha256 string")
