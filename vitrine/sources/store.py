"""A product store for lookups by key: bucketed Parquet, and joins that notice what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ProductStore:
    """Rows laid out by a hash of their key, so that a lookup of a few keys reads a few files."""

    def __init__(self, spark: SparkSession, path: str, key: str = "product_id", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self, col: str):
        return F.pmod(F.xxhash64(col), F.lit(self.buckets)).cast("int")

    def build(self, products: DataFrame) -> None:
        """Write the store; keys must be unique."""
        if not products.groupBy(self.key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{self.key} is not unique")
        rows = products.withColumn("_bucket", self._bucket(self.key))
        rows.repartition("_bucket").sortWithinPartitions(self.key).write.mode("errorifexists").option("compression", "zstd").partitionBy("_bucket").parquet(self.path)

    def fetch(self, keys: Sequence[str]) -> DataFrame:
        """The rows of ``keys``, which must all exist; only their buckets are read."""
        wanted = self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], f"{self.key} string")
        buckets = [r[0] for r in wanted.select(self._bucket(self.key)).distinct().collect()]
        rows = self.spark.read.parquet(self.path).filter(F.col("_bucket").isin(buckets)).drop("_bucket")
        found = wanted.join(rows, self.key, "left_semi")
        lost = wanted.join(found, self.key, "left_anti").limit(5).collect()
        if lost:
            raise KeyError(f"not in the store: {', '.join(r[0] for r in lost)}")
        return rows.join(wanted, self.key, "left_semi")

    def lookup(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows joined with the store, rows whose key it lacks) for a table of any size."""
        store = self.spark.read.parquet(self.path).drop("_bucket")
        return rows.join(store, self.key), rows.join(store.select(self.key), self.key, "left_anti")
