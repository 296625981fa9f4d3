"""Shared pieces of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Judgments collapsed to one row per pair, as SQL for the oracle.
JUDGED = """
judged AS (SELECT query_id, product_locale, product_id, min(example_id) AS example_id, count(*) AS duplicate_count, min(esci_label) AS esci_label,
  count(DISTINCT esci_label) > 1 AS conflict FROM examples GROUP BY query_id, product_locale, product_id)"""

GAIN = "CASE esci_label WHEN 'E' THEN 1.0::DOUBLE WHEN 'S' THEN 0.1::DOUBLE WHEN 'C' THEN 0.01::DOUBLE WHEN 'I' THEN 0.0::DOUBLE END"
LABEL = "CASE esci_label WHEN 'E' THEN 3 WHEN 'S' THEN 2 WHEN 'C' THEN 1 WHEN 'I' THEN 0 END"
