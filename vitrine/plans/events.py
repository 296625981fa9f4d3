"""Queries over the events table, with the functions that also run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.plans.common import table
from vitrine.streaming import events as E


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return E.windowed(table(spark, sf, "events")).withColumns({"window_start": F.col("window_start").cast("string"), "value_sum": F.round("value_sum", 4)})


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return E.sessions(table(spark, sf, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"))


QUERIES = {"event_windows": event_windows, "event_sessions": event_sessions}
SQL = {
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value_sum FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events)
SELECT user_id, CAST(sum(opens) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY user_id""",
}
