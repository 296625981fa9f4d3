"""Queries for reports and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import metrics as M
from vitrine.operators import serving
from vitrine.plans.common import table
from vitrine.plans.evaluation import _DRAWN, CLOSED, REPLICATES, _groups, _ndcg


def seeded_baseline(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "examples").select("query_id", "product_id").distinct()
    return serving.seeded_baseline(pairs, "query_id", "product_id").withColumn("random_score", F.round("random_score", 9))


def negative_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Stages whose gain in NDCG over BM25 is not positive, or not surely."""
    rows = _ndcg(spark, sf)
    wide = rows.groupBy("query_id", "cutoff").pivot("stage", ["bm25", "dense", "rrf"]).agg(F.first("ndcg"))
    long = wide.selectExpr("query_id", "cutoff", "stack(2, 'dense', dense - bm25, 'rrf', rrf - bm25) AS (stage, delta)")
    ci = M.bootstrap(long.join(_groups(spark, sf).select("query_id", "group_key"), "query_id"), ["stage", "cutoff"], "group_key", "delta", REPLICATES)
    return serving.negative_findings(ci).select("stage", "cutoff", "finding")


def brand_share(spark: SparkSession, sf: str) -> DataFrame:
    """Listings and share of each normalised brand, and its part of the Herfindahl index."""
    counted = table(spark, sf, "products").filter("normalized_brand IS NOT NULL").groupBy("normalized_brand").agg(F.count(F.lit(1)).alias("listings"))
    total = counted.agg(F.sum("listings").alias("_n"))
    return counted.crossJoin(F.broadcast(total)).select("normalized_brand", "listings", F.round(F.col("listings") / F.col("_n"), 9).alias("share"), F.round(F.pow(F.col("listings") / F.col("_n"), 2), 12).alias("hhi_part"))  # one row


QUERIES = {f.__name__: f for f in (seeded_baseline, negative_findings, brand_share)}
SQL = {
    "seeded_baseline": "SELECT query_id, product_id, round(('0x' || substr(sha256('42' || chr(0) || query_id || chr(0) || product_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE, 9) AS random_score FROM (SELECT DISTINCT query_id, product_id FROM examples)",
    "negative_findings": f"""WITH {CLOSED}, dl AS (SELECT a.query_id, a.cutoff, a.stage, a.ndcg - b.ndcg AS delta FROM ndcg a JOIN ndcg b USING (query_id, cutoff) WHERE b.stage = 'bm25' AND a.stage <> 'bm25'),
bg AS (SELECT stage, cutoff, group_key, sum(delta) AS s, count(*) AS n FROM dl JOIN grp USING (query_id) GROUP BY ALL), {_DRAWN},
sz AS (SELECT stage, cutoff, sum(s) / sum(n) AS mean FROM bg GROUP BY ALL),
ci AS (SELECT stage, cutoff, any_value(mean) AS mean, quantile_cont(e, 0.025) AS lower FROM est JOIN sz USING (stage, cutoff) GROUP BY stage, cutoff)
SELECT stage, cutoff, CASE WHEN mean <= 0 THEN 'no_mean_gain' ELSE 'interval_reaches_zero' END AS finding FROM ci WHERE mean <= 0 OR lower <= 0""",
    "brand_share": "WITH c AS (SELECT normalized_brand, count(*) AS listings FROM products WHERE normalized_brand IS NOT NULL GROUP BY ALL), t AS (SELECT sum(listings)::DOUBLE AS n FROM c) SELECT normalized_brand, listings, round(listings / n, 9) AS share, round(pow(listings / n, 2), 12) AS hhi_part FROM c, t",
}
