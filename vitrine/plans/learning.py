"""Queries over training populations, rankers, search modes and list metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import tokens_sql
from vitrine.operators import features as X
from vitrine.operators import foundation as B
from vitrine.operators import ltr as L
from vitrine.operators import search as S
from vitrine.operators.skewjoin import shuffled
from vitrine.plans.common import table
from vitrine.plans.evaluation import CLOSED, closed_matrix
from vitrine.plans.retrieval import rrf_hybrid
from vitrine.plans.understanding import feature_matrix
from vitrine.scratch import materialize

FEATURES = list(X.feature_sql(X.Dialect()))


def training_population_audit(spark: SparkSession, sf: str) -> DataFrame:
    kept, audit = L.training_population(closed_matrix(spark, sf))
    return audit.groupBy(F.coalesce("excluded", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("queries"), F.sum("rows").alias("pairs"))


def lambda_gradients(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = L.training_population(closed_matrix(spark, sf))
    out = L.lambda_gradients(kept.select("query_id", "product_id", "gain", F.col("dense").alias("score")))
    return out.select("query_id", "product_id", F.round("lambda", 6).alias("lambda"), F.round("hessian", 6).alias("hessian"))


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training, validation, all held-out) rows of the matrix."""
    rows = materialize(feature_matrix(spark, sf), "matrix")
    held = B.assign_splits(table(spark, sf, "query_records")).select("query_id", "project_split")
    rows = materialize(rows.join(shuffled(held), "query_id"), "splits")
    train, _ = L.training_population(rows.filter("project_split = 'train'"))
    validation, _ = L.training_population(rows.filter("project_split = 'validation'"))
    return train.drop("project_split"), validation.drop("project_split"), rows.filter("project_split <> 'train'").drop("project_split")


def _ranked(df: DataFrame) -> DataFrame:
    from vitrine.operators.grouprank import row_number

    rows = materialize(df.select("query_id", "product_id", "label_id", "score"), "scored")
    return row_number(rows, ["query_id"], [F.round("score", 9).desc(), F.col("product_id")], "rank").withColumn("score", F.round("score", 6))


def pointwise_gbt_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out pairs ranked by a regression of the label: up to 300 rounds, stopped after 30 without gain on validation."""
    train, validation, held = _split(spark, sf)
    return _ranked(L.predict(L.fit_pointwise(train, validation, FEATURES), held, FEATURES))


def lambdamart_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out pairs ranked by LambdaMART with the same settings."""
    train, validation, held = _split(spark, sf)
    return _ranked(L.predict(L.fit_lambdamart(train, validation, FEATURES), held, FEATURES))


def ranker_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Gain and number of splits of every feature in the LambdaMART ranker."""
    train, validation, _ = _split(spark, sf)
    return spark.createDataFrame(L.importance(L.fit_lambdamart(train, validation, FEATURES), FEATURES), "feature string, gain double, splits int")


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(S.search_modes(rrf_hybrid(spark, sf), table(spark, sf, "predictions")), "found")


def search_modes(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf)


def mode_rank_changes(spark: SparkSession, sf: str) -> DataFrame:
    return S.rank_changes(_found(spark, sf)).select("query_id", "mode", "product_id", "rank", "rank_change")


def list_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = S.list_metrics(_found(spark, sf), table(spark, sf, "products"))
    return out.withColumns({c: F.round(c, 6) for c in ("brand_entropy", "brand_concentration")})


def title_ild(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.coalesce(F.expr(tokens_sql("title")), F.array().cast("array<string>")))
    out = S.title_diversity(_found(spark, sf), table(spark, sf, "products").select("product_id", words.alias("tokens")))
    return out.withColumn("title_distance", F.round("title_distance", 6))


def display_hits(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_products(_found(spark, sf).filter("mode = 'active'"), table(spark, sf, "products")).select("query_id", "rank", "product_id", "title", "snippet", "missing_product")


QUERIES = {
    f.__name__: f
    for f in (training_population_audit, lambda_gradients, pointwise_gbt_scores, lambdamart_scores, ranker_importance, search_modes, mode_rank_changes, list_metrics, title_ild, display_hits)
}

_FOUND = """
m AS (SELECT query_id, product_id, min(sparse_rank) AS s, min(dense_rank) AS d FROM candidates GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(1.0::DOUBLE / (60 + s), 0) + coalesce(1.0::DOUBLE / (60 + d), 0), 9) DESC, least(s, d), product_id) AS h FROM m WHERE coalesce(s, d) IS NOT NULL QUALIFY h <= 200),
sc AS (SELECT query_id, product_id, max(score) FILTER (WHERE model_id = 'pointwise') AS pw, max(score) FILTER (WHERE model_id = 'lambdamart') AS lm FROM predictions WHERE score IS NOT NULL AND CAST(score AS VARCHAR) <> 'nan' GROUP BY ALL),
j AS (SELECT f.*, pw, lm FROM fused f LEFT JOIN sc USING (query_id, product_id)),
longm AS (SELECT query_id, product_id, h, 'active' AS mode, lm AS k, 'ranker_unavailable' AS reason, 'lambdamart' AS st FROM j UNION ALL SELECT query_id, product_id, h, 'bm25', -s, 'sparse_unavailable', 'bm25' FROM j
  UNION ALL SELECT query_id, product_id, h, 'dense', -d, 'dense_unavailable', 'dense' FROM j UNION ALL SELECT query_id, product_id, h, 'hybrid', -h, 'fusion_unavailable', 'hybrid' FROM j
  UNION ALL SELECT query_id, product_id, h, 'pointwise', pw, 'ranker_unavailable', 'pointwise' FROM j UNION ALL SELECT query_id, product_id, h, 'lambdamart', lm, 'ranker_unavailable', 'lambdamart' FROM j),
hs AS (SELECT *, count(k) OVER (PARTITION BY query_id, mode) > 0 AS has FROM longm),
found AS MATERIALIZED (SELECT query_id, mode, product_id, CAST(row_number() OVER (PARTITION BY query_id, mode ORDER BY round(CASE WHEN has THEN k ELSE -h END, 9) DESC, h, product_id) AS INTEGER) AS rank,
  CASE WHEN has THEN st ELSE 'hybrid' END AS stage, CASE WHEN NOT has THEN reason END AS fallback FROM hs WHERE NOT has OR k IS NOT NULL QUALIFY rank <= 10)"""
SQL = {
    "training_population_audit": f"""WITH {CLOSED}, a AS (SELECT query_id, count(*) AS n, count(DISTINCT label_id) AS l FROM pool GROUP BY query_id)
SELECT CASE WHEN n < 2 THEN 'too_few_rows' WHEN l < 2 THEN 'single_label' ELSE 'kept' END AS outcome, count(*) AS queries, CAST(sum(n) AS BIGINT) AS pairs FROM a GROUP BY ALL""",
    "lambda_gradients": f"""WITH {CLOSED}, k AS (SELECT query_id FROM pool GROUP BY query_id HAVING count(*) >= 2 AND count(DISTINCT label_id) >= 2),
rk AS (SELECT query_id, product_id, gain, dense AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, product_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, product_id) AS ri FROM pool SEMI JOIN k USING (query_id)),
ic AS (SELECT query_id, sum(gain / log2(ri + 1)) AS idcg FROM rk GROUP BY query_id HAVING sum(gain / log2(ri + 1)) > 0),
pr AS (SELECT a.query_id, a.product_id, CASE WHEN a.gain > b.gain THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg, abs(a.gain - b.gain) * abs(1.0::DOUBLE / log2(a.r + 1) - 1.0::DOUBLE / log2(b.r + 1)) / idcg AS ch, a.score - b.score AS ds
  FROM rk a JOIN rk b ON a.query_id = b.query_id AND a.gain <> b.gain AND least(a.r, b.r) <= 30 JOIN ic ON ic.query_id = a.query_id),
gr AS (SELECT query_id, product_id, sum(sg * ch / (1 + exp(sg * ds))) AS l, sum(ch / (1 + exp(sg * ds)) * (1 - 1 / (1 + exp(sg * ds)))) AS h FROM pr GROUP BY ALL)
SELECT query_id, product_id, round(coalesce(l, 0), 6) AS lambda, round(coalesce(h, 0), 6) AS hessian FROM rk LEFT JOIN gr USING (query_id, product_id)""",
    "search_modes": f"WITH {_FOUND} SELECT query_id, mode, product_id, rank, stage, fallback FROM found",
    "mode_rank_changes": f"WITH {_FOUND} , base AS (SELECT query_id, product_id, rank AS b FROM found WHERE mode = 'hybrid') SELECT f.query_id, f.mode, f.product_id, f.rank, b - f.rank AS rank_change FROM found f LEFT JOIN base USING (query_id, product_id)",
    "list_metrics": f"""WITH {_FOUND}, n AS (SELECT query_id, mode, normalized_brand AS b, count(*) AS n FROM found LEFT JOIN products USING (product_id) GROUP BY ALL), t AS (SELECT query_id, mode, sum(n) FILTER (WHERE b IS NOT NULL) AS t FROM n GROUP BY ALL)
SELECT query_id, mode, round(coalesce(-sum((n / t) * log2(n / t)) FILTER (WHERE b IS NOT NULL), 0), 6) + 0.0 AS brand_entropy, round(coalesce(max(n) FILTER (WHERE b IS NOT NULL) / any_value(t), 0), 6) AS brand_concentration,
  count(b) AS distinct_brands, CAST(coalesce(sum(n) FILTER (WHERE b IS NULL), 0) AS BIGINT) AS missing_brands FROM n JOIN t USING (query_id, mode) GROUP BY query_id, mode""",
    "title_ild": f"""WITH {_FOUND}, w AS (SELECT query_id, mode, rank, list_distinct(coalesce({tokens_sql("title", False)}, [])) AS a FROM found JOIN products USING (product_id))
SELECT x.query_id, x.mode, round(avg(CASE WHEN len(list_distinct(list_concat(x.a, y.a))) > 0 THEN 1 - len(list_intersect(x.a, y.a))::DOUBLE / len(list_distinct(list_concat(x.a, y.a))) ELSE 0 END), 6) AS title_distance
FROM w x JOIN w y ON x.query_id = y.query_id AND x.mode = y.mode AND x.rank < y.rank GROUP BY ALL""",
    "display_hits": f"WITH {_FOUND} SELECT query_id, rank, product_id, title, CASE WHEN p.product_id IS NOT NULL THEN substr(coalesce(description, ''), 1, 240) END AS snippet, p.product_id IS NULL AS missing_product FROM found f LEFT JOIN products p USING (product_id) WHERE mode = 'active'",
}
