"""Queries over query understanding and ranking features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.hashing import hash_key
from vitrine.functions.text import tokens_sql
from vitrine.operators import features as X
from vitrine.operators import foundation as B
from vitrine.operators import fusion
from vitrine.operators import understand as U
from vitrine.operators import validate as V
from vitrine.operators.skewjoin import shuffled
from vitrine.plans.common import JUDGED, table
from vitrine.plans.evaluation import _FUSED, CLOSED, closed_matrix, closed_sql, pair_scores
from vitrine.plans.foundation import _CLEANED
from vitrine.plans.parsing import ENTITIES, PARSED, digest_sql, parsed_queries
from vitrine.plans.retrieval import rrf_hybrid, specificity
from vitrine.scratch import materialize, spread
from vitrine.sources.derived import derived


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "query_records").select("query_id", "query")


def query_parse_tokens(spark: SparkSession, sf: str) -> DataFrame:
    out = U.parse_tokens(_queries(spark, sf), "query_id", "query")
    lists = ("tokens", "numbers", "units", "measurements", "models", "compatibility", "compatibility_phrases", "negations")
    return out.select("query_id", "normalized", *[F.array_join(c, "|").alias(c) for c in lists], "problem")


def stopword_reduction(spark: SparkSession, sf: str) -> DataFrame:
    out = U.parse_tokens(_queries(spark, sf), "query_id", "query")
    return out.select("query_id", F.array_join("reduced", " ").alias("reduced"), F.size("tokens").alias("tokens_before"), F.size("reduced").alias("tokens_after"))


def entity_longest_match(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_queries(spark, sf).filter("brand IS NOT NULL").select("query_id", "brand")


def color_alias(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_queries(spark, sf).filter("color IS NOT NULL").select("query_id", "color", "color_source", "color_confidence")


def parsed_query_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical hash of each parsed query with the state of the parser."""
    good = parsed_queries(spark, sf).filter("problem IS NULL")
    return U.query_hash(good, "query_id", U.parser_state(table(spark, sf, "products")))


def _train_products(spark: SparkSession, sf: str) -> DataFrame:
    train = B.assign_splits(table(spark, sf, "query_records")).filter("project_split = 'train'").select("query_id")
    keys = B.collapse_judgments(table(spark, sf, "examples")).join(shuffled(train), "query_id", "left_semi").select("product_id").distinct()
    return table(spark, sf, "products").join(shuffled(keys), "product_id", "left_semi")


def category_codes_train_only(spark: SparkSession, sf: str) -> DataFrame:
    fit = materialize(_train_products(spark, sf).select("normalized_brand", "normalized_color"), "train")
    products = table(spark, sf, "products").select("product_id", "normalized_brand", "normalized_color")
    coded = X.with_code(products, X.category_codes(fit, "normalized_brand"), "normalized_brand", "brand_code")
    return X.with_code(coded, X.category_codes(fit, "normalized_color"), "normalized_color", "color_code").select("product_id", "brand_code", "color_code")


def _view(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned products with their token lists and category codes, built once."""
    inputs = [f"{sf}/{t}.parquet" for t in ("products", "examples", "query_records")]
    return derived(spark, "view", inputs, lambda: X.product_view(B.clean_products(spread(table(spark, sf, "products")))).join(shuffled(category_codes_train_only(spark, sf)), "product_id").drop("locale"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    parts = parsed_queries(spark, sf).select(
        "query_id",
        F.coalesce("normalized", F.lit("")).alias("q_text"),
        F.col("tokens").alias("q_tokens"),
        F.col("models").alias("q_models"),
        F.col("compatibility").alias("q_compatibility"),
        F.col("brand").alias("q_brand"),
        F.col("color").alias("q_color"),
        F.col("color_confidence").alias("q_color_confidence"),
    )
    return parts.join(shuffled(specificity(spark, sf)), "query_id")


def _features(spark: SparkSession, sf: str, pool: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the 44 features of scored pairs of usable text."""
    pool = fusion.rank_fractions(pool, ["query_id"], {"bm25": "bm25_fraction", "dense": "dense_fraction", "rrf": "rrf_fraction"}, "product_id")
    return X.compute(pool.join(shuffled(_asked(spark, sf)), "query_id").join(shuffled(_view(spark, sf)), "product_id"), keys)


def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, product_id, label_id, gain and the 44 features of every judged pair of usable text."""
    return _features(spark, sf, closed_matrix(spark, sf), ["query_id", "product_id", "label_id", "gain"])


def _shown(out: DataFrame, keys: list[str]) -> DataFrame:
    return out.select(*keys, *[(F.round(c, 5) + 0.0).alias(c) for c in out.columns if c not in keys])


def ltr_features(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(feature_matrix(spark, sf).drop("label_id", "gain"), ["query_id", "product_id"])


def candidate_features(spark: SparkSession, sf: str) -> DataFrame:
    """The 44 features of every fused candidate, without labels, and its fused rank and score."""
    fused = rrf_hybrid(spark, sf).select("query_id", "product_id", F.col("rank").alias("hybrid_rank"), F.col("rrf").alias("hybrid_rrf"))
    keys = ["query_id", "product_id", "hybrid_rank", "hybrid_rrf"]
    return _shown(_features(spark, sf, pair_scores(spark, sf, materialize(fused, "fused")), keys), keys)


def feature_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, nulls, mean, deviation and range of each of the 44 features over all judged pairs."""
    out = V.distribution(feature_matrix(spark, sf), list(X.feature_sql(X.Dialect())))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std_pop", "minimum", "maximum")})


def feature_row_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Parity hash of all 44 features of every pair, in hundred-thousandths."""
    out = feature_matrix(spark, sf)
    text = F.concat_ws(",", *[F.round(F.round(n, 5) * 100_000).cast("bigint").cast("string") for n in X.feature_sql(X.Dialect())])
    return out.select("query_id", "product_id", hash_key(text).alias("row_sha256"))


def leakage_report(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that would give the label away, and whether the feature matrix has them."""
    rows = X.leakage_report(list(X.feature_sql(X.Dialect())))
    return spark.createDataFrame(rows, "prohibited string, present boolean")


QUERIES = {
    f.__name__: f
    for f in (query_parse_tokens, stopword_reduction, entity_longest_match, color_alias, parsed_query_hash, category_codes_train_only, ltr_features, candidate_features, feature_distribution, feature_row_hash, leakage_report)
}


_TRAIN = f"""{JUDGED}, kq AS (SELECT query_id, official_split, coalesce(normalized_query_sha256, 'q:' || query_id) AS group_key FROM query_records),
mx AS (SELECT group_key FROM kq GROUP BY group_key HAVING count(DISTINCT official_split) > 1),
tr AS (SELECT query_id FROM kq WHERE official_split = 'train' AND group_key NOT IN (SELECT group_key FROM mx)
  AND ('0x' || substr(sha256('split-v1' || chr(0) || '42' || chr(0) || 'us' || chr(0) || group_key), 1, 16))::UBIGINT % 10000 < 8500),
fit AS (SELECT * FROM products WHERE product_id IN (SELECT product_id FROM judged WHERE query_id IN (SELECT query_id FROM tr))),
bc AS (SELECT v, row_number() OVER (ORDER BY v) + 1 AS code FROM (SELECT DISTINCT normalized_brand AS v FROM fit WHERE normalized_brand IS NOT NULL)),
cc AS (SELECT v, row_number() OVER (ORDER BY v) + 1 AS code FROM (SELECT DISTINCT normalized_color AS v FROM fit WHERE normalized_color IS NOT NULL))"""
_CODES = "CASE WHEN {p}.normalized_brand IS NULL THEN 0 ELSE coalesce(bc.code, 1) END AS brand_code, CASE WHEN {p}.normalized_color IS NULL THEN 0 ELSE coalesce(cc.code, 1) END AS color_code"


def _features_sql(closed: str = CLOSED, extra: str = "", shown: str = "", raw: bool = False) -> str:
    d = X.Dialect(False)
    whole = "concat_ws(' ', clean_title, clean_brand, clean_color, clean_bullets, clean_description)"
    names = X.feature_sql(d)
    tokens = ", ".join(f"{tokens_sql(x, False)} AS {n}" for x, n in (("clean_title", "t_tokens"), ("clean_description", "d_tokens"), ("clean_bullets", "b_tokens"), (whole, "p_tokens")))
    rank = lambda s: f"((row_number() OVER (PARTITION BY query_id ORDER BY round({s}, 9) DESC, product_id) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY query_id) - 1, 1))::FLOAT"
    return f"""WITH {closed}, {ENTITIES}, {_TRAIN.replace(JUDGED + ',', '').strip()}, {_CLEANED.replace('docs AS', 'docs9 AS')},
fr AS (SELECT query_id, product_id, bm25, dense, rrf, {rank('bm25')} AS bm25_fraction, {rank('dense')} AS dense_fraction, {rank('rrf')} AS rrf_fraction FROM pool),
vw0 AS (SELECT *, {tokens} FROM c2), vw AS (SELECT vw0.*, {X.models_sql('p_tokens', d)} AS p_models, r.normalized_brand AS raw_brand, r.normalized_color AS raw_color FROM vw0 JOIN products r USING (product_id)),
sp AS (SELECT query_id, coalesce(avg(idf), 0) AS specificity FROM query_records LEFT JOIN asked USING (query_id) LEFT JOIN rated USING (term) GROUP BY query_id),
rows AS (SELECT fr.*, coalesce(pq.normalized, '') AS q_text, pq.tokens AS q_tokens, pq.models AS q_models, pq.compatibility AS q_compatibility, b.brand AS q_brand, coalesce(c.color, a.color) AS q_color,
  CASE WHEN c.color IS NOT NULL THEN 1.0 WHEN a.color IS NOT NULL THEN 0.9 ELSE 0.0 END AS q_color_confidence, specificity, vw.* EXCLUDE (product_id),
  CASE WHEN raw_brand IS NULL THEN 0 ELSE coalesce(bc.code, 1) END AS brand_code, CASE WHEN raw_color IS NULL THEN 0 ELSE coalesce(cc.code, 1) END AS color_code
  FROM fr JOIN pq USING (query_id) JOIN sp USING (query_id) JOIN vw USING (product_id) LEFT JOIN brand_hit b USING (query_id) LEFT JOIN color_hit c USING (query_id) LEFT JOIN alias_hit a USING (query_id)
  LEFT JOIN bc ON bc.v = raw_brand LEFT JOIN cc ON cc.v = raw_color)
SELECT query_id, product_id, {shown}{", ".join((f"CAST({x} AS DOUBLE) AS {n}" if raw else f"round(CAST({x} AS DOUBLE), 5) + 0.0 AS {n}") for n, x in names.items())} FROM rows{extra}"""


def _parsed_hash_sql() -> str:
    from vitrine.sources.sinks import json_digest

    state = f"""sha256('{{"brands":"' || (SELECT digest FROM nm_digest WHERE kind = 'brands') || '","color_aliases":"{json_digest(U.COLOR_ALIASES)}","colors":"' || (SELECT digest FROM nm_digest WHERE kind = 'colors')
  || '","parser_version":"{U.PARSER_VERSION}","spelling_aliases":"{json_digest(U.SPELLING)}"}}')"""
    return f"""WITH {PARSED}, nm AS (SELECT DISTINCT 'brands' AS kind, normalized_brand AS value FROM products WHERE length(normalized_brand) >= 2 UNION SELECT 'colors', normalized_color FROM products WHERE normalized_color <> ''),
{digest_sql("nm", "kind", "value")}, st AS (SELECT {state} AS state)
SELECT query_id, sha256('{{"normalized_text":' || CAST(to_json(normalized) AS VARCHAR) || ',"parser_state_sha256":"' || state || '","parser_version":"{U.PARSER_VERSION}"}}') AS query_sha256 FROM pq, st WHERE problem IS NULL"""


SQL = {
    "query_parse_tokens": f"""WITH {PARSED} SELECT query_id, normalized, array_to_string(tokens, '|') AS tokens, array_to_string(plain_numbers, '|') AS numbers, array_to_string(units, '|') AS units, array_to_string(measurements, '|') AS measurements,
  array_to_string(models, '|') AS models, array_to_string(compatibility, '|') AS compatibility, array_to_string(compatibility_phrases, '|') AS compatibility_phrases, array_to_string(negations, '|') AS negations, problem FROM pq""",
    "stopword_reduction": f"WITH {PARSED} SELECT query_id, array_to_string(CASE WHEN len(kept) = 0 THEN tokens ELSE kept END, ' ') AS reduced, CAST(len(tokens) AS INTEGER) AS tokens_before, CAST(CASE WHEN len(kept) = 0 THEN len(tokens) ELSE len(kept) END AS INTEGER) AS tokens_after FROM pq",
    "entity_longest_match": f"WITH {ENTITIES} SELECT query_id, brand FROM brand_hit",
    "color_alias": f"""WITH {ENTITIES} SELECT query_id, coalesce(c.color, a.color) AS color, CASE WHEN c.color IS NOT NULL THEN 'catalog' ELSE 'alias' END AS color_source, CASE WHEN c.color IS NOT NULL THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS color_confidence
FROM color_hit c FULL JOIN alias_hit a USING (query_id)""",
    "parsed_query_hash": _parsed_hash_sql(),
    "category_codes_train_only": f"WITH {_TRAIN} SELECT p.product_id, CAST(b AS INTEGER) AS brand_code, CAST(c AS INTEGER) AS color_code FROM (SELECT p.product_id, {_CODES.format(p='p').replace('brand_code', 'b').replace('color_code', 'c')} FROM products p LEFT JOIN bc ON bc.v = p.normalized_brand LEFT JOIN cc ON cc.v = p.normalized_color) p",
    "ltr_features": _features_sql(),
    "candidate_features": _features_sql(
        closed_sql(f"{JUDGED}, {_FUSED}, hy AS (SELECT query_id, product_id, rank AS hybrid_rank, rrf AS hybrid_rrf FROM listed), lab AS (SELECT query_id, product_id, NULL::INTEGER AS label_id, NULL::DOUBLE AS gain FROM hy)"),
        " JOIN hy USING (query_id, product_id)",
        "CAST(hybrid_rank AS INTEGER) AS hybrid_rank, round(hybrid_rrf, 5) AS hybrid_rrf, ",
    ).replace("round(hybrid_rrf, 5)", "round(hybrid_rrf, 9)"),
    "feature_distribution": f"WITH f AS MATERIALIZED ({_features_sql(raw=True)}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS row_count, count(*) - count({c}) AS nulls, round(avg({c}), 4) AS mean, round(coalesce(stddev_pop({c}), 0), 4) AS std_pop, round(min({c}), 4) AS minimum, round(max({c}), 4) AS maximum FROM f"
        for c in X.feature_sql(X.Dialect(False))
    ),
    "feature_row_hash": f"WITH f AS ({_features_sql()}) SELECT query_id, product_id, sha256(concat_ws(',', {', '.join(f'round({c} * 100000)::BIGINT' for c in X.feature_sql(X.Dialect(False)))})) AS row_sha256 FROM f",
    "leakage_report": " UNION ALL ".join(f"SELECT '{n}' AS prohibited, {p} AS present" for n, p in X.leakage_report(list(X.feature_sql(X.Dialect(False))))),
}
