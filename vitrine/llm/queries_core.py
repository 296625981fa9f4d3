"""Queries of the problems whose operators work on records: 1, 2, 3, 4, 6, 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


_P1 = {"groups": ["ranking", "query_id"], "item": "product_id", "score": "score", "ties": ["best_source_rank"], "n": 10}


def _p1_rows(spark: SparkSession, sf: str) -> DataFrame:
    hybrid = _read(spark, sf, "candidates").select(F.lit("hybrid").alias("ranking"), "query_id", "product_id", F.col("rrf_score").alias("score"), "best_source_rank")
    models = _read(spark, sf, "predictions").select(F.col("model_id").alias("ranking"), "query_id", "product_id", "score", F.lit(None).cast("int").alias("best_source_rank"))
    return hybrid.unionByName(models)


def _p1_inputs(sf: str) -> list[str]:
    return [f"{sf}/candidates.parquet", f"{sf}/predictions.parquet"]


def p1_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Ten best products of every query of candidates and of every model and query of predictions, with rank."""
    from vitrine.llm.topn import top_n_per_group

    return top_n_per_group(_p1_rows(spark, sf), **_P1, inputs=_p1_inputs(sf))


def p1_skips(spark: SparkSession, sf: str) -> DataFrame:
    """Row groups that each file of the layout had read and skipped for the rankings."""
    from vitrine.llm.topn import partial_top_n, skips

    return skips(partial_top_n(_p1_rows(spark, sf), **_P1, inputs=_p1_inputs(sf))).drop("file")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_rankings(spark, sf).select("ranking", "query_id", "product_id")


P1_SQL = """
WITH rows AS (
  SELECT 'hybrid' AS ranking, query_id, product_id, rrf_score AS score, best_source_rank FROM candidates
  UNION ALL SELECT model_id, query_id, product_id, score, NULL FROM predictions),
good AS (SELECT DISTINCT ranking, query_id, product_id, score, best_source_rank FROM rows WHERE score IS NOT NULL AND CAST(score AS VARCHAR) <> 'nan'),
once AS (SELECT *, row_number() OVER (PARTITION BY ranking, query_id, product_id ORDER BY score DESC, best_source_rank) AS k FROM good),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ranking, query_id ORDER BY score DESC, best_source_rank NULLS LAST, product_id) AS rank_in_group
  FROM once WHERE k = 1)
"""

QUERIES = {"p1_found": p1_found, "p1_rankings": p1_rankings, "p1_skips": p1_skips}
SQL = {
    "p1_found": P1_SQL + "SELECT ranking, query_id, product_id FROM ranked WHERE rank_in_group <= 10",
    "p1_rankings": P1_SQL + "SELECT ranking, query_id, product_id, score, best_source_rank, CAST(rank_in_group AS INTEGER) AS rank_in_group FROM ranked WHERE rank_in_group <= 10",
}


def _p4_mapping(spark: SparkSession, sf: str) -> DataFrame:
    from vitrine.llm import canonical as C

    products = _read(spark, sf, "products")
    brand = C.map_column(products, "product_id", "brand", C.brand_key_sql, C.brand_reference(_read(spark, sf, "canonical_brands")))
    color = C.map_column(products, "product_id", "color", C.color_key_sql, C.color_reference(_read(spark, sf, "canonical_colors")))
    return brand.withColumn("field_name", F.lit("brand")).unionByName(color.withColumn("field_name", F.lit("color")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Brand and colour values that are not a canonical name, with the entry they mean or 0."""
    mapped = _p4_mapping(spark, sf)
    names = _read(spark, sf, "canonical_brands").select(F.lit("brand").alias("field_name"), F.col("brand_name").alias("val"))
    names = names.unionByName(_read(spark, sf, "canonical_colors").select(F.lit("color").alias("field_name"), F.col("color_name").alias("val")))
    return mapped.join(names, ["field_name", "val"], "left_anti").select("product_id", "field_name", F.col("entry_id").cast("bigint").alias("entry_id"))


def p4_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The report of entered values that mean no entry, with their numbers of rows."""
    return _p4_mapping(spark, sf).filter("entry_id = 0").groupBy("field_name", "val").agg(F.count(F.lit(1)).alias("rows_entered"))


def p4_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    """Entered values to which several entries are equally close; p4_found takes the one with the smallest id."""
    from vitrine.llm import canonical as C

    products = _read(spark, sf, "products")
    brand = C.ambiguous(products, "brand", C.brand_key_sql, C.brand_reference(_read(spark, sf, "canonical_brands"))).withColumn("field_name", F.lit("brand"))
    color = C.ambiguous(products, "color", C.color_key_sql, C.color_reference(_read(spark, sf, "canonical_colors"))).withColumn("field_name", F.lit("color"))
    both = brand.unionByName(color)
    return both.select("field_name", "val", "edits", F.array_join(F.transform("entries", lambda x: x.cast("string")), ",").alias("entries"), "rows_entered")


def _p4_sql() -> str:
    from vitrine.llm import canonical as C

    k = C.edits_sql("length(ref_key)")
    swap = r"regexp_replace(brand_name, '^(\S+)\s+(?:&\s+)?(\S+)$', '\2 \1')"
    return f"""
WITH entered AS (
  SELECT product_id, 'brand' AS field_name, brand AS val, {C.brand_key_sql("brand", False)} AS val_key FROM products WHERE brand IS NOT NULL
  UNION ALL SELECT product_id, 'color', color, {C.color_key_sql("color", False)} FROM products WHERE color IS NOT NULL),
refs AS (
  SELECT 'brand' AS field_name, brand_id AS entry_id, {C.brand_key_sql("brand_name", False)} AS ref_key FROM canonical_brands
  UNION SELECT 'brand', brand_id, {C.brand_key_sql(swap, False)} FROM canonical_brands
  UNION SELECT 'color', color_id, {C.color_key_sql("name", False)} FROM (
    SELECT color_id, color_name AS name FROM canonical_colors UNION ALL SELECT color_id, unnest(other_names) FROM canonical_colors)),
near AS (
  SELECT v.field_name, val_key, entry_id, min(levenshtein(val_key, ref_key)) AS edits
  FROM (SELECT DISTINCT field_name, val_key FROM entered WHERE val_key <> '') v JOIN refs r ON r.field_name = v.field_name AND ref_key <> ''
  WHERE abs(length(val_key) - length(ref_key)) <= {k} AND levenshtein(val_key, ref_key) <= {k} GROUP BY ALL),
best AS (SELECT field_name, val_key, entry_id FROM near QUALIFY row_number() OVER (PARTITION BY field_name, val_key ORDER BY edits, entry_id) = 1),
mapped AS (SELECT e.product_id, e.field_name, e.val, coalesce(b.entry_id, 0) AS entry_id FROM entered e LEFT JOIN best b USING (field_name, val_key))
"""


QUERIES |= {"p4_found": p4_found, "p4_unmatched": p4_unmatched, "p4_ambiguous": p4_ambiguous}
SQL |= {
    "p4_found": _p4_sql()
    + """SELECT product_id, field_name, CAST(entry_id AS BIGINT) AS entry_id FROM mapped
WHERE NOT (field_name = 'brand' AND val IN (SELECT brand_name FROM canonical_brands)) AND NOT (field_name = 'color' AND val IN (SELECT color_name FROM canonical_colors))""",
    "p4_ambiguous": _p4_sql()
    + """, close AS (SELECT n.field_name, n.val_key, n.edits, string_agg(CAST(n.entry_id AS VARCHAR), ',' ORDER BY n.entry_id) AS entries, count(*) AS c FROM near n
  JOIN (SELECT field_name, val_key, min(edits) AS edits FROM near GROUP BY ALL) m ON m.field_name = n.field_name AND m.val_key = n.val_key AND m.edits = n.edits GROUP BY ALL)
SELECT e.field_name, e.val, CAST(c.edits AS INTEGER) AS edits, c.entries, count(*) AS rows_entered FROM entered e JOIN close c ON c.field_name = e.field_name AND c.val_key = e.val_key AND c.c > 1 GROUP BY ALL""",
    "p4_unmatched": _p4_sql() + "SELECT field_name, val, count(*) AS rows_entered FROM mapped WHERE entry_id = 0 GROUP BY field_name, val",
}


def _p3_records(spark: SparkSession, sf: str) -> DataFrame:
    from vitrine.functions.text import normalize_query_udf
    from vitrine.operators.skewjoin import heavy_light_join
    from vitrine.scratch import materialize

    texts = _read(spark, sf, "query_records").select("query_id", "locale", "query", F.col("normalized_query_sha256").alias("record_sha"))
    # each spelling is normalized once, however many records have it
    spelled = texts.filter("query IS NOT NULL").groupBy("query").agg(F.count(F.lit(1)).alias("spelled")).withColumn("text", normalize_query_udf("query"))
    records = _read(spark, sf, "query_assignments").select("query_id", "official_split", "project_split", F.col("normalized_query_sha256").alias("sha"))
    records = heavy_light_join(records.join(texts, "query_id", "left"), materialize(spelled, "spelled"), ["query"], "spelled")
    text_key = F.when(F.col("text").isNotNull() & F.col("locale").isNotNull(), F.concat_ws("\u0000", "locale", "text"))
    records = records.select("query_id", "official_split", "project_split", F.coalesce("sha", "record_sha").alias("sha"), text_key.alias("text_key"))
    return materialize(records, "keyed")


def _p3_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The standing of all records after two runs on the persisted state: the official training records come
    first, all others after them."""
    from vitrine.llm.splits import assign_splits, load_state, placed, save_state
    from vitrine.scratch import new_path

    records, path = _p3_records(spark, sf), new_path(spark, "splits")
    first = F.coalesce(F.col("official_split") == "train", F.lit(False))
    for part in (records.filter(first), records.filter(~first)):
        _, state = assign_splits(part, "query_id", ["sha", "text_key"], "project_split", state=load_state(spark, path))
        save_state(state, path)
    return placed(records, "query_id", ["sha", "text_key"], "project_split", load_state(spark, path))


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The split of every record, equal within a group; groups that hold several now are quarantined."""
    return _p3_assignment(spark, sf).select("query_id", "old_split", "new_split", "status")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose split is train, validation or test in a group that holds more than one of these."""
    return _p3_assignment(spark, sf).filter("size(declared) > 1 AND old_split IS NOT NULL").select("query_id")


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Records of each new split and status."""
    return _p3_assignment(spark, sf).groupBy("new_split", "status").agg(F.count(F.lit(1)).alias("records"))


QUERIES |= {"p3_found": p3_found, "p3_splits": p3_splits, "p3_shares": p3_shares}


def _p6_scores():
    from vitrine.llm.fused import Score

    return [
        Score("sparse_score", ("sparse_retriever_id", "sparse_index_id"), 1, 0.0, "sparse_rank"),
        Score("dense_score", ("dense_retriever_id", "dense_index_id"), 1, 0.0, "dense_rank"),
        Score("rrf_score", (), 1, 0.5),
    ]


def p6_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """One ranking of every query of candidates from its three scores."""
    from vitrine.llm.fused import fused_ranking

    return fused_ranking(_read(spark, sf, "candidates"), ["query_id"], "product_id", "retrieved_at", _p6_scores())


def _p7_records(spark: SparkSession, sf: str) -> DataFrame:
    from vitrine.functions.text import strip_tags_sql
    from vitrine.scratch import spread

    # each table on its own, as their union has files enough to pass for spread
    products = spread(_read(spark, sf, "products").select("product_id", "title", "bullets")).select(F.lit("product").alias("kind"), F.col("product_id").alias("record_id"), F.expr(strip_tags_sql("concat_ws(' ', title, bullets)")).alias("text"))
    asked = _read(spark, sf, "query_records").select(F.lit("query").alias("kind"), F.col("query_id").cast("string").alias("record_id"), F.col("query").alias("text"))
    return products.unionByName(asked)


def p7_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of every product (title, bullets) and query with its z-score."""
    from vitrine.llm.distinctive import term_scores

    scored = term_scores(_p7_records(spark, sf), ["kind", "record_id"], "text")
    return scored.withColumn("z_score", F.round("z_score", 6))


def _p7_sql() -> str:
    from vitrine.functions.text import strip_tags_sql, tokens_sql
    from vitrine.llm.distinctive import z_sql

    text = strip_tags_sql("concat_ws(' ', title, bullets)", False)
    return f"""
WITH records AS (SELECT 'product' AS kind, product_id AS record_id, {text} AS text FROM products
  UNION ALL SELECT 'query', CAST(query_id AS VARCHAR), query FROM query_records),
words AS (SELECT kind, record_id, unnest({tokens_sql("text", False)}) AS term FROM records WHERE text IS NOT NULL),
counted AS (SELECT kind, record_id, term, count(*) AS occurrences FROM words GROUP BY ALL),
sized AS (SELECT *, CAST(sum(occurrences) OVER (PARTITION BY kind, record_id) AS DOUBLE) AS n FROM counted),
totals AS (SELECT term, CAST(count(*) AS DOUBLE) AS total FROM words GROUP BY term),
g AS (SELECT CAST(count(*) AS DOUBLE) AS grand FROM words)
SELECT kind, record_id, s.term, occurrences, round({z_sql("occurrences", "n", "total", "grand")}, 6) AS z_score
FROM sized s JOIN totals t ON t.term = s.term, g"""


QUERIES |= {"p6_ranking": p6_ranking, "p7_terms": p7_terms}
SQL |= {"p7_terms": _p7_sql()}
