"""Queries over scans, validation and the canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.clean import FIELD_LIMITS, clean_sql
from vitrine.operators import foundation as B
from vitrine.operators import validate as V
from vitrine.plans.common import GAIN, JUDGED, LABEL, table
from vitrine.plans.parsing import digest_sql
from vitrine.scratch import spread

COHORTS = {"development": 200, "portfolio": 400}
DISTRACTORS = 500

EXAMPLES = V.TableSpec(
    "examples",
    {
        "example_id": "bigint",
        "query": "string",
        "query_id": "bigint",
        "product_id": "string",
        "product_locale": "string",
        "esci_label": "string",
        "small_version": "tinyint",
        "large_version": "tinyint",
        "split": "string",
        "received_at": "timestamp",
    },
    ("example_id",),
    ("query", "query_id", "product_id", "esci_label"),
    {"product_locale": ("us", "es", "jp"), "esci_label": ("E", "S", "C", "I"), "small_version": (0, 1), "split": ("train", "test")},
)
QUERIES_SPEC = V.TableSpec(
    "query_records",
    {"query_id": "bigint", "query": "string", "locale": "string", "official_split": "string", "judgment_count": "int", "normalized_query": "string", "normalized_query_sha256": "string", "source": "string"},
    ("query_id",),
    ("query", "normalized_query_sha256"),
    {"official_split": ("train", "test"), "locale": ("us", "es", "jp")},
)


PRODUCTS_SPEC = V.TableSpec(
    "products",
    {
        **dict.fromkeys(("product_id", "locale", "title", "brand", "color", "bullets", "description", "normalized_brand", "normalized_color", "seller_id"), "string"),
        **dict.fromkeys(("title_missing", "brand_missing", "color_missing", "bullets_missing", "description_missing"), "boolean"),
        "updated_at": "timestamp",
    },
    ("product_id",),
    ("product_id", "locale"),
    {"locale": ("us", "es", "jp")},
)

def scan_project_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "products").filter("locale = 'us' AND NOT brand_missing").select("product_id", "brand", "seller_id")


def raw_validation_report(spark: SparkSession, sf: str) -> DataFrame:
    examples, queries = table(spark, sf, "examples"), table(spark, sf, "query_records")
    variants = examples.groupBy("query_id").agg(F.countDistinct("query").alias("q"), F.countDistinct("split").alias("s"))
    steady = variants.agg(F.coalesce(F.sum(((F.col("q") > 1) | (F.col("s") > 1)).cast("int")), F.lit(0)).cast("bigint").alias("failures"))
    steady = steady.select(F.lit("examples").alias("role"), F.lit("query_consistency").alias("check_id"), "failures")
    products = table(spark, sf, "products")
    # a row is usable if one of its texts is there; the flags must say which are missing
    texts = ("title", "brand", "color", "bullets", "description")
    wrong = reduce(lambda x, y: x | y, [F.col(c).isNull() != F.col(f"{c}_missing") for c in texts])
    flags = products.agg(F.coalesce(F.sum(F.coalesce(wrong, F.lit(True)).cast("int")), F.lit(0)).cast("bigint").alias("failures"))
    flags = flags.select(F.lit("products").alias("role"), F.lit("missing_flags").alias("check_id"), "failures")
    unsourced = queries.agg(F.coalesce(F.sum(F.col("source").isNull().cast("int")), F.lit(0)).cast("bigint").alias("failures")).select(F.lit("sources").alias("role"), F.lit("not_null:source").alias("check_id"), "failures")
    orphans = V.orphans(examples, products, ["product_id"]).agg(F.count(F.lit(1)).alias("failures")).select(F.lit("examples").alias("role"), F.lit("product_known").alias("check_id"), "failures")
    parts = [V.validate(examples, EXAMPLES), V.validate(queries, QUERIES_SPEC), V.validate(products, PRODUCTS_SPEC), steady, flags, unsourced, orphans]
    return reduce(DataFrame.unionByName, parts)


def pk_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    keys = {"products": ["product_id"], "query_records": ["query_id"], "examples": ["example_id"], "candidates": ["query_id", "product_id"], "predictions": ["model_id", "query_id", "product_id"]}
    parts = [V.key_uniqueness(table(spark, sf, t), t, k) for t, k in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return V.null_profile(table(spark, sf, "products"), "products").unionByName(V.null_profile(table(spark, sf, "query_records"), "query_records"))


def referential_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    examples = table(spark, sf, "examples")
    lost = V.orphans(examples, table(spark, sf, "products"), ["product_id"]).withColumn("parent", F.lit("products"))
    lost2 = V.orphans(examples, table(spark, sf, "query_records"), ["query_id"]).withColumn("parent", F.lit("query_records"))
    return lost.unionByName(lost2).groupBy("parent", "split").agg(F.count(F.lit(1)).alias("orphan_rows"), F.countDistinct("product_id").alias("orphan_products"))


def judgment_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return B.collapse_judgments(table(spark, sf, "examples"))


def label_gain_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_gains(B.collapse_judgments(table(spark, sf, "examples"))).select("query_id", "product_id", "esci_label", "label_id", "gain")


def stable_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return B.stable_ordinal(B.collapse_judgments(table(spark, sf, "examples"))).select("query_id", "product_id", "stable_ordinal")


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return B.assign_splits(table(spark, sf, "query_records")).select("query_id", "bucket", "project_split")


def collision_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return B.assign_splits(table(spark, sf, "query_records")).filter("quarantine_reason IS NOT NULL").select("query_id", "group_key", "quarantine_reason")


def nested_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return B.nested_cohorts(B.assign_splits(table(spark, sf, "query_records")), COHORTS)


def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    queries = table(spark, sf, "query_records")
    return B.split_summary(B.assign_splits(queries), queries)


def catalog_compact_select(spark: SparkSession, sf: str) -> DataFrame:
    return B.compact_catalog(table(spark, sf, "products"), B.collapse_judgments(table(spark, sf, "examples")), DISTRACTORS)


def catalog_membership(spark: SparkSession, sf: str) -> DataFrame:
    return B.catalog_membership(table(spark, sf, "products"))


def judged_pools(spark: SparkSession, sf: str) -> DataFrame:
    assigned = B.assign_splits(table(spark, sf, "query_records"))
    return B.judged_pools(B.collapse_judgments(table(spark, sf, "examples")), assigned, B.nested_cohorts(assigned, COHORTS))


def clean_product_text(spark: SparkSession, sf: str) -> DataFrame:
    return B.clean_products(spread(table(spark, sf, "products")))


def product_document(spark: SparkSession, sf: str) -> DataFrame:
    return B.product_documents(B.clean_products(spread(table(spark, sf, "products")))).select("product_id", "document_sha256", "document_chars", "document_bytes")


def catalog_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return B.catalog_exclusions(B.clean_products(table(spark, sf, "products")))


def resource_estimate(spark: SparkSession, sf: str) -> DataFrame:
    products = table(spark, sf, "products")
    return B.resource_estimate(B.product_documents(B.clean_products(products)), products)


def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return B.content_digest(table(spark, sf, "query_records"), "official_split", "query_id")


def cohort_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What the stored assignments hold and what they break."""
    return B.cohort_invariants(table(spark, sf, "query_assignments"))


def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    return V.same_sets(table(spark, sf, "query_records"), table(spark, sf, "candidates"), ["query_id"])


def query_context_join(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one left join of assignments with their records."""
    left = table(spark, sf, "query_assignments").select("query_id", "project_split")
    right = table(spark, sf, "query_records").select("query_id", F.coalesce("source", F.lit("unknown")).alias("source"), "locale")
    return V.join_one_to_one(left, right, ["query_id"], "left")


def key_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct union of the product keys of three tables, with the number of tables that have them."""
    parts = [table(spark, sf, t).select("product_id").distinct().withColumn("t", F.lit(t)) for t in ("examples", "candidates", "predictions")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("product_id").agg(F.count(F.lit(1)).alias("tables"))


_SPLITS = """
keyed AS (SELECT query_id, official_split, judgment_count, coalesce(normalized_query_sha256, 'q:' || query_id) AS group_key FROM query_records),
mixed AS (SELECT group_key FROM keyed GROUP BY group_key HAVING count(DISTINCT official_split) > 1),
assigned AS (SELECT query_id, k.group_key, judgment_count,
  CAST(('0x' || substr(sha256('split-v1' || chr(0) || '42' || chr(0) || 'us' || chr(0) || k.group_key), 1, 16))::UBIGINT % 10000 AS INTEGER) AS bucket,
  official_split = 'train' AND m.group_key IS NOT NULL AS held, official_split
  FROM keyed k LEFT JOIN mixed m ON m.group_key = k.group_key),
split AS (SELECT *, CASE WHEN official_split = 'test' THEN 'test' WHEN held THEN 'quarantine' WHEN bucket < 8500 THEN 'train' ELSE 'validation' END AS project_split FROM assigned),
group_order AS (SELECT group_key, row_number() OVER (ORDER BY sha256('profile-v1' || chr(0) || '42' || chr(0) || group_key), group_key) AS r FROM (SELECT DISTINCT group_key FROM keyed)),
cohorts AS (SELECT 'development' AS cohort, group_key FROM group_order WHERE r <= 200 UNION ALL SELECT 'portfolio', group_key FROM group_order WHERE r <= 400)"""


_CLEANED = (
    "cleaned AS (SELECT locale, product_id, "
    + ", ".join(f"{clean_sql(f, n, False)} AS clean_{f}" for f, n in FIELD_LIMITS.items())
    + ", "
    + ", ".join(f"{f} IS NULL AS {f}_missing" for f in FIELD_LIMITS)
    + " FROM products), c2 AS (SELECT locale, product_id, clean_title, clean_brand, clean_color, clean_bullets, clean_description, nullif(lower(clean_brand), '') AS normalized_brand, nullif(lower(clean_color), '') AS normalized_color, title_missing, brand_missing, color_missing, bullets_missing, description_missing, "
    + " OR ".join(f"clean_{f} <> ''" for f in FIELD_LIMITS)
    + " AS has_usable_text FROM cleaned), docs AS (SELECT locale, product_id, '[TITLE] ' || clean_title || ' [BRAND] ' || clean_brand || ' [COLOR] ' || clean_color || ' [BULLETS] ' || clean_bullets || ' [DESCRIPTION] ' || clean_description AS document FROM c2 WHERE has_usable_text)"
)


def _checks() -> str:
    def nulls(t: str, cols: tuple[str, ...]) -> list[str]:
        return [f"SELECT '{t}' AS role, 'not_null:{c}' AS check_id, count(*) - count({c}) AS failures FROM {t}" for c in cols]

    def domain(t: str, c: str, values: str) -> str:
        return f"SELECT '{t}', 'domain:{c}', count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({values})) FROM {t}"

    parts = []
    for t, cols, key in (("examples", EXAMPLES.required, "example_id"), ("query_records", QUERIES_SPEC.required, "query_id"), ("products", PRODUCTS_SPEC.required, "product_id")):
        parts += [f"SELECT '{t}' AS role, '{c}' AS check_id, CAST(0 AS BIGINT) AS failures" for c in ("columns_present", "columns_expected", "types", "not_empty")]
        parts += nulls(t, cols) + [f"SELECT '{t}', 'unique_key', count(*) - count(DISTINCT {key}) FROM {t}"]
    parts += [domain("examples", "product_locale", "'us','es','jp'"), domain("examples", "esci_label", "'E','S','C','I'"), domain("examples", "small_version", "0,1"), domain("examples", "split", "'train','test'")]
    parts += [domain("query_records", "official_split", "'train','test'"), domain("query_records", "locale", "'us','es','jp'")]
    parts.append("SELECT 'examples', 'query_consistency', count(*) FROM (SELECT query_id FROM examples GROUP BY query_id HAVING count(DISTINCT query) > 1 OR count(DISTINCT split) > 1)")
    parts.append(domain("products", "locale", "'us','es','jp'"))
    parts.append("SELECT 'products', 'missing_flags', count(*) FILTER (WHERE " + " OR ".join(f"({c} IS NULL) <> {c}_missing" for c in ("title", "brand", "color", "bullets", "description")) + ") FROM products")
    parts.append("SELECT 'sources', 'not_null:source', count(*) - count(source) FROM query_records")
    parts.append("SELECT 'examples', 'product_known', count(*) FROM examples WHERE product_id IS NULL OR product_id NOT IN (SELECT product_id FROM products)")
    return "\nUNION ALL ".join(parts)


QUERIES = {
    f.__name__: f
    for f in (
        scan_project_filter,
        raw_validation_report,
        pk_uniqueness,
        null_profile,
        referential_anti_join,
        judgment_collapse,
        label_gain_mapping,
        stable_ordinal,
        hash_split,
        collision_quarantine,
        nested_profiles,
        split_summary,
        catalog_compact_select,
        catalog_membership,
        judged_pools,
        clean_product_text,
        product_document,
        catalog_exclusions,
        resource_estimate,
        content_digest,
        cohort_invariants,
        set_equality,
        query_context_join,
        key_union_distinct,
    )
}


def _nulls(t: str, cols: str) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS nulls FROM {t}" for c in cols.split())


SQL = {
    "scan_project_filter": "SELECT product_id, brand, seller_id FROM products WHERE locale = 'us' AND NOT brand_missing",
    "raw_validation_report": _checks(),
    "pk_uniqueness": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, count(DISTINCT {k}) AS distinct_keys, count(*) - count(DISTINCT {k}) AS duplicate_rows FROM {t}"
        for t, k in (("products", "product_id"), ("query_records", "query_id"), ("examples", "example_id"), ("candidates", "(query_id, product_id)"), ("predictions", "(model_id, query_id, product_id)"))
    ),
    "null_profile": _nulls(
        "products",
        "product_id locale title brand color bullets description normalized_brand normalized_color title_missing brand_missing color_missing bullets_missing description_missing seller_id updated_at",
    )
    + " UNION ALL "
    + _nulls("query_records", "query_id query locale official_split judgment_count normalized_query normalized_query_sha256 source"),
    "referential_anti_join": """
SELECT parent, split, count(*) AS orphan_rows, count(DISTINCT product_id) AS orphan_products FROM (
  SELECT 'products' AS parent, split, product_id FROM examples e WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = e.product_id)
  UNION ALL SELECT 'query_records', split, product_id FROM examples e WHERE NOT EXISTS (SELECT 1 FROM query_records q WHERE q.query_id = e.query_id)) GROUP BY parent, split""",
    "judgment_collapse": f"WITH {JUDGED} SELECT * FROM judged",
    "label_gain_mapping": f"WITH {JUDGED} SELECT query_id, product_id, esci_label, {LABEL} AS label_id, {GAIN} AS gain FROM judged",
    "stable_ordinal": f"WITH {JUDGED} SELECT query_id, product_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS INTEGER) AS stable_ordinal FROM judged",
    "hash_split": f"WITH {_SPLITS} SELECT query_id, bucket, project_split FROM split",
    "collision_quarantine": f"WITH {_SPLITS} SELECT query_id, group_key, 'normalized_query_occurs_in_official_test' AS quarantine_reason FROM split WHERE held",
    "nested_profiles": f"WITH {_SPLITS} SELECT * FROM cohorts",
    "split_summary": f"WITH {_SPLITS} SELECT project_split, count(DISTINCT group_key) AS query_groups, count(*) AS queries, CAST(sum(judgment_count) AS BIGINT) AS judgments FROM split GROUP BY project_split",
    "catalog_compact_select": """
WITH k AS (SELECT DISTINCT product_locale AS locale, product_id FROM examples),
kept AS (SELECT locale, product_id FROM products SEMI JOIN k USING (locale, product_id)),
rest AS (SELECT locale, product_id FROM products ANTI JOIN k USING (locale, product_id) ORDER BY sha256('catalog-v1' || chr(0) || '42' || chr(0) || locale || chr(0) || product_id), locale, product_id LIMIT 500)
SELECT locale, product_id, 'judged' AS role FROM kept UNION ALL SELECT locale, product_id, 'distractor' FROM rest""",
    "catalog_membership": "SELECT 'compact' AS catalog_id, locale, product_id, row_number() OVER (ORDER BY locale, product_id) - 1 AS catalog_ordinal FROM products",
    "judged_pools": f"WITH {_SPLITS}, {JUDGED} SELECT c.cohort AS profile, j.query_id, s.project_split, j.product_locale, j.product_id, j.esci_label FROM judged j JOIN split s ON s.query_id = j.query_id AND s.project_split <> 'quarantine' JOIN cohorts c ON c.group_key = s.group_key",
    "clean_product_text": f"WITH {_CLEANED} SELECT * FROM c2",
    "product_document": f"WITH {_CLEANED} SELECT product_id, sha256(document) AS document_sha256, CAST(length(document) AS INTEGER) AS document_chars, CAST(strlen(document) AS INTEGER) AS document_bytes FROM docs",
    "catalog_exclusions": f"WITH {_CLEANED} SELECT 'compact' AS catalog_id, locale, product_id, 'no_usable_source_text' AS reason FROM c2 WHERE NOT has_usable_text",
    "resource_estimate": f"""
WITH {_CLEANED}, s AS (SELECT count(*) AS catalog_products, CAST(sum(strlen(document)) AS BIGINT) AS document_bytes FROM docs),
d AS (SELECT CAST(sum(strlen(coalesce(title, '')) + strlen(coalesce(brand, '')) + strlen(coalesce(color, ''))) AS BIGINT) AS display_bytes FROM products),
e AS (SELECT *, document_bytes * 3 // 2 AS sparse_bytes, catalog_products * 1536 AS dense_bytes, catalog_products * 256 AS id_bytes, CAST(536870912 AS BIGINT) AS reserve_bytes FROM s, d)
SELECT *, sparse_bytes + dense_bytes + id_bytes + display_bytes + reserve_bytes AS projected_bytes, sparse_bytes + dense_bytes + id_bytes + display_bytes + reserve_bytes <= 5905580032 AS proceed FROM e""",
    "content_digest": f"WITH {digest_sql('query_records', 'official_split', 'query_id')} SELECT * FROM query_records_digest",
    "cohort_invariants": """
WITH c AS (SELECT 'development_nested_in_portfolio' AS check_id, count(*) FILTER (WHERE in_development AND NOT coalesce(in_portfolio, FALSE)) AS failures FROM query_assignments
UNION ALL SELECT 'quarantine_excluded', count(*) FILTER (WHERE project_split = 'quarantine' AND (coalesce(in_development, FALSE) OR coalesce(in_portfolio, FALSE))) FROM query_assignments
UNION ALL SELECT 'split_present', count(*) FILTER (WHERE project_split IS NULL) FROM query_assignments
UNION ALL SELECT 'unique_query_ids', count(*) FROM (SELECT query_id FROM query_assignments GROUP BY query_id HAVING count(*) > 1)
UNION ALL SELECT 'group_split_disjointness', count(*) FROM (SELECT normalized_query_sha256 FROM query_assignments WHERE normalized_query_sha256 IS NOT NULL AND project_split <> 'quarantine' GROUP BY 1 HAVING count(DISTINCT project_split) > 1))
SELECT check_id, failures, failures = 0 AS passed FROM c""",
    "set_equality": """
SELECT 'left_only' AS side, count(*) AS missing FROM (SELECT DISTINCT query_id FROM query_records EXCEPT SELECT query_id FROM candidates)
UNION ALL SELECT 'right_only', count(*) FROM (SELECT DISTINCT query_id FROM candidates EXCEPT SELECT query_id FROM query_records)""",
    "query_context_join": "SELECT a.query_id, a.project_split, coalesce(r.source, 'unknown') AS source, r.locale FROM query_assignments a LEFT JOIN query_records r USING (query_id)",
    "key_union_distinct": "SELECT product_id, count(*) AS tables FROM (SELECT DISTINCT product_id FROM examples UNION ALL SELECT DISTINCT product_id FROM candidates UNION ALL SELECT DISTINCT product_id FROM predictions) GROUP BY product_id",
}
