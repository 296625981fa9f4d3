"""Canonical tables: splits, cohorts, judgments, catalog, documents and judged pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.clean import FIELD_LIMITS, attribute, clean
from vitrine.functions.hashing import hash_bucket, hash_key
from vitrine.operators.grouprank import row_number, running_over_all
from vitrine.operators.skewjoin import shuffled
from vitrine.operators.validate import strict_map

#: Label codes and gains.
LABEL_ID = {"I": 0, "C": 1, "S": 2, "E": 3}
LABEL_GAIN = {"I": 0.0, "C": 0.01, "S": 0.1, "E": 1.0}
SPLIT_VERSION, PROFILE_VERSION, CATALOG_VERSION, SEED = "split-v1", "profile-v1", "catalog-v1", 42
TRAIN_BASIS_POINTS = 8_500
#: Fixed value: dimensions of the dense encoder.
DENSE_DIMENSION = 384


def assign_splits(queries: DataFrame) -> DataFrame:
    """``query_id``, ``group_key``, ``bucket``, ``project_split``, ``quarantine_reason``.

    Test stays test. A group with train and test records is quarantined from training. The rest is train or
    validation by the hash bucket of its key. A null key is its own group, by query_id.
    """
    keyed = queries.select("query_id", "official_split", F.coalesce("normalized_query_sha256", F.concat(F.lit("q:"), F.col("query_id").cast("string"))).alias("group_key"))
    mixed = keyed.groupBy("group_key").agg((F.countDistinct("official_split") > 1).alias("mixed")).filter("mixed")
    bucket = hash_bucket(hash_key(F.lit(SPLIT_VERSION), F.lit(str(SEED)), F.lit("us"), "group_key"))
    out = keyed.withColumn("bucket", bucket).join(shuffled(mixed), "group_key", "left")
    held = F.coalesce("mixed", F.lit(False)) & (F.col("official_split") == "train")
    split = F.when(F.col("official_split") == "test", "test").when(held, "quarantine").when(F.col("bucket") < TRAIN_BASIS_POINTS, "train").otherwise("validation")
    return out.select("query_id", "group_key", "bucket", split.alias("project_split"), F.when(held, "normalized_query_occurs_in_official_test").alias("quarantine_reason"))


def nested_cohorts(assignments: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(cohort, group_key): the first N groups by hash for each cohort, so that smaller ones nest in larger.

    Only the largest N rows are ever ordered in one place; N is a parameter, not the size of the data.
    """
    most = max(sizes.values())
    ranked = assignments.select("group_key").distinct().withColumn("_h", hash_key(F.lit(PROFILE_VERSION), F.lit(str(SEED)), "group_key"))
    top = ranked.orderBy("_h", "group_key").limit(most).withColumn("_r", F.row_number().over(Window.orderBy("_h", "group_key")))
    pick = F.explode(F.array(*[F.struct(F.lit(c).alias("cohort"), F.lit(n).alias("n")) for c, n in sizes.items()])).alias("c")
    return top.select("group_key", "_r", pick).filter("_r <= c.n").select("c.cohort", "group_key")


def split_summary(assignments: DataFrame, queries: DataFrame) -> DataFrame:
    """Groups, queries and judgments of each split."""
    joined = assignments.join(queries.select("query_id", "judgment_count"), "query_id")
    return joined.groupBy("project_split").agg(
        F.countDistinct("group_key").alias("query_groups"), F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("judgment_count"), F.lit(0)).cast("bigint").alias("judgments")
    )


def collapse_judgments(examples: DataFrame) -> DataFrame:
    """One row per (query_id, product_locale, product_id): first example, copies, label and whether labels conflict.

    Null labels do not count as a variant; a pair with null labels only has a null label.
    """
    return (
        examples.groupBy("query_id", "product_locale", "product_id")
        .agg(F.min("example_id").alias("example_id"), F.count(F.lit(1)).alias("duplicate_count"), F.min("esci_label").alias("esci_label"), (F.countDistinct("esci_label") > 1).alias("conflict"))
    )


def with_gains(judgments: DataFrame) -> DataFrame:
    """Adds ``label_id`` and ``gain``; an unknown label is an error, a null one stays null."""
    return judgments.withColumns({"label_id": strict_map("esci_label", LABEL_ID), "gain": strict_map("esci_label", LABEL_GAIN)})


def stable_ordinal(judgments: DataFrame) -> DataFrame:
    """Adds ``stable_ordinal``: the place of the product among those of its query, by product_id and locale."""
    return row_number(judgments, ["query_id"], [F.col("product_id"), F.col("product_locale")], "stable_ordinal").withColumn("stable_ordinal", F.col("stable_ordinal").cast("int"))


def compact_catalog(products: DataFrame, judged: DataFrame, distractors: int) -> DataFrame:
    """Judged products and the first ``distractors`` others by hash: ``locale``, ``product_id``, ``role``."""
    keys = judged.select(F.col("product_locale").alias("locale"), "product_id").distinct()
    kept = products.select("locale", "product_id").join(keys, ["locale", "product_id"], "left_semi").withColumn("role", F.lit("judged"))
    rest = products.select("locale", "product_id").join(keys, ["locale", "product_id"], "left_anti")
    rest = rest.withColumn("_h", hash_key(F.lit(CATALOG_VERSION), F.lit(str(SEED)), "locale", "product_id")).orderBy("_h", "locale", "product_id").limit(distractors)
    return kept.unionByName(rest.drop("_h").withColumn("role", F.lit("distractor")))


def catalog_membership(catalog: DataFrame, catalog_id: str = "compact") -> DataFrame:
    """``catalog_ordinal`` 0.. in the order of (locale, product_id), without one task seeing all rows."""
    numbered = running_over_all(catalog.select("locale", "product_id").withColumn("_one", F.lit(1.0)), [F.col("locale"), F.col("product_id")], "_one", "_at")
    return numbered.select(F.lit(catalog_id).alias("catalog_id"), "locale", "product_id", F.col("_at").cast("bigint").alias("catalog_ordinal"))


def clean_products(products: DataFrame) -> DataFrame:
    """Cleaned fields, normalised brand and colour, missing flags (of the raw fields) and ``has_usable_text``."""
    fields = list(FIELD_LIMITS)
    out = products.select(
        "locale",
        "product_id",
        *[clean(f, n).alias(f"clean_{f}") for f, n in FIELD_LIMITS.items()],
        attribute("brand", FIELD_LIMITS["brand"]).alias("normalized_brand"),
        attribute("color", FIELD_LIMITS["color"]).alias("normalized_color"),
        *[F.col(f).isNull().alias(f"{f}_missing") for f in fields],
    )
    usable = F.lit(False)
    for f in fields:
        usable = usable | (F.col(f"clean_{f}") != "")
    return out.withColumn("has_usable_text", usable)


def product_documents(cleaned: DataFrame) -> DataFrame:
    """The document text of every usable product with its hash and sizes."""
    text = F.concat(
        F.lit("[TITLE] "), "clean_title", F.lit(" [BRAND] "), "clean_brand", F.lit(" [COLOR] "), "clean_color", F.lit(" [BULLETS] "), "clean_bullets", F.lit(" [DESCRIPTION] "), "clean_description"
    )
    return cleaned.filter("has_usable_text").select("locale", "product_id", text.alias("document")).withColumns(
        {"document_sha256": F.sha2("document", 256), "document_chars": F.char_length("document"), "document_bytes": F.octet_length("document")}
    )


def catalog_exclusions(cleaned: DataFrame, catalog_id: str = "compact") -> DataFrame:
    return cleaned.filter("NOT has_usable_text").select(F.lit(catalog_id).alias("catalog_id"), "locale", "product_id", F.lit("no_usable_source_text").alias("reason"))


def judged_pools(judgments: DataFrame, assignments: DataFrame, cohorts: DataFrame) -> DataFrame:
    """The judged products of every cohort's queries; a query in two cohorts is in both pools."""
    of_query = assignments.filter("project_split <> 'quarantine'").select("query_id", "group_key", "project_split")
    members = of_query.join(cohorts, "group_key").select("query_id", F.col("cohort").alias("profile"), "project_split")
    return judgments.join(members, "query_id").select("profile", "query_id", "project_split", "product_locale", "product_id", "esci_label")


def resource_estimate(documents: DataFrame, products: DataFrame, reserve_mb: int = 512, limit_mb: int = 5632) -> DataFrame:
    """Projected bytes of the indexes and whether they fit the limit."""
    size = documents.agg(F.count(F.lit(1)).alias("catalog_products"), F.coalesce(F.sum("document_bytes"), F.lit(0)).cast("bigint").alias("document_bytes"))
    shown = sum((F.octet_length(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "brand", "color")), F.lit(0))
    display = products.agg(F.coalesce(F.sum(shown), F.lit(0)).cast("bigint").alias("display_bytes"))
    both = size.crossJoin(display)  # one row each
    mb = 1024 * 1024
    out = both.withColumns(
        {"sparse_bytes": F.expr("document_bytes * 3 div 2"), "dense_bytes": F.col("catalog_products") * DENSE_DIMENSION * 4, "id_bytes": F.col("catalog_products") * 256, "reserve_bytes": F.lit(reserve_mb * mb).cast("bigint")}
    )
    out = out.withColumn("projected_bytes", F.expr("sparse_bytes + dense_bytes + id_bytes + display_bytes + reserve_bytes"))
    return out.withColumn("proceed", F.col("projected_bytes") <= limit_mb * mb)


#: Keys are dealt by the first hex digits of their hash; each part is hashed in order, then the parts in order.
DIGEST_DIGITS = 3


def content_digest(df: DataFrame, group: str, key: str) -> DataFrame:
    """SHA-256 over the ordered keys of each group, as a hash of hashes: the keys of a part (those whose hash starts
    with the same DIGEST_DIGITS digits) in the order of their hashes, then the parts in order.

    Every bit of every key counts, also repeats. A part has 1/4096 of a group's keys, so no task holds a group.
    """
    hashed = df.select(group, F.sha2(F.col(key).cast("string"), 256).alias("_h")).withColumn("_p", F.substring("_h", 1, DIGEST_DIGITS))
    parts = hashed.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_d"))
    whole = parts.groupBy(group).agg(F.sum("_n").alias("keys"), F.array_sort(F.collect_list(F.struct("_p", "_d"))).alias("_all"))
    return whole.select(group, "keys", F.sha2(F.array_join(F.transform("_all", lambda x: x["_d"]), ""), 256).alias("digest"))


def cohort_invariants(assignments: DataFrame) -> DataFrame:
    """(check_id, failures) of what cohorts must hold: one assignment per query, development inside portfolio, no
    group in several splits (quarantine apart), nothing quarantined in a cohort, no split missing."""
    flag = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0)).cast("bigint")
    held = F.col("project_split") == "quarantine"
    row = assignments.agg(
        flag(F.col("in_development") & ~F.coalesce("in_portfolio", F.lit(False))).alias("a"),
        flag(held & (F.coalesce("in_development", F.lit(False)) | F.coalesce("in_portfolio", F.lit(False)))).alias("b"),
        flag(F.col("project_split").isNull()).alias("c"),
    )
    out = row.selectExpr("stack(3, 'development_nested_in_portfolio', a, 'quarantine_excluded', b, 'split_present', c) AS (check_id, failures)")
    once = assignments.groupBy("query_id").count().agg(flag(F.col("count") > 1).alias("failures")).select(F.lit("unique_query_ids").alias("check_id"), "failures")
    groups = assignments.filter("normalized_query_sha256 IS NOT NULL AND project_split <> 'quarantine'").groupBy("normalized_query_sha256").agg(F.countDistinct("project_split").alias("n"))
    apart = groups.agg(flag(F.col("n") > 1).alias("failures")).select(F.lit("group_split_disjointness").alias("check_id"), "failures")
    return out.unionByName(once).unionByName(apart).withColumn("passed", F.col("failures") == 0)
