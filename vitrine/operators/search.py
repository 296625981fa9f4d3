"""Batch search over many queries with modes, fallbacks and list metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The serving modes.
MODES = ("active", "bm25", "dense", "hybrid", "pointwise", "lambdamart")


def search_modes(fused: DataFrame, predictions: DataFrame, top_k: int = 10, active: str = "lambdamart") -> DataFrame:
    """``query_id``, ``mode``, ``product_id``, ``rank``, ``stage``, ``fallback`` for every mode.

    ``fused`` has query_id, product_id, rank, sparse_rank, dense_rank; ``predictions`` model_id, query_id,
    product_id, score. A mode whose evidence a query lacks falls back to the fused ranking and says why. Only
    products of the fused list appear, as its cap decides what can be served.
    """
    base = fused.select("query_id", "product_id", F.col("rank").alias("_hybrid"), F.col("sparse_rank").alias("_bm25"), F.col("dense_rank").alias("_dense"))
    scores = predictions.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("query_id", "product_id").agg(
        *[F.max(F.when(F.col("model_id") == m, F.col("score"))).alias(f"_s_{m}") for m in ("pointwise", "lambdamart")]
    )
    rows = base.join(scores, ["query_id", "product_id"], "left")
    keys = {"bm25": -F.col("_bm25"), "dense": -F.col("_dense"), "hybrid": -F.col("_hybrid"), "pointwise": F.col("_s_pointwise"), "lambdamart": F.col("_s_lambdamart")}
    keys["active"] = keys[active]
    reason = {"bm25": "sparse_unavailable", "dense": "dense_unavailable", "pointwise": "ranker_unavailable", "lambdamart": "ranker_unavailable", "hybrid": "fusion_unavailable"}
    reason["active"] = reason[active]
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), keys[m].cast("double").alias("key"), F.lit(reason[m]).alias("reason"), F.lit(active if m == "active" else m).alias("stage")) for m in MODES]))
    long = rows.select("query_id", "product_id", "_hybrid", modes.alias("m")).select("query_id", "product_id", "_hybrid", "m.*")
    has = long.groupBy("query_id", "mode").agg((F.count("key") > 0).alias("_has"))
    judged = long.join(has, ["query_id", "mode"]).withColumn("key", F.when(F.col("_has"), F.col("key")).otherwise(-F.col("_hybrid").cast("double"))).filter("key IS NOT NULL")
    order = Window.partitionBy("query_id", "mode").orderBy(F.round("key", 9).desc(), F.col("_hybrid"), F.col("product_id"))
    out = judged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    fallback = F.when(~F.col("_has"), F.col("reason"))
    return out.select("query_id", "mode", "product_id", "rank", F.when(F.col("_has"), F.col("stage")).otherwise("hybrid").alias("stage"), fallback.alias("fallback"))


def rank_changes(found: DataFrame, baseline: str = "hybrid") -> DataFrame:
    """Adds ``rank_change``: baseline rank minus rank, null for products outside the baseline's list."""
    base = found.filter(F.col("mode") == baseline).select("query_id", "product_id", F.col("rank").alias("_b"))
    return found.join(base, ["query_id", "product_id"], "left").withColumn("rank_change", F.col("_b") - F.col("rank")).drop("_b")


def list_metrics(lists: DataFrame, products: DataFrame) -> DataFrame:
    """Brand entropy (bits), concentration, distinct brands and missing brands of each (query_id, mode) list."""
    named = lists.join(products.select("product_id", "normalized_brand"), "product_id", "left")
    per = named.groupBy("query_id", "mode", "normalized_brand").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("normalized_brand").isNotNull(), F.col("n"))
    total = per.groupBy("query_id", "mode").agg(
        F.sum(known).alias("t"), F.sum(known * F.log2(F.col("n").cast("double"))).alias("x"), F.max(known).alias("top"), F.count("normalized_brand").alias("distinct_brands"), F.sum(F.when(F.col("normalized_brand").isNull(), F.col("n")).otherwise(0)).alias("missing_brands")
    )
    entropy = F.when(F.col("t") > 0, F.log2(F.col("t").cast("double")) - F.col("x") / F.col("t")).otherwise(0.0)
    return total.select("query_id", "mode", entropy.alias("brand_entropy"), F.when(F.col("t") > 0, F.col("top") / F.col("t")).otherwise(0.0).alias("brand_concentration"), "distinct_brands", "missing_brands")


def title_diversity(lists: DataFrame, titles: DataFrame) -> DataFrame:
    """Mean Jaccard distance between the titles of each list's items; ``titles`` has product_id, tokens.

    Pairs are made inside a list of top-k items only, so k * (k - 1) / 2 each.
    """
    rows = lists.select("query_id", "mode", "rank", "product_id").join(titles, "product_id")
    left, right = rows.select("query_id", "mode", F.col("rank").alias("i"), F.col("tokens").alias("a")), rows.select("query_id", "mode", F.col("rank").alias("j"), F.col("tokens").alias("b"))
    either = F.size(F.array_union("a", "b"))
    distance = F.when(either > 0, 1 - F.size(F.array_intersect("a", "b")) / either).otherwise(0.0)
    return left.join(right, ["query_id", "mode"]).filter("i < j").groupBy("query_id", "mode").agg(F.avg(distance).alias("title_distance"))


def with_products(found: DataFrame, products: DataFrame, snippet: int = 240) -> DataFrame:
    """Hits with display fields; ``missing_product`` marks ids that the catalog lacks."""
    shown = products.select("product_id", "title", "brand", "color", F.substring(F.coalesce("description", F.lit("")), 1, snippet).alias("snippet"), F.lit(False).alias("_miss"))
    return found.join(shown, "product_id", "left").withColumn("missing_product", F.coalesce("_miss", F.lit(True))).drop("_miss")


def diversified(found: DataFrame, products: DataFrame, per_brand: int = 2) -> DataFrame:
    """At most ``per_brand`` items of a brand first, the rest behind them, ranks renumbered."""
    named = found.join(products.select("product_id", F.coalesce("normalized_brand", F.col("product_id")).alias("_b")), "product_id", "left")
    nth = F.row_number().over(Window.partitionBy("query_id", "mode", "_b").orderBy("rank"))
    late = named.withColumn("_late", (nth > per_brand).cast("int"))
    return late.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "mode").orderBy("_late", "rank"))).drop("_b", "_late")
