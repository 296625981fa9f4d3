"""The 44 pair features as one wide select of JVM expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import tokens_sql
from vitrine.operators.grouprank import running_over_all
from vitrine.operators.skewjoin import shuffled

#: A word that is a model number, in the tokenizer's terms.
MODEL = "^[a-z0-9]+([-_.][a-z0-9]+)*$"


@dataclass(frozen=True)
class Dialect:
    """Function names that differ between Spark and the oracle's engine."""

    spark: bool = True

    def size(self, x: str) -> str:
        return f"size({x})" if self.spark else f"len({x})"

    def both(self, a: str, b: str) -> str:
        return self.size(f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})")

    def either(self, a: str, b: str) -> str:
        return self.size(f"array_union({a}, {b})" if self.spark else f"list_distinct(list_concat({a}, {b}))")

    def keep(self, a: str, condition: str) -> str:
        return f"filter({a}, x -> {condition})" if self.spark else f"list_filter({a}, lambda x: {condition})"

    def like(self, x: str, pattern: str) -> str:
        return f"{x} RLIKE '{pattern}'" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})" if self.spark else f"list_distinct({x})"

    def text(self, x: str) -> str:
        return f"array_join({x}, ' ')" if self.spark else f"array_to_string({x}, ' ')"


def models_sql(x: str, d: Dialect) -> str:
    return d.distinct(d.keep(x, f"{d.like('x', MODEL)} AND {d.like('x', '[a-z]')} AND {d.like('x', '[0-9]')}"))


def feature_sql(d: Dialect) -> dict[str, str]:
    """Feature name -> expression over the columns of :func:`pair_view`, in the order of the model matrix."""
    q, t, e, u, p = "q_tokens", "t_tokens", "d_tokens", "b_tokens", "p_tokens"
    n = d.size
    share = lambda words: f"CASE WHEN {n(d.distinct(q))} = 0 THEN 0 ELSE {d.both(q, words)} / CAST({n(d.distinct(q))} AS DOUBLE) END"
    flag = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    present = lambda c: f"coalesce({c}, '') <> ''"
    return {
        "query_char_count": "char_length(q_text)" if d.spark else "length(q_text)",
        "query_token_count": n(q),
        "query_unique_token_ratio": f"CASE WHEN {n(q)} = 0 THEN 0 ELSE {n(d.distinct(q))} / CAST({n(q)} AS DOUBLE) END",
        "query_digit_token_count": n(d.keep(q, d.like("x", "[0-9]"))),
        "query_model_token_count": n("q_models"),
        "query_brand_detected": flag("q_brand IS NOT NULL"),
        "query_brand_confidence": "CASE WHEN q_brand IS NOT NULL THEN 1.0 ELSE 0.0 END",
        "query_color_detected": flag("q_color IS NOT NULL"),
        "query_color_confidence": "q_color_confidence",
        "query_lexical_specificity": "specificity",
        "locale_code": "1",
        "title_char_count": "char_length(clean_title)" if d.spark else "length(clean_title)",
        "title_token_count": n(t),
        "description_char_count": "char_length(clean_description)" if d.spark else "length(clean_description)",
        "description_token_count": n(e),
        "bullet_char_count": "char_length(clean_bullets)" if d.spark else "length(clean_bullets)",
        "bullet_token_count": n(u),
        "title_missing": flag("title_missing"),
        "brand_missing": flag("brand_missing"),
        "color_missing": flag("color_missing"),
        "bullets_missing": flag("bullets_missing"),
        "description_missing": flag("description_missing"),
        "product_text_completeness": "(" + " + ".join(flag(f"clean_{f} <> ''") for f in ("title", "brand", "color", "bullets", "description")) + ") / 5.0",
        "brand_code": "brand_code",
        "color_code": "color_code",
        "direct_bm25_score": "bm25",
        "bm25_rank_fraction": "bm25_fraction",
        "direct_dense_cosine": "dense",
        "dense_rank_fraction": "dense_fraction",
        "closed_rrf_score": "rrf",
        "closed_rrf_rank_fraction": "rrf_fraction",
        "title_token_jaccard": f"CASE WHEN {d.either(q, t)} = 0 THEN 0 ELSE {d.both(q, t)} / CAST({d.either(q, t)} AS DOUBLE) END",
        "title_query_coverage": share(t),
        "description_query_coverage": share(e),
        "bullet_query_coverage": share(u),
        "exact_phrase_match": flag(f"{n(q)} > 0 AND {'contains' if d.spark else 'contains'}(concat(' ', {d.text(p)}, ' '), concat(' ', {d.text(q)}, ' '))"),
        "brand_match": flag("coalesce(q_brand = normalized_brand, FALSE)"),
        "brand_conflict": flag(f"{present('q_brand')} AND {present('normalized_brand')} AND q_brand <> normalized_brand"),
        "color_match": flag("coalesce(q_color = normalized_color, FALSE)"),
        "color_conflict": flag(f"{present('q_color')} AND {present('normalized_color')} AND q_color <> normalized_color"),
        "model_token_match": flag(f"{d.both('q_models', 'p_models')} > 0"),
        "model_token_conflict": flag(f"{n('q_models')} > 0 AND {n('p_models')} > 0 AND {d.both('q_models', 'p_models')} = 0"),
        "compatibility_term_match": flag(f"{d.both('q_compatibility', p)} > 0"),
        "query_title_log_length_ratio": f"CASE WHEN {n(t)} = 0 THEN 0 ELSE least(ln(1 + {n(q)}) / ln(1 + {n(t)}), 4.0) / 4.0 END",
    }


def category_codes(products: DataFrame, column: str) -> DataFrame:
    """``column``, ``code``: 2, 3, ... for the sorted distinct values; unseen values are 1 and missing ones 0 later."""
    values = products.filter(F.col(column).isNotNull()).select(column).distinct().withColumn("_one", F.lit(1.0))
    return running_over_all(values, [F.col(column)], "_one", "_before").select(column, (F.col("_before") + 2).cast("int").alias("code"))


def with_code(df: DataFrame, codes: DataFrame, column: str, out: str) -> DataFrame:
    joined = df.join(shuffled(codes.withColumnRenamed("code", "_code")), column, "left")
    return joined.withColumn(out, F.when(F.col(column).isNull(), 0).otherwise(F.coalesce("_code", F.lit(1)))).drop("_code")


def product_view(cleaned: DataFrame) -> DataFrame:
    """Cleaned products with the token lists of their fields."""
    whole = "concat_ws(' ', clean_title, clean_brand, clean_color, clean_bullets, clean_description)"
    out = cleaned.withColumns({"t_tokens": F.expr(tokens_sql("clean_title")), "d_tokens": F.expr(tokens_sql("clean_description")), "b_tokens": F.expr(tokens_sql("clean_bullets")), "p_tokens": F.expr(tokens_sql(whole))})
    return out.withColumn("p_models", F.expr(models_sql("p_tokens", Dialect())))


def compute(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the 44 features of rows that hold the columns named in :func:`feature_sql`."""
    return pairs.select(*keys, *[F.expr(x).cast("double").alias(name) for name, x in feature_sql(Dialect()).items()])


#: Names that must never be a feature: they give the label away.
PROHIBITED = ("label_id", "gain", "esci_label", "split", "project_split", "official_split", "judgment_count", "example_id", "query_id", "product_id")


def leakage_report(features: list[str]) -> list[tuple[str, bool]]:
    """(prohibited name, does it occur among the features?)."""
    return [(name, name in features) for name in PROHIBITED]
