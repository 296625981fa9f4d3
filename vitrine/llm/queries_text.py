"""Queries of the problems whose operators work on texts: 2, 5, 8, 9, 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _p9(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from vitrine.llm.mixing import TOKENIZER_KEY, mix_sources

    vocabulary = spark.conf.get(TOKENIZER_KEY, "/opt/tokenizers/byte_bpe_50k.json")
    return mix_sources(_read(spark, sf, "documents"), _read(spark, sf, "source_targets"), "doc_id", "source", "text", vocabulary)


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The selected documents with their numbers of copies."""
    return _p9(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of every target source."""
    return _p9(spark, sf)[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents the larger part of which is keywords, links, tags or menu entries."""
    return p10_piles(spark, sf).filter("spam").select("doc_id")


def p10_piles(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each document that is piles."""
    from vitrine.llm.spam import find_piles

    return find_piles(_read(spark, sf, "documents"), "doc_id", "text", "lang")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a passage of a test item, with the item."""
    return p8_leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the number of the item's words that the document holds: about half of them, or more."""
    from vitrine.llm.leaks import PASSAGE, Want, find_leaks

    return find_leaks(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"), want=Want(PASSAGE, 0.48))


def p8_longest(spark: SparkSession, sf: str) -> DataFrame:
    """The longest verbatim matches of every test suffix with all their places."""
    from vitrine.llm.leaks import longest_matches

    return longest_matches(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p8_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without those that leak."""
    from vitrine.llm.leaks import without_leaks

    return without_leaks(_read(spark, sf, "documents"), p8_found(spark, sf))


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Clean description and bullets of every product, and whether they held markup."""
    from vitrine.llm.markup import clean_markup

    return clean_markup(_read(spark, sf, "products"), "product_id", ["description", "bullets"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The fields that held markup."""
    marked = p5_clean(spark, sf).selectExpr("product_id", "stack(2, 'description', description_markup, 'bullets', bullets_markup) AS (field_name, found)")
    return marked.filter("found").select("product_id", "field_name")


def _p2(spark: SparkSession, sf: str) -> DataFrame:
    from vitrine.llm.listings import same_products
    from vitrine.scratch import materialize

    return materialize(same_products(_read(spark, sf, "products"), _read(spark, sf, "canonical_brands"), _read(spark, sf, "canonical_colors")), "same")


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every listing with the product that it offers, the group's representative and size."""
    from vitrine.llm.listings import membership

    return membership(_p2(spark, sf))


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every listing with the representative of its product; the representatives themselves are left out."""
    linked = p2_groups(spark, sf).filter("product_id <> representative")
    return linked.selectExpr("representative AS product_id_a", "product_id AS product_id_b")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of listings of the same product."""
    from vitrine.llm.listings import pairs

    return pairs(_p2(spark, sf))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p2_pairs": p2_pairs, "p5_found": p5_found, "p5_clean": p5_clean, "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_longest": p8_longest, "p8_clean": p8_clean, "p10_found": p10_found, "p10_piles": p10_piles, "p9_selection": p9_selection, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
