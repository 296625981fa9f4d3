"""BM25 over a term table: index statistics, search for many queries at once, pair scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions.text import tokens_sql
from vitrine.operators.grouprank import SLICES
from vitrine.operators.skewjoin import shuffled
from vitrine.scratch import materialize
from vitrine.sources.derived import derived

K1, B = 1.2, 0.75


def tokenized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``tokens``, ``doc_length``; null text has no tokens and length 0."""
    tokens = F.coalesce(F.expr(tokens_sql(text)), F.array().cast("array<string>"))
    return docs.select(key, tokens.alias("tokens")).withColumn("doc_length", F.size("tokens"))


def postings(tokens: DataFrame, key: str) -> DataFrame:
    """``term``, ``key``, ``tf``, ``doc_length``."""
    words = tokens.select(key, "doc_length", F.explode("tokens").alias("term"))
    return words.groupBy("term", key, "doc_length").agg(F.count(F.lit(1)).cast("int").alias("tf")).select("term", key, "tf", "doc_length")


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: ``docs`` (also those without tokens) and ``mean_length``."""
    return tokens.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("mean_length"))


def idf(docs: Column, df: Column) -> Column:
    """In single precision, as an index stores it."""
    return F.log(F.lit(1.0) + (docs - df + 0.5) / (df + 0.5)).cast("float").cast("double")


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """``term``, ``df``, ``idf``."""
    counted = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("docs"), F.col("df")).alias("idf"))  # one row


def term_score(k1: float = K1, b: float = B) -> Column:
    length = F.lit(1 - b) + F.lit(b) * F.col("doc_length") / F.col("mean_length")
    return F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """Distinct (query_id, term)."""
    return queries.select(query_id, F.explode(F.array_distinct(F.coalesce(F.expr(tokens_sql(text)), F.array().cast("array<string>")))).alias("term"))


@dataclass(frozen=True)
class Index:
    """An inverted index as tables: ``postings`` (term, key, tf, doc_length), ``terms`` (term, df, idf) and the one
    row of ``stats`` (docs, mean_length)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def build_index(docs: DataFrame, key: str, text: str) -> Index:
    """The index of ``docs``, written once to the shared folder for the queries of this call."""
    tokens = materialize(tokenized(docs, key, text), "tokens")
    post = materialize(postings(tokens, key), "postings")
    stats = materialize(corpus_stats(tokens), "stats")
    return Index(post, materialize(term_stats(post, stats), "terms"), stats)


def open_index(spark: SparkSession, inputs: Sequence[str], docs: Callable[[], DataFrame], key: str, text: str) -> Index:
    """The index of documents made from ``inputs``: built by the first query, read by all later ones."""
    tokens = derived(spark, "tokens", inputs, lambda: tokenized(docs(), key, text))
    post = derived(spark, "postings", inputs, lambda: postings(tokens, key), bucket_by="term")
    stats = derived(spark, "stats", inputs, lambda: corpus_stats(tokens))
    return Index(post, derived(spark, "terms", inputs, lambda: term_stats(post, stats)), stats)


def _rated(index: Index) -> DataFrame:
    return index.terms.crossJoin(F.broadcast(index.stats))  # one row


def search(index: Index, queries: DataFrame, key: str, query_id: str, query_text: str, k: int = 150) -> DataFrame:
    """The ``k`` best documents of each query: ``query_id``, ``key``, ``score``, ``rank``.

    Order: score rounded to nine digits, descending, then key. Only documents that share a term appear; a
    query without known terms has no rows. Null texts match nothing. The postings of a term with more than its
    share of all postings are dealt over as many parts as there are shuffle partitions, so neither a term of
    every document nor one of every query is one task.
    """
    parts = int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = materialize(query_terms(queries, query_id, query_text), "asked")
    total = index.terms.agg(F.sum("df").alias("_all"))
    # fewer than SLICES * parts terms can be hot, whatever the size of the index
    hot = F.broadcast(index.terms.crossJoin(F.broadcast(total)).filter(F.col("df") * (SLICES * parts) > F.col("_all")).select("term", F.lit(True).alias("_hot")))
    wanted = asked.select("term").distinct()
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(key), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    post = index.postings.join(wanted, "term", "left_semi").join(hot, "term", "left").withColumn("_part", part).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    asked = asked.join(hot, "term", "left").withColumn("_part", F.explode(every)).drop("_hot")
    # idf and lengths come with the asked terms, which are few; postings are met once
    asked = asked.join(_rated(index).select("term", "idf", "mean_length"), "term")
    total = asked.join(post, ["term", "_part"]).groupBy(query_id, key).agg(F.sum(term_score()).alias("score"))
    order = Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), F.col(key))
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def score_pairs(index: Index, queries: DataFrame, pairs: DataFrame, key: str, query_id: str, query_text: str) -> DataFrame:
    """Every (query_id, key) of ``pairs`` with its score, 0 where nothing matches."""
    asked = materialize(query_terms(queries, query_id, query_text), "asked")
    wanted = pairs.select(query_id, key).distinct()
    rated = shuffled(asked).join(_rated(index).select("term", "idf", "mean_length"), "term")
    hits = wanted.join(shuffled(rated), query_id).join(shuffled(index.postings), ["term", key])
    total = hits.groupBy(query_id, key).agg(F.sum(term_score()).alias("score"))
    return wanted.join(shuffled(total), [query_id, key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def lexical_specificity(index: Index, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """``query_id``, ``specificity``: mean idf of the query's known terms, 0 if it has none."""
    asked = query_terms(queries, query_id, query_text)
    mean = asked.join(shuffled(index.terms), "term").groupBy(query_id).agg(F.avg("idf").alias("specificity"))
    return queries.select(query_id).join(shuffled(mean), query_id, "left").withColumn("specificity", F.coalesce("specificity", F.lit(0.0)))
