"""Queries over sparse and dense retrieval and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import tokens_sql
from vitrine.functions.vectors import encode, vectors_sql
from vitrine.operators import dense, fusion, sparse
from vitrine.plans.common import table
from vitrine.scratch import spread
from vitrine.sources.derived import derived

#: The searches ask with every fiftieth record, against all products or vectors.
ASKED = "query_id % 50 = 0"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "products").select("product_id", F.concat_ws(" ", "title", "bullets").alias("text"))


def index(spark: SparkSession, sf: str) -> sparse.Index:
    """The BM25 index of the catalogue, built once."""
    return sparse.open_index(spark, [f"{sf}/products.parquet"], lambda: spread(_docs(spark, sf)), "product_id", "text")


def product_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``product_id``, ``vector`` of the catalogue, encoded once."""
    return derived(spark, "vectors", [f"{sf}/products.parquet"], lambda: spread(_docs(spark, sf)).select("product_id", encode("text").alias("vector")))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, "asked-vectors", [f"{sf}/query_records.parquet"], lambda: spread(table(spark, sf, "query_records")).select("query_id", encode("query").alias("vector")))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "query_records").filter(ASKED).select("query_id", F.col("query").alias("asked_text"))


def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "products").select("locale", F.explode(F.expr(tokens_sql("title"))).alias("term"))
    return words.groupBy("locale", "term").agg(F.count(F.lit(1)).alias("occurrences"))


def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).postings


def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).terms.withColumn("idf", F.round("idf", 6))


def bm25_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.search(index(spark, sf), _asked(spark, sf), "product_id", "query_id", "asked_text", 150).withColumn("score", F.round("score", 6))


def bm25_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "examples").select("query_id", "product_id")
    asked = table(spark, sf, "query_records").select("query_id", F.col("query").alias("asked_text"))
    return sparse.score_pairs(index(spark, sf), asked, pairs, "product_id", "query_id", "asked_text").withColumn("score", F.round("score", 6))


def specificity(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "query_records").select("query_id", F.col("query").alias("asked_text"))
    return sparse.lexical_specificity(index(spark, sf), asked, "query_id", "asked_text")


def query_lexical_specificity(spark: SparkSession, sf: str) -> DataFrame:
    return specificity(spark, sf).withColumn("specificity", F.round("specificity", 6))


def dense_norm_check(spark: SparkSession, sf: str) -> DataFrame:
    return dense.norm_check(table(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("norm", F.round("norm", 6))


def dense_knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = dense.knn(base, base.filter("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 10, skip_self=True)
    return found.withColumn("score", F.round("score", 6))


def dense_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pairs = base.select(F.col("vec_id").alias("vec_a"), (F.col("vec_id") + 1).alias("vec_b"))
    return dense.score_pairs(pairs, "vec_a", "vec_b", base, "vec_id", "embedding").withColumn("score", F.round("score", 6))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "candidates")
    return rows.groupBy("query_id", "product_id").agg(
        F.min("sparse_rank").alias("sparse_rank"), F.min("dense_rank").alias("dense_rank"), F.max("sparse_score").cast("double").alias("sparse_score"), F.max("dense_score").cast("double").alias("dense_score")
    )


def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Fused ranking of both sources for every query, repeated rows counted once."""
    fused = fusion.rank_fused(_merged(spark, sf), "query_id", "product_id", ["sparse_rank", "dense_rank"])
    count = F.col("sparse_rank").isNotNull().cast("int") + F.col("dense_rank").isNotNull().cast("int")
    return fused.select("query_id", "product_id", "sparse_rank", "dense_rank", count.alias("source_count"), F.round("rrf", 9).alias("rrf"), "rank")


def closed_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks recomputed inside each query's candidates, fused."""
    out = fusion.closed_rrf(_merged(spark, sf).select("query_id", "product_id", "sparse_score", "dense_score"), "query_id", "product_id", ["sparse_score", "dense_score"])
    return out.select("query_id", "product_id", "sparse_score_rank", "dense_score_rank", F.round("closed_rrf", 9).alias("closed_rrf"))


def rank_fractions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "predictions").groupBy("model_id", "query_id", "product_id").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score"))
    out = fusion.rank_fraction(rows, ["model_id", "query_id"], "score", "product_id", "rank_fraction")
    return out.select("model_id", "query_id", "product_id", F.round(F.col("rank_fraction").cast("double"), 6).alias("rank_fraction"))


def candidate_provenance(spark: SparkSession, sf: str) -> DataFrame:
    out = fusion.provenance(_merged(spark, sf), {"sparse": "sparse_rank", "dense": "dense_rank"})
    return out.groupBy("found_by", "degraded", "best_source").agg(F.count(F.lit(1)).alias("products"), F.countDistinct("query_id").alias("queries"))


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 and vector search over all products, fused."""
    asked = _asked(spark, sf)
    lexical = sparse.search(index(spark, sf), asked, "product_id", "query_id", "asked_text", 150)
    near = dense.knn(product_vectors(spark, sf), query_vectors(spark, sf).filter(ASKED), "product_id", "vector", "query_id", "vector", 150)
    fused = fusion.fuse({"sparse": lexical, "dense": near}, "query_id", "product_id")
    return fused.select("query_id", "product_id", "sparse_rank", "dense_rank", "source_count", F.round("rrf", 9).alias("rrf"), "rank")


def degraded_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Per query, which source gave nothing or had no query to ask with, and why."""
    return fusion.degradation(table(spark, sf, "query_records").select("query_id", "query"), table(spark, sf, "candidates"), {"sparse": "sparse_rank", "dense": "dense_rank"}, "query_id", "query")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms,
        bm25_postings,
        bm25_term_stats,
        bm25_search_topk,
        bm25_pair_scores,
        query_lexical_specificity,
        dense_norm_check,
        dense_knn_topk,
        dense_pair_scores,
        rrf_hybrid,
        closed_rrf,
        rank_fractions,
        candidate_provenance,
        hybrid_search,
        degraded_queries,
    )
}

_T = tokens_sql("text", False)
BM25 = f"""
docs AS (SELECT product_id, concat_ws(' ', title, bullets) AS text FROM products),
tok AS (SELECT product_id, {_T} AS tokens FROM docs),
len AS (SELECT product_id, len(tokens) AS doc_length FROM tok),
stats AS (SELECT count(*)::DOUBLE AS docs, avg(doc_length) AS mean_length FROM len),
post AS (SELECT term, product_id, count(*) AS tf FROM (SELECT product_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
rated AS (SELECT term, df, ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))::FLOAT::DOUBLE AS idf FROM terms, stats),
asked AS (SELECT DISTINCT query_id, unnest({tokens_sql("query", False)}) AS term FROM query_records),
scored AS (SELECT p.term, p.product_id, idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_length / mean_length)) AS s
  FROM post p JOIN rated r ON r.term = p.term JOIN len l ON l.product_id = p.product_id, stats)"""
DENSE = f"""
{vectors_sql("product_id", "text", "docs", "pv")},
{vectors_sql("query_id", "query", "query_records", "qv")}"""
_MERGED = "merged AS (SELECT query_id, product_id, min(sparse_rank) AS sparse_rank, min(dense_rank) AS dense_rank, max(sparse_score)::DOUBLE AS sparse_score, max(dense_score)::DOUBLE AS dense_score FROM candidates GROUP BY ALL)"
SQL = {
    "tokenize_terms": f"SELECT locale, term, count(*) AS occurrences FROM (SELECT locale, unnest({tokens_sql('title', False)}) AS term FROM products) GROUP BY locale, term",
    "bm25_postings": f"WITH {BM25} SELECT p.term, p.product_id, CAST(tf AS INTEGER) AS tf, CAST(doc_length AS INTEGER) AS doc_length FROM post p JOIN len USING (product_id)",
    "bm25_term_stats": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM rated",
    "bm25_search_topk": f"""WITH {BM25}, total AS (SELECT query_id, product_id, sum(s) AS score FROM asked JOIN scored USING (term) WHERE query_id % 50 = 0 GROUP BY ALL)
SELECT query_id, product_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) AS INTEGER) AS rank FROM total QUALIFY rank <= 150""",
    "bm25_pair_scores": f"""WITH {BM25}, pairs AS (SELECT DISTINCT query_id, product_id FROM examples),
hit AS (SELECT p.query_id, p.product_id, sum(s) AS score FROM pairs p JOIN asked a ON a.query_id = p.query_id JOIN scored t ON t.term = a.term AND t.product_id = p.product_id GROUP BY ALL)
SELECT query_id, product_id, round(coalesce(score, 0), 6) AS score FROM pairs LEFT JOIN hit USING (query_id, product_id)""",
    "query_lexical_specificity": f"""WITH {BM25}, m AS (SELECT query_id, avg(idf) AS s FROM asked JOIN rated USING (term) GROUP BY query_id)
SELECT query_id, round(coalesce(s, 0), 6) AS specificity FROM query_records LEFT JOIN m USING (query_id)""",
    "dense_norm_check": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) BETWEEN 0.999 AND 1.001 AS unit FROM embeddings",
    "dense_knn_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, b.vec_id, round(list_inner_product(q.e, b.e), 9) AS score FROM v q, v b WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "dense_pair_scores": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT a.vec_id AS vec_a, a.vec_id + 1 AS vec_b, round(coalesce(list_inner_product(a.e, b.e), 0), 6) AS score FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 1""",
    "rrf_hybrid": f"""WITH {_MERGED}, f AS (SELECT *, coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0) AS rrf, least(sparse_rank, dense_rank) AS best FROM merged)
SELECT query_id, product_id, sparse_rank, dense_rank, (sparse_rank IS NOT NULL)::INTEGER + (dense_rank IS NOT NULL)::INTEGER AS source_count, round(rrf, 9) AS rrf,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, best, product_id) AS INTEGER) AS rank FROM f WHERE best IS NOT NULL QUALIFY rank <= 200""",
    "closed_rrf": f"""WITH {_MERGED}, r AS (SELECT query_id, product_id,
  row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(sparse_score, '-infinity'::DOUBLE), 9) DESC, product_id) AS sparse_score_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(dense_score, '-infinity'::DOUBLE), 9) DESC, product_id) AS dense_score_rank FROM merged)
SELECT *, round(1.0::DOUBLE / (60 + sparse_score_rank) + 1.0::DOUBLE / (60 + dense_score_rank), 9) AS closed_rrf FROM r""",
    "rank_fractions": """
WITH p AS (SELECT model_id, query_id, product_id, max(score) FILTER (WHERE CAST(score AS VARCHAR) <> 'nan') AS score FROM predictions GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model_id, query_id ORDER BY round(coalesce(score, '-infinity'::DOUBLE), 9) DESC, product_id) AS r, count(*) OVER (PARTITION BY model_id, query_id) AS n FROM p)
SELECT model_id, query_id, product_id, round(((r - 1)::DOUBLE / greatest(n - 1, 1))::FLOAT::DOUBLE, 6) AS rank_fraction FROM r""",
    "hybrid_search": f"""WITH {BM25}, {DENSE}, total AS (SELECT query_id, product_id, sum(s) AS score FROM asked JOIN scored USING (term) WHERE query_id % 50 = 0 GROUP BY ALL),
sp AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, product_id) AS r FROM total QUALIFY r <= 150),
near AS (SELECT q.query_id, p.product_id, coalesce(sum(q.x * p.x), 0) AS score FROM (SELECT DISTINCT query_id FROM qv WHERE query_id % 50 = 0) i CROSS JOIN (SELECT DISTINCT product_id FROM pv) d
  JOIN qv q ON q.query_id = i.query_id JOIN pv p ON p.product_id = d.product_id AND p.dim = q.dim GROUP BY ALL),
full_ AS (SELECT i.query_id, d.product_id, round(coalesce(n.score, 0), 9) AS score FROM (SELECT DISTINCT query_id FROM qv WHERE query_id % 50 = 0) i CROSS JOIN (SELECT DISTINCT product_id FROM pv) d LEFT JOIN near n ON n.query_id = i.query_id AND n.product_id = d.product_id),
de AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS r FROM full_ QUALIFY r <= 150),
u AS (SELECT query_id, product_id, CAST(s.r AS INTEGER) AS sparse_rank, CAST(d.r AS INTEGER) AS dense_rank FROM sp s FULL JOIN de d USING (query_id, product_id)),
f AS (SELECT *, coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0) AS rrf FROM u)
SELECT query_id, product_id, sparse_rank, dense_rank, (sparse_rank IS NOT NULL)::INTEGER + (dense_rank IS NOT NULL)::INTEGER AS source_count, round(rrf, 9) AS rrf,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, least(sparse_rank, dense_rank), product_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 200""",
    "degraded_queries": """WITH c AS (SELECT query_id, count(sparse_rank) AS s, count(dense_rank) AS d FROM candidates GROUP BY query_id),
q AS (SELECT r.query_id, coalesce(s, 0) AS s, coalesce(d, 0) AS d, CASE WHEN query IS NULL OR trim(query) = '' THEN 'query_failed' ELSE 'unavailable' END AS why FROM query_records r LEFT JOIN c USING (query_id))
SELECT query_id, concat_ws(',', CASE WHEN d = 0 THEN 'dense' END, CASE WHEN s = 0 THEN 'sparse' END) AS degraded_sources,
  concat_ws(',', CASE WHEN d = 0 THEN 'dense_' || why END, CASE WHEN s = 0 THEN 'sparse_' || why END) AS reasons, d > 0 OR s > 0 AS served FROM q""",
    "candidate_provenance": f"""WITH {_MERGED}, p AS (SELECT query_id,
  concat_ws(',', CASE WHEN dense_rank IS NOT NULL THEN 'dense' END, CASE WHEN sparse_rank IS NOT NULL THEN 'sparse' END) AS found_by,
  concat_ws(',', CASE WHEN dense_rank IS NULL THEN 'dense' END, CASE WHEN sparse_rank IS NULL THEN 'sparse' END) AS degraded,
  CASE WHEN dense_rank = least(sparse_rank, dense_rank) THEN 'dense' WHEN sparse_rank = least(sparse_rank, dense_rank) THEN 'sparse' END AS best_source FROM merged)
SELECT found_by, degraded, best_source, count(*) AS products, count(DISTINCT query_id) AS queries FROM p GROUP BY ALL""",
}
