"""Reciprocal-rank fusion and ranks inside the current set, for all queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.grouprank import DEFAULT_LIMIT, row_numbers

CONSTANT, UNION_CAP = 60, 200


def _weight(rank: Column, constant: int) -> Column:
    return F.coalesce(1.0 / (F.lit(float(constant)) + rank), F.lit(0.0))


def fuse(lists: dict[str, DataFrame], query_id: str, item: str, constant: int = CONSTANT, cap: int = UNION_CAP) -> DataFrame:
    """Fuse ranked lists (``query_id``, ``item``, ``rank``, ``score``) of several sources.

    ``rrf`` is the sum of 1 / (constant + rank); ties go by the best source rank, then the item. The evidence
    of each source stays in nullable ``<source>_rank`` and ``<source>_score``; the first ``cap`` of a query remain.
    """
    names = list(lists)
    stacked = reduce(DataFrame.unionByName, [d.select(query_id, item, F.lit(s).alias("_source"), "rank", F.col("score").cast("double").alias("score")) for s, d in lists.items()])
    aggs = []
    for s in names:
        own = F.col("_source") == s
        aggs += [F.min(F.when(own, F.col("rank"))).alias(f"{s}_rank"), F.max(F.when(own, F.col("score"))).alias(f"{s}_score")]
    merged = stacked.groupBy(query_id, item).agg(*aggs, F.countDistinct("_source").cast("int").alias("source_count"), F.min("rank").alias("best_source_rank"))
    return rank_fused(merged, query_id, item, [f"{s}_rank" for s in names], constant, cap)


def rank_fused(merged: DataFrame, query_id: str, item: str, ranks: list[str], constant: int = CONSTANT, cap: int = UNION_CAP) -> DataFrame:
    """Adds ``rrf`` and ``rank`` to rows that hold the rank of each source; rows without any rank are dropped.

    Only the first ``cap`` of a query are kept, so every task sends at most that many rows of a query to the
    window (Spark's group limit, up to ``spark.sql.optimizer.windowGroupLimitThreshold``), hot query or not.
    """
    rrf = reduce(lambda x, y: x + y, [_weight(F.col(r), constant) for r in ranks])
    best = F.least(*[F.col(r) for r in ranks]) if len(ranks) > 1 else F.col(ranks[0])
    rows = merged.withColumns({"rrf": rrf, "_best": best}).filter("_best IS NOT NULL")
    order = Window.partitionBy(query_id).orderBy(F.round("rrf", 9).desc(), F.col("_best"), F.col(item))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).drop("_best")


def rank_fractions(df: DataFrame, group: list[str], scores: dict[str, str], item: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Adds a column for each (score, out) of ``scores``: (rank - 1) / max(n - 1, 1) in [0, 1] by score descending,
    then item; a null score ranks last."""
    orders = {f"_r_{out}": _best_first(score, item) for score, out in scores.items()}
    ranked = row_numbers(df, group, orders, size="_n", limit=limit)
    shares = {out: ((F.col(f"_r_{out}") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).cast("float") for out in scores.values()}
    return ranked.withColumns(shares).drop("_n", *orders)


def rank_fraction(df: DataFrame, group: list[str], score: str, item: str, out: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """:func:`rank_fractions` of one score."""
    return rank_fractions(df, group, {score: out}, item, limit)


def _best_first(score: str, item: str) -> list[Column]:
    return [(F.round(F.coalesce(score, F.lit(float("-inf"))), 9) + 0.0).desc(), F.col(item)]  # no negative zero


def closed_rrf(df: DataFrame, group: str, item: str, scores: list[str], constant: int = CONSTANT, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Ranks recomputed from direct scores inside the current set, fused: adds ``<score>_rank`` and ``closed_rrf``."""
    df = row_numbers(df, [group], {f"{s}_rank": _best_first(s, item) for s in scores}, limit=limit)
    return df.withColumn("closed_rrf", reduce(lambda x, y: x + y, [_weight(F.col(f"{s}_rank"), constant) for s in scores]))


def provenance(df: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """Adds ``found_by`` (sources with a rank, in name order), ``degraded`` (without) and ``best_source``."""
    names = sorted(ranks)
    found = F.array_compact(F.array(*[F.when(F.col(ranks[s]).isNotNull(), F.lit(s)) for s in names]))
    lost = F.array_compact(F.array(*[F.when(F.col(ranks[s]).isNull(), F.lit(s)) for s in names]))
    least = F.least(*[F.col(ranks[s]) for s in names])
    best = F.coalesce(*[F.when(F.col(ranks[s]) == least, F.lit(s)) for s in names])
    return df.withColumns({"found_by": F.array_join(found, ","), "degraded": F.array_join(lost, ","), "best_source": best})


def degradation(queries: DataFrame, found: DataFrame, ranks: dict[str, str], query_id: str, text: str) -> DataFrame:
    """``query_id``, ``degraded_sources``, ``reasons``, ``served`` for every query.

    A source is degraded for a query if it returned no item for it: the reason is ``<source>_query_failed`` if
    the query has no text to ask with, else ``<source>_unavailable``. A query is served if one source answered.
    """
    names = sorted(ranks)
    counts = found.groupBy(query_id).agg(*[F.count(ranks[s]).alias(f"_n_{s}") for s in names])
    rows = queries.select(query_id, text).join(counts, query_id, "left")
    none = {s: F.coalesce(F.col(f"_n_{s}"), F.lit(0)) == 0 for s in names}
    why = F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("query_failed")).otherwise(F.lit("unavailable"))
    lost = F.array_compact(F.array(*[F.when(none[s], F.lit(s)) for s in names]))
    reasons = F.array_compact(F.array(*[F.when(none[s], F.concat(F.lit(f"{s}_"), why)) for s in names]))
    served = ~reduce(lambda x, y: x & y, [none[s] for s in names])
    return rows.select(query_id, F.array_join(lost, ",").alias("degraded_sources"), F.array_join(reasons, ",").alias("reasons"), served.alias("served"))
