"""Learning to rank: the training population, a pointwise ranker, lambda gradients and LambdaMART.

The audit, the features and the gradients of a table are plans. The rankers are fitted on all training rows and
stopped by all validation rows, dealt out by query over the tasks of one barrier stage (:mod:`boosting`); only the
trees come to the driver, and are sent to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.boosting import ROUNDS, Objective, Rows, Trees, boost
from vitrine.operators.grouprank import row_number, running_over_all
from vitrine.operators.skewjoin import shuffled
from vitrine.scratch import materialize

#: Pairs count if one of the two items is among the first so many, so a query has at most this many per item.
TRUNCATION = 30
#: Fixed value: the cutoff of the NDCG that boosting stops by.
CUTOFF = 10
#: Rows of whole queries that gradients are found for at once; a query with more is alone.
PIECE = 1 << 14


def training_population(matrix: DataFrame, query_id: str = "query_id", label: str = "label_id", least_rows: int = 2, least_labels: int = 2) -> tuple[DataFrame, DataFrame]:
    """(kept rows, audit). The audit has a row per query: rows, labels and why it is left out, or null.

    Counts come from a group-by, so a hot query meets in no window. Rows with a null label are left out first.
    """
    known = matrix.filter(F.col(label).isNotNull())
    counts = known.groupBy(query_id).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(label).alias("labels"))
    why = F.when(F.col("rows") < least_rows, "too_few_rows").when(F.col("labels") < least_labels, "single_label")
    audit = counts.withColumn("excluded", why)
    return known.join(shuffled(audit.filter("excluded IS NULL").select(query_id)), query_id, "left_semi"), audit


def lambda_gradients(scored: DataFrame, truncation: int = TRUNCATION) -> DataFrame:
    """``query_id``, ``product_id``, ``lambda``, ``hessian`` from ``query_id, product_id, gain, score``.

    Each pair with different gains adds |delta NDCG| * rho to the better and takes it from the worse item, with
    rho = 1 / (1 + exp(s_better - s_worse)). Only pairs with one item among the first ``truncation`` count: the
    join meets that many rows per item, never all pairs of a query.
    """
    scored = scored.select("query_id", "product_id", "gain", "score")
    ranked = row_number(scored, ["query_id"], [(F.round("score", 9) + 0.0).desc(), F.col("product_id")], "r")
    ideal = row_number(scored, ["query_id"], [F.col("gain").desc(), F.col("product_id")], "_i")
    best = ideal.select("query_id", (F.col("gain") / F.log2(F.col("_i") + 1.0)).alias("d")).groupBy("query_id").agg(F.sum("d").alias("idcg")).filter("idcg > 0")
    head = ranked.filter(F.col("r") <= truncation).select("query_id", F.col("gain").alias("g2"), F.col("score").alias("s2"), F.col("r").alias("r2"), F.col("product_id").alias("p2"))
    met = ranked.join(head, "query_id").join(best, "query_id").filter("gain <> g2 AND product_id <> p2")
    # a pair with both items in the head is met from both sides, one with a single head item from one side only
    change = F.abs(F.col("gain") - F.col("g2")) * F.abs(1 / F.log2(F.col("r") + 1.0) - 1 / F.log2(F.col("r2") + 1.0)) / F.col("idcg")
    sign = F.when(F.col("gain") > F.col("g2"), 1.0).otherwise(-1.0)
    rho = 1 / (1 + F.exp(sign * (F.col("score") - F.col("s2"))))
    own = met.select("query_id", "product_id", (sign * change * rho).alias("l"), (change * rho * (1 - rho)).alias("h"))
    other = met.filter(F.col("r") > truncation).select("query_id", F.col("p2").alias("product_id"), (-sign * change * rho).alias("l"), (change * rho * (1 - rho)).alias("h"))
    sums = own.unionByName(other).groupBy("query_id", "product_id").agg(F.sum("l").alias("lambda"), F.sum("h").alias("hessian"))
    zero = F.lit(0.0)
    return scored.select("query_id", "product_id").join(sums, ["query_id", "product_id"], "left").select("query_id", "product_id", F.coalesce("lambda", zero).alias("lambda"), F.coalesce("hessian", zero).alias("hessian"))


def bounded(rows: DataFrame, most: int, query_id: str = "query_id") -> DataFrame:
    """``rows`` if there are at most ``most``; else the rows of whole queries, by hash, that fit into them. For looking at
    large tables; no ranker and no query takes this."""
    sizes = materialize(rows.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    if (sizes.agg(F.sum("_n")).first()[0] or 0) <= most:
        return rows
    placed = running_over_all(sizes.withColumn("_size", F.col("_n")), [F.xxhash64(query_id), F.col(query_id)], "_size", "_before")
    return rows.join(placed.filter(F.col("_before") + F.col("_n") <= most).select(query_id), query_id, "left_semi")


class _Lists:
    """Rows by query, with what NDCG and its gradients need."""

    def __init__(self, frame: pd.DataFrame) -> None:
        self.frame = frame.sort_values(["query_id", "product_id"], kind="stable")
        self._index(np.bincount(pd.factorize(self.frame["query_id"])[0]) if len(frame) else np.zeros(0, dtype=np.int64), self.frame["gain"].to_numpy(dtype=float))

    @classmethod
    def of(cls, sizes: np.ndarray, gain: np.ndarray) -> _Lists:
        """Of queries with so many rows, in order."""
        out = cls.__new__(cls)
        out._index(sizes, gain)
        return out

    def _index(self, sizes: np.ndarray, gain: np.ndarray) -> None:
        self.sizes, self.gain = sizes, gain
        self.query = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.append(0, np.cumsum(sizes))[:-1]
        by = np.lexsort((-gain, self.query))
        place = np.arange(len(gain)) - np.repeat(self.first, sizes)
        part, head = gain[by] / np.log2(place + 2), place < CUTOFF
        self.ideal = np.bincount(self.query, part, len(sizes))
        self.ideal_cut = np.bincount(self.query[head], part[head], len(sizes))

    def ranks(self, score: np.ndarray) -> np.ndarray:
        """1, 2, ... in each query, by the rounded score, then product_id (the order of the rows)."""
        by = np.lexsort((np.arange(len(score)), -np.round(score, 9), self.query))
        rank = np.empty(len(score), dtype=np.int64)
        rank[by] = np.arange(len(score)) - np.repeat(self.first, self.sizes) + 1
        return rank

    def ndcg(self, score: np.ndarray) -> np.ndarray:
        """Of each query."""
        rank = self.ranks(score)
        head = rank <= CUTOFF
        dcg = np.bincount(self.query[head], self.gain[head] / np.log2(rank[head] + 1.0), len(self.sizes))
        return np.where(self.ideal_cut > 0, dcg / np.where(self.ideal_cut > 0, self.ideal_cut, 1.0), 0.0)

    def lambdas(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and curvatures as :func:`lambda_gradients` defines them: every row with the head of its query."""
        n, rank = len(score), self.ranks(score)
        grad, hess = np.zeros(n), np.zeros(n)
        heads = np.minimum(self.sizes, TRUNCATION)
        by = np.lexsort((rank, self.query))
        for at in range(0, n, PIECE):
            rows = np.arange(at, min(at + PIECE, n))
            count = heads[self.query[rows]]
            i = np.repeat(rows, count)
            j = by[self.first[self.query[i]] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)]
            keep = (rank[i] > rank[j]) & (self.gain[i] != self.gain[j]) & (self.ideal[self.query[i]] > 0)
            i, j = i[keep], j[keep]
            change = np.abs(self.gain[i] - self.gain[j]) * np.abs(1 / np.log2(rank[i] + 1.0) - 1 / np.log2(rank[j] + 1.0)) / self.ideal[self.query[i]]
            sign = np.where(self.gain[i] > self.gain[j], 1.0, -1.0)
            rho = 1 / (1 + np.exp(sign * (score[i] - score[j])))
            pull, bend = sign * change * rho, change * rho * (1 - rho)
            grad += np.bincount(i, pull, n) - np.bincount(j, pull, n)
            hess += np.bincount(i, bend, n) + np.bincount(j, bend, n)
        return grad, hess


def _by_queries(rows: Rows) -> Iterator[tuple[slice, _Lists]]:
    """Whole queries with up to PIECE rows together; where one begins depends on no other."""
    sizes = np.diff(rows.starts)
    k = 0
    while k < len(sizes):
        end = max(int(np.searchsorted(rows.starts, rows.starts[k] + PIECE, side="right")) - 1, k + 1)
        s = slice(int(rows.starts[k]), int(rows.starts[end]))
        yield s, _Lists.of(sizes[k:end], np.asarray(rows.gain[s]))
        k = end


class _Pointwise:
    """Regression of the label, judged by NDCG."""

    def base(self, labels: float, rows: int) -> float:
        return labels / rows if rows else 0.0

    def step(self, rows: Rows) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for at in range(0, len(rows.score), PIECE):
            s = slice(at, at + PIECE)
            yield s, rows.label[s] - rows.score[s], np.ones(len(rows.score[s]))

    def quality(self, rows: Rows) -> Iterator[np.ndarray]:
        for s, lists in _by_queries(rows):
            yield lists.ndcg(np.asarray(rows.score[s]))


class _Lambda(_Pointwise):
    """Lambda gradients, judged by NDCG."""

    def base(self, labels: float, rows: int) -> float:
        return 0.0

    def step(self, rows: Rows) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for s, lists in _by_queries(rows):
            yield s, *lists.lambdas(np.asarray(rows.score[s]))


def _fit(train: DataFrame, validation: DataFrame, features: Sequence[str], objective: Objective, rounds: int, tasks: int | None = None) -> Trees:
    """All rows, dealt out by query over ``tasks`` (as many as run at once), each ordered by query and product."""
    spark, m = train.sparkSession, len(features)
    if tasks is None:
        context = spark.sparkContext._jsc.sc()
        tasks = max(context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()), 1)
    numbers = ["label_id", "gain", *features]
    rows = None
    for part, held in ((train, False), (validation, True)):
        own = part.select(F.lit(held).alias("_held"), "query_id", "product_id", *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(numbers)])
        rows = own if rows is None else rows.unionByName(own)
    laid = rows.repartition(tasks, "query_id").sortWithinPartitions("_held", "query_id", "product_id", *[f"_{i}" for i in range(len(numbers))]).drop("product_id")
    told = laid.mapInArrow(lambda batches: boost(batches, m, objective, rounds), "model string", barrier=True).collect()
    return Trees.from_json(told[0].model) if told else Trees([[] for _ in features], objective.base(0.0, 0))


def fit_pointwise(train: DataFrame, validation: DataFrame, features: Sequence[str], rounds: int = ROUNDS) -> Trees:
    """Boosted regression of the label, stopped by the NDCG of the validation queries."""
    return _fit(train, validation, features, _Pointwise(), rounds)


def fit_lambdamart(train: DataFrame, validation: DataFrame, features: Sequence[str], rounds: int = ROUNDS) -> Trees:
    """Boosted trees on lambda gradients, stopped by the NDCG of the validation queries."""
    return _fit(train, validation, features, _Lambda(), rounds)


def predict(model: Trees, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``score``, over Arrow batches in as many tasks as the rows have."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most ROUNDS trees of a few leaves

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype=float)

    return rows.withColumn("score", run(F.array(*[F.col(f).cast("double") for f in features])))


def importance(model: Trees, features: Sequence[str]) -> list[tuple[str, float, int]]:
    """(feature, gain, splits)."""
    return [(f, g, int(n)) for f, g, n in zip(features, model.importance("gain"), model.importance("split"), strict=True)]
