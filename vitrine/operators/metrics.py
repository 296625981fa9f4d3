"""Ranking and retrieval metrics, their aggregates, bootstrap intervals and comparisons, for all queries at once.

Only the first rows of a ranking up to the largest cutoff are ever windowed; everything about a whole pool
(relevant items, ideal gain) comes from counts per label, so a hot query is no larger than any other.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.grouprank import DEFAULT_LIMIT, row_number, running_before
from vitrine.scratch import materialize

#: Labels that count as relevant.
THRESHOLDS = {"exact": (3,), "exact_or_substitute": (3, 2)}
GAINS = (0.0, 0.01, 0.1, 1.0)
TOLERANCE = 1e-12


def ranked_pool(pool: DataFrame, stages: Sequence[str], limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """``query_id``, ``stage``, ``product_id``, ``label_id``, ``gain``, ``rank`` from one score column per stage.

    Order: score rounded to nine digits, descending, then product_id; a null score ranks last.
    """
    pairs = ", ".join(f"'{s}', {s}" for s in stages)
    long = pool.selectExpr("query_id", "product_id", "label_id", "gain", f"stack({len(stages)}, {pairs}) AS (stage, score)")
    order = [(F.round(F.coalesce("score", F.lit(float("-inf"))), 9) + 0.0).desc(), F.col("product_id")]  # no negative zero
    return row_number(long, ["query_id", "stage"], order, "rank", limit)


def _ideal(k: int) -> Column:
    """DCG of the best order, from the numbers of items per label."""
    sums = [0.0]
    for i in range(1, k + 1):
        sums.append(sums[-1] + 1 / math.log2(i + 1))
    table = F.array(*[F.lit(s) for s in sums])

    def until(n: Column) -> Column:
        return F.element_at(table, (F.least(n, F.lit(k)) + 1).cast("int"))

    a, b, c = F.col("n3"), F.col("n3") + F.col("n2"), F.col("n3") + F.col("n2") + F.col("n1")
    return GAINS[3] * until(a) + GAINS[2] * (until(b) - until(a)) + GAINS[1] * (until(c) - until(b))


def _pool_counts(pool: DataFrame) -> DataFrame:
    return pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("label_id") == i).cast("int")).alias(f"n{i}") for i in range(4)])


def ndcg(ranked: DataFrame, pool: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """``query_id``, ``stage``, ``cutoff``, ``ndcg``: direct gains, 0 where the ideal is 0."""
    gain = F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)
    dcg = ranked.filter(F.col("rank") <= max(cutoffs)).groupBy("query_id", "stage").agg(*[F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"d{k}") for k in cutoffs])
    joined = dcg.join(_pool_counts(pool), "query_id")
    values = [F.when(_ideal(k) > 0, F.col(f"d{k}") / _ideal(k)).otherwise(0.0).alias(f"v{k}") for k in cutoffs]
    wide = joined.select("query_id", "stage", *values)
    return wide.selectExpr("query_id", "stage", f"stack({len(cutoffs)}, {', '.join(f'{k}, v{k}' for k in cutoffs)}) AS (cutoff, ndcg)")


def closed_pool(ranked: DataFrame, pool: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """Long rows (query_id, stage, threshold, cutoff, precision, mrr, map, exact_hit) of complete pools.

    Precision divides by min(cutoff, pool size); MAP divides by all relevant items of the pool.
    """
    head = ranked.filter(F.col("rank") <= max(cutoffs))
    order = Window.partitionBy("query_id", "stage").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    for t, labels in THRESHOLDS.items():
        rel = F.coalesce(F.col("label_id").isin(*labels), F.lit(False)).cast("int")
        head = head.withColumn(f"r_{t}", rel).withColumn(f"c_{t}", F.sum(rel).over(order))
    aggs = []
    for t in THRESHOLDS:
        rel = F.col(f"r_{t}") == 1
        for k in cutoffs:
            top = rel & (F.col("rank") <= k)
            aggs += [
                F.sum(top.cast("int")).alias(f"hits_{t}_{k}"),
                F.min(F.when(top, F.col("rank"))).alias(f"first_{t}_{k}"),
                F.sum(F.when(top, F.col(f"c_{t}") / F.col("rank")).otherwise(0.0)).alias(f"ap_{t}_{k}"),
            ]
    wide = head.groupBy("query_id", "stage").agg(*aggs).join(_pool_counts(pool), "query_id")
    rows = []
    for t, labels in THRESHOLDS.items():
        relevant = sum((F.col(f"n{i}") for i in labels[1:]), F.col(f"n{labels[0]}"))
        for k in cutoffs:
            rows.append(
                F.struct(
                    F.lit(t).alias("threshold"),
                    F.lit(k).alias("cutoff"),
                    (F.col(f"hits_{t}_{k}") / F.least(F.lit(k), F.col("n"))).alias("precision"),
                    F.coalesce(1.0 / F.col(f"first_{t}_{k}"), F.lit(0.0)).alias("mrr"),
                    F.when(relevant > 0, F.col(f"ap_{t}_{k}") / relevant).otherwise(0.0).alias("map"),
                    (F.col(f"hits_exact_{k}") > 0).cast("int").alias("exact_hit"),
                )
            )
    return wide.select("query_id", "stage", F.explode(F.array(*rows)).alias("m")).select("query_id", "stage", "m.*")


def retrieval(queries: DataFrame, ranked: DataFrame, judgments: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """Metrics of lists whose items may be unjudged; a query without a list keeps zeros.

    Of the items returned, a share is known (``known_judgment_coverage``) and the rest is not (``unjudged_rate``):
    the two sum to 1 for every list that is not empty. ``ranked`` has query_id, product_id, rank; ``judgments`` query_id, product_id, label_id.
    """
    head = ranked.filter(F.col("rank") <= max(cutoffs)).join(judgments, ["query_id", "product_id"], "left")
    relevant = judgments.groupBy("query_id").agg(*[F.sum(F.col("label_id").isin(*v).cast("int")).alias(f"all_{t}") for t, v in THRESHOLDS.items()])
    aggs = []
    for k in cutoffs:
        top = F.col("rank") <= k
        aggs += [F.sum(top.cast("int")).alias(f"n_{k}"), F.sum((top & F.col("label_id").isNotNull()).cast("int")).alias(f"known_{k}")]
        for t, v in THRESHOLDS.items():
            rel = top & F.coalesce(F.col("label_id").isin(*v), F.lit(False))
            aggs += [F.sum(rel.cast("int")).alias(f"hits_{t}_{k}"), F.min(F.when(rel, F.col("rank"))).alias(f"first_{t}_{k}")]
    wide = queries.select("query_id").join(head.groupBy("query_id").agg(*aggs), "query_id", "left").join(relevant, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = []
    for t in THRESHOLDS:
        for k in cutoffs:
            rows.append(
                F.struct(
                    F.lit(t).alias("threshold"),
                    F.lit(k).alias("cutoff"),
                    F.when(zero(f"all_{t}") > 0, zero(f"hits_{t}_{k}") / F.col(f"all_{t}")).otherwise(0.0).alias("judged_recall"),
                    F.coalesce(1.0 / F.col(f"first_{t}_{k}"), F.lit(0.0)).alias("judged_mrr"),
                    (zero(f"hits_exact_{k}") > 0).cast("int").alias("exact_hit"),
                    F.when(zero(f"n_{k}") > 0, F.col(f"known_{k}") / F.col(f"n_{k}")).otherwise(0.0).alias("known_judgment_coverage"),
                    F.when(zero(f"n_{k}") > 0, (F.col(f"n_{k}") - F.col(f"known_{k}")) / F.col(f"n_{k}")).otherwise(0.0).alias("unjudged_rate"),
                )
            )
    return wide.select("query_id", F.explode(F.array(*rows)).alias("m")).select("query_id", "m.*")


#: What may be measured how.
CLOSED_POOL, RETRIEVAL, END_TO_END = "closed_pool_v1", "retrieval_catalog_v1", "end_to_end_diagnostic_v1"


class ProtocolError(ValueError):
    """A list was to be measured under a protocol that does not fit it."""


def pool_fit(ranked: DataFrame, judgments: DataFrame) -> DataFrame:
    """Per query of either side: ``returned``, ``judged``, ``unjudged`` items returned, judged items ``missing`` from the
    list, ``repeated`` items, and ``closed``: the list is exactly the judged pool, so closed-pool metrics hold."""
    own = ranked.groupBy("query_id", "product_id").agg(F.count(F.lit(1)).alias("_times"))
    both = own.join(judgments.select("query_id", "product_id", F.lit(1).alias("_known")).distinct(), ["query_id", "product_id"], "full")
    count = lambda c: F.sum(c.cast("int"))
    out = both.groupBy("query_id").agg(
        F.coalesce(F.sum("_times"), F.lit(0)).alias("returned"),
        F.count("_known").alias("judged"),
        count(F.col("_times").isNotNull() & F.col("_known").isNull()).alias("unjudged"),
        count(F.col("_times").isNull()).alias("missing"),
        F.coalesce(F.sum(F.col("_times") - 1), F.lit(0)).alias("repeated"),
    )
    return out.withColumn("closed", F.expr("unjudged = 0 AND missing = 0 AND repeated = 0"))


def evaluate(protocol: str, queries: DataFrame, ranked: DataFrame, judgments: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """The metrics of ``protocol`` and no others: closed-pool metrics need lists that are exactly the judged pools,
    retrieval metrics are for lists over a catalogue.

    ``ranked`` has query_id, product_id, rank; ``judgments`` query_id, product_id, label_id, gain. A list that does
    not fit its protocol is a :class:`ProtocolError`, found by one aggregate before anything is measured.
    """
    if not cutoffs or any(k < 1 for k in cutoffs):
        raise ProtocolError("cutoffs are positive")
    if protocol == CLOSED_POOL:
        if not pool_fit(ranked, judgments).filter("NOT closed").isEmpty():
            raise ProtocolError("closed-pool metrics need complete judged pools")
        joined = ranked.join(judgments, ["query_id", "product_id"]).withColumn("stage", F.lit("list"))
        scores = ndcg(joined, judgments, cutoffs).select("query_id", "cutoff", "ndcg")
        return closed_pool(joined, judgments, cutoffs).join(scores, ["query_id", "cutoff"]).drop("stage")
    if protocol in (RETRIEVAL, END_TO_END):
        if not contiguity(ranked, ["query_id"], "rank").filter("NOT contiguous").isEmpty():
            raise ProtocolError("ranks are 1 to n without gaps or repeats")
        return retrieval(queries, ranked, judgments, cutoffs)
    raise ProtocolError(f"no such protocol: {protocol}")


def contiguity(ranked: DataFrame, groups: Sequence[str], rank: str) -> DataFrame:
    """Per group ``row_count``, ``null_ranks``, ``distinct_ranks``, ``highest`` and ``contiguous``: the ranks are 1 to n.

    Two group-bys, each combining on the map side; no group meets in one task.
    """
    per = ranked.groupBy(*groups, rank).agg(F.count(F.lit(1)).alias("_n"))
    out = per.groupBy(*groups).agg(
        F.sum("_n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col(rank).isNull(), F.col("_n"))), F.lit(0)).alias("null_ranks"),
        F.count(rank).alias("distinct_ranks"),
        F.min(rank).alias("_low"),
        F.max(rank).alias("highest"),
    )
    ok = F.expr("null_ranks = 0 AND _low = 1 AND highest = row_count AND distinct_ranks = row_count")
    return out.withColumn("contiguous", F.coalesce(ok, F.lit(False))).drop("_low")


def quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """``groups`` and a column per share: exact quantiles with linear interpolation, nulls left out.

    The rows next to each wanted place are found by their row numbers, so a group of any size is cut over range
    partitions instead of held in one task.
    """
    known = df.select(*groups, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    # equal values of a group are one row, so the order is total
    counts = known.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running_before(counts.withColumn("_w", F.col("_c")), groups, [F.col("_v")], "_w", "_before")
    sizes = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    on = reduce(lambda x, y: x & y, [F.col(f"p.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups])
    met = placed.alias("p").join(sizes.alias("s"), on).select(*[F.col(f"p.{g}") for g in groups], "_v", "_c", "_before", "_n")
    aggs = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_n") - 1)
        holds = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_c"))
        low, high = F.max(F.when(holds(F.floor(at)), F.col("_v"))), F.max(F.when(holds(F.ceil(at)), F.col("_v")))
        part = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * part).alias(name))
    return met.groupBy(*groups).agg(*aggs)


def slices(metrics: DataFrame, base: Sequence[str], dimensions: Sequence[str], value: str) -> DataFrame:
    """Mean, exact median and count of ``value`` for everything and for each value of each dimension (null is 'unknown')."""
    cells = [F.struct(F.lit("all").alias("slice_name"), F.lit("all").alias("slice_value"))]
    cells += [F.struct(F.lit(d).alias("slice_name"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("slice_value")) for d in dimensions]
    long = materialize(metrics.select(*base, F.col(value).alias("_value"), F.explode(F.array(*cells)).alias("c")).select(*base, "c.*", "_value"), "slices")
    keys = [*base, "slice_name", "slice_value"]
    means = long.groupBy(*keys).agg(F.avg("_value").alias("mean"), F.count(F.lit(1)).alias("queries"))
    return means.join(quantiles(long, keys, "_value", {"median": 0.5}), keys).select(*keys, "mean", "median", "queries")


#: The distribution function of a Poisson variable with mean 1 at 0, 1, 2, ...
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))
#: Replicates whose weights come from one hash: each takes this many of its 64 hex digits.
_DIGITS, _PER_HASH = 13, 4


def poisson_sql(u: str) -> str:
    """The Poisson weight of a uniform draw, the same for Spark and the oracle."""
    return "CASE " + " ".join(f"WHEN {u} < {p!r} THEN {k}" for k, p in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"


def bootstrap(values: DataFrame, series: Sequence[str], group: str, value: str, replicates: int) -> DataFrame:
    """``series`` columns, ``mean``, ``lower``, ``upper``, ``groups``: percentile intervals over resampled groups.

    Queries are first summed per group. In replicate r a group counts as often as a Poisson variable with mean 1
    that is fixed by ``sha256(group | block)``, the same in every series: the Poisson form of drawing groups with
    replacement. No draw is joined: each row makes its weights, and sums combine on the map side, so the shuffle
    holds a row per series and block of replicates. A replicate that draws no group gives no estimate.
    """
    by_group = values.groupBy(*series, group).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    by_group = materialize(by_group, "groups")
    means = by_group.groupBy(*series).agg((F.sum("_sum") / F.sum("_n")).alias("mean"), F.count(F.lit(1)).alias("groups"))
    blocks = -(-replicates // _PER_HASH)
    rows = by_group.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("_h", F.sha2(F.concat_ws("|", F.col(group).cast("string"), F.col("_b").cast("string")), 256))
    sums = []
    for c in range(_PER_HASH):
        draw = f"(CAST(conv(substring(_h, {1 + c * _DIGITS}, {_DIGITS}), 16, 10) AS DOUBLE) / {16**_DIGITS}D)"
        weight = F.expr(poisson_sql(draw))
        sums += [F.sum(weight * F.col("_sum")).alias(f"_s{c}"), F.sum(weight * F.col("_n")).alias(f"_w{c}")]
    drawn = rows.groupBy(*series, "_b").agg(*sums)
    each = F.explode(F.array(*[F.struct((F.col("_b") * _PER_HASH + c).alias("r"), F.when(F.col(f"_w{c}") > 0, F.col(f"_s{c}") / F.col(f"_w{c}")).alias("e")) for c in range(_PER_HASH)]))
    drawn = drawn.select(*series, each.alias("x")).select(*series, "x.*").filter(F.col("r") < replicates)
    # ``replicates`` values of a series meet here, whatever the data
    ends = drawn.groupBy(*series).agg(F.percentile("e", F.lit(0.025)).alias("lower"), F.percentile("e", F.lit(0.975)).alias("upper"))
    return means.join(ends, list(series)).select(*series, "mean", "lower", "upper", "groups")


def paired(metrics: DataFrame, keys: Sequence[str], series: Sequence[str], value: str, treatment: str, baseline: str, lower_is_better: bool = False) -> DataFrame:
    """Per series: mean difference treatment - baseline, wins, ties, losses, queries; one pass pivots the stages."""
    wide = metrics.filter(F.col("stage").isin(treatment, baseline)).groupBy(*keys, *series).agg(
        F.max(F.when(F.col("stage") == treatment, F.col(value))).alias("_t"), F.max(F.when(F.col("stage") == baseline, F.col(value))).alias("_b")
    )
    delta = (F.col("_b") - F.col("_t")) if lower_is_better else (F.col("_t") - F.col("_b"))
    wide = wide.filter("_t IS NOT NULL AND _b IS NOT NULL").withColumn("_d", delta)
    return wide.groupBy(*series).agg(
        F.lit(treatment).alias("treatment"),
        F.lit(baseline).alias("baseline"),
        F.avg("_d").alias("mean_delta"),
        F.sum((F.col("_d") > TOLERANCE).cast("int")).alias("wins"),
        F.sum((F.abs("_d") <= TOLERANCE).cast("int")).alias("ties"),
        F.sum((F.col("_d") < -TOLERANCE).cast("int")).alias("losses"),
        F.count(F.lit(1)).alias("queries"),
    )


def largest_changes(metrics: DataFrame, keys: Sequence[str], series: Sequence[str], value: str, treatment: str, baseline: str, n: int = 20) -> DataFrame:
    """The ``n`` queries of each series with the largest absolute difference between two stages, with both values and
    the ``outcome``: win, loss or tie."""
    wide = metrics.filter(F.col("stage").isin(treatment, baseline)).groupBy(*keys, *series).agg(
        F.max(F.when(F.col("stage") == treatment, F.col(value))).alias("treatment_value"), F.max(F.when(F.col("stage") == baseline, F.col(value))).alias("baseline_value")
    )
    wide = wide.withColumn("delta", F.col("treatment_value") - F.col("baseline_value"))
    wide = wide.withColumn("outcome", F.when(F.col("delta") > TOLERANCE, "win").when(F.col("delta") < -TOLERANCE, "loss").otherwise("tie"))
    order = Window.partitionBy(*series).orderBy(F.round(F.abs("delta"), 9).desc(), *[F.col(k) for k in keys])
    return wide.filter("delta IS NOT NULL").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def champion(means: DataFrame, baseline: str = "rrf", improvement: float = 0.0, regression: float = 0.005) -> DataFrame:
    """``stage``, ``selection_score``, ``eligible``, ``selected`` from (stage, cutoff, value) means.

    A stage is eligible if it beats the baseline at one cutoff and at none falls behind by more than
    ``regression``. The highest mean over cutoffs wins; within 1e-12 the baseline and then name order wins.
    """
    base = means.filter(F.col("stage") == baseline).select("cutoff", F.col("value").alias("_base"))
    joined = means.join(F.broadcast(base), "cutoff").groupBy("stage").agg(F.avg("value").alias("selection_score"), F.max(F.col("value") - F.col("_base")).alias("_up"), F.min(F.col("value") - F.col("_base")).alias("_down"))
    eligible = (F.col("stage") == baseline) | ((F.col("_up") > improvement) & (F.col("_down") >= -regression))
    rated = joined.withColumn("eligible", eligible)
    order = Window.orderBy(F.col("eligible").desc(), F.round("selection_score", 12).desc(), (F.col("stage") != baseline).cast("int"), F.col("stage"))  # one row per stage
    return rated.withColumn("selected", F.row_number().over(order) == 1).select("stage", "selection_score", "eligible", "selected")


def best_single(means: DataFrame, first: str, second: str, keys: Sequence[str]) -> DataFrame:
    """Per key the better of two stages; the second only if strictly better."""
    wide = means.groupBy(*keys).agg(F.max(F.when(F.col("stage") == first, F.col("value"))).alias("_a"), F.max(F.when(F.col("stage") == second, F.col("value"))).alias("_b"))
    return wide.select(*keys, F.when(F.col("_b") > F.col("_a") + TOLERANCE, second).otherwise(first).alias("best_stage"), F.greatest("_a", "_b").alias("value"))


def percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact p50, p95, p99 with linear interpolation, the maximum and the number of measured values."""
    known = df.groupBy(group).agg(F.max(value).alias("maximum"), F.count(value).alias("measured"))
    found = quantiles(df, [group], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed(group, "_g")
    return known.join(found, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "p50", "p95", "p99", "maximum", "measured")
