"""One ranking from several differently scaled scores: the first principal component of rank-transformed scores.

Every score is replaced by its mid-rank share within the rows that share its scale, so neither its range nor
outliers count. The correlation matrix of the shares is one distributed aggregate; its leading eigenvector,
with each loading turned to the declared direction, gives the projection that the items are sorted by.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.grouprank import DEFAULT_LIMIT, _flag_hot, _range_positions, row_number
from vitrine.operators.skewjoin import heavy_light_join
from vitrine.scratch import materialize


@dataclass(frozen=True)
class Score:
    """A score: rows with equal ``scale`` columns (besides the group) are comparable. ``direction`` is 1 if more
    is better, else -1. ``absent`` is the share of a row without the score. ``rank`` names a column with the
    one-based rank that stands in for a missing score."""

    column: str
    scale: tuple[str, ...] = ()
    direction: int = 1
    absent: float = 0.0
    rank: str | None = None


def _known(s: Score):
    return F.col(s.column).isNotNull() & ~F.isnan(s.column)


def _shares_small(df: DataFrame, group: Sequence[str], scores: Sequence[Score]) -> DataFrame:
    for i, s in enumerate(scores):
        part = Window.partitionBy(*group, *s.scale, _known(s))
        order = part.orderBy(F.col(s.column))
        share = (F.percent_rank().over(order) * (F.count(F.lit(1)).over(part) - 1) / F.count(F.lit(1)).over(part) + F.cume_dist().over(order)) / 2
        df = df.withColumn(f"_share{i}", F.when(_known(s), share))
        df = df.withColumn(f"_found{i}", F.sum(_known(s).cast("long")).over(Window.partitionBy(*group, *s.scale)))
    return df


def _shares_large(df: DataFrame, group: Sequence[str], item: str, scores: Sequence[Score]) -> DataFrame:
    """The same for groups that must not meet in one task: counts per distinct score and running sums of them,
    for all scores in one pass over a row per item and score."""
    text = lambda columns: F.to_json(F.struct(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"}) if columns else F.lit("")
    one = [
        F.struct(F.lit(i).alias("_i"), text(s.scale).alias("_f"), F.when(_known(s), F.col(s.column).cast("double") + 0.0).alias("_v"), (F.col(s.rank) if s.rank else F.lit(None)).cast("long").alias("_r"))
        for i, s in enumerate(scores)
    ]
    keys = ["_g", "_i", "_f"]
    long = df.select(*group, item, text(group).alias("_g"), F.explode(F.array(*one)).alias("o")).select(*group, item, "_g", "o.*")
    counts = long.filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).cast("double").alias("_cnt"))
    placed = materialize(_range_positions(counts, keys, [F.col("_v")], "_cnt"), "placed")
    # one row for each scale of a large group; there are few of those, by their bound
    sizes = materialize(placed.groupBy(*keys).agg(F.sum("_cnt").cast("long").alias("_found")), "sizes")
    shares = placed.join(F.broadcast(sizes), keys).withColumn("_share", (F.col("_before") + F.col("_cnt") / 2) / F.col("_found"))
    long = heavy_light_join(long, shares.select(*keys, "_v", "_cnt", "_share"), [*keys, "_v"], "_cnt")
    long = long.join(F.broadcast(sizes), keys, "left")
    own = lambda i, c: F.max(F.when(F.col("_i") == i, F.col(c)))
    back = []
    for i, s in enumerate(scores):
        back += [own(i, "_share").alias(f"_share{i}"), F.coalesce(own(i, "_found"), F.lit(0)).alias(f"_found{i}"), *([own(i, "_r").cast(df.schema[s.rank].dataType).alias(s.rank)] if s.rank else [])]
    return long.groupBy(*group, item).agg(*back)


def rank_shares(df: DataFrame, group: Sequence[str], item: str, latest: str, scores: Sequence[Score], limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """``group``, ``item`` and ``s0``, ``s1``, ... in [0, 1], plus ``k0``, ... telling if the score was there."""
    columns = list(dict.fromkeys([*group, item, latest, *[c for s in scores for c in (s.column, *s.scale, *([s.rank] if s.rank else []))]]))
    slim = df.select(*columns)
    small, large = _flag_hot(slim, group, limit)
    once = Window.partitionBy(*group, item).orderBy(F.col(latest).desc_nulls_last(), *[F.col(s.column).desc_nulls_last() for s in scores])
    # placed by group once: the windows below need no exchange of their own
    rows = _shares_small(small.repartition(*group).withColumn("_k", F.row_number().over(once)).filter("_k = 1").drop("_k"), group, scores)
    rows = rows.select(*group, item, *dict.fromkeys(s.rank for s in scores if s.rank), *[f"_{n}{i}" for i in range(len(scores)) for n in ("share", "found")])
    if small is not slim:
        large = materialize(large.withColumn("_k", F.row_number().over(once)).filter("_k = 1").drop("_k"), "hot")
        rows = rows.unionByName(_shares_large(large, group, item, scores).select(rows.columns))
    out = []
    for i, s in enumerate(scores):
        share = F.col(f"_share{i}")
        if s.rank:
            known = F.greatest(F.col(f"_found{i}"), F.col(s.rank))
            share = F.coalesce(share, F.when(F.col(s.rank).isNotNull(), (known - F.col(s.rank) + 0.5) / known))
        share = F.coalesce(share, F.lit(s.absent if s.direction > 0 else 1 - s.absent))
        out += [share.alias(f"s{i}"), F.col(f"_share{i}").isNotNull().alias(f"k{i}")]
    return rows.select(*group, item, *out)


def loadings(shares: DataFrame, scores: Sequence[Score]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loadings, means, deviations) from one aggregate; correlations use the rows that have both scores.

    The loadings are those of the leading eigenvector of the correlations of the scores as declared (a score
    with direction -1 counts negated), turned as a whole so that their sum is not negative. A score that
    contradicts the others keeps a loading against its direction; :func:`contradicting` names it.
    """
    m = len(scores)
    aggs = []
    for i in range(m):
        aggs += [F.avg(f"s{i}").alias(f"m{i}"), F.stddev_pop(f"s{i}").alias(f"d{i}")]
        for j in range(i + 1, m):
            both = F.col(f"k{i}") & F.col(f"k{j}")
            x, y = F.when(both, F.col(f"s{i}")), F.when(both, F.col(f"s{j}"))
            aggs += [F.covar_pop(x, y).alias(f"c{i}_{j}"), F.stddev_pop(x).alias(f"x{i}_{j}"), F.stddev_pop(y).alias(f"y{i}_{j}")]
    row = shares.agg(*aggs).first()
    corr = np.eye(m)
    for i in range(m):
        for j in range(i + 1, m):
            spread = (row[f"x{i}_{j}"] or 0.0) * (row[f"y{i}_{j}"] or 0.0)
            corr[i, j] = corr[j, i] = row[f"c{i}_{j}"] / spread if spread > 1e-12 else 0.0
    sign = np.array([s.direction for s in scores], dtype=float)
    first = np.linalg.eigh(corr * np.outer(sign, sign))[1][:, -1]
    first = (first if first.sum() >= 0 else -first) * sign
    clean = lambda prefix, default: np.array([default if row[f"{prefix}{i}"] is None else row[f"{prefix}{i}"] for i in range(m)], dtype=float)
    return first, clean("m", 0.0), clean("d", 0.0)


def contradicting(load: np.ndarray, scores: Sequence[Score]) -> list[str]:
    """Scores whose loading points against their declared direction."""
    return [s.column for s, x in zip(scores, load, strict=True) if x * s.direction < -1e-9]


def fused_ranking(df: DataFrame, group: Sequence[str], item: str, latest: str, scores: Sequence[Score], limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """``group``, ``item``, ``fused_score`` and ``fused_rank`` (1.. within the group, ties by item).

    An item counts once per group, by its row with the latest ``latest``. Null and NaN scores are missing: the
    row gets the share that its rank column implies, else the ``absent`` share. Infinite scores are ordinary.
    Groups whose scores are all equal get the share 1/2 each. A constant column has weight 0. A score that
    contradicts the others is warned of and has weight 0, so it cannot turn the ranking against its direction. An empty table
    gives an empty result. Other columns are dropped, whatever their names.
    """
    shares = materialize(rank_shares(df, group, item, latest, scores, limit), "shares")
    load, mean, dev = loadings(shares, scores)
    against = contradicting(load, scores)
    if against:
        warnings.warn(f"scores against their declared direction: {', '.join(against)}", stacklevel=2)
        load = np.array([0.0 if s.column in against else x for s, x in zip(scores, load, strict=True)])
    score = sum(((F.col(f"s{i}") - float(mean[i])) * float(load[i] / dev[i]) for i in range(len(scores)) if dev[i] > 1e-12), F.lit(0.0))
    scored = shares.select(*group, item, F.round(score, 12).alias("fused_score"))
    return row_number(scored, group, [F.col("fused_score").desc(), F.col(item).asc_nulls_last()], "fused_rank", limit)
