"""Equi-joins against a table with unique keys where a few left keys may hold most of the rows, or that must not be
a broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than 1 / HEAVY of all left rows are heavy, so there are fewer than HEAVY of them.
HEAVY = 5_000


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides. The planner goes by the bytes of files, which are a tenth or less of
    what a broadcast takes in the driver, so tables with a row per query, term or product are never left to it."""
    return df.hint("merge")


def heavy_light_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: str, heavy: int = HEAVY) -> DataFrame:
    """Left join of ``left`` with ``right``, whose ``keys`` are unique and whose column ``rows`` says how many
    left rows have the key. Heavy keys (fewer than ``heavy`` of them, by pigeonhole) are broadcast; only left
    rows with light keys are shuffled. ``rows`` is not in the result. Null keys match nothing.
    """
    extra = [c for c in right.columns if c not in keys and c != rows]
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("_n"))
    sized = right.crossJoin(F.broadcast(total))  # one row
    hot = sized.filter(F.col(rows) * heavy > F.col("_n")).select(*keys, *[F.col(c).alias(f"_h_{c}") for c in extra], F.lit(True).alias("_hot"))
    cold = sized.filter(F.col(rows) * heavy <= F.col("_n")).select(*keys, *extra)
    marked = left.join(F.broadcast(hot), list(keys), "left")
    done = marked.filter("_hot").select(*left.columns, *[F.col(f"_h_{c}").alias(c) for c in extra])
    rest = marked.filter("_hot IS NULL").select(*left.columns).join(cold, list(keys), "left").select(*left.columns, *extra)
    return done.unionByName(rest)
