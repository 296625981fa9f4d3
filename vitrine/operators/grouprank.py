"""Exact ranks and running sums inside groups, one of which may hold a third of all rows.

A window over a group puts the whole group into one task. A group with more than the share
1 / (SLICES * shuffle partitions) of all rows is therefore cut: its rows go to range partitions of
(group, order), get local positions there, and are shifted by the totals of the partitions before; the shift
table has one row per partition and large group. Fewer than SLICES * partitions groups can have such a share,
whatever the size of the data, so the list of them may be broadcast. Smaller groups take a window. Both ways
give the same values, and which of them a group takes depends on its share only, not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.scratch import materialize

#: A group is cut if it has more rows than a task would have if every shuffle partition were so many tasks.
SLICES = 4
#: The limit follows from the share; callers may give one in rows.
DEFAULT_LIMIT = None


def _limit(df: DataFrame, limit: int | None) -> int:
    if limit is not None:
        return limit
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(df.count() // (SLICES * max(parts, 1)), 1)


def _flag_hot(df: DataFrame, groups: Sequence[str], limit: int | None = DEFAULT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(cold, hot) rows; cold is ``df`` itself if no group is hot. The list of hot groups is bounded by the share
    above, or by rows / limit if a limit is given; it is written once, from one count per group."""
    hot = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > _limit(df, limit))
    hot = materialize(hot.select(*[F.col(g).alias(f"_h_{g}") for g in groups]), "hotgroups")
    if hot.isEmpty():
        return df, df.limit(0)
    on = None
    for g in groups:
        eq = F.col(g).eqNullSafe(F.col(f"_h_{g}"))
        on = eq if on is None else on & eq
    if limit is None:
        hot = F.broadcast(hot)  # fewer than SLICES * partitions rows
    return df.join(hot, on, "left_anti"), df.join(hot, on, "left_semi")


def _range_positions(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Adds ``_before``: the sum of ``value`` over the earlier rows of the group."""
    fields = [f for f in df.schema.fields]
    schema = T.StructType([*fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.DoubleType())])
    glist = list(groups)

    def local(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key, total = None, 0.0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            codes = np.zeros(n, dtype=bool)
            for g in glist:
                col = batch.column(batch.schema.get_field_index(g)).dictionary_encode("encode")
                idx = col.indices.to_numpy(zero_copy_only=False)
                codes[1:] |= idx[1:] != idx[:-1]
            val = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(float)
            first = tuple(batch.column(batch.schema.get_field_index(g))[0].as_py() for g in glist)
            if first != key:
                total = 0.0
            run = np.cumsum(val) - val
            starts = np.flatnonzero(codes)
            base = np.zeros(n)
            base[: starts[0] if len(starts) else n] = -total
            if len(starts):
                lengths = np.diff(np.append(starts, n))
                base[starts[0] :] = np.repeat(run[starts], lengths)
            before = run - base
            key = tuple(batch.column(batch.schema.get_field_index(g))[n - 1].as_py() for g in glist)
            total = before[-1] + val[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(before)], names=[*batch.schema.names, "_part", "_local"]
            )

    gcols = [F.col(g) for g in groups]
    spread = df.repartitionByRange(*gcols, *order).sortWithinPartitions(*gcols, *order).mapInArrow(local, schema)
    spread = materialize(spread, "positions")
    totals = spread.groupBy("_part", *groups).agg(F.max(F.col("_local") + F.col(value)).alias("_total"))
    # a row per partition and group that has rows there: a partition holds the end of one group and the start of
    # others, so there are at most as many rows as partitions and groups together, each of them few (see above)
    w = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        F.col("_part").alias("_s_part"), *[F.col(g).alias(f"_s_{g}") for g in groups], F.coalesce(F.sum("_total").over(w), F.lit(0.0)).alias("_shift")
    )
    on = F.col("_part") == F.col("_s_part")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    out = spread.join(F.broadcast(shift), on, "left").withColumn("_before", F.col("_local") + F.col("_shift"))
    return out.drop("_part", "_local", "_shift", "_s_part", *[f"_s_{g}" for g in groups])


def running_before(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, out: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Adds ``out`` (double): the sum of ``value`` over the rows of the group that come earlier in ``order``.

    ``order`` must be total within a group. Null groups form one group. ``value`` must not be null.
    """
    df = df.withColumn(value, F.col(value).cast("double"))
    cold, hot = _flag_hot(df, groups, limit)
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    small = cold.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0.0)))
    if cold is df:
        return small
    large = _range_positions(hot, groups, order, value).withColumnRenamed("_before", out)
    return small.unionByName(large.select(small.columns))


def running_over_all(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """The same with the whole table as one group: always by range partitions, never in one task."""
    whole = df.withColumns({value: F.col(value).cast("double"), "_whole": F.lit(0)})
    return _range_positions(whole, ["_whole"], order, value).withColumnRenamed("_before", out).drop("_whole")


def row_number(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Adds ``out`` (long): 1, 2, ... within each group by the total order ``order``."""
    return row_numbers(df, groups, {out: order}, limit=limit)


def row_numbers(df: DataFrame, groups: Sequence[str], orders: Mapping[str, Sequence[Column]], size: str | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Adds a row number for each of ``orders`` (and ``size``, the rows of the group); small groups need one
    exchange for all of them, and the hot ones are looked for once."""
    cold, hot = _flag_hot(df, groups, limit)
    small = cold.withColumns({out: F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long") for out, order in orders.items()})
    if size:
        small = small.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*groups)))
    if cold is df:
        return small
    large = hot.withColumn("_one", F.lit(1.0))
    for out, order in orders.items():
        large = _range_positions(large, groups, order, "_one").withColumn(out, (F.col("_before") + 1).cast("long")).drop("_before")
    if size:
        sizes = large.groupBy(*groups).agg(F.count(F.lit(1)).alias(size)).select(*[F.col(g).alias(f"_z_{g}") for g in groups], size)
        on = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_z_{g}")) for g in groups])
        large = large.join(F.broadcast(sizes), on).drop(*[f"_z_{g}" for g in groups])  # a row per hot group
    return small.unionByName(large.select(small.columns))
