"""Checks as data: every check is a row, none throws midway. And joins that assert their cardinality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """What a raw table must hold: columns by type, keys, required columns, allowed values."""

    name: str
    columns: Mapping[str, str]
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    domains: Mapping[str, tuple] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()


def validate(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(role, check_id, failures) of all checks of a table, from one aggregate and one count of keys.

    Missing columns are reported and the checks that need them left out. An empty table fails ``not_empty``.
    """
    spark = df.sparkSession
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    static = [("columns_present", sum(c not in have for c in spec.columns))]
    static.append(("columns_expected", sum(c not in spec.columns and c not in spec.ignored for c in have)))
    static.append(("types", sum(have[c] != t for c, t in spec.columns.items() if c in have)))
    aggs: list[tuple[str, Column]] = [("not_empty", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0))]
    aggs += [(f"not_null:{c}", F.coalesce(F.sum(F.col(c).isNull().cast("int")), F.lit(0))) for c in spec.required if c in have]
    for c, allowed in spec.domains.items():
        if c in have:
            outside = F.col(c).isNull() | ~F.col(c).isin(*allowed)
            aggs.append((f"domain:{c}", F.coalesce(F.sum(outside.cast("int")), F.lit(0))))
    row = df.agg(*[a.cast("bigint").alias(f"c{i}") for i, (_, a) in enumerate(aggs)])
    stacked = ", ".join(f"'{name}', c{i}" for i, (name, _) in enumerate(aggs))
    out = row.selectExpr(f"stack({len(aggs)}, {stacked}) AS (check_id, failures)")
    out = out.unionByName(spark.createDataFrame(static, "check_id string, failures bigint"))
    if all(k in have for k in spec.key):
        doubled = df.groupBy(*spec.key).count().filter(F.col("count") > 1)
        out = out.unionByName(doubled.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("failures")).withColumn("check_id", F.lit("unique_key")))
    return out.select(F.lit(spec.name).alias("role"), "check_id", "failures")


def key_uniqueness(df: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """(table_name, row_count, distinct_keys, duplicate_rows)."""
    grouped = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    ).select(F.lit(name).alias("table_name"), "row_count", "distinct_keys", "duplicate_rows")


def null_profile(df: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, nulls) of every column in one pass. NaN is no null."""
    row = df.agg(*[F.coalesce(F.sum(F.col(f"`{c}`").isNull().cast("int")), F.lit(0)).cast("bigint").alias(f"c{i}") for i, c in enumerate(df.columns)])
    stacked = ", ".join(f"'{c}', c{i}" for i, c in enumerate(df.columns))
    return row.selectExpr(f"'{name}' AS table_name", f"stack({len(df.columns)}, {stacked}) AS (column_name, nulls)")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows without a parent (anti-join); null keys have none."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, row_count, nulls, mean, std_pop, minimum, maximum) of numeric columns in one pass; NaN counts as null."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"m{i}"),
            F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"s{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    stacked = ", ".join(f"'{c}', rows, rows - n{i}, m{i}, s{i}, lo{i}, hi{i}" for i, c in enumerate(columns))
    return row.selectExpr(f"stack({len(columns)}, {stacked}) AS (feature, row_count, nulls, mean, std_pop, minimum, maximum)")


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def strict_map(col: Column | str, mapping: Mapping, otherwise_error: bool = True) -> Column:
    """``mapping[col]``; null stays null; any other value is an error (or null)."""
    col = F.col(col) if isinstance(col, str) else col
    hit = reduce(lambda acc, kv: acc.when(col == F.lit(kv[0]), F.lit(kv[1])), list(mapping.items())[1:], F.when(col == F.lit(next(iter(mapping))), F.lit(next(iter(mapping.values())))))
    if not otherwise_error:
        return hit
    return hit.when(col.isNotNull(), F.raise_error(F.concat(F.lit("unmapped value: "), col.cast("string")))).otherwise(F.lit(None))


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """``df`` if its keys are unique; else a ValueError. Costs one aggregate."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{what}: {', '.join(keys)} is not unique")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join whose keys must be unique on both sides."""
    return assert_unique(left, keys, "left side").join(assert_unique(right, keys, "right side"), list(keys), how)


def same_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(side, missing): how many keys of each side the other lacks."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    one = x.join(y, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("missing")).withColumn("side", F.lit("left_only"))
    two = y.join(x, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("missing")).withColumn("side", F.lit("right_only"))
    return one.unionByName(two).select("side", "missing")
