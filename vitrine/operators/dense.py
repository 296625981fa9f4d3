"""Exact inner-product search over vectors, as blocked matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.vectors import dot, norm

#: Queries that go to the tasks at once.
BLOCK = 4_096


def norm_check(vectors: DataFrame, key: str, vector: str, low: float = 0.999, high: float = 1.001) -> DataFrame:
    """``key``, ``norm``, ``unit``; a null vector has a null norm and is not unit."""
    n = norm(vector)
    return vectors.select(key, n.alias("norm"), F.coalesce(n.between(low, high), F.lit(False)).alias("unit"))


def _blocks(queries: DataFrame, key: str, vector: str, size: int):
    ids, rows = [], []
    for r in queries.select(key, vector).filter(F.col(vector).isNotNull()).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == size:
            yield ids, np.array(rows, dtype=np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, dtype=np.float64)


def knn(base: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str, k: int = 150, skip_self: bool = False, block: int = BLOCK) -> DataFrame:
    """The ``k`` vectors with the largest inner product of each query: ``query_id``, ``key``, ``score``, ``rank``.

    Exact. Queries go out in blocks of ``block``, every task keeps its own k best of each query (ties by key),
    and a window merges them, so a query meets at most k rows of each task there. Order: score rounded to nine
    digits, descending, then key. Null vectors are left out; all vectors must have one length.
    """
    kind, asked = base.schema[key].dataType, queries.schema[query_key].dataType
    schema = T.StructType([T.StructField("query_id", asked), T.StructField(key, kind), T.StructField("score", T.DoubleType())])
    spark, parts = base.sparkSession, []
    usable = base.select(key, vector).filter(F.col(vector).isNotNull())
    for ids, matrix in _blocks(queries, query_key, query_vector, block):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches, shared=shared):
            from pyspark.sql.pandas.types import to_arrow_schema

            out = to_arrow_schema(schema)
            own_ids, asked_matrix = shared.value
            best: list[list[tuple[float, object]]] = [[] for _ in own_ids]
            most = k + skip_self  # the query itself may be among the best
            for batch in batches:
                keys = batch.column(0).to_pylist()
                if not keys:
                    continue
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                scores = np.round(asked_matrix @ flat.reshape(len(keys), -1).T, 9)
                for q, row in enumerate(scores):
                    floor = best[q][-1][0] if len(best[q]) >= k else -np.inf
                    at = np.flatnonzero(row >= floor)
                    if len(at) > 4 * most:  # keep ties at the last score
                        cut = np.partition(row[at], len(at) - most)[len(at) - most]
                        at = at[row[at] >= cut]
                    if len(at):
                        merged = best[q] + [(float(row[i]), keys[i]) for i in at.tolist() if not (skip_self and keys[i] == own_ids[q])]
                        merged.sort(key=lambda x: (-x[0], x[1]))
                        best[q] = merged[:k]
            rows = [(own_ids[q], i, s) for q, found in enumerate(best) for s, i in found]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        parts.append(usable.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def score_pairs(pairs: DataFrame, a: str, b: str, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``a``, ``b``, ``score`` of given pairs; 0 where a vector is missing."""
    left = vectors.select(F.col(key).alias(a), F.col(vector).alias("_va"))
    right = vectors.select(F.col(key).alias(b), F.col(vector).alias("_vb"))
    return pairs.join(left, a, "left").join(right, b, "left").select(a, b, F.coalesce(dot("_va", "_vb"), F.lit(0.0)).alias("score"))
