"""Top N items of every group by statistics-guided skipping.

The rows are laid out once as Parquet: files clustered by group, rows inside a file by descending score, so
that the row groups of a file carry descending maximum scores in their footers. A reader task takes one file,
visits its row groups in descending maximum score, keeps the current N best items of each group, and skips
every row group whose maximum lies strictly below the current N-th score of each group that it contains.
The partial results (at most N rows per file and group) are merged by a window.

A hot group is spread over many files by the range partitioning on (group, hash of item); every file then
stops early on its own, and no task holds a group.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.scratch import new_path
from vitrine.sources.derived import derived

#: Rows of one row group in the layout; the unit of skipping.
ROW_GROUP_ROWS = 2_048


def write_clustered(df: DataFrame, groups: Sequence[str], item: str, score: str, path: str, row_group_rows: int = ROW_GROUP_ROWS) -> None:
    """Write the layout that :func:`top_n_from_layout` reads. Rows with null or NaN score are left out."""
    kept = df.filter(F.col(score).isNotNull() & ~F.isnan(score))
    (
        kept.repartitionByRange(*[F.col(g) for g in groups], F.xxhash64(F.col(item)))
        .sortWithinPartitions(F.col(score).desc())
        .write.option("compression", "zstd")
        .option("parquet.block.row.count.limit", row_group_rows)
        .parquet(path)
    )


class _Best:
    """The best ``n`` items of each group of a file, from rows that come in any order. A group holds at most 4 * n items;
    it is cut back when it has more, so each row costs the same however many row groups the file has."""

    def __init__(self, n: int) -> None:
        self.n, self.items, self.nth = n, {}, {}

    def add(self, group: tuple, item, key: tuple, row: tuple) -> None:
        """``key`` orders rows, the smallest is the best; its first part is the negative score."""
        own = self.items.setdefault(group, {})
        old = own.get(item)
        if old is None or key < old[0]:
            own[item] = (key, row)
        if len(own) > 4 * self.n:
            self.items[group] = dict(sorted(own.items(), key=lambda x: x[1][0])[: self.n])

    def settle(self, touched) -> None:
        for g in touched:
            own = self.items[g]
            if len(own) >= self.n:
                self.nth[g] = -sorted(k[0] for k, _ in own.values())[self.n - 1]

    def rows(self):
        for own in self.items.values():
            for _, row in sorted(own.values(), key=lambda x: x[0])[: self.n]:
                yield row


def _read_file(uri: str, names: list[str], groups: list[str], item: str, score: str, ties: list[str], n: int) -> tuple[list[tuple], int, int]:
    """(best rows, row groups read, row groups skipped) of one file."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, at = pafs.FileSystem.from_uri(_SCHEMES.sub("s3://", uri))
    best, read, skipped = _Best(n), 0, 0
    place = {c: k for k, c in enumerate(names)}
    gpos, ipos, spos, tpos = [place[g] for g in groups], place[item], place[score], [place[t] for t in ties]
    with fs.open_input_file(at) as source:
        file = pq.ParquetFile(source)
        meta = file.metadata
        column = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == score)
        tops = []
        for i in range(meta.num_row_groups):
            st = meta.row_group(i).column(column).statistics
            tops.append((st.max if st is not None and st.has_min_max else float("inf"), i))
        for top, i in sorted(tops, key=lambda x: (-x[0], x[1])):
            if best.nth:
                inside = file.read_row_group(i, columns=groups).group_by(groups).aggregate([])
                if all(top < best.nth.get(g, float("-inf")) for g in zip(*[inside.column(g).to_pylist() for g in groups], strict=True)):
                    skipped += 1
                    continue
            read += 1
            touched = set()
            part = file.read_row_group(i, columns=names).select(names)
            # only rows that can still count are taken apart; most of a later row group cannot
            inside = zip(*[part.column(g).to_pylist() for g in groups], strict=True)
            floor = np.fromiter((best.nth.get(g, float("-inf")) for g in inside), dtype=float, count=part.num_rows)
            part = part.take(np.flatnonzero(part.column(score).to_numpy() >= floor))
            for row in zip(*[column.to_pylist() for column in part.columns], strict=True):
                group, value, last = tuple(row[k] for k in gpos), row[spos], row[ipos]
                key = (-value, *((row[k] is None, row[k] if row[k] is not None else 0) for k in tpos), last is None, last.encode() if isinstance(last, str) else last or 0)
                best.add(group, last, key, row)
                touched.add(group)
            best.settle(touched)
    return list(best.rows()), read, skipped


_SCHEMES = re.compile(r"^s3[an]://")


def top_n_from_layout(layout: DataFrame, groups: Sequence[str], item: str, score: str, ties: Sequence[str], n: int) -> DataFrame:
    """Partial top N of each file of the layout, with ``_file``, ``_read`` and ``_skipped``: the file and how many of its
    row groups were read and skipped. A file without rows has one row of nulls besides these."""
    spark, files, names = layout.sparkSession, layout.inputFiles(), layout.columns
    told = [T.StructField("_file", T.StringType()), T.StructField("_read", T.IntegerType()), T.StructField("_skipped", T.IntegerType())]
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in layout.schema.fields], *told])
    glist, tlist = list(groups), list(ties)

    def reader(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, read, skipped = _read_file(uri, names, glist, item, score, tlist, n)
                rows = [(*r, uri, read, skipped) for r in rows] or [(*[None] * len(names), uri, read, skipped)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartitionByRange(len(files), "file")  # a hash would put several files into one task
    return listed.mapInArrow(reader, schema)


def skips(partial: DataFrame) -> DataFrame:
    """``file``, ``row_groups_read``, ``row_groups_skipped`` of every file."""
    return partial.groupBy(F.col("_file").alias("file")).agg(F.max("_read").alias("row_groups_read"), F.max("_skipped").alias("row_groups_skipped"))


def merged(partial: DataFrame, groups: Sequence[str], item: str, score: str, ties: Sequence[str], n: int, rank: str) -> DataFrame:
    """The result of the partial results; the same item lies in one file only, so they are distinct."""
    order = [F.col(score).desc(), *[F.col(t).asc_nulls_last() for t in ties], F.col(item).asc_nulls_last()]
    rows = partial.filter(F.col(score).isNotNull()).drop("_file", "_read", "_skipped")
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= n)


def top_n_per_group(
    df: DataFrame, groups: Sequence[str], item: str, score: str, ties: Sequence[str] = (), n: int = 10, row_group_rows: int = ROW_GROUP_ROWS, rank: str = "rank_in_group", inputs: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` best items of each group: ``groups``, ``item``, ``score``, ``ties`` and ``rank`` (1..n).

    Order: ``score`` descending, then each of ``ties`` ascending with nulls last, then ``item`` ascending by
    bytes with null last, so it is total. An item counts once per group, by its best row. Rows with null or
    NaN score are no candidates; infinities are ordinary scores. Null group values form a group of their own.
    A group with fewer than ``n`` items comes out whole. An empty table gives an empty result. Other columns
    of ``df`` are dropped, whatever their names; the name ``rank`` must differ from the used columns.

    ``inputs`` names the files that ``df`` comes from: their layout is then written once and read by every later
    call. Without it the layout serves this call only.
    """
    return merged(partial_top_n(df, groups, item, score, ties, n, row_group_rows, rank, inputs), groups, item, score, ties, n, rank)


def partial_top_n(df: DataFrame, groups: Sequence[str], item: str, score: str, ties: Sequence[str] = (), n: int = 10, row_group_rows: int = ROW_GROUP_ROWS, rank: str = "rank_in_group", inputs: Sequence[str] = ()) -> DataFrame:
    """The partial results of :func:`top_n_per_group`."""
    used = [*groups, item, score, *ties]
    if rank in used or len(set(used)) != len(used):
        raise ValueError("groups, item, score, ties and rank must be different columns")
    slim = df.select(*used)
    write = lambda rows, path: write_clustered(rows, groups, item, score, path, row_group_rows)
    if inputs:
        layout = derived(df.sparkSession, f"topn-{row_group_rows}", inputs, lambda: slim, write=write)
    else:
        path = new_path(df.sparkSession, "topn")
        write(slim, path)
        layout = df.sparkSession.read.schema(slim.schema).parquet(path)
    return top_n_from_layout(layout.select(*used), groups, item, score, ties, n)
