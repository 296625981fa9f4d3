"""Table sinks: ordered Parquet, whole-group Parquet parts, CSV reports, canonical JSON, charts and tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.grouprank import running_over_all
from vitrine.scratch import materialize


def parquet(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Zstandard Parquet, sorted inside the files."""
    (df.sortWithinPartitions(*order) if order else df).write.mode(mode).option("compression", "zstd").parquet(path)


def ordered_parquet(df: DataFrame, path: str, order: Sequence[str], rows_per_file: int, mode: str = "errorifexists") -> None:
    """Globally ordered files of at most ``rows_per_file`` rows."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    ranged.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def grouped_parquet(df: DataFrame, path: str, group: str, order: Sequence[str] = (), rows_per_file: int = 100_000, mode: str = "errorifexists") -> None:
    """Files, each in a folder ``part=n``, that never split a group and have at most ``rows_per_file`` rows.

    Groups of more than half a file get one of their own; the others, in the order of their keys, go where their
    first row falls in steps of half a file, so none is overfull. A group that fits no file is an error.
    """
    half = max(rows_per_file // 2, 1)
    sizes = materialize(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    if not sizes.filter(F.col("_n") > rows_per_file).isEmpty():
        raise ValueError(f"a group has more than {rows_per_file} rows")
    placed = running_over_all(sizes.withColumn("_w", F.when(F.col("_n") > half, 0).otherwise(F.col("_n"))), [F.col(group).asc_nulls_first()], "_w", "_at")
    big = running_over_all(placed.withColumn("_one", (F.col("_n") > half).cast("int")), [F.col(group).asc_nulls_first()], "_one", "_bigs").select(group, "_n", "_at", "_bigs")
    # large groups are numbered below zero, the others from zero on
    part = F.when(F.col("_n") > half, -1 - F.col("_bigs")).otherwise(F.floor(F.col("_at") / half)).cast("long")
    parts = big.select(F.col(group).alias("_g"), part.alias("part"))
    rows = df.join(parts, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").repartition("part").sortWithinPartitions("part", group, *order)
    rows.write.mode(mode).option("compression", "zstd").partitionBy("part").parquet(path)


def report_csv(df: DataFrame, path: str, order: Sequence[str], most_rows: int = 1_000_000) -> None:
    """One CSV file of an aggregated report; more than ``most_rows`` rows are an error."""
    if not df.offset(most_rows).isEmpty():
        raise ValueError(f"a report has at most {most_rows} rows")
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, no NaN: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def json_digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def strict_json(text: str) -> object:
    """Parse JSON; a repeated key is an error."""

    def pairs(items: list[tuple[str, object]]) -> dict[str, object]:
        keys = [k for k, _ in items]
        if len(set(keys)) < len(keys):
            raise ValueError(f"repeated key among {sorted(keys)}")
        return dict(items)

    return json.loads(text, object_pairs_hook=pairs)


def markdown_table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    cells = [[str(c).replace("|", "\\|") for c in r] for r in [columns, *rows]]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(cells[0]), line(["---"] * len(columns)), *map(line, cells[1:])]) + "\n"


def bar_chart_svg(path: Path, title: str, bars: Sequence[tuple[str, float]], width: int = 640) -> None:
    """Horizontal bars with their values."""
    most = max([abs(v) for _, v in bars] or [1.0]) or 1.0
    body = [f'<text x="8" y="20" font-size="14">{escape(title)}</text>']
    for n, (label, v) in enumerate(bars):
        y = 36 + 22 * n
        body.append(f'<text x="8" y="{y + 13}" font-size="11">{escape(label)}</text><rect x="180" y="{y}" width="{(width - 260) * abs(v) / most:.1f}" height="16" fill="#4a78b5"/>')
        body.append(f'<text x="{186 + (width - 260) * abs(v) / most:.1f}" y="{y + 13}" font-size="11">{v:.4f}</text>')
    path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{48 + 22 * len(bars)}" font-family="sans-serif">{"".join(body)}</svg>\n', encoding="utf-8")
