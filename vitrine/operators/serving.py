"""What surrounds a batch search: request bounds, gates on measured times, findings, resumable encoding."""

from __future__ import annotations

import ipaddress
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.search import MODES

MOST_CHARS, MOST_K, MOST_BODY = 512, 50, 16_384


def accept(host: str, body: bytes, most: int = MOST_BODY) -> None:
    """A ValueError unless ``host`` (with or without a port) is this machine itself and ``body`` is small enough."""
    name = host.rsplit(":", 1)[0] if host.count(":") == 1 or host.startswith("[") and "]:" in host else host
    name = name.strip("[]")
    try:
        here = ipaddress.ip_address(name).is_loopback
    except ValueError:
        here = name.lower() == "localhost"
    if not here:
        raise ValueError(f"{host} is not this machine")
    if len(body) > most:
        raise ValueError(f"a request has at most {most} bytes")


@dataclass(frozen=True)
class Request:
    """A search request within its bounds."""

    query: str
    mode: str = "active"
    top_k: int = 10

    def __post_init__(self) -> None:
        if not self.query.strip() or len(self.query) > MOST_CHARS:
            raise ValueError(f"a query has 1 to {MOST_CHARS} characters")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if not 1 <= self.top_k <= MOST_K:
            raise ValueError(f"top_k is 1 to {MOST_K}")


def measure(run: Callable[[], object], warm: int = 2, rounds: int = 5, clock: Callable[[], float] = time.perf_counter) -> list[float]:
    """Milliseconds of ``rounds`` runs after ``warm`` that do not count."""
    for _ in range(warm):
        run()
    out = []
    for _ in range(rounds):
        began = clock()
        run()
        out.append((clock() - began) * 1000)
    return out


def percentile(values: Sequence[float], share: float) -> float:
    """With linear interpolation, as ``percentile`` in SQL."""
    ordered = sorted(values)
    at = share * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def gate(measured: Mapping[str, Sequence[float]], limits: Mapping[str, float], share: float = 0.95) -> dict[str, tuple[float, float, bool]]:
    """Stage -> (percentile, limit, passed). A stage without measurements fails."""
    return {s: (percentile(measured[s], share), m, percentile(measured[s], share) <= m) if measured.get(s) else (float("inf"), m, False) for s, m in limits.items()}


def negative_findings(comparisons: DataFrame, mean: str = "mean", lower: str = "lower") -> DataFrame:
    """Comparisons that show no gain: a mean of at most 0, or an interval that reaches 0."""
    found = F.when(F.col(mean) <= 0, "no_mean_gain").when(F.col(lower) <= 0, "interval_reaches_zero")
    return comparisons.withColumn("finding", found).filter("finding IS NOT NULL")


def seeded_baseline(pairs: DataFrame, query_id: str, item: str, seed: int = 42) -> DataFrame:
    """A random score in [0, 1) per pair that only depends on the seed and the pair."""
    key = F.concat_ws("\u0000", F.lit(str(seed)), F.col(query_id).cast("string"), F.col(item).cast("string"))
    return pairs.withColumn("random_score", F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12)))


def encode_missing(docs: DataFrame, done: DataFrame, key: str, text: str, encoder: Callable[[Column], Column]) -> DataFrame:
    """Vectors of the documents that ``done`` lacks: a broken run is resumed by what it already wrote."""
    return docs.join(done.select(key), key, "left_anti").select(key, encoder(F.col(text)).alias("vector"))
