"""Hash keys, buckets and draws that any engine can recompute from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts: Column | str) -> Column:
    """SHA-256 in hex of the parts joined by NUL; a null part makes the key null."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    joined = cols[0].cast("string")
    for c in cols[1:]:
        joined = F.concat(joined, F.lit("\u0000"), c.cast("string"))
    return F.sha2(joined, 256)


def hash_bucket(key: Column | str, buckets: int = 10_000) -> Column:
    """The first 64 bits of a hex key modulo ``buckets``."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(key, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(buckets)).cast("int")
