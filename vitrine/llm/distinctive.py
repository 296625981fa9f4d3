"""How distinctive a term is for its record: log-odds against the rest with a Dirichlet prior, as z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import tokens_sql
from vitrine.operators.skewjoin import heavy_light_join
from vitrine.scratch import materialize, spread

#: Weight of the prior in terms: the collection counts scaled to this sum.
PRIOR = 500.0
#: Terms with more than 1 / HEAVY_TERMS of all occurrences are joined by broadcast, so fewer than this many are.
HEAVY_TERMS = 50_000
#: Up to so many terms are counted inside the row of their text; longer texts are counted by a group-by.
ROW_TERMS = 1_000


def term_scores(records: DataFrame, ids: list[str], text: str, prior: float = PRIOR) -> DataFrame:
    """``ids``, ``term``, ``occurrences``, ``z_score`` of every term of every record.

    With y the occurrences of the term in the record, n the record's terms, Y and N those of the collection
    and a = prior * Y / N: the log-odds ``log((y+a)/(n+prior-y-a)) - log((Y-y+a)/(N-n+prior-Y+y-a))`` is divided
    by the root of ``1/(y+a) + 1/(Y-y+a)``. A term that only this record has still has the prior in the rest.
    A record with null or empty text has no rows. Rows with the same ids are records of their own. If the whole
    collection is one term, the z-score is 0. Whole texts are read, however long.
    """
    # terms are found once; the three passes below read them back
    listed = spread(records.filter(F.col(text).isNotNull()).select(*ids, text)).select(*ids, F.expr(tokens_sql(text)).alias("_terms"))
    listed = materialize(listed, "tokens")
    totals = listed.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_rows"))
    totals = materialize(totals, "terms")
    grand = totals.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]

    # a text of bounded length is counted where it is read: what a term's removal takes away is its number
    short = listed.filter(F.size("_terms") <= ROW_TERMS).select(*ids, "_terms", F.array_distinct("_terms").alias("_once"))
    number = F.expr("CASE WHEN size(_once) = size(_terms) THEN transform(_once, x -> 1) ELSE transform(_once, x -> size(_terms) - size(array_remove(_terms, x))) END")
    short = short.select(*ids, F.size("_terms").alias("_n"), F.explode(F.arrays_zip(F.col("_once").alias("t"), number.alias("k"))).alias("_p"))
    short = short.select(*ids, F.col("_p.t").alias("term"), F.col("_p.k").cast("bigint").alias("occurrences"), "_n")
    # longer ones are placed by record once: the group-by then needs no further exchange
    long = listed.filter(F.size("_terms") > ROW_TERMS).withColumn("_row", F.monotonically_increasing_id()).repartition(*ids)
    long = long.select(*ids, "_row", F.size("_terms").alias("_n"), F.explode("_terms").alias("term")).groupBy(*ids, "_row", "term", "_n").agg(F.count(F.lit(1)).alias("occurrences"))
    counted = short.unionByName(long.select(short.columns))
    joined = heavy_light_join(counted, totals.withColumn("_total", F.col("_rows")), ["term"], "_rows", HEAVY_TERMS)
    return joined.select(*ids, "term", "occurrences", F.expr(z_sql("occurrences", "_n", "_total", f"{grand}D", prior)).alias("z_score"))


def z_sql(y: str, n: str, total: str, grand: str, prior: float = PRIOR) -> str:
    a = f"({prior} * {total} / {grand})"
    rest = f"({total} - {y} + {a})"
    own_rest, other_rest = f"({n} + {prior} - {y} - {a})", f"({grand} - {n} + {prior} - {total} + {y} - {a})"
    ratio = f"ln(({y} + {a}) / {own_rest}) - ln({rest} / {other_rest})"
    return f"CASE WHEN {own_rest} > 1e-9 AND {other_rest} > 1e-9 THEN ({ratio}) / sqrt(1 / ({y} + {a}) + 1 / {rest}) ELSE 0 END"
