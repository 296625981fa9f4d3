"""Mixing sources to target shares, measured in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.grouprank import DEFAULT_LIMIT, running_before
from vitrine.scratch import materialize, spread

#: The setting that names a vocabulary file of the ``tokenizers`` library.
TOKENIZER_KEY = "spark.vitrine.tokenizer"


def token_count(text: Column | str, tokenizer: str) -> Column:
    """Tokens of the whole text; null and empty texts have 0. ``tokenizer`` is the path of a vocabulary file at the same
    place on every executor, or the name of one that was shipped with ``SparkContext.addFile``."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer if os.path.exists(tokenizer) else SparkFiles.get(tokenizer))
        model.encode_special_tokens = True
        for s in batches:
            out = []
            for at in range(0, len(s), 256):
                part = [t if isinstance(t, str) else "" for t in s.iloc[at : at + 256]]
                out += [len(e.ids) for e in model.encode_batch(part, add_special_tokens=False)]
            yield pd.Series(out, dtype="int64")

    return count(text)


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    doc_id: str,
    source: str,
    text: str,
    tokenizer: str,
    total_tokens: int | None = None,
    seed: int = 17,
    limit: int | None = DEFAULT_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(selection, report) for ``targets`` (``source``, ``target_share``, ``max_repeats``).

    ``selection`` has ``doc_id``, ``source``, ``tokens`` and ``copies`` (1 .. max_repeats); ``report`` has a row
    for every target source. Documents of a source come in the order of a seeded hash; a source of budget B and
    available tokens A gives floor(B / A) full epochs and the documents whose middle lies before the remainder.
    ``total_tokens`` None means the largest total at which every target source that has documents reaches its
    share within its repeats (shares are taken relative to those sources). With a given total, a source that
    cannot fill its budget gives all its repeats and the report shows the smaller share.

    Documents of unlisted or null source, and those without tokens, are never selected. Target rows with null or
    non-positive share or repeats get nothing. Repeated doc_ids count as documents of their own.
    """
    sized = spread(docs.select(doc_id, source, text)).select(doc_id, source, token_count(text, tokenizer).alias("tokens")).filter(F.col(source).isNotNull() & (F.col("tokens") > 0))
    sized = materialize(sized, "tokens")
    have = sized.groupBy(source).agg(F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("documents"))
    plan = targets.select(F.col("source").alias(source), "target_share", "max_repeats").join(have, source, "left")
    usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("available_tokens") > 0)
    plan = materialize(plan.withColumn("_ok", F.coalesce(usable, F.lit(False))), "plan")
    share_sum = plan.filter("_ok").agg(F.sum("target_share").alias("s")).first()["s"] or 1.0
    plan = plan.withColumn("_share", F.when(F.col("_ok"), F.col("target_share") / share_sum))
    if total_tokens is None:
        total_tokens = plan.filter("_ok").agg(F.min(F.col("available_tokens") * F.col("max_repeats") / F.col("_share")).alias("t")).first()["t"] or 0.0
    budget = F.least(F.col("_share") * F.lit(float(total_tokens)), (F.col("available_tokens") * F.col("max_repeats")).cast("double"))
    plan = plan.withColumn("budget_tokens", F.when(F.col("_ok"), budget))
    plan = plan.withColumn("_epochs", F.floor(F.col("budget_tokens") / F.col("available_tokens") + 1e-9))
    plan = plan.withColumn("_rest", F.col("budget_tokens") - F.col("_epochs") * F.col("available_tokens"))

    # the table of targets names each source once; its size does not depend on the documents
    cut = plan.filter("_ok").select(source, "_epochs", "_rest")
    keyed = sized.join(cut, source).withColumn("_key", F.xxhash64(F.lit(seed), F.col(doc_id)))
    placed = running_before(keyed, [source], [F.col("_key"), F.col(doc_id)], "tokens", "_before", limit)
    copies = F.col("_epochs") + (F.col("_before") + F.col("tokens") / 2 <= F.col("_rest")).cast("int")
    chosen = placed.select(doc_id, source, F.col("tokens").cast("long").alias("tokens"), copies.cast("int").alias("copies")).filter("copies > 0")
    chosen = materialize(chosen, "mixed")
    got = chosen.groupBy(source).agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected_tokens"), F.max("copies").alias("most_copies"))
    report = plan.join(got, source, "left").withColumn("selected_tokens", F.coalesce("selected_tokens", F.lit(0)))
    all_tokens = report.agg(F.sum("selected_tokens").alias("_sum"))
    report = report.crossJoin(F.broadcast(all_tokens)).select(  # one row
        source,
        "target_share",
        "max_repeats",
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.round("budget_tokens", 3).alias("budget_tokens"),
        "selected_tokens",
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(F.when(F.col("_sum") > 0, F.col("selected_tokens") / F.col("_sum")).otherwise(0.0), 9).alias("reached_share"),
    )
    return chosen, report
