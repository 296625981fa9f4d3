"""Queries over metrics, slices, intervals, comparisons and the choice of a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import tokens_sql
from vitrine.functions.vectors import dot
from vitrine.operators import foundation as B
from vitrine.operators import fusion, sparse
from vitrine.operators import metrics as M
from vitrine.operators.skewjoin import shuffled
from vitrine.plans.common import GAIN, JUDGED, LABEL, table
from vitrine.plans.retrieval import BM25, DENSE, index, product_vectors, query_vectors
from vitrine.scratch import materialize
from vitrine.sources.derived import derived

CUTOFFS, RETRIEVAL_CUTOFFS, REPLICATES = (10, 20), (10, 100), 1000
STAGES = ("bm25", "dense", "rrf")


def closed_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Judged pairs with label, gain and three stage scores: BM25, cosine of the text vectors and their closed fusion.

    Built by the first query that needs it, read by the others. A pair whose query or product has no vector has
    cosine 0.
    """
    inputs = [f"{sf}/{t}.parquet" for t in ("examples", "products", "query_records")]
    return derived(spark, "closed", inputs, lambda: pair_scores(spark, sf, _judged(spark, sf)))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    judged = B.with_gains(B.collapse_judgments(table(spark, sf, "examples"))).filter("label_id IS NOT NULL")
    return judged.select("query_id", "product_id", "label_id", "gain")


def pair_scores(spark: SparkSession, sf: str, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``bm25``, ``dense`` and ``rrf``, ranks recomputed inside each query's pairs."""
    queries = table(spark, sf, "query_records").select("query_id", F.col("query").alias("asked_text"))
    bm25 = sparse.score_pairs(index(spark, sf), queries, pairs, "product_id", "query_id", "asked_text").withColumnRenamed("score", "bm25")
    rows = pairs.join(shuffled(bm25), ["query_id", "product_id"], "left")
    rows = rows.join(shuffled(query_vectors(spark, sf).withColumnRenamed("vector", "_q")), "query_id", "left").join(shuffled(product_vectors(spark, sf).withColumnRenamed("vector", "_p")), "product_id", "left")
    rows = rows.withColumns({"bm25": F.coalesce("bm25", F.lit(0.0)), "dense": F.coalesce(dot("_q", "_p"), F.lit(0.0))}).drop("_q", "_p")
    out = fusion.closed_rrf(materialize(rows, "scores"), "query_id", "product_id", ["bm25", "dense"]).withColumnRenamed("closed_rrf", "rrf")
    return out.select(*pairs.columns, "bm25", "dense", "rrf")


def _ndcg(spark: SparkSession, sf: str) -> DataFrame:
    pool = closed_matrix(spark, sf)
    return M.ndcg(M.ranked_pool(pool, STAGES), pool, CUTOFFS)


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "query_records").select(
        "query_id", F.coalesce("normalized_query_sha256", F.concat(F.lit("q:"), F.col("query_id").cast("string"))).alias("group_key"), "locale", F.coalesce("source", F.lit("unknown")).alias("source"), "query"
    )


def closed_matrix_scores(spark: SparkSession, sf: str) -> DataFrame:
    return closed_matrix(spark, sf).select("query_id", "product_id", "label_id", "gain", F.round("bm25", 6).alias("bm25"), (F.round("dense", 6) + 0.0).alias("dense"), F.round("rrf", 9).alias("rrf"))


def ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return _ndcg(spark, sf).withColumn("ndcg", F.round("ndcg", 6))


def closed_pool_metrics(spark: SparkSession, sf: str) -> DataFrame:
    pool = closed_matrix(spark, sf)
    out = M.closed_pool(M.ranked_pool(pool, STAGES), pool, CUTOFFS)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "mrr", "map")})


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from vitrine.plans.retrieval import rrf_hybrid

    judged = B.with_gains(B.collapse_judgments(table(spark, sf, "examples"))).filter("label_id IS NOT NULL").select("query_id", "product_id", "label_id")
    out = M.retrieval(table(spark, sf, "query_records"), rrf_hybrid(spark, sf).select("query_id", "product_id", "rank"), judged, RETRIEVAL_CUTOFFS)
    return out.withColumns({c: F.round(c, 6) for c in ("judged_recall", "judged_mrr", "known_judgment_coverage", "unjudged_rate")})


def metric_long_table(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics as rows; NDCG once under official_gain, exact_hit once under exact."""
    pool = closed_matrix(spark, sf)
    ranked = M.ranked_pool(pool, STAGES)
    gain = M.ndcg(ranked, pool, CUTOFFS).select("query_id", "stage", F.lit("official_gain").alias("threshold"), "cutoff", F.lit("ndcg").alias("metric"), F.col("ndcg").alias("value"))
    rest = M.closed_pool(ranked, pool, CUTOFFS).selectExpr("query_id", "stage", "threshold", "cutoff", "stack(4, 'precision', precision, 'mrr', mrr, 'map', map, 'exact_hit', CAST(exact_hit AS DOUBLE)) AS (metric, value)")
    rest = rest.filter("metric <> 'exact_hit' OR threshold = 'exact'")
    return gain.unionByName(rest).withColumn("value", F.round("value", 6))


def label_composition(spark: SparkSession, sf: str) -> DataFrame:
    judged = B.with_gains(B.collapse_judgments(table(spark, sf, "examples"))).filter("label_id IS NOT NULL")
    return judged.groupBy("query_id").pivot("label_id", [0, 1, 2, 3]).count().select("query_id", *[F.coalesce(str(i), F.lit(0)).alias(f"label_{i}") for i in range(4)])


DIMENSIONS = ("length_bucket", "specificity_bucket", "brand_presence", "color_presence", "model_presence", "compatibility_presence", "source", "project_split", "judgment_composition")


def _context(spark: SparkSession, sf: str) -> DataFrame:
    """A row of slices for every judged query."""
    from vitrine.plans.retrieval import query_lexical_specificity
    from vitrine.plans.parsing import parsed_queries

    parsed = parsed_queries(spark, sf).select("query_id", F.size("tokens").alias("words"), "brand", "color", (F.size("models") > 0).alias("model"), (F.size("compatibility") > 0).alias("compatible"))
    split = B.assign_splits(table(spark, sf, "query_records")).select("query_id", "project_split")
    base = label_composition(spark, sf).join(_groups(spark, sf).select("query_id", "source"), "query_id").join(parsed, "query_id").join(split, "query_id")
    base = materialize(base.join(query_lexical_specificity(spark, sf), "query_id").withColumn("_all", F.lit(0)), "context")
    middle = M.quantiles(base, ["_all"], "specificity", {"middle": 0.5}).select("middle")
    length = F.when(F.col("words") <= 2, "1-2").when(F.col("words") <= 5, "3-5").otherwise("6+")
    mix = F.when(F.col("label_3") > 0, "exact_present").when(F.col("label_2") > 0, "substitute_without_exact").when(F.col("label_1") > F.col("label_0"), "complement_heavy").otherwise("irrelevant_heavy")
    out = base.crossJoin(F.broadcast(middle))  # one row
    low = F.when(F.col("specificity") <= F.col("middle"), "low").otherwise("high")
    there = lambda c, name: F.when(c, "present").otherwise("absent").alias(name)
    return out.select(
        "query_id",
        "source",
        "project_split",
        length.alias("length_bucket"),
        low.alias("specificity_bucket"),
        there(F.col("brand").isNotNull(), "brand_presence"),
        there(F.col("color").isNotNull(), "color_presence"),
        there(F.col("model"), "model_presence"),
        there(F.col("compatible"), "compatibility_presence"),
        mix.alias("judgment_composition"),
    )


def context(spark: SparkSession, sf: str) -> DataFrame:
    inputs = [f"{sf}/{t}.parquet" for t in ("examples", "products", "query_records")]
    return derived(spark, "context", inputs, lambda: _context(spark, sf))


def query_context_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Slices of every judged query: length, specificity, entities, composition, source, split."""
    return context(spark, sf)


def slice_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and median NDCG for everything and for each value of the nine dimensions."""
    out = M.slices(_ndcg(spark, sf).join(context(spark, sf), "query_id"), ["stage", "cutoff"], DIMENSIONS, "ndcg")
    return out.withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


def grouped_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of mean NDCG from 1,000 replicates."""
    values = _ndcg(spark, sf).join(_groups(spark, sf).select("query_id", "group_key"), "query_id")
    out = M.bootstrap(values, ["stage", "cutoff"], "group_key", "ndcg", REPLICATES)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "lower", "upper")})


def rank_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the stored ranks of each query of candidates are 1 to n."""
    return M.contiguity(table(spark, sf, "candidates"), ["query_id"], "one_based_rank")


def protocol_guard(spark: SparkSession, sf: str) -> DataFrame:
    """How each query's list fits its judged pool, for the fused lists and for the closed rankings, and so which
    protocol may measure it."""
    from vitrine.plans.retrieval import rrf_hybrid

    judged = closed_matrix(spark, sf).select("query_id", "product_id")
    lists = {"hybrid": rrf_hybrid(spark, sf).select("query_id", "product_id"), "closed": judged}
    parts = [M.pool_fit(rows, judged).withColumn("list_name", F.lit(n)) for n, rows in lists.items()]
    out = parts[0].unionByName(parts[1])
    return out.withColumn("protocol", F.when(F.col("closed"), M.CLOSED_POOL).otherwise(M.RETRIEVAL))


def frozen_test(spark: SparkSession, sf: str) -> DataFrame:
    """Every stage on the test queries, with the stage that the validation queries chose; nothing is chosen on test."""
    split = B.assign_splits(table(spark, sf, "query_records")).select("query_id", "project_split")
    rows = materialize(_ndcg(spark, sf).join(split, "query_id").filter("project_split IN ('validation', 'test')"), "held")
    means = rows.groupBy("project_split", "stage", "cutoff").agg(F.avg("ndcg").alias("value"), F.count(F.lit(1)).alias("queries"))
    means = materialize(means, "means")
    chosen = M.champion(means.filter("project_split = 'validation'")).select("stage", "selected")
    out = means.filter("project_split = 'test'").join(F.broadcast(chosen), "stage", "left")  # one row per stage
    return out.select("stage", "cutoff", F.round("value", 6).alias("test_ndcg"), "queries", F.coalesce("selected", F.lit(False)).alias("selected_on_validation"))


def paired_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(_ndcg(spark, sf), "ndcg")
    out = M.paired(rows, ["query_id"], ["cutoff"], "ndcg", "rrf", "bm25").unionByName(M.paired(rows, ["query_id"], ["cutoff"], "ndcg", "rrf", "dense"))
    return out.withColumn("mean_delta", F.round("mean_delta", 6))


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(_ndcg(spark, sf).groupBy("stage", "cutoff").agg(F.avg("ndcg").alias("value")), "means")


def best_single(spark: SparkSession, sf: str) -> DataFrame:
    return M.best_single(_means(spark, sf), "bm25", "dense", ["cutoff"]).withColumn("value", F.round("value", 6))


def champion_selection(spark: SparkSession, sf: str) -> DataFrame:
    return M.champion(_means(spark, sf)).withColumn("selection_score", F.round("selection_score", 6))


def failure_topn(spark: SparkSession, sf: str) -> DataFrame:
    return M.largest_changes(_ndcg(spark, sf), ["query_id"], ["cutoff"], "ndcg", "rrf", "bm25").withColumns({c: F.round(c, 6) for c in ("delta", "treatment_value", "baseline_value")})


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    out = M.percentiles(table(spark, sf, "events"), "event_type", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99", "maximum")})


def bounded_group_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Whole query groups, in query order, as long as their rows fit a budget of half of all judged pairs."""
    sizes = B.collapse_judgments(table(spark, sf, "examples")).groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs"))
    from vitrine.operators.grouprank import running_over_all

    placed = running_over_all(sizes, [F.col("query_id")], "pairs", "before")
    total = sizes.agg((F.sum("pairs") / 2).alias("budget"))
    return placed.crossJoin(F.broadcast(total)).filter("before + pairs <= budget").select("query_id", F.col("pairs").cast("bigint").alias("pairs"))  # one row


QUERIES = {
    f.__name__: f
    for f in (
        closed_matrix_scores,
        ndcg_at_k,
        closed_pool_metrics,
        retrieval_metrics,
        metric_long_table,
        label_composition,
        query_context_slices,
        slice_aggregates,
        grouped_bootstrap_ci,
        rank_contiguity,
        protocol_guard,
        frozen_test,
        paired_comparison,
        best_single,
        champion_selection,
        failure_topn,
        latency_percentiles,
        bounded_group_prefix,
    )
}

_Q, _TI = tokens_sql("query", False), tokens_sql("title", False)
_LAB = f"{JUDGED}, lab AS (SELECT query_id, product_id, {LABEL} AS label_id, {GAIN} AS gain FROM judged WHERE esci_label IS NOT NULL)"


def closed_sql(lab: str = _LAB) -> str:
    """The scores and metrics of the pairs in the table ``lab``, as the beginning of a WITH clause."""
    return f"""
{BM25}, {lab},
hit AS (SELECT p.query_id, p.product_id, sum(s) AS score FROM lab p JOIN asked a ON a.query_id = p.query_id JOIN scored t ON t.term = a.term AND t.product_id = p.product_id GROUP BY ALL),
{DENSE},
near AS (SELECT l.query_id, l.product_id, sum(q.x * p.x) AS cosine FROM lab l JOIN qv q ON q.query_id = l.query_id JOIN pv p ON p.product_id = l.product_id AND p.dim = q.dim GROUP BY ALL),
stage AS (SELECT l.query_id, l.product_id, label_id, gain, coalesce(h.score, 0) AS bm25, coalesce(n.cosine, 0) AS dense
  FROM lab l LEFT JOIN hit h ON h.query_id = l.query_id AND h.product_id = l.product_id LEFT JOIN near n ON n.query_id = l.query_id AND n.product_id = l.product_id),
pool AS (SELECT *, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, product_id))
  + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, product_id)) AS rrf FROM stage),
long AS (SELECT query_id, product_id, label_id, gain, 'bm25' AS stage, bm25 AS score FROM pool UNION ALL SELECT query_id, product_id, label_id, gain, 'dense', dense FROM pool
  UNION ALL SELECT query_id, product_id, label_id, gain, 'rrf', rrf FROM pool),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, stage ORDER BY round(score, 9) DESC, product_id) AS rank,
  row_number() OVER (PARTITION BY query_id, stage ORDER BY gain DESC) AS ideal FROM long),
cuts AS (SELECT unnest([10, 20]) AS cutoff),
nd AS (SELECT query_id, stage, cutoff, sum(CASE WHEN rank <= cutoff THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= cutoff THEN gain / log2(ideal + 1) ELSE 0 END) AS idcg FROM ranked, cuts GROUP BY ALL),
ndcg AS (SELECT query_id, stage, cutoff, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg FROM nd),
th AS (SELECT 'exact' AS threshold, 3 AS least UNION ALL SELECT 'exact_or_substitute', 2),
rel AS (SELECT query_id, stage, threshold, rank, label_id, (label_id >= least)::INTEGER AS r, sum((label_id >= least)::INTEGER) OVER (PARTITION BY query_id, stage, threshold ORDER BY rank) AS c FROM ranked, th),
closed AS (SELECT query_id, stage, threshold, cutoff, sum(r) FILTER (WHERE rank <= cutoff)::DOUBLE / least(cutoff, count(*)) AS precision,
  coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE r = 1 AND rank <= cutoff), 0) AS mrr,
  CASE WHEN sum(r) > 0 THEN coalesce(sum(c::DOUBLE / rank) FILTER (WHERE r = 1 AND rank <= cutoff), 0) / sum(r) ELSE 0 END AS map,
  max((label_id = 3 AND rank <= cutoff)::INTEGER) AS exact_hit FROM rel, cuts GROUP BY query_id, stage, threshold, cutoff),
grp AS (SELECT query_id, coalesce(normalized_query_sha256, 'q:' || query_id) AS group_key, locale, coalesce(source, 'unknown') AS source, query FROM query_records),
means AS (SELECT stage, cutoff, avg(ndcg) AS value FROM ndcg GROUP BY ALL)"""


CLOSED = closed_sql()


def _paired(a: str, b: str) -> str:
    return f"""SELECT cutoff, '{a}' AS treatment, '{b}' AS baseline, round(avg(d), 6) AS mean_delta, sum((d > 1e-12)::INTEGER)::BIGINT AS wins, sum((abs(d) <= 1e-12)::INTEGER)::BIGINT AS ties,
  sum((d < -1e-12)::INTEGER)::BIGINT AS losses, count(*) AS queries FROM (SELECT x.query_id, x.cutoff, x.ndcg - y.ndcg AS d FROM ndcg x JOIN ndcg y USING (query_id, cutoff) WHERE x.stage = '{a}' AND y.stage = '{b}') GROUP BY cutoff"""


_FUSED = """merged AS (SELECT query_id, product_id, min(sparse_rank) AS s, min(dense_rank) AS d FROM candidates GROUP BY ALL),
listed AS (SELECT query_id, product_id, coalesce(1.0::DOUBLE / (60 + s), 0) + coalesce(1.0::DOUBLE / (60 + d), 0) AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(1.0::DOUBLE / (60 + s), 0) + coalesce(1.0::DOUBLE / (60 + d), 0), 9) DESC, least(s, d), product_id) AS rank
  FROM merged WHERE coalesce(s, d) IS NOT NULL QUALIFY rank <= 200)"""
SQL = {
    "closed_matrix_scores": f"WITH {CLOSED} SELECT query_id, product_id, label_id, gain, round(bm25, 6) AS bm25, round(dense, 6) + 0.0 AS dense, round(rrf, 9) AS rrf FROM pool",
    "ndcg_at_k": f"WITH {CLOSED} SELECT query_id, stage, cutoff, round(ndcg, 6) AS ndcg FROM ndcg",
    "closed_pool_metrics": f"WITH {CLOSED} SELECT query_id, stage, threshold, cutoff, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(map, 6) AS map, exact_hit FROM closed",
    "retrieval_metrics": f"""WITH {JUDGED}, lab AS (SELECT query_id, product_id, {LABEL} AS label_id FROM judged WHERE esci_label IS NOT NULL), {_FUSED},
head AS (SELECT l.query_id, l.rank, lab.label_id FROM listed l LEFT JOIN lab USING (query_id, product_id)),
th AS (SELECT 'exact' AS threshold, 3 AS least UNION ALL SELECT 'exact_or_substitute', 2), cuts AS (SELECT unnest([10, 100]) AS cutoff),
base AS (SELECT query_id, threshold, least, cutoff FROM query_records, th, cuts),
got AS (SELECT b.query_id, threshold, cutoff, count(h.rank) AS n, count(h.label_id) AS known, count(*) FILTER (WHERE h.label_id >= b.least) AS hits, min(h.rank) FILTER (WHERE h.label_id >= b.least) AS first,
  count(*) FILTER (WHERE h.label_id = 3) AS e FROM base b LEFT JOIN head h ON h.query_id = b.query_id AND h.rank <= b.cutoff GROUP BY ALL),
al AS (SELECT b.query_id, threshold, cutoff, count(*) FILTER (WHERE l.label_id >= b.least) AS rel FROM base b LEFT JOIN lab l ON l.query_id = b.query_id GROUP BY ALL)
SELECT query_id, threshold, cutoff, round(CASE WHEN rel > 0 THEN hits::DOUBLE / rel ELSE 0 END, 6) AS judged_recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS judged_mrr, (e > 0)::INTEGER AS exact_hit,
  round(CASE WHEN n > 0 THEN known::DOUBLE / n ELSE 0 END, 6) AS known_judgment_coverage, round(CASE WHEN n > 0 THEN (n - known)::DOUBLE / n ELSE 0 END, 6) AS unjudged_rate
FROM got JOIN al USING (query_id, threshold, cutoff)""",
    "metric_long_table": f"""WITH {CLOSED} SELECT query_id, stage, 'official_gain' AS threshold, cutoff, 'ndcg' AS metric, round(ndcg, 6) AS value FROM ndcg
UNION ALL SELECT query_id, stage, threshold, cutoff, 'precision', round(precision, 6) FROM closed UNION ALL SELECT query_id, stage, threshold, cutoff, 'mrr', round(mrr, 6) FROM closed
UNION ALL SELECT query_id, stage, threshold, cutoff, 'map', round(map, 6) FROM closed UNION ALL SELECT query_id, stage, threshold, cutoff, 'exact_hit', exact_hit::DOUBLE FROM closed WHERE threshold = 'exact'""",
    "label_composition": f"WITH {JUDGED}, lab AS (SELECT query_id, {LABEL} AS l FROM judged WHERE esci_label IS NOT NULL) SELECT query_id, "
    + ", ".join(f"count(*) FILTER (WHERE l = {i}) AS label_{i}" for i in range(4))
    + " FROM lab GROUP BY query_id",
    "paired_comparison": f"WITH {CLOSED} {_paired('rrf', 'bm25')} UNION ALL {_paired('rrf', 'dense')}",
    "best_single": f"""WITH {CLOSED} SELECT a.cutoff, CASE WHEN b.value > a.value + 1e-12 THEN 'dense' ELSE 'bm25' END AS best_stage, round(greatest(a.value, b.value), 6) AS value
FROM means a JOIN means b USING (cutoff) WHERE a.stage = 'bm25' AND b.stage = 'dense'""",
    "champion_selection": f"""WITH {CLOSED}, c AS (SELECT m.stage, avg(m.value) AS score, max(m.value - r.value) AS up, min(m.value - r.value) AS down FROM means m JOIN means r ON r.cutoff = m.cutoff AND r.stage = 'rrf' GROUP BY m.stage),
e AS (SELECT *, stage = 'rrf' OR (up > 0 AND down >= -0.005) AS eligible FROM c)
SELECT stage, round(score, 6) AS selection_score, eligible, row_number() OVER (ORDER BY eligible DESC, round(score, 12) DESC, (stage <> 'rrf'), stage) = 1 AS selected FROM e""",
    "failure_topn": f"""WITH {CLOSED}, d AS (SELECT x.query_id, x.cutoff, x.ndcg AS t, y.ndcg AS b, x.ndcg - y.ndcg AS delta FROM ndcg x JOIN ndcg y USING (query_id, cutoff) WHERE x.stage = 'rrf' AND y.stage = 'bm25')
SELECT query_id, cutoff, round(t, 6) AS treatment_value, round(b, 6) AS baseline_value, round(delta, 6) AS delta, CASE WHEN delta > 1e-12 THEN 'win' WHEN delta < -1e-12 THEN 'loss' ELSE 'tie' END AS outcome, CAST(row_number() OVER (PARTITION BY cutoff ORDER BY round(abs(delta), 9) DESC, query_id) AS INTEGER) AS place FROM d QUALIFY place <= 20""",
    "latency_percentiles": """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS maximum, count(value) AS measured
FROM events GROUP BY event_type""",
    "bounded_group_prefix": f"""WITH {JUDGED}, s AS (SELECT query_id, count(*) AS pairs FROM judged GROUP BY query_id), p AS (SELECT *, sum(pairs) OVER (ORDER BY query_id) AS upto, sum(pairs) OVER () / 2 AS budget FROM s)
SELECT query_id, pairs FROM p WHERE upto <= budget""",
}


def _context_sql() -> str:
    from vitrine.plans.foundation import _SPLITS
    from vitrine.plans.parsing import ENTITIES

    return f"""{CLOSED}, {ENTITIES}, {_SPLITS},
counts AS (SELECT query_id, {", ".join(f"count(*) FILTER (WHERE label_id = {i}) AS l{i}" for i in range(4))} FROM lab GROUP BY query_id),
sp AS (SELECT query_id, round(coalesce(avg(idf), 0), 6) AS specificity FROM query_records LEFT JOIN asked USING (query_id) LEFT JOIN rated USING (term) GROUP BY query_id),
cb AS (SELECT c.*, g.source, s.project_split, len(pq.tokens) AS words, specificity, b.brand, coalesce(co.color, al.color) AS color, len(pq.models) AS models, len(pq.compatibility) AS compatible
  FROM counts c JOIN grp g USING (query_id) JOIN sp USING (query_id) JOIN pq USING (query_id) JOIN split s USING (query_id) LEFT JOIN brand_hit b USING (query_id) LEFT JOIN color_hit co USING (query_id) LEFT JOIN alias_hit al USING (query_id)),
cm AS (SELECT quantile_cont(specificity, 0.5) AS middle FROM cb),
cx AS (SELECT query_id, source, project_split, CASE WHEN words <= 2 THEN '1-2' WHEN words <= 5 THEN '3-5' ELSE '6+' END AS length_bucket, CASE WHEN specificity <= middle THEN 'low' ELSE 'high' END AS specificity_bucket,
  CASE WHEN brand IS NOT NULL THEN 'present' ELSE 'absent' END AS brand_presence, CASE WHEN color IS NOT NULL THEN 'present' ELSE 'absent' END AS color_presence,
  CASE WHEN models > 0 THEN 'present' ELSE 'absent' END AS model_presence, CASE WHEN compatible > 0 THEN 'present' ELSE 'absent' END AS compatibility_presence,
  CASE WHEN l3 > 0 THEN 'exact_present' WHEN l2 > 0 THEN 'substitute_without_exact' WHEN l1 > l0 THEN 'complement_heavy' ELSE 'irrelevant_heavy' END AS judgment_composition FROM cb, cm)"""


_DRAWN = f"""num AS (SELECT *, unnest(range({-(-REPLICATES // 4)})) AS blk FROM bg), hs AS (SELECT *, sha256(group_key || '|' || blk) AS h FROM num),
wt AS (SELECT stage, cutoff, s, n, blk * 4 + c AS r, ('0x' || substr(h, CAST(1 + c * 13 AS INTEGER), 13))::BIGINT / {16**13}::DOUBLE AS u FROM hs, (SELECT unnest([0, 1, 2, 3]) AS c)),
est AS (SELECT stage, cutoff, r, sum(w * s) / nullif(sum(w * n), 0) AS e FROM (SELECT *, {M.poisson_sql("u")} AS w FROM wt WHERE r < {REPLICATES}) GROUP BY ALL)"""


def _late_sql() -> dict[str, str]:
    from vitrine.plans.foundation import _SPLITS

    with_context = _context_sql()
    union = " UNION ALL ".join(f"SELECT stage, cutoff, ndcg, '{d}' AS slice_name, coalesce({d}, 'unknown') AS slice_value FROM x" for d in DIMENSIONS)
    return {
        "query_context_slices": f"WITH {with_context} SELECT * FROM cx",
        "slice_aggregates": f"""WITH {with_context}, x AS (SELECT n.*, cx.* EXCLUDE (query_id) FROM ndcg n JOIN cx USING (query_id))
SELECT stage, cutoff, slice_name, slice_value, round(avg(ndcg), 6) AS mean, round(quantile_cont(ndcg, 0.5), 6) AS median, count(*) AS queries FROM (
  SELECT stage, cutoff, ndcg, 'all' AS slice_name, 'all' AS slice_value FROM x UNION ALL {union}) GROUP BY ALL""",
        "grouped_bootstrap_ci": f"""WITH {CLOSED}, bg AS (SELECT stage, cutoff, group_key, sum(ndcg) AS s, count(*) AS n FROM ndcg JOIN grp USING (query_id) GROUP BY ALL), {_DRAWN},
sz AS (SELECT stage, cutoff, count(*) AS groups, sum(s) / sum(n) AS mean FROM bg GROUP BY ALL)
SELECT stage, cutoff, round(any_value(mean), 6) AS mean, round(quantile_cont(e, 0.025), 6) AS lower, round(quantile_cont(e, 0.975), 6) AS upper, any_value(groups) AS groups FROM est JOIN sz USING (stage, cutoff) GROUP BY stage, cutoff""",
        "rank_contiguity": """SELECT query_id, count(*) AS row_count, count(*) - count(one_based_rank) AS null_ranks, count(DISTINCT one_based_rank) AS distinct_ranks, max(one_based_rank) AS highest,
  coalesce(count(one_based_rank) = count(*) AND min(one_based_rank) = 1 AND max(one_based_rank) = count(*) AND count(DISTINCT one_based_rank) = count(*), FALSE) AS contiguous FROM candidates GROUP BY query_id""",
        "protocol_guard": f"""WITH {JUDGED}, lab AS (SELECT query_id, product_id FROM judged WHERE esci_label IS NOT NULL), {_FUSED},
f AS (SELECT 'hybrid' AS list_name, coalesce(l.query_id, b.query_id) AS query_id, l.rank IS NOT NULL AS ret, b.product_id IS NOT NULL AS jud FROM listed l FULL JOIN lab b ON b.query_id = l.query_id AND b.product_id = l.product_id
  UNION ALL SELECT 'closed', query_id, TRUE, TRUE FROM lab),
g AS (SELECT list_name, query_id, count(*) FILTER (WHERE ret) AS returned, count(*) FILTER (WHERE jud) AS judged, count(*) FILTER (WHERE ret AND NOT jud) AS unjudged, count(*) FILTER (WHERE NOT ret) AS missing, CAST(0 AS BIGINT) AS repeated FROM f GROUP BY ALL)
SELECT *, unjudged = 0 AND missing = 0 AS closed, CASE WHEN unjudged = 0 AND missing = 0 THEN 'closed_pool_v1' ELSE 'retrieval_catalog_v1' END AS protocol FROM g""",
        "frozen_test": f"""WITH {CLOSED}, {_SPLITS}, hm AS (SELECT project_split, stage, cutoff, avg(ndcg) AS value, count(*) AS queries FROM ndcg JOIN split USING (query_id) WHERE project_split IN ('validation', 'test') GROUP BY ALL),
v AS (SELECT * FROM hm WHERE project_split = 'validation'), c AS (SELECT m.stage, avg(m.value) AS score, max(m.value - r.value) AS up, min(m.value - r.value) AS down FROM v m JOIN v r ON r.cutoff = m.cutoff AND r.stage = 'rrf' GROUP BY m.stage),
e AS (SELECT *, stage = 'rrf' OR (up > 0 AND down >= -0.005) AS eligible FROM c), ch AS (SELECT stage FROM e ORDER BY eligible DESC, round(score, 12) DESC, (stage <> 'rrf'), stage LIMIT 1)
SELECT stage, cutoff, round(value, 6) AS test_ndcg, queries, stage IN (SELECT stage FROM ch) AS selected_on_validation FROM hm WHERE project_split = 'test'""",
    }


SQL |= _late_sql()
