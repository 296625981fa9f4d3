import math

import pytest
from pyspark.sql import functions as F

from vitrine.functions.clean import clean_text_exact
from vitrine.functions.hashing import hash_bucket, hash_key
from vitrine.functions.text import normalize_query, tokens_sql
from vitrine.functions.vectors import encode_text
from vitrine.operators import dense, fusion, metrics, sparse, understand, validate
from vitrine.operators import features as feats
from vitrine.operators import ltr
from vitrine.operators.grouprank import row_number, running_before
from vitrine.operators.skewjoin import heavy_light_join


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_row_number_is_the_same_either_way(spark):
    rows = [(g, f"p{i:03d}", float((i * 7) % 13)) for g, n in (("a", 60), ("b", 7), (None, 5)) for i in range(n)]
    df = frame(spark, rows, "g string, p string, s double").repartition(5)
    order = [F.col("s").desc(), F.col("p")]
    one = {(r.g, r.p): r.k for r in row_number(df, ["g"], order, "k").collect()}
    two = {(r.g, r.p): r.k for r in row_number(df, ["g"], order, "k", limit=6).collect()}
    assert one == two and len(one) == 72
    assert sorted(k for (g, _), k in two.items() if g == "a") == list(range(1, 61))


def test_running_before_spans_partitions(spark):
    rows = [("x", i, float(i % 3)) for i in range(50)]
    df = frame(spark, rows, "g string, i long, v double")
    got = {r.i: r.b for r in running_before(df, ["g"], [F.col("i")], "v", "b", limit=4).collect()}
    want, total = {}, 0.0
    for i in range(50):
        want[i] = total
        total += i % 3
    assert got == want


def test_running_before_of_nothing(spark):
    df = frame(spark, [], "g string, i long, v double")
    assert running_before(df, ["g"], [F.col("i")], "v", "b").count() == 0


def test_heavy_and_light_keys_join_alike(spark):
    left = frame(spark, [("hot", i) for i in range(90)] + [("cold", 1), (None, 2), ("lost", 3)], "k string, i long")
    right = frame(spark, [("hot", 90, "H"), ("cold", 1, "C")], "k string, n long, v string")
    got = heavy_light_join(left, right, ["k"], "n", heavy=3).collect()
    assert len(got) == 93
    assert {r.v for r in got if r.k == "hot"} == {"H"} and [r.v for r in got if r.k == "cold"] == ["C"]
    assert all(r.v is None for r in got if r.k not in ("hot", "cold"))


def test_tie_rule_of_fusion(spark):
    a = frame(spark, [(1, "z", 1, 9.0), (1, "a", 2, 8.0)], "q long, p string, rank int, score double")
    b = frame(spark, [(1, "a", 1, 0.9), (1, "z", 2, 0.8)], "q long, p string, rank int, score double")
    assert [r.p for r in fusion.fuse({"sparse": a, "dense": b}, "q", "p").orderBy("rank").collect()] == ["a", "z"]


def test_fusion_by_hand(spark):
    a = frame(spark, [(1, "a", 1, 3.0), (1, "b", 2, 2.0)], "q long, p string, rank int, score double")
    b = frame(spark, [(1, "b", 1, 0.7), (1, "c", 2, 0.6)], "q long, p string, rank int, score double")
    got = fusion.fuse({"sparse": a, "dense": b}, "q", "p").orderBy("rank").collect()
    assert [r.p for r in got] == ["b", "a", "c"]
    assert got[0].rrf == pytest.approx(1 / 62 + 1 / 61) and got[2].sparse_rank is None and got[0].source_count == 2


def test_degraded_source(spark):
    only = frame(spark, [(1, "a", 1, 1.0)], "q long, p string, rank int, score double")
    none = frame(spark, [], "q long, p string, rank int, score double")
    got = fusion.fuse({"sparse": only, "dense": none}, "q", "p").collect()
    assert len(got) == 1 and got[0].dense_rank is None


def test_rank_fraction_by_hand(spark):
    df = frame(spark, [(1, "p2", 1.0), (1, "p1", 1.0), (1, "p3", -1.0), (2, "x", None)], "q long, p string, s double")
    for limit in (100, 2):
        got = {r.p: r.f for r in fusion.rank_fraction(df, ["q"], "s", "p", "f", limit).collect()}
        assert got == {"p1": 0.0, "p2": 0.5, "p3": 1.0, "x": 0.0}


def test_closed_pool_by_hand(spark):
    pool = frame(spark, [(1, "a", 0, 0.0, 4.0), (1, "b", 3, 1.0, 3.0), (1, "c", 2, 0.1, 2.0), (1, "d", 1, 0.01, 1.0)], "query_id long, product_id string, label_id int, gain double, s double")
    got = {r.threshold: r for r in metrics.closed_pool(metrics.ranked_pool(pool, ["s"]), pool, [3]).collect()}
    row = got["exact_or_substitute"]
    assert (row.precision, row.mrr, row.exact_hit) == (pytest.approx(2 / 3), 0.5, 1)
    assert row.map == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_ndcg_by_hand(spark):
    pool = frame(spark, [(1, "a", 3, 1.0, 1.0), (1, "b", 2, 0.1, 3.0), (1, "c", 1, 0.01, 2.0), (2, "x", 0, 0.0, 1.0)], "query_id long, product_id string, label_id int, gain double, s double")
    got = {r.query_id: r.ndcg for r in metrics.ndcg(metrics.ranked_pool(pool, ["s"]), pool, [3]).collect()}
    ideal = 1 + 0.1 / math.log2(3) + 0.01 / 2
    assert got[1] == pytest.approx((0.1 + 0.01 / math.log2(3) + 1 / 2) / ideal) and got[2] == 0.0


def test_retrieval_with_unknown_items(spark):
    queries = frame(spark, [(1,), (2,)], "query_id long")
    ranked = frame(spark, [(1, "u1", 1), (1, "s", 2), (1, "u2", 3), (1, "e", 4)], "query_id long, product_id string, rank int")
    judged = frame(spark, [(1, "s", 2), (1, "e", 3)], "query_id long, product_id string, label_id int")
    got = {(r.query_id, r.threshold): r for r in metrics.retrieval(queries, ranked, judged, [4]).collect()}
    row = got[(1, "exact_or_substitute")]
    assert (row.judged_recall, row.judged_mrr, row.known_judgment_coverage, row.unjudged_rate) == (1.0, 0.5, 0.5, 0.5)
    empty = got[(2, "exact")]
    assert (empty.judged_recall, empty.judged_mrr, empty.exact_hit, empty.unjudged_rate) == (0.0, 0.0, 0, 0.0)


@pytest.mark.parametrize(("late", "chosen"), [(0.49, "rrf"), (0.499, "lambdamart")])
def test_champion_policy(spark, late, chosen):
    rows = [("rrf", 10, 0.50), ("rrf", 20, 0.50), ("pointwise", 10, 0.52), ("pointwise", 20, 0.49), ("lambdamart", 10, 0.52), ("lambdamart", 20, late)]
    got = {r.stage: r for r in metrics.champion(frame(spark, rows, "stage string, cutoff int, value double")).collect()}
    assert [s for s, r in got.items() if r.selected] == [chosen] and not got["pointwise"].eligible


def test_champion_tie_keeps_the_baseline(spark):
    rows = [(s, k, 0.5) for s in ("rrf", "pointwise") for k in (10, 20)]
    got = metrics.champion(frame(spark, rows, "stage string, cutoff int, value double")).filter("selected").collect()
    assert [r.stage for r in got] == ["rrf"]


def test_query_parser_by_hand(spark):
    queries = frame(spark, [(1, "  ACME PRO wireles XPS-13 16 GB compatible with RED "), (2, "acme pro charcoal case"), (3, None), (4, "  "), (5, "the of")], "query_id long, query string")
    products = frame(spark, [("acme", "blue"), ("acme pro", "gray"), ("other", "red")], "normalized_brand string, normalized_color string")
    got = {r.query_id: r for r in understand.parse(queries, "query_id", "query", products).collect()}
    one = got[1]
    assert (one.brand, one.color, one.models, one.units, one.measurements) == ("acme pro", "red", ["xps-13"], ["gb"], ["16 gb"])
    assert one.numbers == ["13", "16"] and one.compatibility_phrases == ["compatible with"] and one.corrected
    assert (got[2].color, got[2].color_source, got[2].color_confidence) == ("gray", "alias", 0.9)
    assert (got[3].problem, got[4].problem) == ("null", "empty")
    assert got[5].reduced == ["the", "of"]


def test_population_audit(spark):
    rows = [(1, "a", 3), (1, "b", 0), (2, "a", 1), (3, "a", 2), (3, "b", 2), (4, "a", None)]
    kept, audit = ltr.training_population(frame(spark, rows, "query_id long, product_id string, label_id int"))
    assert {r.query_id for r in kept.collect()} == {1}
    assert {r.query_id: r.excluded for r in audit.collect()} == {1: None, 2: "too_few_rows", 3: "single_label"}


def test_lambda_gradients_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(q, f"p{i}", rng.choice([0.0, 0.01, 0.1, 1.0]), rng.random()) for q in (1, 2) for i in range(12)]
    for truncation in (4, 30):
        got = {(r.query_id, r.product_id): (r["lambda"], r.hessian) for r in ltr.lambda_gradients(frame(spark, rows, "query_id long, product_id string, gain double, score double"), truncation).collect()}
        for q in (1, 2):
            own = sorted([r for r in rows if r[0] == q], key=lambda r: (-round(r[3], 9), r[1]))
            ideal = sum(g / math.log2(i + 2) for i, g in enumerate(sorted((r[2] for r in own), reverse=True)))
            want = {r[1]: [0.0, 0.0] for r in own}
            for i, a in enumerate(own):
                for j, b in enumerate(own):
                    if a[2] > b[2] and min(i, j) < truncation:
                        d = (a[2] - b[2]) * abs(1 / math.log2(i + 2) - 1 / math.log2(j + 2)) / ideal
                        rho = 1 / (1 + math.exp(a[3] - b[3]))
                        want[a[1]][0] += d * rho
                        want[b[1]][0] -= d * rho
                        want[a[1]][1] += d * rho * (1 - rho)
                        want[b[1]][1] += d * rho * (1 - rho)
            for p, (lam, hes) in want.items():
                assert got[(q, p)] == (pytest.approx(lam), pytest.approx(hes))


def learning_rows(queries, seed):
    import random

    rng, rows = random.Random(seed), []
    for q in queries:
        for i in range(8):
            x, y = rng.random(), rng.random()
            label = int(min(3, x * 4))
            rows.append((q, f"p{i}", label, (0.0, 0.01, 0.1, 1.0)[label], x, y))
    return rows


LEARNING = "query_id long, product_id string, label_id int, gain double, x double, y double"


def test_rankers_learn_stop_and_repeat(spark):
    import numpy as np

    from vitrine.operators.boosting import Trees

    train, held = frame(spark, learning_rows(range(60), 9), LEARNING), frame(spark, learning_rows(range(100, 120), 10), LEARNING)
    for fit in (ltr.fit_pointwise, ltr.fit_lambdamart):
        model = fit(train, held, ["x", "y"])
        assert max(model.history) > 0.95 and len(model.trees) == int(np.argmax(np.array(model.history) > max(model.history) - 1e-12)) + 1
        assert len(model.history) == 300 or len(model.history) == len(model.trees) + 30
        told = {f: (g, n) for f, g, n in ltr.importance(model, ["x", "y"])}
        assert told["x"][0] > told["y"][0] and told["x"][1] >= 1
        again = fit(train.orderBy("product_id"), held.orderBy("product_id"), ["x", "y"])
        assert again.to_json() == model.to_json()
        x = np.random.default_rng(1).random((50, 2))
        assert Trees.from_json(model.to_json()).predict(x).tolist() == model.predict(x).tolist()
        assert model.contributions(x).sum(axis=1) == pytest.approx(model.predict(x))
        scored = {(r.query_id, r.product_id): r.score for r in ltr.predict(model, held, ["x", "y"]).collect()}
        rows = held.toPandas()
        assert [scored[k] for k in zip(rows.query_id, rows.product_id)] == pytest.approx(model.predict(rows[["x", "y"]].to_numpy()))  # noqa: B905


def test_gradients_of_a_sample_are_those_of_the_plan(spark):
    rows = learning_rows(range(5), 3) + learning_rows([9] * 6, 4)
    rows = [(q, f"p{n:03}", *r) for n, (q, _, *r) in enumerate(rows)]
    data = frame(spark, rows, LEARNING)
    lists = ltr._Lists(data.toPandas())
    grad, bend = lists.lambdas(lists.frame["y"].to_numpy())
    want = {(r.query_id, r.product_id): (r["lambda"], r.hessian) for r in ltr.lambda_gradients(data.withColumnRenamed("y", "score")).collect()}
    for q, p, g, h in zip(lists.frame.query_id, lists.frame.product_id, grad, bend):  # noqa: B905
        assert want[(q, p)] == (pytest.approx(g), pytest.approx(h))


def test_fitting_takes_whole_queries_up_to_its_bound(spark):
    data = frame(spark, learning_rows(range(40), 2), LEARNING)
    kept = ltr.bounded(data, 100).groupBy("query_id").count().collect()
    assert len(kept) == 12 and {r["count"] for r in kept} == {8}
    assert ltr.bounded(data, 320).count() == 320
    empty = ltr.fit_lambdamart(data.limit(0), data.limit(0), ["x", "y"], rounds=2)
    assert empty.trees == [] and ltr.predict(empty, data, ["x", "y"]).filter("score = 0").count() == 320


def many_rows(spark, queries, first=0):
    rows = spark.range(first * 8, (first + queries) * 8).select(F.expr("id div 8").alias("query_id"), F.col("id").cast("string").alias("product_id"), F.expr("cast(pmod(xxhash64(id), 4) as int)").alias("label_id"), F.col("id").cast("double").alias("x"))
    return rows.withColumn("gain", F.expr("array(0.0D, 0.01D, 0.1D, 1.0D)[label_id]")).withColumn("y", F.expr("pmod(xxhash64(x, 1), 9) + label_id").cast("double"))


@pytest.fixture(scope="module")
def many(spark):
    """More training and validation rows than half a million and 200,000."""
    return many_rows(spark, 65_000), many_rows(spark, 26_000, 65_000)


def held_ndcg(model, held):
    """Mean over all validation queries, by a sort of the whole table."""
    import numpy as np

    rows = held.select("query_id", "product_id", "gain", "x", "y").toPandas()
    rows["score"] = np.round(model.predict(rows[["x", "y"]].to_numpy()), 9)
    dcg = lambda by, up: rows.sort_values(by, ascending=up).assign(n=lambda r: r.groupby("query_id").cumcount()).pipe(lambda r: r.gain / np.log2(r.n + 2)).groupby(rows.query_id).sum()
    ideal = dcg(["query_id", "gain"], [True, False])
    return float((dcg(["query_id", "score", "product_id"], [True, False, True]) / ideal.where(ideal > 0, 1.0)).mean())


def quantiles(n):
    import numpy as np

    return np.unique(np.quantile(np.arange(n, dtype=float), np.linspace(0, 1, 64)[1:-1], method="lower")).tolist()


def test_lambdamart_takes_all_rows(spark, many):
    train, held = many
    model = ltr.fit_lambdamart(train, held, ["x", "y"], rounds=1)
    assert model.edges[0] == quantiles(520_000)
    assert model.history == [pytest.approx(held_ndcg(model, held), abs=1e-9)]


def test_pointwise_takes_all_rows(spark, many):
    train, held = many
    model = ltr.fit_pointwise(train, held, ["x", "y"], rounds=1)
    assert model.base == train.selectExpr("sum(label_id) / count(*)").first()[0] and model.edges[0] == quantiles(520_000)
    assert model.history == [pytest.approx(held_ndcg(model, held), abs=1e-9)]


def test_importance_counts_all_rows(spark, many):
    import numpy as np

    train, held = many
    model = ltr.fit_lambdamart(train, held.limit(0), ["x"], rounds=1)
    (_, gain, splits), = ltr.importance(model, ["x"])
    rows = train.select("query_id", "product_id", "gain", "x").toPandas().sort_values(["query_id", "product_id"])
    lists = ltr._Lists(rows)
    grad, hess = lists.lambdas(np.zeros(len(rows)))
    x = lists.frame["x"].to_numpy()
    score = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1.0)
    best = max(score(x <= e) + score(x > e) - score(x >= 0) for e in quantiles(520_000))
    assert splits >= 1 and model.trees[0][0][5] == pytest.approx(best, rel=1e-6) and gain >= best * (1 - 1e-6)


def test_lambdamart_does_not_depend_on_tasks(spark):
    train, held = frame(spark, learning_rows(range(60), 9), LEARNING), frame(spark, learning_rows(range(100, 120), 10), LEARNING)
    for objective in (ltr._Lambda(), ltr._Pointwise()):
        one, three = (ltr._fit(train, held, ["x", "y"], objective, 12, tasks) for tasks in (1, 3))
        assert one.to_json() == three.to_json() and one.trees


def test_lambdamart_rows_stay_with_the_tasks(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    train = frame(spark, learning_rows(range(20), 9), LEARNING)
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("rows came to the driver"))
    assert ltr.fit_lambdamart(train, train.limit(0), ["x", "y"], rounds=2).trees


def broadcast_keys(df):
    """Keys of the joins that the planner makes a broadcast of tables by query, product or term."""
    import re

    return re.findall(r"BroadcastHashJoin \[(?:query_id|product_id|term)#", df._jdf.queryExecution().executedPlan().toString())


def test_lambdamart_scores_tables_by_query_are_no_broadcasts(spark):
    """Pair scores, means and features join tables with a row per query, term or product by shuffles, however small they are."""
    from vitrine.plans.understanding import feature_matrix

    docs = frame(spark, [("b", "red shoe"), ("a", "red shoe")], "product_id string, text string")
    asked = frame(spark, [(1, "red"), (2, "shoe")], "query_id long, t string")
    index = sparse.build_index(docs, "product_id", "text")
    scored = sparse.score_pairs(index, asked, asked.select("query_id", F.lit("a").alias("product_id")), "product_id", "query_id", "t")
    mean = sparse.lexical_specificity(index, asked, "query_id", "t")
    assert scored.filter("score > 0").count() == 2 and mean.filter("specificity > 0").count() == 2
    for df in (scored, mean, feature_matrix(spark, "/root/testdata/sf0.001")):
        assert broadcast_keys(df) == []


def test_pointwise_gbt_scores_splits_are_no_broadcasts(spark, monkeypatch):
    from vitrine.plans import learning

    seen = []
    monkeypatch.setattr(learning, "materialize", lambda df, label: seen.append(broadcast_keys(df)) or df)
    learning._split(spark, "/root/testdata/sf0.001")
    assert seen == [[], []]


def test_pointwise_gbt_scores_groups_and_codes_are_no_broadcasts(spark):
    """Mixed groups and category codes grow with the tables, too."""
    from vitrine.operators import features, foundation

    rows = frame(spark, [(1, "train", "g"), (2, "test", "g"), (3, "train", "h"), (4, "train", None)], "query_id long, official_split string, normalized_query_sha256 string")
    split = foundation.assign_splits(rows)
    assert {r.query_id: r.quarantine_reason for r in split.collect() if r.project_split == "quarantine"} == {1: "normalized_query_occurs_in_official_test"}
    coded = features.with_code(frame(spark, [("a",), ("c",), (None,)], "b string"), frame(spark, [("a", 2), ("b", 3)], "b string, code int"), "b", "n")
    assert {r.b: r.n for r in coded.collect()} == {"a": 2, "c": 1, None: 0}
    for df in (split, coded):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_ranker_importance_population_is_no_broadcast(spark):
    from vitrine.scratch import materialize

    kept, _ = ltr.training_population(materialize(frame(spark, learning_rows(range(3), 9), LEARNING)))
    assert kept.count() == 24 and broadcast_keys(kept) == []


def test_ranker_importance_parser_entries_are_no_broadcasts(spark):
    """The parser's entries grow with the brands and colours of the catalogue."""
    from vitrine.operators import understand

    known = frame(spark, [("brand", "red star", 2, "Red Star"), ("color", "red", 1, "red")], "kind string, gram string, width int, value string")
    found = understand.longest_matches(frame(spark, [(1, ["red", "star"]), (2, ["red"])], "query_id long, tokens array<string>"), "query_id", known, ("brand", "color"))
    assert {r.query_id: (r.brand, r.color) for r in found.collect()} == {1: ("Red Star", "red"), 2: (None, "red")}
    alias = understand.alias_entries(frame(spark, [("navy",), ("gray",), (None,)], "c string"), "c")
    assert {r.gram for r in alias.collect()} == {"charcoal", "grey", "navy blue"}
    for df in (found, alias):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_bm25_ties_and_empty_texts(spark):
    docs = frame(spark, [("b", "red shoe"), ("a", "red shoe"), ("c", None), ("d", "")], "id string, text string")
    asked = frame(spark, [(1, "red"), (2, "nothing"), (3, None)], "q long, t string")
    got = sparse.search(sparse.build_index(docs, "id", "text"), asked, "id", "q", "t", 5).orderBy("rank").collect()
    assert [(r.q, r.id) for r in got] == [(1, "a"), (1, "b")] and got[0].score == pytest.approx(got[1].score)


def test_knn_blocks_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).round(2).astype("float32")
    base = frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id long, v array<float>")
    got = {}
    for r in dense.knn(base, base.filter("id % 7 = 0"), "id", "v", "id", "v", 5, skip_self=True, block=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for q in range(0, 60, 7):
        scores = np.round(vectors.astype(float) @ vectors[q].astype(float), 9)
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert [got[q][k] for k in range(1, 6)] == want


def test_encoder_is_unit_and_blank_is_none():
    v = encode_text("Red  SHOE red")
    assert sum(x * x for x in v) == pytest.approx(1.0, abs=1e-5) and v == encode_text("red shoe RED")
    assert encode_text("  ") is None and encode_text(None) is None


def test_text_functions(spark):
    assert normalize_query(" Ｆancy　Straße \n") == "fancy strasse"
    rows = frame(spark, [("Ｒed-Shoe's 12 ﬁne",), (None,)], "t string").select(F.expr(tokens_sql("t")).alias("w")).collect()
    assert rows[0].w == ["red-shoe's", "12", "fine"] and rows[1].w is None
    assert clean_text_exact("<b>Wireless</b>\u0000 Mouse &amp; pad") == "Wireless Mouse & pad"
    assert clean_text_exact(None) == ""


def test_hash_bucket_is_that_of_python(spark):
    import hashlib

    row = frame(spark, [("k", 7)], "a string, b long").select(hash_key("a", "b").alias("h"), hash_bucket(hash_key("a", "b")).alias("n")).first()
    want = hashlib.sha256(b"k\x007").hexdigest()
    assert row.h == want and row.n == int(want[:16], 16) % 10_000


def test_validation_reports_every_kind_of_failure(spark):
    spec = validate.TableSpec("t", {"id": "bigint", "label": "string", "gone": "int"}, ("id",), ("label",), {"label": ("E", "S")})
    got = {r.check_id: r.failures for r in validate.validate(frame(spark, [(1, "E"), (1, "x"), (2, None)], "id long, label string"), spec).collect()}
    assert got == {"columns_present": 1, "columns_expected": 0, "types": 0, "not_empty": 0, "not_null:label": 1, "domain:label": 2, "unique_key": 1}
    empty = {r.check_id: r.failures for r in validate.validate(frame(spark, [], "id long, label string"), spec).collect()}
    assert empty["not_empty"] == 1 and empty["unique_key"] == 0


def test_strict_map_and_one_to_one(spark):
    df = frame(spark, [(1, "E"), (2, None)], "id long, l string")
    assert [r.v for r in df.select(validate.strict_map("l", {"E": 3, "S": 2}).alias("v")).collect()] == [3, None]
    with pytest.raises(Exception, match="unmapped value"):
        frame(spark, [("Z",)], "l string").select(validate.strict_map("l", {"E": 3}).alias("v")).collect()
    with pytest.raises(ValueError, match="not unique"):
        validate.join_one_to_one(df, frame(spark, [(1,), (1,)], "id long"), ["id"])


def test_features_are_44_and_do_not_leak():
    names = list(feats.feature_sql(feats.Dialect()))
    assert len(names) == 44 and not any(found for _, found in feats.leakage_report(names))


def poisson_weight(key, c):
    import hashlib

    u = int(hashlib.sha256(key.encode()).hexdigest()[13 * c : 13 * c + 13], 16) / 16**13
    return next((k for k, p in enumerate(metrics.POISSON) if u < p), len(metrics.POISSON))


def test_intervals_against_brute_force(spark, monkeypatch):
    import numpy as np

    from vitrine.plans import evaluation, reporting

    rows = [(q, s, 10, (q * k % 17) / 16) for q in range(1, 31) for s, k in (("bm25", 5), ("dense", 7), ("rrf", 3))]
    ndcg = frame(spark, rows, "query_id long, stage string, cutoff int, ndcg double")
    groups = frame(spark, [(q, f"g{q % 11:02}") for q in range(1, 31)], "query_id long, group_key string")
    for module in (evaluation, reporting):
        monkeypatch.setattr(module, "_ndcg", lambda *_: ndcg)
        monkeypatch.setattr(module, "_groups", lambda *_: groups)

    def interval(values):
        est = []
        for r in range(1000):
            w = {g: poisson_weight(f"g{g:02}|{r // 4}", r % 4) for g in range(11)}
            n = sum(w[q % 11] for q in values)
            if n:
                est.append(sum(w[q % 11] * v for q, v in values.items()) / n)
        return np.percentile(est, [2.5, 97.5])

    by = {s: {q: v for q, t, _, v in rows if t == s} for s in ("bm25", "dense", "rrf")}
    got = {r.stage: r for r in evaluation.grouped_bootstrap_ci(spark, "").collect()}
    assert set(got) == set(by)
    for s, values in by.items():
        assert [got[s].lower, got[s].upper] == pytest.approx(interval(values), abs=2e-6)
    want = {}
    for s in ("dense", "rrf"):
        delta = {q: v - by["bm25"][q] for q, v in by[s].items()}
        if sum(delta.values()) <= 0:
            want[s] = "no_mean_gain"
        elif interval(delta)[0] <= 0:
            want[s] = "interval_reaches_zero"
    assert {r.stage: r.finding for r in reporting.negative_findings(spark, "").collect()} == want


def test_poisson_intervals_are_near_those_of_drawing_groups(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(f"g{g}", "s", float(rng.normal(0.5, 0.2))) for g in range(150) for _ in range(int(rng.integers(1, 4)))]
    got = metrics.bootstrap(frame(spark, rows, "g string, s string, v double"), ["s"], "g", "v", 1000).collect()[0]
    sums = [(sum(v for h, _, v in rows if h == f"g{g}"), sum(h == f"g{g}" for h, *_ in rows)) for g in range(150)]
    est = []
    for _ in range(4000):
        drawn = [sums[i] for i in rng.integers(0, 150, 150)]
        est.append(sum(x for x, _ in drawn) / sum(n for _, n in drawn))
    assert [got.lower, got.upper] == pytest.approx(np.percentile(est, [2.5, 97.5]), abs=0.006) and got.groups == 150


def test_quantiles_of_hot_and_small_groups(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(g, None if i % 9 == 4 else float(rng.integers(0, 30))) for g, n in (("hot", 500), ("a", 3), (None, 4), ("b", 1)) for i in range(n)] + [("none", None)]
    got = {r.g: (r.lo, r.hi) for r in metrics.quantiles(frame(spark, rows, "g string, v double"), ["g"], "v", {"lo": 0.31, "hi": 0.95}).collect()}
    for g in ("hot", "a", None, "b"):
        assert got[g] == pytest.approx(tuple(np.percentile([v for h, v in rows if h == g and v is not None], [31, 95])))
    assert "none" not in got
    assert {r.g: r.p95 for r in metrics.percentiles(frame(spark, rows, "g string, v double"), "g", "v").collect()}["none"] is None


def test_protocols_are_kept_apart(spark):
    queries = frame(spark, [(1,)], "query_id long")
    judged = frame(spark, [(1, "e", 3, 1.0), (1, "s", 2, 0.1)], "query_id long, product_id string, label_id int, gain double")
    lists = lambda *items: frame(spark, [(1, p, k) for k, p in enumerate(items, start=1)], "query_id long, product_id string, rank int")
    got = metrics.evaluate(metrics.CLOSED_POOL, queries, lists("s", "e"), judged, [2]).filter("threshold = 'exact'").collect()[0]
    assert (got.mrr, got.precision) == (0.5, 0.5) and 0 < got.ndcg < 1
    for bad in (lists("s"), lists("s", "e", "x"), lists("s", "e", "e")):
        with pytest.raises(metrics.ProtocolError, match="complete"):
            metrics.evaluate(metrics.CLOSED_POOL, queries, bad, judged, [2])
    open_ = {(r.threshold): r for r in metrics.evaluate(metrics.RETRIEVAL, queries, lists("x", "s", "e"), judged, [3]).collect()}
    assert open_["exact"].known_judgment_coverage + open_["exact"].unjudged_rate == pytest.approx(1)
    with pytest.raises(metrics.ProtocolError, match="gaps"):
        metrics.evaluate(metrics.END_TO_END, queries, frame(spark, [(1, "x", 2)], "query_id long, product_id string, rank int"), judged, [3])
    with pytest.raises(metrics.ProtocolError):
        metrics.evaluate("open", queries, lists("s"), judged, [3])


def test_contiguity(spark):
    rows = [("ok", 1), ("ok", 2), ("gap", 1), ("gap", 3), ("twice", 1), ("twice", 1), ("null", 1), ("null", None), ("late", 2), ("late", 3)]
    got = {r.g: r.contiguous for r in metrics.contiguity(frame(spark, rows, "g string, k int"), ["g"], "k").collect()}
    assert got == {"ok": True, "gap": False, "twice": False, "null": False, "late": False}


def test_longest_names_of_any_width(spark):
    long = "grand old house of fine tools and lamps"
    queries = frame(spark, [(1, f"the {long} desk lamp"), (2, "house of desk")], "query_id long, query string")
    products = frame(spark, [(long, "red"), ("house", None)], "normalized_brand string, normalized_color string")
    assert {r.query_id: r.brand for r in understand.parse(queries, "query_id", "query", products).collect()} == {1: long, 2: "house"}


def test_query_hash_is_that_of_json(spark):
    import hashlib
    import json

    queries = frame(spark, [(1, 'a "12-inch" \\ lamp')], "query_id long, query string")
    products = frame(spark, [("acme", "red")], "normalized_brand string, normalized_color string")
    state = understand.parser_state(products)
    parsed = understand.parse_tokens(queries, "query_id", "query")
    document = {"normalized_text": parsed.first().normalized, "parser_state_sha256": state.first().state, "parser_version": understand.PARSER_VERSION}
    want = hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert understand.query_hash(parsed, "query_id", state).first().query_sha256 == want
    other = understand.parser_state(frame(spark, [("acmes", "red")], "normalized_brand string, normalized_color string"))
    assert other.first().state != state.first().state


def test_broken_cohorts_are_told(spark):
    rows = [(1, "a", "train", True, True), (2, "a", "test", True, False), (3, "b", "quarantine", False, True), (3, "c", None, False, False)]
    got = {r.check_id: r.failures for r in __import__("vitrine.operators.foundation", fromlist=["x"]).cohort_invariants(frame(spark, rows, "query_id long, normalized_query_sha256 string, project_split string, in_development boolean, in_portfolio boolean")).collect()}
    assert got == {"development_nested_in_portfolio": 1, "quarantine_excluded": 1, "split_present": 1, "unique_query_ids": 1, "group_split_disjointness": 1}
