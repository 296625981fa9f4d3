import pytest
from pyspark.sql import functions as F

from vitrine.functions.vectors import encode
from vitrine.operators import search, serving


def test_request_bounds():
    assert serving.Request("lamp").top_k == 10
    for bad in ({"query": " "}, {"query": "x" * 513}, {"query": "x", "mode": "odd"}, {"query": "x", "top_k": 0}):
        with pytest.raises(ValueError):
            serving.Request(**bad)


def test_only_small_requests_from_here():
    for host in ("localhost", "localhost:8000", "127.0.0.1:80", "[::1]:80", "::1"):
        serving.accept(host, b"{}")
    for host, body in (("example.org", b""), ("10.0.0.1:80", b""), ("127.0.0.1", b"x" * 20_000), ("", b"")):
        with pytest.raises(ValueError):
            serving.accept(host, body)


def test_gates():
    ticks = iter(range(100))
    assert serving.measure(lambda: None, 1, 3, lambda: next(ticks)) == [1000.0] * 3
    got = serving.gate({"parse": [1, 2, 3, 4, 5]}, {"parse": 4.8, "rank": 10})
    assert got["parse"] == (pytest.approx(4.8), 4.8, True) and got["rank"][2] is False


def test_encoding_resumes(spark):
    docs = spark.createDataFrame([("a", "red"), ("b", "blue")], "id string, text string")
    left = serving.encode_missing(docs, docs.filter("id = 'a'"), "id", "text", encode)
    assert [r.id for r in left.collect()] == ["b"]


def test_modes_fall_back_with_a_reason(spark):
    fused = spark.createDataFrame([(1, "a", 1, 1, None), (1, "b", 2, 2, None)], "query_id long, product_id string, rank int, sparse_rank int, dense_rank int")
    scored = spark.createDataFrame([("pointwise", 1, "b", 9.0), ("pointwise", 1, "a", float("nan"))], "model_id string, query_id long, product_id string, score double")
    got = {}
    for r in search.search_modes(fused, scored).collect():
        got.setdefault(r["mode"], []).append((r["rank"], r.product_id, r.fallback))
    assert got["dense"] == [(1, "a", "dense_unavailable"), (2, "b", "dense_unavailable")]
    assert got["pointwise"] == [(1, "b", None)] and got["bm25"][0] == (1, "a", None)
    change = search.rank_changes(search.search_modes(fused, scored)).filter((F.col("mode") == "pointwise")).collect()
    assert [(r.product_id, r.rank_change) for r in change] == [("b", 1)]
    products = spark.createDataFrame([("a", "x", "t", None, "d" * 300, None)], "product_id string, normalized_brand string, title string, brand string, description string, color string")
    shown = {r.product_id: r for r in search.with_products(got_df(spark), products).collect()}
    assert len(shown["a"].snippet) == 240 and shown["b"].missing_product


def got_df(spark):
    return spark.createDataFrame([(1, "bm25", "a", 1), (1, "bm25", "b", 2)], "query_id long, mode string, product_id string, rank int")


def test_diversity_moves_repeats_back(spark):
    rows = [(1, "m", p, i) for i, p in enumerate("abcd", start=1)]
    found = spark.createDataFrame(rows, "query_id long, mode string, product_id string, rank int")
    brands = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "product_id string, normalized_brand string")
    assert [r.product_id for r in search.diversified(found, brands).orderBy("rank").collect()] == ["a", "b", "d", "c"]
