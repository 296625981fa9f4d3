import io
import urllib.error
from collections import Counter

import pytest

from vitrine.sources import acquire, config, readers, sinks
from vitrine.sources.artifacts import ArtifactError, ArtifactStore, file_digest
from vitrine.sources.store import ProductStore
from vitrine.streaming import events


def test_artifact_is_immutable_and_tamper_proof(tmp_path):
    store = ArtifactStore(tmp_path)
    with store.stage("base", {"a": 1}) as folder:
        (folder / "data.txt").write_text("x")
    base = store.find("base", {"a": 1})
    with store.stage("child", {"b": 1}, {"base": base}) as folder:
        (folder / "data.txt").write_text("y")
    child = store.load(store.place("child", {"b": 1}))
    assert child.parents == {"base": base.digest}
    with pytest.raises(ArtifactError, match="never change"), store.stage("base", {"a": 1}):
        pass
    (base.path / "data.txt").write_text("z")
    with pytest.raises(ArtifactError, match="was changed"):
        store.load(child.path)


def test_failed_stage_leaves_nothing(tmp_path):
    store = ArtifactStore(tmp_path)
    with pytest.raises(RuntimeError), store.stage("base", {}) as folder:
        (folder / "half").write_text("x")
        raise RuntimeError
    assert store.find("base", {}) is None


def test_acquire_retries_checks_and_reuses(tmp_path):
    calls, waits = [], []

    def transport(url):
        calls.append(url)
        if len(calls) == 1:
            raise urllib.error.URLError("down")
        return io.BytesIO(b"hello")

    import hashlib

    pin = acquire.PinnedFile("f.txt", "https://x.example/f", 5, hashlib.sha256(b"hello").hexdigest())
    assert acquire.acquire([pin], tmp_path, transport, waits.append) == {"f.txt": "downloaded"}
    assert waits == [0.5] and acquire.acquire([pin], tmp_path, transport) == {"f.txt": "reused"}
    bad = acquire.PinnedFile("g.txt", "https://x.example/g", 5, "0" * 64)
    with pytest.raises(acquire.AcquireError, match="differs"):
        acquire.acquire([bad], tmp_path, lambda url: io.BytesIO(b"hello"))
    assert not (tmp_path / "g.txt").exists() and not list(tmp_path.glob("*.part"))


def test_config_layers(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("x: {k: 1, b: 2}\n")
    (tmp_path / "b.yaml").write_text("x: {k: 3}\n")
    got, digest = config.load([tmp_path / "a.yaml", tmp_path / "b.yaml"], {"x.b": 5})
    assert got == {"x": {"k": 3, "b": 5}} and digest == config.load([tmp_path / "a.yaml"], {"x.k": 3, "x.b": 5})[1]
    with pytest.raises(config.ConfigError, match="repeated"):
        config.read_yaml("a: 1\na: 2\n")
    with pytest.raises(config.ConfigError, match="unknown"):
        config.with_overrides({"a": {"b": 1}}, {"a.c": 1})


def test_json_is_canonical_and_strict():
    assert sinks.canonical_json({"b": 1, "a": "ß"}) == '{"a":"ß","b":1}'
    with pytest.raises(ValueError, match="repeated key"):
        sinks.strict_json('{"a":1,"a":2}')
    with pytest.raises(ValueError):
        sinks.canonical_json(float("nan"))
    assert sinks.markdown_table(["a"], [["x|y"]]) == "| a |\n| --- |\n| x\\|y |\n"


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, f"n{i}") for i in range(30)], "g long, i long, n string")
    sinks.grouped_parquet(df, f"{tmp_path}/grouped", "g", ["i"])
    seen = {}
    for row in readers.parquet(spark, f"{tmp_path}/grouped", ["g", "i"]).selectExpr("g", "input_file_name() AS f").distinct().collect():
        assert seen.setdefault(row.g, row.f) == row.f
    sizes = {0: 1, 1: 7, 2: 3, 3: 10, 4: 2, 5: 6, 6: 5, 7: 5, 8: 1}
    many = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)] + [(None, 1)], "g long, i long")
    sinks.grouped_parquet(many, f"{tmp_path}/bounded", "g", ["i"], 10)
    files = readers.parquet(spark, f"{tmp_path}/bounded").selectExpr("g", "i", "input_file_name() AS f").collect()
    assert len(files) == 41 and max(Counter(r.f for r in files).values()) <= 10
    assert all(len({r.f for r in files if r.g == g}) == 1 for g in (*sizes, None))
    with pytest.raises(ValueError, match="more than 9"):
        sinks.grouped_parquet(many, f"{tmp_path}/over", "g", ["i"], 9)
    sinks.ordered_parquet(df, f"{tmp_path}/ordered", ["i"], 7)
    assert readers.parquet(spark, f"{tmp_path}/ordered").count() == 30
    sinks.report_csv(df, f"{tmp_path}/csv", ["i"])
    back = readers.csv(spark, f"{tmp_path}/csv", "g long, i long, n string")
    assert back.exceptAll(df).isEmpty() and back.count() == 30
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in readers.checksums(spark, f"{tmp_path}/csv").collect()}
    part = next((tmp_path / "csv").glob("part-*.csv"))
    assert sums[part.name] == file_digest(part)
    sinks.bar_chart_svg(tmp_path / "c.svg", "t<", [("a", 1.0)])
    assert "t&lt;" in (tmp_path / "c.svg").read_text()


def test_product_store(spark, tmp_path):
    store = ProductStore(spark, f"{tmp_path}/store", buckets=4)
    store.build(spark.createDataFrame([(f"p{i}", i) for i in range(20)], "product_id string, v long"))
    assert {r.product_id: r.v for r in store.fetch(["p3", "p7", "p3"]).collect()} == {"p3": 3, "p7": 7}
    with pytest.raises(KeyError, match="nope"):
        store.fetch(["p1", "nope"])
    hit, miss = store.lookup(spark.createDataFrame([("p1",), ("zz",)], "product_id string"))
    assert hit.count() == 1 and [r.product_id for r in miss.collect()] == ["zz"]


def test_stream_equals_batch(spark, tmp_path):
    stream = events.read_events(spark, "/root/testdata/sf0.001", name="events.parquet")
    done = events.run_to_memory(events.windowed(stream), "windows", "complete", str(tmp_path / "cp"))
    batch = events.windowed(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    count = lambda df: {(r.window_start, r.event_type): r.events for r in df.collect()}
    assert count(done) == count(batch)


def test_search_stream_answers_each_batch(spark, tmp_path):
    spark.createDataFrame([(1, "red")], "q long, t string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("q long, t string").parquet(f"{tmp_path}/in")
    query = events.search_stream(stream, lambda b: b.withColumnRenamed("t", "hit"), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    assert [(r.q, r.hit) for r in spark.read.parquet(f"{tmp_path}/out").select("q", "hit").collect()] == [(1, "red")]
