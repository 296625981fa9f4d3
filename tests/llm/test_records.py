"""The operators on records: top N, splits, canonical values, fused rankings, distinctive terms."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vitrine.llm import canonical, distinctive, fused, splits, topn


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- top N ---------------------------------------------------------------------------------------------------


def best(rows, n):
    by = defaultdict(dict)
    for g, p, s, b in rows:
        if s is None or math.isnan(s):
            continue
        key = (-s, b is None, b or 0, p is None, p or "")
        if p not in by[g] or key < by[g][p]:
            by[g][p] = key
    return {(g, p, k) for g, items in by.items() for k, (p, _) in enumerate(sorted(items.items(), key=lambda x: x[1])[:n], start=1)}


def topn_rows():
    rng = random.Random(4)
    rows = [("hot", f"p{i}", rng.choice([0.1, 0.5, 0.9, rng.random()]), rng.choice([1, 2, None])) for i in range(3000)]
    rows += [(f"g{g}", f"p{i}", round(rng.random(), 1), rng.choice([1, 2])) for g in range(40) for i in range(rng.randint(1, 25))]
    rows += [(None, "x", 1.0, 1), (None, "y", 1.0, 1), ("odd", "n", None, 1), ("odd", "m", float("nan"), 1), ("odd", "i", float("inf"), 1), ("g1", None, 0.95, None)]
    rows += rng.sample(rows, 200)  # repeated rows
    return rows


def test_top_n_equals_brute_force(spark):
    rows = topn_rows()
    df = frame(spark, rows, "g string, p string, s double, b int").withColumn("rank", F.lit("clash"))
    got = topn.top_n_per_group(df, ["g"], "p", "s", ["b"], n=5, row_group_rows=100)
    assert got.columns == ["g", "p", "s", "b", "rank_in_group"]
    assert {(r.g, r.p, r.rank_in_group) for r in got.collect()} == best(rows, 5)


def test_top_n_skips_row_groups(spark, tmp_path):
    """A row group with only low scores of full groups is not read: its other columns may even be damaged."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = tmp_path / "layout"
    path.mkdir()
    schema = pa.schema([("g", pa.string()), ("p", pa.string()), ("s", pa.float64())])
    with pq.ParquetWriter(path / "part-0.parquet", schema, compression="NONE", use_dictionary=["g"]) as w:
        w.write_table(pa.table({"g": ["a"] * 50, "p": [f"p{i:04d}" for i in range(50)], "s": [9.0 - i / 100 for i in range(50)]}, schema))
        w.write_table(pa.table({"g": ["a"] * 50, "p": [f"q{i:04d}" for i in range(50)], "s": [1.0 - i / 100 for i in range(50)]}, schema))
    file = path / "part-0.parquet"
    meta = pq.ParquetFile(file).metadata.row_group(1).column(1)
    raw = bytearray(file.read_bytes())
    raw[meta.data_page_offset : meta.data_page_offset + meta.total_compressed_size] = b"\xff" * meta.total_compressed_size
    file.write_bytes(bytes(raw))
    layout = spark.read.schema("g string, p string, s double").parquet(f"file://{path}")
    got = topn.top_n_from_layout(layout, ["g"], "p", "s", [], 3)
    assert sorted(r.p for r in got.collect()) == ["p0000", "p0001", "p0002"]
    assert [(r.row_groups_read, r.row_groups_skipped) for r in topn.skips(got).collect()] == [(1, 1)]


def test_top_n_layout_is_kept_and_skips_most_row_groups(spark, tmp_path):
    rows = [(f"g{i % 5}", f"p{i}", float(i)) for i in range(20_000)]
    frame(spark, rows, "g string, p string, s double").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    call = {"groups": ["g"], "item": "p", "score": "s", "n": 3, "row_group_rows": 200, "inputs": [f"{tmp_path}/in"]}
    told = topn.skips(topn.partial_top_n(df, **call))
    one = {(r.file, r.row_groups_read) for r in told.collect()}
    assert told.selectExpr("sum(row_groups_skipped) > 10 * sum(row_groups_read) AS most").first().most
    assert {(r.file, r.row_groups_read) for r in topn.skips(topn.partial_top_n(df, **call)).collect()} == one  # the same files
    assert {(r.g, r.p) for r in topn.top_n_per_group(df, **call).collect()} == {(f"g{i % 5}", f"p{i}") for i in range(20_000 - 15, 20_000)}


def test_top_n_rows_in_any_order():
    rng = random.Random(9)
    rows = [(f"g{rng.randint(0, 3)}", f"p{rng.randint(0, 60)}", rng.random()) for _ in range(3000)]
    best_ = topn._Best(4)
    for g, p, s in rows:
        best_.add((g,), p, (-s, False, p.encode()), (g, p, s))
    best_.settle({(g,) for g, *_ in rows})
    want = best([(g, p, s, None) for g, p, s in rows], 4)
    assert {(g, p) for g, p, _ in best_.rows()} == {(g, p) for g, p, _ in want}


def test_top_n_of_nothing(spark):
    df = frame(spark, [], "g string, p string, s double")
    assert topn.top_n_per_group(df, ["g"], "p", "s").count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, ["g"], "p", "s", rank="p")


# --- splits --------------------------------------------------------------------------------------------------


def groups_of(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, *keys in rows:
        find(("r", i))
        for k, v in enumerate(keys):
            if v is not None:
                parent[find(("r", i))] = find((k, v))
    return {i: find(("r", i)) for i, *_ in rows}


def test_components_of_long_chains_and_stars(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("s0", f"s{i}") for i in range(1, 40)] + [("x", "x"), ("c001", "c000")]
    got = {r.node: r.component for r in splits.components(frame(spark, edges, "a string, b string"), "a", "b").collect()}
    assert {v for k, v in got.items() if k[0] == "c"} == {"c000"} and {v for k, v in got.items() if k[0] == "s"} == {"s0"}
    assert "x" not in got


def test_splits_keep_groups_together(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None, f"k{i}"]) if i % 3 else f"k{i // 6}", rng.choice([None, f"t{i // 4}"])) for i in range(80)]
    split = {i: rng.choice(["train", "test", None, "quarantine"]) if i % 5 == 0 else None for i, _, _ in rows}
    df = frame(spark, [(*r, split[r[0]], "clash") for r in rows], "id long, sha string, txt string, now string, component string")
    out, state = splits.assign_splits(df, "id", ["sha", "txt"], "now")
    got = {r.id: r for r in out.collect()}
    truth = groups_of(rows)
    assert len(got) == 80
    for a, b in ((a, b) for a in truth for b in truth if a < b):
        assert (truth[a] == truth[b]) == (got[a].component == got[b].component)
    for g in set(truth.values()):
        members = [i for i in truth if truth[i] == g]
        had = {split[i] for i in members if split[i] in ("train", "validation", "test")}
        new = {got[i].new_split for i in members}
        assert len(new) == 1
        assert new == ({"quarantine"} if len(had) > 1 else had or new) and (had or got[members[0]].status == "filled")
    assert state.groupBy("key").count().filter("count > 1").isEmpty()


def test_new_groups_fill_the_deficit(spark):
    df = frame(spark, [(i, f"k{i}", "train" if i < 50 else None) for i in range(100)], "id long, k string, now string")
    out, _ = splits.assign_splits(df, "id", ["k"], "now", {"train": 0.5, "test": 0.5})
    assert Counter(r.new_split for r in out.collect()) == {"train": 50, "test": 50}


def test_state_keeps_splits_and_quarantines_merges(spark):
    first = frame(spark, [(1, "a", "x", "train"), (2, "b", "y", "test")], "id long, k string, t string, now string")
    _, state = splits.assign_splits(first, "id", ["k", "t"], "now")
    state = spark.createDataFrame(state.collect(), state.schema)
    again, _ = splits.assign_splits(frame(spark, [(3, "a", None, None)], "id long, k string, t string, now string"), "id", ["k", "t"], "now", state=state)
    assert [(r.new_split, r.status) for r in again.collect()] == [("train", "kept")]
    merge, _ = splits.assign_splits(frame(spark, [(4, "a", "y", None)], "id long, k string, t string, now string"), "id", ["k", "t"], "now", state=state)
    assert [(r.new_split, r.status) for r in merge.collect()] == [("quarantine", "quarantined")]


SPLIT_ROWS = "id long, k string, t string, now string"


def test_three_runs_on_a_persisted_state(spark, tmp_path):
    """Quarantine lasts, components without a record stay, sizes count over all runs, chains merge across runs."""
    path = f"file://{tmp_path}/state"
    assert splits.load_state(spark, path) is None

    def run(rows):
        out, state = splits.assign_splits(frame(spark, rows, SPLIT_ROWS), "id", ["k", "t"], "now", {"train": 0.5, "test": 0.5}, splits.load_state(spark, path))
        got = {r.id: (r.new_split, r.status) for r in out.collect()}
        splits.save_state(state, path)
        return got

    one = run([(1, "a", "x", "train"), (2, "a", "y", "test"), (3, "b", None, "train"), (15, "b", None, "train"), (4, "c", None, None), (5, None, None, None)])
    assert one[1] == one[2] == ("quarantine", "quarantined") and one[3] == ("train", "kept") and one[4] == one[5] == ("test", "filled")
    two = run([(6, "a", None, None), (7, "new", "x", None), (8, "d", None, None)])
    assert two[6] == two[7] == ("quarantine", "quarantined") and two[8][1] == "filled"
    three = run([(9, "new", "z", None), (10, "b", None, None), (11, "c", "w", "train"), (12, "b", "q", None), (13, "d", "b2", None), (14, "e", "b2", None)])
    assert three[9] == ("quarantine", "quarantined") and three[10] == three[12] == ("train", "kept")
    assert three[11] == ("quarantine", "quarantined")  # its component was filled with test before
    assert three[13] == three[14] == (two[8][0], "kept")
    state = splits.load_state(spark, path)
    rows = {r.key: r for r in state.collect()}
    assert set(rows) == {"_k0:a", "_k1:x", "_k1:y", "_k0:b", "_k0:c", "_self:5", "_k0:new", "_k0:d", "_k1:z", "_k1:w", "_k1:q", "_k1:b2", "_k0:e"} and state.count() == 13
    assert rows["_k1:z"].component == rows["_k1:y"].component and rows["_k1:z"].size == 5 and sorted(rows["_k1:z"].declared) == ["test", "train"]
    assert rows["_k0:b"].size == 4 and rows["_self:5"].size == 1
    again = splits.placed(frame(spark, [(2, "a", "y", "test"), (14, "e", None, None), (99, "unknown", None, None)], SPLIT_ROWS), "id", ["k", "t"], "now", state)
    assert {r.id: r.new_split for r in again.collect()} == {2: "quarantine", 14: two[8][0], 99: None}
    assert run([]) == {} and splits.load_state(spark, path).count() == 13


def test_shares_over_all_runs(spark):
    state, rng, given = None, random.Random(5), Counter()
    for n in range(3):
        rows = [(1000 * n + i, f"k{n}-{i // rng.randint(1, 3)}", None, "train" if n == 0 and i < 60 else None) for i in range(200)]
        out, state = splits.assign_splits(frame(spark, rows, SPLIT_ROWS), "id", ["k", "t"], "now", {"train": 0.6, "validation": 0.1, "test": 0.3}, state)
        given.update(r.new_split for r in out.collect())
    assert sum(given.values()) == 600 and given["quarantine"] == 0
    for s, share in (("train", 0.6), ("validation", 0.1), ("test", 0.3)):
        assert given[s] / 600 == pytest.approx(share, abs=0.01)


def test_runs_in_parts_group_like_one_run(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([None, f"k{rng.randint(0, 40)}"]), rng.choice([None, f"t{rng.randint(0, 40)}"]), rng.choice([None, "train", "test"])) for i in range(90)]
    whole, _ = splits.assign_splits(frame(spark, rows, SPLIT_ROWS), "id", ["k", "t"], "now")
    want = {r.id: (r.component, len(r.declared) > 1) for r in whole.collect()}
    state = None
    for part in (rows[:40], rows[40:60], rows[60:]):
        _, state = splits.assign_splits(frame(spark, part, SPLIT_ROWS), "id", ["k", "t"], "now", state=state)
    got = {r.id: (r.component, len(r.declared) > 1) for r in splits.placed(frame(spark, rows, SPLIT_ROWS), "id", ["k", "t"], "now", state).collect()}
    assert got == want


def test_splits_of_nothing(spark):
    out, state = splits.assign_splits(frame(spark, [], "id long, k string, now string"), "id", ["k"], "now")
    assert out.count() == 0 and state.count() == 0


# --- canonical values ----------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [((0, 0), (4, 1)), ((0, 0), (4, 1), (7, 2))])
def test_pigeonhole_join_equals_all_pairs(spark, monkeypatch, edits):
    monkeypatch.setattr(canonical, "EDITS", edits)
    rng = random.Random(8)
    refs = [(i, "".join(rng.choices("abc", k=rng.randint(1, 9)))) for i in range(40)]
    values = ["".join(rng.choices("abc", k=rng.randint(0, 10))) for _ in range(80)] + ["", "abcabc" * 50]
    got = canonical.match_values(frame(spark, [(v,) for v in values], "val_key string"), frame(spark, refs, "entry_id long, ref_key string"))
    allowed = lambda n: max(k for least, k in edits if n >= least)
    want = {}
    for v in set(values) - {""}:
        near = [(edit_distance(v, r), i) for i, r in refs if edit_distance(v, r) <= allowed(len(r))]
        if near:
            want[v] = min(near)
    assert {r.val_key: (r.edits, r.entry_id) for r in got.collect()} == want


def test_entered_brands_and_colors(spark):
    brands = frame(spark, [(1, "Quarifuthum"), (2, "Yorajell Trading"), (3, "Peluvack & Orm"), (4, "Quarifuthums")], "brand_id long, brand_name string")
    written = {
        "QUARIFUTHUM ": 1, "Quarifuthum®": 1, "Visit the Quarifuthum Store": 1, "Q U A R I F U T H U M": 1, "Y O R A J E L L T R A D I N G": 2, "Yoraajell Tradinng": 2, "Qurifuthum": 1, "Ｑｕａｒｉｆｕｔｈｕｍ": 1, "Quarifuthums": 4,
        "Trading, Yorajell": 2, "Y0rajell Trading": 2, "Marca: Yorajell Trading Co., Ltd.": 2, "Peluvack and Orm": 3, "Peluvack &amp; Orm": 3, "Galosoft": 0, "-": 0, "N/A": 0, "": 0,
    }
    rows = frame(spark, [(f"p{i}", b, "clash") for i, b in enumerate(written)] + [("none", None, "x")], "product_id string, brand string, entry_id string")
    got = {r.val: r.entry_id for r in canonical.map_column(rows, "product_id", "brand", canonical.brand_key_sql, canonical.brand_reference(brands)).collect()}
    assert got == written
    colors = frame(spark, [(10, "gray", ["grey", "charcoal"]), (11, "rose gold", None), (12, "pink", ["rosa"])], "color_id long, color_name string, other_names array<string>")
    shades = {"matte Grey": 10, "Color: charcoal": 10, "Rose-Gold (2 Pack)": 11, "rosa/rosa": 12, "chrcoal satin": 10, "plaid": 0, "60 Hz": 0}
    rows = frame(spark, [(f"p{i}", c) for i, c in enumerate(shades)], "product_id string, color string")
    got = {r.val: r.entry_id for r in canonical.map_column(rows, "product_id", "color", canonical.color_key_sql, canonical.color_reference(colors)).collect()}
    assert got == shades


def test_ambiguous_values_are_told(spark):
    brands = frame(spark, [(1, "Yoreinexter"), (2, "Yoreinexteris"), (3, "Galosoft")], "brand_id long, brand_name string")
    rows = frame(spark, [("p1", "Yoreinexteri"), ("p2", "yoreinexteri"), ("p3", "Yoreinexter"), ("p4", "Galosft"), ("p5", None)], "product_id string, brand string")
    got = canonical.ambiguous(rows, "brand", canonical.brand_key_sql, canonical.brand_reference(brands)).collect()
    assert {(r.val, tuple(r.entries), r.edits, r.rows_entered) for r in got} == {("Yoreinexteri", (1, 2), 1, 1), ("yoreinexteri", (1, 2), 1, 1)}


def test_hot_values_map_like_others(spark):
    colors = frame(spark, [(10, "gray", ["grey"])], "color_id long, color_name string, other_names array<string>")
    rows = frame(spark, [(f"p{i}", "grey") for i in range(500)] + [("q", "gray "), ("r", "zzz")], "product_id string, color string")
    got = canonical.map_column(rows, "product_id", "color", canonical.color_key_sql, canonical.color_reference(colors))
    assert Counter(r.entry_id for r in got.collect()) == {10: 501, 0: 1}
    assert canonical.map_column(rows.limit(0), "product_id", "color", canonical.color_key_sql, canonical.color_reference(colors)).count() == 0


# --- fused rankings ------------------------------------------------------------------------------------------

SCORES = [fused.Score("a", ("va",), 1, 0.0, "ra"), fused.Score("b", (), 1, 0.0), fused.Score("c", (), -1, 0.5)]


def fused_rows():
    rng = random.Random(6)
    rows = []
    for g, n in (("hot", 300), ("g1", 9), ("g2", 1), (None, 4)):
        for i in range(n):
            x = rng.random()
            a = rng.choice([None, float("nan"), x, x * 1000])
            rows.append((g, f"p{i}", i, a, rng.choice(["v1", "v2", None]), rng.choice([None, i + 1]), rng.choice([x, 0.5, None]), -x))
    return rows + rows[:40]


FUSED = "g string, p string, at long, a double, va string, ra int, b double, c double"


def test_large_and_small_groups_rank_alike(spark):
    df = frame(spark, fused_rows(), FUSED).withColumns({"s0": F.lit("clash"), "rank": F.lit(1)})
    one = {(r.g, r.p): (r.fused_rank, r.fused_score) for r in fused.fused_ranking(df, ["g"], "p", "at", SCORES).collect()}
    two = {(r.g, r.p): (r.fused_rank, r.fused_score) for r in fused.fused_ranking(df, ["g"], "p", "at", SCORES, limit=20).collect()}
    assert len(one) == 314 and one.keys() == two.keys()
    for k in one:
        assert one[k][0] == two[k][0] and one[k][1] == pytest.approx(two[k][1])


def test_shares_against_brute_force(spark):
    rows = fused_rows()
    got = {(r.g, r.p): r for r in fused.rank_shares(frame(spark, rows, FUSED), ["g"], "p", "at", SCORES).collect()}
    once = {(r[0], r[1]): r for r in rows}
    for (g, p), r in once.items():
        value = r[6]
        if value is not None:
            same = [x[6] for k, x in once.items() if k[0] == g and x[6] is not None]
            share = (sum(v < value for v in same) + sum(v <= value for v in same)) / 2 / len(same)
            assert got[(g, p)].s1 == pytest.approx(share)
        else:
            assert got[(g, p)].s1 == 0.0 and not got[(g, p)].k1


def test_scale_does_not_matter(spark):
    rows = [("g", f"p{i}", i, float(i), float((i * 7) % 11)) for i in range(11)]
    plain = [fused.Score("a"), fused.Score("b")]
    rank = lambda rs: [r.p for r in fused.fused_ranking(frame(spark, rs, "g string, p string, at long, a double, b double"), ["g"], "p", "at", plain).orderBy("fused_rank").collect()]
    assert rank(rows) == rank([(g, p, at, math.exp(a), b * 1e6) for g, p, at, a, b in rows])


def test_constant_scores_and_empty_tables(spark):
    plain = [fused.Score("a"), fused.Score("b")]
    rows = [("g", "y", 1, 1.0, 2.0), ("g", "x", 1, 1.0, 2.0)]
    got = fused.fused_ranking(frame(spark, rows, "g string, p string, at long, a double, b double"), ["g"], "p", "at", plain)
    assert [(r.p, r.fused_rank) for r in got.orderBy("fused_rank").collect()] == [("x", 1), ("y", 2)]
    against = [("g", f"p{i}", 1, float(i), float(-i), float(i * i)) for i in range(9)]
    three = [fused.Score("a"), fused.Score("b"), fused.Score("c")]
    with pytest.warns(UserWarning, match="b"):
        got = fused.fused_ranking(frame(spark, against, "g string, p string, at long, a double, b double, c double"), ["g"], "p", "at", three)
    assert [r.p for r in got.orderBy("fused_rank").collect()] == [f"p{i}" for i in range(8, -1, -1)]
    assert fused.fused_ranking(frame(spark, [], "g string, p string, at long, a double, b double"), ["g"], "p", "at", plain).count() == 0


# --- distinctive terms ---------------------------------------------------------------------------------------


def test_term_scores_by_hand(spark, monkeypatch):
    monkeypatch.setattr(distinctive, "HEAVY_TERMS", 3)
    texts = {"r1": "red red shoe", "r2": "red hat", "r3": None, "r4": "", "r5": "shoe " * 3000 + "rare"}
    df = frame(spark, [(k, t, 1) for k, t in texts.items()], "id string, text string, term int")
    got = {(r.id, r.term): r.z_score for r in distinctive.term_scores(df, ["id"], "text").collect()}
    counts = {k: Counter((t or "").split()) for k, t in texts.items()}
    total = sum(counts.values(), Counter())
    grand = sum(total.values())
    assert set(got) == {(k, w) for k, c in counts.items() for w in c}
    for (k, w), z in got.items():
        y, n, p = counts[k][w], sum(counts[k].values()), distinctive.PRIOR
        a = p * total[w] / grand
        delta = math.log((y + a) / (n + p - y - a)) - math.log((total[w] - y + a) / (grand - n + p - total[w] + y - a))
        assert z == pytest.approx(delta / math.sqrt(1 / (y + a) + 1 / (total[w] - y + a)))
    assert got[("r1", "red")] > got[("r1", "shoe")]


def test_long_and_short_texts_count_alike(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"r{i % 25}", " ".join(rng.choices("a bb ccc dddd eeeee ff".split(), k=rng.randint(0, 40)))) for i in range(30)]
    df = frame(spark, rows, "id string, text string")
    score = lambda: Counter((r.id, r.term, r.occurrences, round(r.z_score, 9)) for r in distinctive.term_scores(df, ["id"], "text").collect())
    short = score()
    monkeypatch.setattr(distinctive, "ROW_TERMS", 0)
    assert short == score() and sum(short.values()) == sum(len(set(t.split())) for _, t in rows)


def test_terms_of_one_word_and_of_nothing(spark):
    got = distinctive.term_scores(frame(spark, [("a", "x"), ("b", "x")], "id string, text string"), ["id"], "text").collect()
    assert len(got) == 2 and all(math.isfinite(r.z_score) for r in got)
    assert distinctive.term_scores(frame(spark, [], "id string, text string"), ["id"], "text").count() == 0
