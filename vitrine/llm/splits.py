"""Splits that keep related records together, from a persisted table of components.

Records that share a key belong together, also through others. What is known after a run is a state table with
a row per key: ``key``, ``component``, ``split``, ``status``, ``size`` (records of the component so far) and
``declared`` (the splits that its records came with). A run

1. reduces the new records to their distinct key combinations, so a key held by a third of all rows is one row;
2. replaces every known key by its component and finds what the new records tie together by hooking to the
   smallest neighbour and pointer jumping, a written table each round (``spark.checkpoint.dir``): the work
   follows the new records, the state is only joined;
3. lets a component with one split keep it, quarantines one whose parts have different splits or of which a part
   was in quarantine, and fills the deficits of the target proportions, counted over all runs, with the rest;
4. gives the new state: components that were not touched stay as they are.

:func:`save_state` and :func:`load_state` keep states under a path; a state appears by one rename.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.grouprank import running_over_all
from vitrine.operators.skewjoin import heavy_light_join
from vitrine.scratch import materialize, publish, versions

#: Proportions of records when the caller gives none.
TARGETS = {"train": 0.7, "validation": 0.1, "test": 0.2}
#: What a state holds.
STATE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("declared", T.ArrayType(T.StringType())),
    ]
)
QUARANTINE = "quarantine"


def save_state(state: DataFrame, path: str) -> str:
    """Write ``state`` as the next version below ``path``; readers see it only when it is complete."""
    return publish(state.select(*STATE.names), path)


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version below ``path``, or None if there is none."""
    found = versions(spark, path)
    return spark.read.schema(STATE).parquet(found[-1]) if found else None


def _combinations(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct combinations of keys: ``_combo`` (their hash), ``_keys`` tagged by column, ``_rows`` and the
    splits that their records came with."""
    tagged = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in keys]))
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.collect_set("_split").alias("_declared")).select(_combo(keys), tagged.alias("_keys"), "_rows", "_declared")


def _combo(keys: Sequence[str]):
    return F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256).alias("_combo")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node; ``component`` is its smallest node. ``edges`` may repeat and loop.

    Each round hooks every root to the smallest root next to its tree and then halves all paths by pointer
    jumping, so chains take logarithmically many rounds. A node with very many neighbours is only ever met in
    a grouped minimum, which combines on the map side.
    """
    spark = edges.sparkSession
    live = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    nodes = live.select(F.explode(F.array("u", "v")).alias("node"))
    parent = materialize(nodes.distinct().withColumn("parent", F.col("node")), "parents")
    while not live.isEmpty():
        # hook: the larger root of an edge points to the smallest root that it touches
        hook = live.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        parent = materialize(
            parent.join(hook, "node", "left").select("node", F.when(F.col("node") == F.col("parent"), F.coalesce("to", "parent")).otherwise(F.col("parent")).alias("parent")),
            "hooked",
        )
        while True:  # jump until every node points to a root
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            jumped = materialize(parent.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "jumped")
            parent = jumped.select("node", "parent")
            if jumped.filter("moved").isEmpty():
                break
        root = parent.select(F.col("node").alias("u"), F.col("parent").alias("ru"))
        other = parent.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        live = live.join(root, "u").join(other, "v").filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()
        live = materialize(live, "edges")
    return parent.select("node", F.col("parent").alias("component"))


def _tied(combos: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(combinations with ``component``, new keys with ``component``, touched components of the state (``_was``)
    with their component ``_now``). A node is a key, or the component that the state has for it."""
    pairs = combos.select("_combo", F.explode("_keys").alias("key"))
    if state is None:
        known = pairs.select("key").distinct().withColumn("_old", F.lit(None).cast("string"))
    else:
        known = pairs.select("key").distinct().join(state.select("key", F.col("component").alias("_old")), "key", "left")
    known = materialize(known.withColumn("node", F.coalesce("_old", "key")), "known")
    # hot keys are one row of a combination each, so these joins meet no more rows than there are combinations
    nodes = materialize(pairs.join(known, "key").select("_combo", "node"), "nodes")
    first = nodes.groupBy("_combo").agg(F.min("node").alias("u"))
    links = first.join(nodes, "_combo").select("u", F.col("node").alias("v"))
    found = components(links, "u", "v")
    known = materialize(known.join(found, "node", "left").select("key", "_old", "node", F.coalesce("component", "node").alias("component")), "labelled")
    of_node = known.select(F.col("node").alias("u"), "component").distinct()
    combos = materialize(combos.join(first, "_combo").join(of_node, "u").drop("u", "_keys"), "grouped")
    new_keys = known.filter("_old IS NULL").select("key", "component")
    touched = None if state is None else known.filter("_old IS NOT NULL").select(F.col("_old").alias("_was"), F.col("component").alias("_now")).distinct()
    return combos, new_keys, touched


def _sizes(state: DataFrame | None, names: Sequence[str]) -> dict[str, int]:
    """Records of each split so far, from one row per component."""
    if state is None:
        return {}
    of = state.filter(F.col("split").isin(*names)).groupBy("component", "split").agg(F.max("size").alias("size"))
    return {r["split"]: int(r["n"]) for r in of.groupBy("split").agg(F.sum("size").alias("n")).collect()}


def assign_splits(
    records: DataFrame, record_id: str, keys: Sequence[str], split: str, targets: Mapping[str, float] = TARGETS, state: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(assignment, new state).

    ``assignment`` has ``record_id``, ``component``, ``old_split``, ``new_split``, ``status`` (kept, filled or
    quarantined) and ``declared`` of the component, for the given records. ``split`` is the split a record has
    now; only the names in ``targets`` count, others and null are no split. ``state`` is the state after the run
    before, or None; :func:`placed` gives the standing of all records of any run.

    A component in quarantine stays there. The state keeps components of which this run has no record, and the
    deficits count the records of all runs. Null keys link nothing; a record with no key is a component of its
    own. Repeated record ids give repeated rows. Empty input gives empty tables and leaves the state as it is.
    Columns besides the named ones do not matter.
    """
    names = list(targets)
    slim, kcols = _keyed(records, record_id, keys, split, names)
    combos = materialize(_combinations(slim, kcols), "combos")
    if state is not None:
        state = materialize(state.select(*STATE.names), "state")
    combos, new_keys, touched = _tied(combos, state)

    parts = combos.select("component", F.col("_rows").alias("size"), F.col("_declared").alias("declared"), F.lit(None).cast("string").alias("split"))
    before = _sizes(state, names)
    if state is not None:
        old = state.join(touched, F.col("component") == F.col("_was"))
        old = old.groupBy("_was", "_now").agg(F.max("size").alias("size"), F.max("declared").alias("declared"), F.max("split").alias("split"))
        old = materialize(old.select(F.col("_now").alias("component"), "size", "declared", "split"), "old")
        for r in old.filter(F.col("split").isin(*names)).groupBy("split").agg(F.sum("size").alias("n")).collect():
            before[r["split"]] -= int(r["n"])  # they are counted again with the new records
        parts = parts.unionByName(old.select(parts.columns))
    # a set of at most len(names) + 1 strings per component, made on the map side
    comp = parts.groupBy("component").agg(
        F.sum("size").alias("size"),
        *[F.max(F.array_contains("declared", s)).alias(f"_d{i}") for i, s in enumerate(names)],
        *[F.max(F.coalesce(F.array_contains("declared", s) | (F.col("split") == s), F.array_contains("declared", s))).alias(f"_h{i}") for i, s in enumerate(names)],
        F.coalesce(F.max(F.col("split") == QUARANTINE), F.lit(False)).alias("_held"),
    )
    comp = comp.withColumn("declared", F.array_compact(F.array(*[F.when(F.col(f"_d{i}"), F.lit(s)) for i, s in enumerate(names)])))
    has = F.array_compact(F.array(*[F.when(F.col(f"_h{i}"), F.lit(s)) for i, s in enumerate(names)]))
    comp = comp.withColumn("_has", has).select("component", "size", "declared", "_has", "_held")
    status = F.when(F.col("_held") | (F.size("_has") > 1), "quarantined").when(F.size("_has") == 1, "kept").otherwise("filled")
    comp = comp.withColumn("status", status).withColumn("_kept", F.when(F.col("status") == "quarantined", QUARANTINE).otherwise(F.get("_has", F.lit(0))))
    comp = materialize(comp.drop("_has", "_held"), "states")

    have, fresh_records = dict(before), 0
    for r in comp.filter("status <> 'quarantined'").groupBy("_kept").agg(F.sum("size").alias("n")).collect():  # a row per split
        if r["_kept"] is None:
            fresh_records = int(r["n"])
        else:
            have[r["_kept"]] = have.get(r["_kept"], 0) + int(r["n"])
    total = sum(have.values()) + fresh_records
    lack = {s: max(0.0, targets[s] * total - have.get(s, 0)) for s in names}
    scale = fresh_records / (sum(lack.values()) or 1)
    # large components first, then by hash: each goes where its middle falls in the row of deficits
    order = [F.col("size").desc(), F.xxhash64("component"), F.col("component")]
    fresh = running_over_all(comp.filter("status = 'filled'").withColumn("_n", F.col("size")), order, "_n", "_before")
    middle, edge, pick = F.col("_before") + F.col("size") / 2, 0.0, None
    for s in names:
        edge += lack[s] * scale
        pick = F.when(middle <= edge, s) if pick is None else pick.when(middle <= edge, s)
    columns = ["component", "size", "declared", "status", "split"]
    fresh = fresh.withColumn("split", pick.otherwise(max(lack, key=lack.get))).select(*columns)
    done = comp.filter("status <> 'filled'").withColumn("split", F.col("_kept")).select(*columns)
    done = materialize(done.unionByName(fresh), "assigned")

    by_combo = materialize(combos.select("_combo", "component", "_rows").join(done, "component").select("_combo", "_rows", "component", "status", F.col("split").alias("new_split"), "declared"), "combos")
    out = heavy_light_join(slim.withColumn("_combo", _combo(kcols)), by_combo, ["_combo"], "_rows")
    out = out.select(F.col("_id").alias(record_id), "component", F.col("_split").alias("old_split"), "new_split", "status", "declared")

    rows = new_keys
    if state is not None:
        relabelled = state.select("key", F.col("component").alias("_was")).join(touched, "_was").select("key", F.col("_now").alias("component"))
        rows = rows.unionByName(relabelled)
    new_state = rows.join(done, "component").select(*STATE.names)
    if state is not None:
        untouched = state.join(touched, F.col("component") == F.col("_was"), "left_anti").select(*STATE.names)
        new_state = new_state.unionByName(untouched)
    return out, materialize(new_state, "state")


def _keyed(records: DataFrame, record_id: str, keys: Sequence[str], split: str, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    slim = records.select(F.col(record_id).alias("_id"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.when(F.col(split).isin(*names), F.col(split)).alias("_split"))
    kcols = [f"_k{i}" for i in range(len(keys))]
    # a record without keys gets its own id as key, in a separate key column
    slim = slim.withColumn("_self", F.when(F.coalesce(*kcols).isNull(), F.col("_id").cast("string")))
    return materialize(slim, "records"), [*kcols, "_self"]


def placed(records: DataFrame, record_id: str, keys: Sequence[str], split: str, state: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """The columns of an assignment for ``records`` of any earlier run, as ``state`` has them now.

    A record whose keys the state lacks has null columns. Any one key of a record leads to its component.
    """
    slim, kcols = _keyed(records, record_id, keys, split, list(targets))
    tagged = F.coalesce(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in kcols])
    slim = slim.withColumn("key", tagged)
    counted = slim.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    out = heavy_light_join(slim, materialize(counted.join(state, "key"), "standing"), ["key"], "_rows")
    return out.select(F.col("_id").alias(record_id), "component", F.col("_split").alias("old_split"), F.col("split").alias("new_split"), "status", "declared")
