"""The general problems against brute force on small made cases."""

import os
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.common import cut, cut_measured, meet, sieve
from graphloom.operators import hierarchy, orphans, skew
from graphloom.operators import snapshots as changes

T = datetime(2025, 1, 1)


def _brute(links):
    """(tree, id) -> (root, depth, path), depth -1 on or below a ring."""
    up, ids = {}, set()
    for tree, parent, child in links:
        if None in (tree, parent, child):
            continue
        ids |= {(tree, parent), (tree, child)}
        up[tree, child] = min(parent, up.get((tree, child), parent))
    out = {}
    for tree, id_ in ids:
        way, seen = [id_], {id_}
        while (tree, way[-1]) in up and up[tree, way[-1]] not in seen:
            way.append(up[tree, way[-1]])
            seen.add(way[-1])
        if (tree, way[-1]) in up:
            at = way.index(up[tree, way[-1]])
            out[tree, id_] = (min(way[at:]), -1, None)
        else:
            out[tree, id_] = (way[-1], len(way) - 1, tuple(reversed(way)))
    return out


def _made(seed):
    rnd = random.Random(seed)
    links = []
    for tree in ("CONTAINS", "EXTENDS"):
        names = [f"{tree[0]}{k} é" for k in range(120)]
        for k, name in enumerate(names[1:], 1):
            shape = rnd.random()
            parent = names[k - 1] if shape < 0.4 else names[0] if shape < 0.6 else names[rnd.randrange(k)]
            if rnd.random() < 0.95:
                links.append((tree, parent, name))
        links += [(tree, "ring a", "ring b"), (tree, "ring b", "ring c"), (tree, "ring c", "ring a"), (tree, "ring b", "below"), (tree, "below", "lower"), (tree, "self", "self"), (tree, "self", "under self")]
    links += links[:30] + [("CONTAINS", None, "x"), ("CONTAINS", "x", None), (None, "x", "y")]
    rnd.shuffle(links)
    return links


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy(spark, seed):
    links = _made(seed)
    expected = _brute(links)
    h = hierarchy.build(spark.createDataFrame(links, "tree string, parent string, child string"))
    found = {(r["tree"], r["id"]): (r["root"], r["depth"]) for r in hierarchy.positions(h).collect()}
    assert found == {k: v[:2] for k, v in expected.items()}
    paths = {(r["tree"], r["id"]): tuple(r["path"]) for r in hierarchy.paths(h).collect()}
    assert paths == {k: v[2] for k, v in expected.items() if v[2]}
    spans = {(r["tree"], r["id"]): (r["root"], r["first"], r["last"]) for r in hierarchy.intervals(h).collect()}
    below = {(a, b, c) for a, b, c in (tuple(r) for r in hierarchy.descendants(h).collect())}
    for (tree, a), (root, first, last) in spans.items():
        inside = {b for (t, b), (r, f, _) in spans.items() if (t, r) == (tree, root) and first < f <= last}
        assert inside == {b for (t, b), v in expected.items() if t == tree and v[2] and a in v[2][:-1]}
        assert inside == {c for t, b, c in below if (t, b) == (tree, a)}


def test_hierarchy_of_one_long_chain_and_one_wide_node(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "SIBLINGS_PER_BUCKET", 50)
    links = [("CONTAINS", f"c{k:04}", f"c{k + 1:04}") for k in range(700)] + [("CONTAINS", "c0300", f"leaf{k}") for k in range(400)]
    h = hierarchy.build(spark.createDataFrame(links, "tree string, parent string, child string"))
    found = {r["id"]: r["depth"] for r in hierarchy.positions(h).collect()}
    assert found["c0700"] == 700 and found["leaf7"] == 301 and len(found) == 1101
    firsts = [r["first"] for r in hierarchy.intervals(h).collect()]
    assert sorted(firsts) == list(range(1101))


def _keys(df):
    """Names by their hashes."""
    return {(r["h1"], r["h2"]): r["key"] for r in df.select("key", *orphans.key_hashes("key")).distinct().collect()}


def test_orphans(spark):
    nodes = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (4, "a"), (4, "a"), (4, None), (None, "z")]
    edges = [(1, "s", "CALLS", "c"), (1, "s", "CALLS", "c"), (2, "s", "CALLS", "a"), (2, "t", "CALLS", "x"), (4, "s", "CALLS", "b"), (4, "s", "CALLS", "c "), (4, "s", "CALLS", None), (1, "s", "USES", "a")]
    e = spark.createDataFrame(edges, "snap_no int, src string, kind string, dst string")
    snaps = spark.createDataFrame([(1,), (2,), (4,), (4,), (None,)], "snap_no int")
    keys = orphans.orphan_keys(e, spark.createDataFrame(nodes, "snap_no int, id string"), snaps)
    name = _keys(e.select(F.col("dst").alias("key")))
    assert {(name[r["h1"], r["h2"]], r["snap_no"], r["refs"], r["state"]) for r in keys.collect()} == {("c", 1, 2, "late"), ("a", 2, 1, "deleted"), ("x", 2, 1, "missing"), ("b", 4, 1, "deleted"), ("c ", 4, 1, "missing")}
    assert orphans.orphan_references(e, keys).count() == 5
    assert orphans.orphan_keys(e, spark.createDataFrame(nodes, "snap_no int, id string"), snaps.limit(0)).count() == 0


def _many_snapshots(n, seed=3):
    rnd = random.Random(seed)
    snaps = [3 * k + 2 for k in range(n)]
    refs = [(s, f"k{k}") for s in snaps for k in range(20) if rnd.random() < 0.3 for _ in range(rnd.randrange(1, 4))]
    records = [(s, f"k{k}") for s in snaps for k in range(18) if rnd.random() < (0.02 if k < 9 else 0.5)]
    expected = set()
    for s, k in set(refs):
        if (s, k) not in set(records):
            has = [x for x, y in records if y == k]
            expected.add((k, s, refs.count((s, k)), "deleted" if any(x < s for x in has) else "late" if any(x > s for x in has) else "missing"))
    return snaps, refs, records, expected


@pytest.mark.parametrize("n", [4, 40, 400])
def test_orphans_of_many_snapshots(spark, n):
    snaps, refs, records, expected = _many_snapshots(n)
    made = [spark.createDataFrame(x, "snap_no int, key string") for x in (refs, records)]
    order = orphans.places(spark.createDataFrame([(s,) for s in snaps], "snap_no int"))
    name = _keys(made[0])
    assert {(name[r["h1"], r["h2"]], r["snap_no"], r["refs"], r["state"]) for r in orphans.orphans(orphans.deltas(*made, order), order).collect()} == expected


def test_orphans_kept_from_delta_to_delta(spark):
    snaps, refs, records, expected = _many_snapshots(5)
    made = [spark.createDataFrame(x, "snap_no int, key string") for x in (refs, records)]
    changes = cut(orphans.deltas(*made, orphans.places(spark.createDataFrame([(s,) for s in snaps], "snap_no int"))))
    name, state = _keys(made[0]), spark.createDataFrame([], "h1 long, h2 long, refs long, exists long, had boolean")
    for place, s in enumerate(snaps):
        state = cut(orphans.apply_deltas(state, changes.where(F.col("pos") == place)))
        now = {(name[r["h1"], r["h2"]], s, r["refs"], r["state"]) for r in orphans.current(state).collect()}
        assert now == {(k, at, n, "missing" if what == "late" else what) for k, at, n, what in expected if at == s}


def test_a_long_chain_and_a_wide_star_without_the_adaptive_split(spark):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        n, wide = 100_000, 1_000_000
        chain = spark.range(n).select(F.lit("CONTAINS").alias("tree"), F.concat(F.lit("c"), "id").alias("parent"), F.concat(F.lit("c"), F.col("id") + 1).alias("child"))
        star = spark.range(wide).select(F.lit("EXTENDS").alias("tree"), F.lit("hub").alias("parent"), F.concat(F.lit("leaf"), "id").alias("child"))
        h = hierarchy.build(chain.unionByName(star))
        found = hierarchy.positions(h).groupBy("tree", "root").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.sum("depth").alias("all"), F.countDistinct("depth").alias("depths")).collect()
        assert {tuple(r) for r in found} == {("CONTAINS", "c0", n + 1, n, n * (n + 1) // 2, n + 1), ("EXTENDS", "hub", wide + 1, 1, wide, 2)}
        spans = hierarchy.intervals(h).where("tree = 'EXTENDS'").agg(F.count("*"), F.countDistinct("first"), F.min("first"), F.max("last")).first()
        assert tuple(spans) == (wide + 1, wide + 1, 0, wide)
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_sieve_and_meet(spark):
    rows = spark.createDataFrame([(k % 7, f"v{k}") for k in range(700)] + [(None, "none")], "k long, v string").withColumn("h", F.xxhash64("k"))
    keys = spark.createDataFrame([(2,), (3,), (3,), (99,)], "k long").select(F.xxhash64("k").alias("h"))
    assert {r["k"] for r in sieve(rows, keys, "h").collect()} == {2, 3}
    assert sieve(rows, keys.limit(0), "h").count() == 0
    few = spark.createDataFrame([(1, True, "x"), (2, False, "y"), (8, True, "z"), (None, True, "w")], "own long, hot boolean, what string")
    assert {(r["v"], r["what"]) for r in meet(rows, "k", few, "own", F.coalesce("hot", F.lit(False))).collect()} == {(f"v{k}", "x" if k % 7 == 1 else "y") for k in range(700) if k % 7 in (1, 2)}


def test_measures_and_dropped_tables(spark):
    one, seen = cut_measured(spark.range(10), n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    assert seen == {"n": 10, "odd": 5}
    none, seen = cut_measured(spark.createDataFrame([], "id long"), n=F.count(F.lit(1)))
    assert seen == {"n": 0} and none.count() == 0
    gone = cut_measured(one.where("id > 20"), one, n=F.count(F.lit(1)))
    assert gone[1] == {"n": 0} and not os.path.exists(one._cut_path.removeprefix("file:"))


def test_compare_bucket():
    rng = np.random.default_rng(3)
    snaps, held, parts = [1, 3, 4], [], {"snap_no": [], "h1": [], "h2": [], "row": []}
    for s in snaps:
        state = {(int(a), int(b)): int(c) for a, b, c in zip(rng.integers(0, 40, 150), rng.integers(0, 3, 150), rng.integers(0, 3, 150))}
        held.append(state)
        for (a, b), c in state.items():
            for name, v in zip(parts, (s, a, b, c)):
                parts[name].append(v)
    out = changes.compare_bucket({k: np.array(v, dtype=np.int64) for k, v in parts.items()}, snaps)
    found = set(zip(out["snap_no"].tolist(), out["h1"].tolist(), out["h2"].tolist(), out["what"].tolist()))
    expected = set()
    for s, old, new in zip(snaps[1:], held, held[1:]):
        expected |= {(s, *k, "added") for k in new.keys() - old.keys()} | {(s, *k, "removed") for k in old.keys() - new.keys()} | {(s, *k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    assert found == expected
    assert len(changes.compare_bucket({k: np.zeros(0, dtype=np.int64) for k in parts}, snaps)["h1"]) == 0


def test_snapshot_changes(spark):
    later = datetime(2025, 1, 2)
    nodes = [(1, "a", "AB", T), (1, "a", "old", None), (2, "a", " ab\n", T), (1, "b", None, T), (2, "b", "x", T), (1, "c", None, T), (2, "c", None, T), (2, "d", "1", T), (1, "e", "1", T), (2, "f", "1", T), (2, "f", "2", later), (5, "f", "2", T), (1, None, "q", T)]
    found = changes.node_changes(spark.createDataFrame(nodes, "snap_no int, id string, sha string, loaded_at timestamp"), [1, 2, 5])
    first = {(r["id"], r["what"]) for r in found.collect() if r["snap_no"] == 2}
    assert first == {("b", "changed"), ("d", "added"), ("e", "removed"), ("f", "added")}
    assert {(r["id"], r["what"]) for r in found.collect() if r["snap_no"] == 5} == {(x, "removed") for x in "abcd"}
    edges = [(1, "s", "x", "CALLS"), (1, "s", "x", " calls"), (2, "s", "x", "CALLS"), (1, "t", "x", "CALLS"), (2, "t", "x", "USES"), (2, "u", "x", "USES"), (1, "v", None, None), (2, "v", None, None), (1, None, "x", "CALLS")]
    found = changes.source_changes(spark.createDataFrame(edges, "snap_no int, src string, dst string, kind string"), [1, 2])
    assert {tuple(r) for r in found.collect()} == {(2, "t", "changed"), (2, "u", "added")}


def test_skewed_keys(spark):
    rnd = random.Random(5)
    rows = [("hot", None, rnd.choice([-(2**62), 0, 5, 2**62]) + rnd.randrange(1000)) for _ in range(3000)]
    rows += [(f"k{rnd.randrange(40)}", "d" if rnd.random() < 0.5 else None, rnd.randrange(-5, 400)) for _ in range(1500)] + [("one", "d", 7)] * 20 + [("none", "d", None)] * 3
    df = spark.createDataFrame(rows, "kind string, dst string, v long")
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    expected = {}
    for k in {r[:2] for r in rows}:
        values = sorted(r[2] for r in rows if r[:2] == k and r[2] is not None)
        for q in shares if values else ():
            expected[(*k, q)] = (len(values), values[max(0, int(np.ceil(len(values) * q)) - 1)])
    found = {(r["kind"], r["dst"], r["share"]): (r["n"], r["value"]) for r in skew.exact_quantiles(df, ["kind", "dst"], "v", shares).collect()}
    assert found == expected
    counts = {(r["kind"], r["dst"]): r["n_src"] for r in skew.distinct_per_key(df, ["kind", "dst"], "v", "n_src").collect()}
    assert counts == {k: len({r[2] for r in rows if r[:2] == k and r[2] is not None}) for k in {r[:2] for r in rows} if k[0] != "none"}
