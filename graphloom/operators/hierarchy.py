"""Parent-child links to full hierarchies by heavy-path decomposition.

Each node that has children hangs on its parent's chain or starts one: the child with the largest subtree goes on with the chain of its parent,
all others start their own, so any way up crosses at most log2(n) chains. Nodes with a ring above them are told apart first. All steps are joins on
integer keys that halve the remaining way (pointer doubling), so a chain of a million links takes twenty rounds and no group is ever
gathered: subtree sizes are sums, siblings get their places from sums over hash buckets. Nodes without children, most of a usual tree, take no part in
the rounds: they weigh on their parent and get what they need from its result at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import cut, cut_measured, meet

#: Children that one window sorts at most on average when siblings get their places.
SIBLINGS_PER_BUCKET = 50_000
#: A node that more than this share of all nodes hang on directly is met by a broadcast, so there are at most 1 / WIDE of these.
WIDE = 1 / 1024
#: Descendants of one node that one row stands for before they are listed.
DESCENDANTS_PER_ROW = 10_000


@dataclass
class Hierarchy:
    """nodes: nid, tree (any grouping column), id, pid, at (itself where it has children, else its parent). chains: nid, pid, size, heavy, head, pos, last
    (the child without children that goes on with its chain, if any), wide, of the nodes that are in trees and have children. heads: head, root, depth.
    rings: nid, ring (smallest id on the ring), wide of the nodes that are on or below a ring and have children."""

    nodes: DataFrame
    chains: DataFrame
    heads: DataFrame
    rings: DataFrame
    n: int


def climb(links: DataFrame, sums: list[str] = (), joins: list[str] = ()) -> DataFrame:
    """For links (nid, up, ...) without rings: nid, top, and along the way up the sums of columns and the joined arrays, uppermost first.

    up is null at a top. Each round looks up where the present target leads to, so the way doubles with each round."""
    cols = [*sums, *joins]
    state, seen = cut_measured(links.select("nid", F.coalesce("up", "nid").alias("top"), F.col("up").isNull().alias("done"), *cols), left=F.count_if(~F.col("done")))
    while seen["left"]:
        there = state.select(F.col("nid").alias("_nid"), F.col("top").alias("_top"), F.col("done").alias("_done"), *(F.col(c).alias(f"_{c}") for c in cols))
        moved = state.where("not done").join(there, F.col("top") == F.col("_nid")).select(
            "nid", F.col("_top").alias("top"), F.col("_done").alias("done"),
            *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums), *(F.concat(f"_{c}", c).alias(c) for c in joins))
        state, seen = cut_measured(state.where("done").unionByName(moved), state, left=F.count_if(~F.col("done")))
    return state.drop("done")


def _sizes_and_rings(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """links: nid, pid, s (own weight), last, wide. The same with size of the nodes in trees, and nid, pid, up, wide of those with a ring above, up being on the ring.

    up is the ancestor exactly 2^k above, s the weight of the descendants nearer than 2^k. As depths have no gaps, each round either takes some
    nodes past their root or no node of a tree is left."""
    keep = ["nid", "pid", "last", "wide"]
    left = F.count_if(F.col("up").isNotNull())
    state, seen = cut_measured(links.select(*keep, F.col("pid").alias("up"), "s"), left=left)
    before = -1
    while seen["left"] not in (0, before):
        before = seen["left"]
        more = state.where("up is not null").groupBy("up").agg(F.sum("s").alias("_s")).withColumnRenamed("up", "_v")
        grown = state.join(more, F.col("nid") == F.col("_v"), "left").select(*keep, "up", (F.col("s") + F.coalesce("_s", F.lit(0))).alias("s"))
        there = state.where("up is not null").select(F.col("nid").alias("_nid"), F.col("up").alias("_up"))
        state, seen = cut_measured(grown.join(there, F.col("up") == F.col("_nid"), "left").select(*keep, F.col("_up").alias("up"), "s"), state, left=left)
    sized = state.where("up is null").select(*keep, F.col("s").alias("size"))
    if not seen["left"]:
        return sized, None
    ringed, known = state.where("up is not null").select("nid", "pid", "wide", "up"), -1
    while True:  # the targets are on the ring once their number stays
        n = ringed.select("up").distinct().count()
        if n == known:
            return sized, ringed
        known = n
        ringed = cut(ringed.join(ringed.select(F.col("nid").alias("_nid"), F.col("up").alias("_up")), F.col("up") == F.col("_nid")).select("nid", "pid", "wide", F.col("_up").alias("up")))


def _ring_names(nodes: DataFrame, ringed: DataFrame | None) -> DataFrame:
    """nid, ring and wide of every node on or below a ring."""
    if ringed is None:
        return nodes.sparkSession.createDataFrame([], "nid long, ring string, wide boolean")
    on = ringed.select(F.col("up").alias("nid")).distinct()
    state, changed = cut(nodes.join(on, "nid").select("nid", F.col("pid").alias("up"), F.col("id").alias("low"))), 1
    while changed:
        there = state.select(F.col("nid").alias("_nid"), F.col("up").alias("_up"), F.col("low").alias("_low"))
        lower = state.join(there, F.col("up") == F.col("_nid")).select("nid", F.col("_up").alias("up"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("changed"))
        state, seen = cut_measured(lower, state, changed=F.count_if(F.col("changed")))
        changed = seen["changed"]
    return ringed.join(state.select(F.col("nid").alias("_nid"), F.col("low").alias("ring")), F.col("up") == F.col("_nid")).select("nid", "ring", "wide")


def build(links: DataFrame) -> Hierarchy:
    """links: tree, parent, child. Links with a null are left out; repeated ones count once; of several parents the smallest id holds.

    An empty table gives empty results. A link from a node to itself is a ring."""
    whole = links.where("tree is not null and parent is not null and child is not null")
    ends = whole.select("tree", F.inline(F.array(F.struct(F.col("child").alias("id"), F.col("parent").alias("above")), F.struct(F.col("parent").alias("id"), F.lit(None).cast("string").alias("above")))))
    named, seen = cut_measured(ends.groupBy("tree", "id").agg(F.min("above").alias("above")).withColumn("nid", F.monotonically_increasing_id()), n=F.count(F.lit(1)))
    n = seen["n"]
    parents = named.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("nid").alias("pid"))
    linked = cut(named.join(parents, (F.col("tree") == F.col("_tree")) & (F.col("above") == F.col("_id")), "left").select("nid", "tree", "id", "pid"), named)
    kids = linked.where("pid is not null").groupBy("pid").agg(F.count("*").alias("kids")).withColumnRenamed("pid", "_pid")
    nodes = cut(linked.join(kids, F.col("nid") == F.col("_pid"), "left").select(
        "nid", "tree", "id", "pid", F.when(F.col("kids").isNotNull(), F.col("nid")).otherwise(F.col("pid")).alias("at"), F.coalesce(F.col("kids") > n * WIDE, F.lit(False)).alias("wide")), linked)
    leaves = nodes.where("at <> nid").groupBy("pid").agg(F.count("*").alias("leaves"), F.max("nid").alias("leaf")).withColumnRenamed("pid", "_pid")
    own = nodes.where("at = nid").select("nid", "pid", "wide").join(leaves, F.col("nid") == F.col("_pid"), "left")
    sized, ringed = _sizes_and_rings(own.select("nid", "pid", "wide", F.col("leaf").alias("last"), (1 + F.coalesce("leaves", F.lit(0))).cast("long").alias("s")))
    heavy = sized.where("pid is not null").groupBy("pid").agg(F.max(F.struct("size", "nid"))["nid"].alias("_heavy"))
    chosen, going = heavy.select("_heavy"), heavy.select(F.col("pid").alias("_pid"))
    tree = cut(
        sized.join(chosen, F.col("nid") == F.col("_heavy"), "left").join(going, F.col("nid") == F.col("_pid"), "left")
        .select("nid", "pid", "size", F.col("_heavy").isNotNull().alias("heavy"), F.when(F.col("_pid").isNull(), F.col("last")).alias("last"), "wide"))
    placed = climb(tree.select("nid", F.when(F.col("heavy"), F.col("pid")).alias("up"), F.when(F.col("heavy"), 1).otherwise(0).cast("long").alias("pos")), ["pos"])
    chains = cut(tree.join(placed, "nid").select("nid", "pid", "size", "heavy", F.col("top").alias("head"), "pos", "last", "wide"), tree)
    heads = climb(_hung(chains, F.lit(0).cast("long")).select("nid", "up", "depth"), ["depth"]).select(F.col("nid").alias("head"), F.col("top").alias("root"), "depth")
    return Hierarchy(nodes, chains, heads, _ring_names(nodes, ringed), n)


def _hung(chains: DataFrame, offset: Column) -> DataFrame:
    """nid, up, depth, enter of each head: the head of the chain that it hangs on, and how far it stands behind that in depth and, with its offset, in order."""
    on = chains.select(F.col("nid").alias("_nid"), F.col("head").alias("up"), F.col("pos").alias("_at"))
    return chains.where("nid = head").join(on, F.col("pid") == F.col("_nid"), "left").select(
        "nid", "up", F.coalesce(F.col("_at") + 1, F.lit(0)).alias("depth"), F.coalesce(F.col("_at") + offset, F.lit(0)).alias("enter"))


def _everywhere(h: Hierarchy, placed: DataFrame) -> DataFrame:
    """placed: nid, wide and more for nodes with children. tree, id, nid, leaf and that of the node itself or, where it has no children (leaf), of its parent.

    Few parents may have most of the nodes; these are met by a broadcast."""
    rows = h.nodes.select("tree", "id", "nid", "at", (F.col("at") != F.col("nid")).alias("leaf"))
    return meet(rows, "at", placed.withColumnRenamed("nid", "_nid"), "_nid", F.col("wide")).drop("at", "_nid", "wide")


def positions(h: Hierarchy) -> DataFrame:
    """tree, id, root, depth of every node; a node on or below a ring has the ring's smallest id and -1."""
    names = h.nodes.select(F.col("nid").alias("_root"), F.col("id").alias("root"))
    tops = h.heads.withColumnRenamed("root", "_top").join(names, F.col("_top") == F.col("_root")).select("head", "root", "depth")
    inside = h.chains.select("nid", "head", "pos", "wide").join(tops, "head").select("nid", "wide", "root", (F.col("depth") + F.col("pos")).alias("depth"))
    outside = h.rings.select("nid", "wide", F.col("ring").alias("root"), F.lit(-1).cast("long").alias("depth"))
    depth = F.when(F.col("depth") < 0, -1).otherwise(F.col("depth") + F.col("leaf").cast("int"))
    return _everywhere(h, cut(inside.unionByName(outside))).select("tree", "id", "root", depth.cast("int").alias("depth"))


def _offsets(h: Hierarchy) -> DataFrame:
    """nid, offset of all nodes with a parent in a tree: how far behind its parent a node stands in the order of the whole tree, the heavy child first.

    Siblings fall into hash buckets; sums per bucket place the buckets and a window places the siblings inside one, so not even the children of
    a node that has a third of all rows come into one task."""
    buckets = h.n // SIBLINGS_PER_BUCKET + 1
    lasts = h.chains.where("last is not null").select(F.col("last").alias("_last"))
    leaves = h.nodes.where("at <> nid").join(lasts, F.col("nid") == F.col("_last"), "left").select("nid", "pid", F.lit(1).cast("long").alias("size"), F.col("_last").isNotNull().alias("heavy"))
    tree = leaves.unionByName(h.chains.where("pid is not null").select("nid", "pid", "size", "heavy"))
    light = tree.where("not heavy").withColumn("bucket", F.pmod(F.hash("nid"), F.lit(buckets)))
    sums = light.groupBy("pid", "bucket").agg(F.sum("size").alias("all"))
    before = Window.partitionBy("pid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = tree.where("heavy").select(F.col("pid").alias("_pid"), F.col("size").alias("first"))
    starts = sums.withColumn("start", F.coalesce(F.sum("all").over(before), F.lit(0))).join(first, F.col("pid") == F.col("_pid")).select("pid", "bucket", (F.col("start") + F.col("first") + 1).alias("start"))
    inside = Window.partitionBy("pid", "bucket").orderBy("nid").rowsBetween(Window.unboundedPreceding, -1)
    placed = light.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["pid", "bucket"]).select("nid", (F.col("start") + F.col("own")).alias("offset"))
    return placed.unionByName(tree.where("heavy").select("nid", F.lit(1).cast("long").alias("offset")))


def intervals(h: Hierarchy) -> DataFrame:
    """tree, id, root, first, last: the descendants of a node are the nodes of its root whose first lies behind its first and not behind its last.

    Every chain is one run of numbers and every subtree too, so this is the whole relation in one row per node. Ringed nodes have none."""
    offsets = cut(_offsets(h))
    held = h.chains.join(offsets, "nid", "left")
    enters = climb(_hung(held, F.col("offset")).select("nid", "up", "enter"), ["enter"]).select(F.col("nid").alias("head"), F.col("top").alias("_top"), "enter")
    names = h.nodes.select(F.col("nid").alias("_root"), F.col("id").alias("root"))
    tops = enters.join(names, F.col("_top") == F.col("_root")).select("head", "root", "enter")
    inner = cut(h.chains.select("nid", "head", "pos", "size", "wide").join(tops, "head").select("nid", "wide", "root", (F.col("enter") + F.col("pos")).alias("enter"), "size"))
    rows = _everywhere(h, inner).join(offsets.withColumnRenamed("nid", "_at"), F.col("nid") == F.col("_at"), "left")
    first = F.when(F.col("leaf"), F.col("enter") + F.col("offset")).otherwise(F.col("enter"))
    return rows.select("tree", "id", "root", first.alias("first"), F.when(F.col("leaf"), first).otherwise(first + F.col("size") - 1).alias("last"))


def paths(h: Hierarchy) -> DataFrame:
    """tree, id, path: the ids from the root to the node, the node itself included. Ringed nodes have none.

    The segment of a node on its own chain goes behind the whole path of the node that the chain hangs on."""
    names = h.nodes.where("at = nid").select("nid", "id")
    segments = climb(h.chains.join(names, "nid").select("nid", F.when(F.col("heavy"), F.col("pid")).alias("up"), F.array("id").alias("seg")), joins=["seg"]).withColumnRenamed("top", "head")
    hang = segments.select(F.col("nid").alias("_nid"), F.col("head").alias("up"), F.col("seg").alias("above"))
    hung = h.chains.where("nid = head").join(hang, F.col("pid") == F.col("_nid"), "left").select("nid", "up", F.coalesce("above", F.array().cast("array<string>")).alias("above"))
    tops = climb(hung, joins=["above"]).select(F.col("nid").alias("head"), "above")
    inner = segments.join(tops, "head").join(h.chains.select("nid", "wide"), "nid").select("nid", "wide", F.concat("above", "seg").alias("path"))
    return _everywhere(h, cut(inner)).select("tree", "id", F.when(F.col("leaf"), F.concat("path", F.array("id"))).otherwise(F.col("path")).alias("path"))


def descendants(h: Hierarchy) -> DataFrame:
    """tree, id, descendant: every pair of a node and one below it, from the intervals: the numbers inside a node's are looked up one by one.

    As many rows as all depths together, which on a long chain is the square of its length; intervals says the same in one row per node."""
    at = cut(intervals(h))
    step = F.lit(DESCENDANTS_PER_ROW).cast("long")
    parts = at.where("last > first").select("tree", "root", "id", "last", F.explode(F.sequence(F.col("first") + 1, F.col("last"), step)).alias("from")).repartition("tree", "root", "from")
    below = parts.select("tree", "root", "id", F.explode(F.sequence(F.col("from"), F.least(F.col("last"), F.col("from") + step - 1))).alias("first"))
    return below.join(at.select("tree", "root", "first", F.col("id").alias("descendant")), ["tree", "root", "first"]).select("tree", "id", "descendant")


def links_of(edges: DataFrame, kind: Column) -> DataFrame:
    """Edges of CONTAINS (src holds dst) and EXTENDS (src is below dst) as links."""
    return edges.select(kind.alias("tree"), "src", "dst").where("tree in ('CONTAINS', 'EXTENDS')").select(
        "tree", F.when(F.col("tree") == "CONTAINS", F.col("src")).otherwise(F.col("dst")).alias("parent"), F.when(F.col("tree") == "CONTAINS", F.col("dst")).otherwise(F.col("src")).alias("child"))
