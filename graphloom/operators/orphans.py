"""References to records that do not exist, from signed counts per key.

Each snapshot changes two counts of a key: how many records refer to it and how often it exists. The changes are added up per key before the
shuffle, so a key that a third of all records refer to weighs no more than any other. Where a key's counts change is one row; the counts in
between are kept running over these rows, so neither a plan nor a row grows with the number of snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import cut, cut_measured, meet, sieve

#: An orphan key with more than this share of the references to orphans is met by a broadcast, so there are at most 1 / HOT_SHARE of these.
HOT_SHARE = 1 / 1024


def key_hashes(key: str) -> list[Column]:
    """Two hashes with different seeds that stand for a key; together they keep billions of keys apart."""
    return [F.xxhash64(F.col(key)).alias("h1"), F.xxhash64(F.lit(7), F.col(key)).alias("h2")]


def places(snaps: DataFrame) -> DataFrame:
    """snap_no, pos: the place of each snapshot in order, from 0. One row per build, so the window and the broadcasts of it are small."""
    return snaps.where("snap_no is not null").select("snap_no").distinct().withColumn("pos", F.row_number().over(Window.orderBy("snap_no")) - 1)


def deltas(refs: DataFrame, records: DataFrame, order: DataFrame) -> DataFrame:
    """refs: snap_no, key; records: snap_no, key; order: snap_no, pos. h1, h2, pos, d_refs, d_exists: the signed change of both counts of a key against the
    snapshot before, where one has changed.

    Rows with a null key or of a snapshot outside the order are left out."""
    one = lambda df, n, m: df.where("key is not null").select("snap_no", *key_hashes("key"), F.lit(n).cast("long").alias("n"), F.lit(m).cast("long").alias("m"))
    counts = one(refs, 1, 0).unionByName(one(records, 0, 1)).groupBy("snap_no", "h1", "h2").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    held = counts.join(F.broadcast(order), "snap_no").select("h1", "h2", F.explode(F.array(F.struct("pos", "n", "m"), F.struct((F.col("pos") + 1).alias("pos"), (-F.col("n")).alias("n"), (-F.col("m")).alias("m")))).alias("c"))
    return held.groupBy("h1", "h2", "c.pos").agg(F.sum("c.n").alias("d_refs"), F.sum("c.m").alias("d_exists")).where("d_refs <> 0 or d_exists <> 0")


def running(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """h1, h2, pos, until, refs, exists, had, will: the counts of a key from one change up to the next (until, null for the last one), whether the key existed
    at a place before, and whether it does behind.

    state: h1, h2, refs, exists, had as apply_deltas gives it, from before the first change."""
    key = Window.partitionBy("h1", "h2")
    upto = key.orderBy("pos")
    both = changes.select("h1", "h2", "pos", "d_refs", "d_exists", F.lit(False).alias("old"))
    if state is not None:
        both = both.unionByName(state.select("h1", "h2", F.lit(-1).alias("pos"), F.col("refs").alias("d_refs"), F.col("exists").alias("d_exists"), F.col("had").alias("old")))
    rows = both.select(
        "h1", "h2", "pos", F.lead("pos").over(upto).alias("until"), F.sum("d_refs").over(upto).alias("refs"), F.sum("d_exists").over(upto).alias("exists"), "old")
    here = F.col("exists") > 0
    return rows.select(
        "h1", "h2", "pos", "until", "refs", "exists",
        F.coalesce(F.max(here | F.col("old")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias("before"),
        F.coalesce(F.max(here).over(upto.rowsBetween(1, Window.unboundedFollowing)), F.lit(False)).alias("will"), "old",
    ).select("h1", "h2", "pos", "until", "refs", "exists", (F.col("before") | F.col("old")).alias("had"), "will")


def apply_deltas(state: DataFrame, change: DataFrame) -> DataFrame:
    """The maintained state (h1, h2, refs, exists, had) after more changes (h1, h2, pos, d_refs, d_exists); a key that nothing refers to and that never was goes.

    had tells whether the key existed at a place before the last change to it or exists now."""
    last = running(change, state).where("until is null")
    return last.select("h1", "h2", "refs", "exists", (F.col("had") | (F.col("exists") > 0)).alias("had")).where("refs <> 0 or exists <> 0 or had")


def current(state: DataFrame) -> DataFrame:
    """h1, h2, refs, state of the keys that are referred to and don't exist now: deleted, or missing as far as is known."""
    return state.where("refs > 0 and exists = 0").select("h1", "h2", "refs", F.when(F.col("had"), "deleted").otherwise("missing").alias("state"))


def orphans(changes: DataFrame, order: DataFrame) -> DataFrame:
    """h1, h2, snap_no, refs, state of each key that a snapshot refers to and does not have.

    state is deleted if an earlier snapshot has the key, else late if a later one has it, else missing."""
    lost = running(changes).where("refs > 0 and exists = 0")
    state = F.when(F.col("had"), "deleted").when(F.col("will"), "late").otherwise("missing")
    each = lost.select("h1", "h2", "refs", state.alias("state"), F.explode(F.expr("sequence(pos, until - 1)")).alias("pos"))
    return each.join(F.broadcast(order), "pos").select("h1", "h2", "snap_no", "refs", "state")


def orphan_keys(edges: DataFrame, nodes: DataFrame, snaps: DataFrame) -> DataFrame:
    """The orphan report over the dst of edges and the id of nodes in the snapshots of snaps; without snapshots it is empty."""
    refs, records = edges.select("snap_no", F.col("dst").alias("key")), nodes.select("snap_no", F.col("id").alias("key"))
    order = places(snaps)
    return orphans(deltas(refs, records, order), order)


def orphan_references(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """snap_no, src, kind, dst, state of each reference to an orphan key, once however often it was delivered.

    edges: snap_no, src, kind (clean), dst. A sieve ends nearly all other references where they are read, before any shuffle; the join tells the rest apart."""
    keys, seen = cut_measured(keys, refs=F.sum("refs"))
    near = cut(sieve(edges.where("dst is not null").select("snap_no", "src", "kind", "dst", *key_hashes("dst")), keys, "h1"))
    own = keys.select(F.struct("snap_no", "h1", "h2").alias("_own"), "state", (F.col("refs") > seen["refs"] * HOT_SHARE).alias("_hot"))
    rows = near.select("snap_no", "src", "kind", "dst", F.struct("snap_no", "h1", "h2").alias("_key"))
    return meet(rows, "_key", own, "_own", F.col("_hot")).select("snap_no", "src", "kind", "dst", "state").distinct()
