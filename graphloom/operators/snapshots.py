"""What changed between consecutive full snapshots.

Keys travel as two independent 64-bit hashes and rows as one; full values are read again only for the keys that differ. Hash buckets of these
arrays are sorted in numpy and compared by binary search, a bounded number of rows in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import clean_kind, clean_sha, cut, sieve
from graphloom.operators.orphans import key_hashes

#: Compact rows (about 32 bytes each) that one bucket holds on average at most.
ROWS_PER_BUCKET = 1_000_000

DIFFERENT = "snap_no int, h1 long, h2 long, what string"


def _ranks(rows: dict[str, np.ndarray]) -> np.ndarray:
    """The same number for the same key, over all snapshots of the bucket."""
    order = np.lexsort((rows["h2"], rows["h1"]))
    a, b = rows["h1"][order], rows["h2"][order]
    new = np.ones(len(a), dtype=np.int64)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(a), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted ones and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def compare_bucket(rows: dict[str, np.ndarray], snaps: list[int]) -> dict[str, np.ndarray]:
    """rows: snap_no, h1, h2, row of one bucket, one row per key and snapshot. The keys that differ between consecutive snapshots."""
    key = _ranks(rows)
    sides = []
    for s in snaps:
        own = np.flatnonzero(rows["snap_no"] == s)
        sides.append(own[np.argsort(key[own])])
    picks: list[tuple[int, str, np.ndarray]] = []
    for s, old, new in zip(snaps[1:], sides, sides[1:]):
        at, there = _found(key[old], key[new])
        picks.append((s, "added", new[~there]))
        picks.append((s, "changed", new[there][rows["row"][old[at[there]]] != rows["row"][new[there]]]))
        picks.append((s, "removed", old[~_found(key[new], key[old])[1]]))
    index = np.concatenate([i for _, _, i in picks]) if picks else np.zeros(0, dtype=np.int64)
    return {
        "snap_no": np.repeat([s for s, _, _ in picks], [len(i) for _, _, i in picks]).astype(np.int32), "h1": rows["h1"][index], "h2": rows["h2"][index],
        "what": np.repeat(np.array([w for _, w, _ in picks], dtype=object), [len(i) for _, _, i in picks]),
    }


def differing(compact: DataFrame, snaps: list[int], rows: int) -> DataFrame:
    """compact: snap_no, h1, h2, row, one row per key and snapshot; rows: an upper bound of their number. snap_no, h1, h2, what."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [{c: b.column(c).to_numpy(zero_copy_only=False) for c in ("snap_no", "h1", "h2", "row")} for b in batches if b.num_rows]
        if parts:
            out = compare_bucket({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, snaps)
            yield pa.RecordBatch.from_pydict({"snap_no": pa.array(out["snap_no"]), "h1": pa.array(out["h1"]), "h2": pa.array(out["h2"]), "what": pa.array(out["what"].tolist(), type=pa.string())})

    least = int(compact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return compact.select("snap_no", "h1", "h2", "row").repartition(max(least, rows // ROWS_PER_BUCKET + 1), "h1", "h2").mapInArrow(compare, DIFFERENT)


def _named(different: DataFrame, ids: DataFrame) -> DataFrame:
    """The full keys of the differing ones; ids: id, repeated or not. Rows whose hash is none of theirs end at a sieve, where they are read."""
    different = cut(different)
    near = sieve(ids.where("id is not null").select("id", *key_hashes("id")), different, "h1").distinct()
    return different.join(near, ["h1", "h2"]).select("snap_no", "id", "what")


def node_changes(nodes: DataFrame, snaps: list[int]) -> DataFrame:
    """snap_no, id, what for nodes by id and sha. Of repeated deliveries the one loaded last counts; a null sha is a value; a null id is left out."""
    when = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(2**62)))
    rows = nodes.where("id is not null and snap_no is not null").select("snap_no", *key_hashes("id"), F.xxhash64(F.col("sha").isNull(), clean_sha()).alias("row"), when.alias("when"))
    compact = rows.groupBy("snap_no", "h1", "h2").agg(F.max_by("row", F.struct("when", "row")).alias("row"))
    return _named(differing(compact, snaps, nodes.count()), nodes.select("id"))


def source_changes(edges: DataFrame, snaps: list[int]) -> DataFrame:
    """snap_no, id, what for the sources of edges by their set of (kind, dst). Rows with a null src are left out; null kinds and dsts are values.

    A set is told by its number and the exclusive or of two hashes of its members. Members are told apart before, by hash, so neither a source nor
    a target with very many edges comes into one task."""
    kind = clean_kind()
    member = F.xxhash64(F.col("src"), kind.isNull(), kind, F.col("dst").isNull(), F.col("dst"))
    once = edges.where("src is not null and snap_no is not null").select("snap_no", *key_hashes("src"), member.alias("m")).distinct()
    sets = once.groupBy("snap_no", "h1", "h2").agg(F.count("*").alias("n"), F.bit_xor("m").alias("x"), F.bit_xor(F.xxhash64(F.lit(3), F.col("m"))).alias("y"))
    compact = sets.select("snap_no", "h1", "h2", F.xxhash64("n", "x", "y").alias("row"))
    return _named(differing(compact, snaps, edges.count()), edges.select(F.col("src").alias("id")))
