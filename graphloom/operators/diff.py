"""What differs between two versions of the graph, and what that reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import clean_sha
from graphloom.operators import graph as G
from graphloom.operators.walk import backwards, reach

#: Kinds of nodes that are compared by their attributes, and kinds that are compared at all.
WIRING = ("HTTP_ROUTE", "MESSAGE_TOPIC", "CONFIG_KEY", "BEAN", "SCHEDULED_JOB")
COMPARED = (*G.CODE, "METHOD", "CONSTRUCTOR", "FIELD", *WIRING)
REACHED = ("CALLS", "DISPATCHES_TO", "INJECTS", "USES_TYPE", "OVERRIDES")


def _compared(g: G.Graph) -> DataFrame:
    attrs = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: k != "handler")
    calls = g.edges.where("kind = 'CALLS'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("dst")).alias("x"))
    own = g.nodes.where(F.col("kind").isin(*COMPARED) & (F.col("origin") == "REPO")).where(~G.is_test())
    return own.select("id", "kind", clean_sha().alias("sha"), "signature", G.rendered(attrs).alias("attrs")).join(calls, "id", "left")


def changes(base: G.Graph, head: G.Graph) -> DataFrame:
    """id, kind, what: added, removed, or changed in attributes, body, signature or calls, the first of these that tells.

    Tests and what isn't the project's own are left out. Sets of callees are compared by their number and a hash."""
    old = _compared(base).select(*(F.col(c).alias(f"old_{c}") for c in ("id", "kind", "sha", "signature", "attrs", "n", "x")))
    both = _compared(head).join(old, F.col("id") == F.col("old_id"), "full_outer")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"old_{c}"))
    what = (
        F.when(F.col("old_id").isNull(), "added").when(F.col("id").isNull(), "removed")
        .when(F.col("kind").isin(*WIRING), F.when(~same("attrs"), "attributes changed"))
        .when(F.col("sha").isNotNull() & F.col("old_sha").isNotNull(), F.when(F.col("sha") != F.col("old_sha"), "body changed"))
        .when(~same("signature"), "signature changed").when(~(same("n") & same("x")), "calls changed")
    )
    return both.select(F.coalesce("id", "old_id").alias("id"), F.coalesce("kind", "old_kind").alias("kind"), what.alias("what")).where("what is not null")


def affected(base: G.Graph, head: G.Graph, changed: DataFrame, depth: int = 3) -> DataFrame:
    """id, distance: what the changed and removed ids reach backwards: through the edges of head, and where an id is gone from it, of base."""
    seeds = changed.where("what <> 'added'").select("id")
    now = head.nodes.select(F.col("id").alias("src"))
    links = backwards(head.edges, REACHED).join(now, "src", "left_semi").unionByName(backwards(base.edges, REACHED).join(now, "src", "left_anti"))
    return reach(links, seeds, depth).where("distance > 0")
