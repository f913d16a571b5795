"""End-to-end flows: the depth-first walk from each entry point, all entries side by side."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.functions.names import owner
from graphloom.operators import graph as G

#: What a flow is: so deep and so many steps at most, and topics with so few readers are followed.
MAX_DEPTH, MAX_STEPS, MAX_READERS = 10, 150, 2
#: Kinds of entries in the order flows are listed.
ENTRY_KINDS = ("route", "consumer", "job", "main")


def entries(g: G.Graph) -> DataFrame:
    """id, entry_kind, label: one per method; of several labels the first kind's smallest."""
    short = F.concat_ws(".", F.regexp_replace(F.substring_index(owner("id"), ".", -1), r"\$", "."), F.substring_index(F.substring_index("id", "#", -1), "(", 1))
    named = g.nodes.select(F.col("id").alias("dst"), "fqn", F.coalesce(G.attr("remote") == "true", F.lit(False)).alias("remote"))
    routed = g.edges.where("kind = 'HANDLES_ROUTE'").join(named, "dst").where("not remote").select(F.col("src").alias("id"), F.lit(0).alias("rank"), F.col("fqn").alias("label"))
    reading = g.edges.where("kind = 'CONSUMES_FROM'").join(named, "dst").select(F.col("src").alias("id"), F.lit(1).alias("rank"), F.concat(F.lit("consume "), "fqn").alias("label"))
    jobs = g.edges.where("kind = 'CALLS' and src like 'job:%'").select(F.col("dst").alias("id")).select("id", F.lit(2).alias("rank"), F.concat(F.lit("scheduled "), short).alias("label"))
    mains = g.nodes.where("kind = 'METHOD' and origin = 'REPO' and endswith(id, '#main(java.lang.String[])')").where(~G.is_test()).select("id").select("id", F.lit(3).alias("rank"), F.concat(F.lit("main "), short).alias("label"))
    first = routed.unionByName(reading).unionByName(jobs).unionByName(mains).groupBy("id").agg(F.min(F.struct("rank", "label")).alias("f"))
    kinds = F.array(*map(F.lit, ENTRY_KINDS))
    return first.join(g.nodes.select("id"), "id", "left_semi").select("id", F.element_at(kinds, F.col("f.rank") + 1).alias("entry_kind"), "f.label")


def adjacency(g: G.Graph) -> DataFrame:
    """src, calls: what a walk visits from a method, in its order: calls by target, dispatches by target, readers of its topics. Trivial members are left out."""
    facts = g.nodes.select(F.col("id").alias("dst"), F.when(F.col("origin") == "EXTERNAL", "external").when(G.is_test(), "test").otherwise("own").alias("what"))
    direct = g.edges.where("kind in ('CALLS', 'DISPATCHES_TO')").select("src", "dst", F.when(F.col("kind") == "CALLS", 0).otherwise(1).alias("rank"), "resolution")
    direct = direct.join(G.trivial_members(g).select(F.col("id").alias("dst")), "dst", "left_anti").join(facts, "dst")
    readers = g.edges.where("kind = 'CONSUMES_FROM'").select(F.col("dst").alias("topic"), F.col("src").alias("reader")).withColumn("n", F.count("*").over(Window.partitionBy("topic"))).where(F.col("n") <= MAX_READERS)
    across = g.edges.where("kind = 'PRODUCES_TO'").select("src", F.col("dst").alias("topic")).join(readers, "topic").select("src", F.col("reader").alias("dst"), F.lit(2).alias("rank"), F.lit("HEURISTIC").alias("resolution")).join(facts, "dst")
    both = direct.select("src", "rank", "dst", "resolution", "what").unionByName(across.select("src", "rank", "dst", "resolution", "what"))
    return both.groupBy("src").agg(F.array_sort(F.collect_set(F.struct("rank", "dst", "resolution", "what"))).alias("calls"))


def walk(entry: str, known: dict[str, list[tuple[str, str, str]]]) -> tuple[list[tuple[str, int, str]], list[str], list[str]]:
    """Steps (id, depth, how) in order and external ids, as far as known leads, and the ids met of which nothing is known yet, as many as steps are left."""
    steps, seen, outside, missing = [], set(), [], []
    stack = [(entry, 0, "EXACT", "own")]
    while stack:
        at, depth, how, what = stack.pop()
        if at in seen or len(steps) >= MAX_STEPS:
            continue
        seen.add(at)
        if what == "external":
            outside.append(at)
        if what != "own":
            continue
        steps.append((at, depth, how))
        if depth >= MAX_DEPTH:
            continue
        if at not in known:
            missing.append(at)
        stack += [(dst, depth + 1, how, what) for dst, how, what in reversed(known.get(at, ()))]
    return steps, outside, missing


def flows(g: G.Graph) -> DataFrame:
    """entry, entry_kind, label, steps (id, depth, via in order), external: the flow of each entry.

    Each round walks every entry as far as the calls fetched for it lead and then fetches what it met and lacked, by a join; an entry needs few rounds, as
    a walk is MAX_DEPTH deep, and never holds more than the calls of some MAX_STEPS methods a round."""
    calls = cut(adjacency(g))
    starts = cut(entries(g))
    step = "struct<id:string,depth:int,via:string>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {r.src: [(c["dst"], c["resolution"], c["what"]) for c in r.calls] if r.calls is not None else [] for r in pdf.itertuples() if r.src is not None}
        steps, outside, missing = walk(pdf["entry"].iloc[0], known)
        return pd.DataFrame({"entry": [pdf["entry"].iloc[0]], "steps": [[{"id": i, "depth": d, "via": v} for i, d, v in steps]], "external": [outside], "missing": [missing]})

    known = starts.select(F.col("id").alias("entry"), F.lit(None).cast("string").alias("src"), F.lit(None).cast(calls.schema["calls"].dataType).alias("calls"))
    while True:
        walked = cut(known.groupBy("entry").applyInPandas(run, f"entry string, steps array<{step}>, external array<string>, missing array<string>"))
        wanted = walked.select("entry", F.explode("missing").alias("src"))
        if wanted.isEmpty():
            break
        known = cut(known.unionByName(wanted.join(calls, "src", "left").select("entry", "src", "calls")))
    return walked.join(starts.withColumnRenamed("id", "entry"), "entry").select("entry", "entry_kind", "label", "steps", "external")
