"""The code graph of one snapshot as two tables, and the writes that make and cut it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.common import at_snapshot, clean_kind, cut, last_snapshot, latest_rows, table
from graphloom.functions.names import member, owner

#: Kinds of nodes that are types, and kinds of edges that only give structure.
CODE = ("CLASS", "INTERFACE", "ENUM", "RECORD", "ANNOTATION")
STRUCTURE = ("CONTAINS", "MEMBER_OF_COMMUNITY", "STEP_OF_FLOW", "HAS_FINDING", "IMPORTS", "TESTS")
#: What a change of a target reaches backwards.
IMPACT = ("CALLS", "DISPATCHES_TO", "INJECTS", "USES_TYPE", "READS_FIELD", "WRITES_FIELD", "EXTENDS", "IMPLEMENTS", "OVERRIDES")
#: How sure an edge is, best first.
RESOLUTIONS = ("EXACT", "CHA", "SPRING", "HEURISTIC")


@dataclass
class Graph:
    """nodes: one row per id. edges: one row per src, dst and kind. Kinds are clean."""

    nodes: DataFrame
    edges: DataFrame


def upsert_edges(edges: DataFrame, keys: list[str] = ("src", "dst", "kind")) -> DataFrame:
    """Of repeated edges the first delivery holds; a later one only fills in a missing line. Rows with a null in a key are left out.

    keys, resolution, confidence, line. Everything is combined before the shuffle, so an edge delivered very often weighs no more than others."""
    kept = edges.where(" and ".join(f"{k} is not null" for k in keys))
    first = F.min(F.struct("loaded_at", "resolution", "confidence")).alias("_first")
    line = F.min(F.when(F.col("line").isNotNull(), F.struct("loaded_at", "line"))).alias("_line")
    return kept.groupBy(*keys).agg(first, line).select(*keys, "_first.resolution", "_first.confidence", "_line.line")


def load(spark: SparkSession, folder: str, snap_no: int | None = None) -> Graph:
    """The graph of a snapshot, the last one if none is named."""
    snap_no = last_snapshot(spark, folder) if snap_no is None else snap_no
    nodes = latest_rows(at_snapshot(table(spark, folder, "nodes"), snap_no), ["id"]).drop("snap_no", "loaded_at").withColumn("kind", clean_kind())
    return Graph(nodes, upsert_edges(at_snapshot(table(spark, folder, "edges"), snap_no).withColumn("kind", clean_kind())))


def attr(name: str, attrs: str = "attrs") -> Column:
    """One entry of the attributes, null where it is missing."""
    return F.try_element_at(F.col(attrs), F.lit(name))


def is_test() -> Column:
    return F.coalesce(attr("test") == "true", F.lit(False))


def is_code() -> Column:
    return F.col("kind").isin(*CODE)


def rendered(attrs: Column) -> Column:
    """Attributes as one line of sorted name=value parts; empty for none."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), "; ")


def merge_tiers(rows: DataFrame, tier: str) -> DataFrame:
    """One row per id from deliveries of several tiers: columns of the highest tier, attributes of all, the higher tier's value where both have one.

    A key has at most one row per tier; the number of tiers bounds what is gathered for it."""
    rest = [c for c in rows.columns if c not in ("id", "attrs", tier)]
    merged = rows.where("id is not null").groupBy("id").agg(
        F.max_by(F.struct(*rest), F.col(tier)).alias("_top"), F.array_sort(F.collect_list(F.struct(F.col(tier).alias("tier"), F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"))), lambda a, b: F.when(a["tier"] < b["tier"], -1).when(a["tier"] > b["tier"], 1).otherwise(0)).alias("_all"))
    fold = F.aggregate("_all", F.create_map().cast("map<string,string>"), lambda acc, x: F.map_zip_with(acc, x["attrs"], lambda k, a, b: F.coalesce(b, a)))
    return merged.select("id", *(F.col("_top")[c].alias(c) for c in rest), fold.alias("attrs"))


def set_attrs(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with the entries of changes (id, new) merged into their attributes; ids without a node are ignored."""
    both = nodes.join(changes.select(F.col("id").alias("_id"), "new"), F.col("id") == F.col("_id"), "left")
    merged = F.map_zip_with(F.coalesce("attrs", F.create_map().cast("map<string,string>")), F.col("new"), lambda k, a, b: F.coalesce(b, a))
    return both.withColumn("attrs", F.when(F.col("_id").isNull(), F.col("attrs")).otherwise(merged)).drop("_id", "new")


def delete_nodes(g: Graph, ids: DataFrame, incoming: bool = True) -> Graph:
    """The graph without the nodes of ids (id) and the edges that leave them, and with incoming those that reach them."""
    nodes = g.nodes.join(ids, "id", "left_anti")
    edges = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti")
    return Graph(nodes, edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select(*g.edges.columns) if incoming else edges.select(*g.edges.columns))


def delete_unit(g: Graph, module: str) -> Graph:
    """The graph without a module: its nodes and the edges leaving them. Edges that reach it stay and find it again, or end in stubs."""
    return delete_nodes(g, g.nodes.where(F.col("module") == module).select("id"), incoming=False)


def delete_kinds(g: Graph, kinds: list[str]) -> Graph:
    """The graph without the nodes of some kinds and every edge that touches them."""
    return delete_nodes(g, g.nodes.where(F.col("kind").isin(*kinds)).select("id"))


def delete_stubs(g: Graph) -> Graph:
    """The graph without external nodes and the edges leaving them."""
    return delete_nodes(g, g.nodes.where("origin = 'EXTERNAL'").select("id"), incoming=False)


def stubs(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, fqn, origin, module, artifact, inherited) for targets without one, and the CONTAINS edges (src, dst) that hold them.

    The kind follows from the shape of the id. A member of a known type takes its place in the project, all else is external."""
    ids = g.nodes.select("id", "origin", "module", "artifact")
    missing = g.edges.select(F.col("dst").alias("id")).distinct().join(ids.select("id"), "id", "left_anti")
    annotations = g.edges.where("kind = 'ANNOTATED_WITH'").select(F.col("dst").alias("_note")).distinct()
    shaped = missing.join(annotations, F.col("id") == F.col("_note"), "left").withColumn(
        "kind", F.when(F.contains("id", F.lit("#<init>(")), "CONSTRUCTOR").when(F.contains("id", F.lit("(")), "METHOD").when(F.contains("id", F.lit("#")), "FIELD")
        .when(F.col("_note").isNotNull(), "ANNOTATION").otherwise("CLASS")).withColumn("_owner", F.when(F.contains("id", F.lit("#")), owner("id")))
    held = shaped.join(ids.select(F.col("id").alias("_oid"), "origin", "module", "artifact"), F.col("_owner") == F.col("_oid"), "left")
    made = held.select("id", "kind", F.col("id").alias("fqn"), F.coalesce("origin", F.lit("EXTERNAL")).alias("origin"), "module", "artifact", F.col("_oid").isNotNull().alias("inherited"), "_owner")
    lone = made.where("_owner is not null and not inherited").select("_owner").distinct().join(missing.select(F.col("id").alias("_owner")), "_owner", "left_anti")
    none = F.lit(None).cast("string")
    owners = lone.select(F.col("_owner").alias("id"), F.lit("CLASS").alias("kind"), F.col("_owner").alias("fqn"), F.lit("EXTERNAL").alias("origin"), none.alias("module"), none.alias("artifact"), F.lit(False).alias("inherited"))
    return made.drop("_owner").unionByName(owners), made.where("_owner is not null").select(F.col("_owner").alias("src"), F.col("id").alias("dst"))


def prune_orphans(g: Graph, rounds: int = 3) -> Graph:
    """The graph without unreferenced external nodes, packages that hold nothing, and edges with an end missing, round by round.

    Rounds work on the keys alone, cut after each one, as the next round reads them several times."""
    nodes, edges = cut(g.nodes.select("id", "kind", "origin")), cut(g.edges.select("src", "dst", "kind"))
    for _ in range(rounds):
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        holders = edges.where("kind = 'CONTAINS'").select(F.col("src").alias("id"))
        lone = nodes.where("origin = 'EXTERNAL'").select("id").join(ends, "id", "left_anti")
        empty = nodes.where("kind = 'PACKAGE'").select("id").join(holders, "id", "left_anti")
        nodes = cut(nodes.join(lone.union(empty), "id", "left_anti"), nodes)
        edges = cut(edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"), edges)
    return Graph(g.nodes.join(nodes.select("id"), "id", "left_semi"), g.edges.join(edges, ["src", "dst", "kind"], "left_semi"))


def prune_unreachable(g: Graph, artifact: str, depth: int = 2) -> DataFrame:
    """Ids of an artifact (or module) whose class nothing outside reaches within depth further steps; annotated members count as reached."""
    own = g.nodes.where((F.col("artifact") == artifact) | (F.col("module") == artifact)).select("id", owner("id").alias("cls"), attr("annotations").alias("notes"))
    links = g.edges.where(~F.col("kind").isin(*STRUCTURE)).select("src", "dst").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    ids = own.select(F.col("id").alias("src"))
    inside, outside = links.join(ids, "src", "left_semi"), links.join(ids, "src", "left_anti")
    wired = own.where(F.coalesce(F.size(F.json_object_keys("notes")), F.lit(0)) > 0).where(F.exists(F.json_object_keys("notes"), lambda n: ~n.rlike(r"^(java\.lang|kotlin)\."))).select("id")
    frontier = outside.select(F.col("dst").alias("id")).union(wired).distinct()
    reached = frontier
    for _ in range(depth):
        classes = frontier.join(own, "id").select(F.col("cls").alias("id"))
        nexts = frontier.join(inside, F.col("id") == F.col("src")).select(F.col("dst").alias("id"))
        frontier = classes.union(nexts).distinct().join(reached, "id", "left_anti")
        reached = reached.union(frontier)
    kept = reached.union(frontier.join(own, "id").select("cls")).join(own, "id").select("cls").distinct()
    return own.join(kept, "cls", "left_anti").select("id")


def usage_of(g: Graph, module: str) -> DataFrame:
    """id: targets inside the packages of a module that edges from outside it point at.

    The packages of a target are all prefixes of its id up to a dot, so the prefix join is an equal join on packages."""
    packages = g.nodes.where((F.col("module") == module) & is_code()).select(F.regexp_replace(F.substring_index("id", "$", 1), r"\.[^.]*$", "").alias("pkg")).distinct()
    outside = g.nodes.where("origin <> 'EXTERNAL'").where(F.col("module").isNull() | (F.col("module") != module)).select(F.col("id").alias("src"))
    targets = g.edges.join(outside, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    parts = F.split("id", r"\.")
    prefixes = targets.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("pkg"))
    return prefixes.join(packages, "pkg", "left_semi").select("id").distinct()


def clean_edges(g: Graph) -> DataFrame:
    """src, dst, kind, resolution, confidence: the best edge for each pair that tells something.

    No structure, mentions or edges to itself; dispatches from a fifth of confidence on; no test as target unless the source is a test."""
    tests = g.nodes.where(is_test()).select(F.col("id").alias("_test"))
    rank = F.array_position(F.array(*map(F.lit, RESOLUTIONS)), F.col("resolution"))
    told = g.edges.where(~F.col("kind").isin(*STRUCTURE, "MENTIONS") & (F.col("src") != F.col("dst"))).where("kind <> 'DISPATCHES_TO' or confidence >= 0.2")
    to_test = told.join(tests, F.col("dst") == F.col("_test"), "left").withColumnRenamed("_test", "_to").join(tests, F.col("src") == F.col("_test"), "left").where("_to is null or _test is not null")
    best = F.min(F.struct(rank.alias("rank"), (-F.col("confidence")).alias("less"), "kind", "resolution", "confidence"))
    return to_test.groupBy("src", "dst").agg(best.alias("b")).select("src", "dst", "b.kind", "b.resolution", "b.confidence")


def overridable(signature: Column) -> Column:
    """Whether a method can have another body below: it is not static, private or final. Without a signature it can."""
    return F.coalesce(~F.substring_index(signature, "(", 1).rlike(r"\b(static|private|final)\b"), F.lit(True))


def trivial_members(g: Graph) -> DataFrame:
    """id: constructors, and accessors that call nothing."""
    methods = g.nodes.where("kind in ('METHOD', 'CONSTRUCTOR')").select("id", member("id").alias("m"))
    accessor = methods.where(F.col("m").rlike(r"^(get|set|is)") & (F.length(F.substring_index("m", "(", 1)) > 3))
    callers = g.edges.where("kind = 'CALLS'").select(F.col("src").alias("id"))
    return methods.where("m like '<%'").select("id").union(accessor.join(callers, "id", "left_anti").select("id"))


def resolve_ids(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, id: what each name (name) denotes: a node's id, else every class of that bare name, else the members of that class and short form.

    The project's own nodes come before those of libraries. A name that denotes nothing has no row."""
    wanted = names.where("name is not null").select("name").distinct()
    ids = nodes.select("id", "kind", "origin")
    exact = wanted.join(ids, F.col("name") == F.col("id")).select("name", "id")
    rest = wanted.join(exact.select("name"), "name", "left_anti")
    classes = ids.where(is_code()).select("id", F.substring_index(F.substring_index("id", ".", -1), "$", -1).alias("bare"), (F.col("origin") == "REPO").alias("own"))
    bare = rest.where("not contains(name, '#') and not contains(name, '.')").join(classes, F.col("name") == F.col("bare"))
    short = F.regexp_replace(F.regexp_replace(member("name"), " ", ""), r"[\w.]+\.", "")
    asked = rest.where("contains(name, '#')").select("name", owner("name").alias("cls"), short.alias("want"))
    members = ids.where(F.contains("id", F.lit("#"))).select("id", owner("id").alias("oid"), F.regexp_replace(member("id"), r"[\w.]+\.", "").alias("sig"), (F.col("origin") == "REPO").alias("own"))
    keyed = members.select("*", F.explode(F.array_distinct(F.array("oid", F.substring_index("oid", ".", -1)))).alias("cls"))
    found = asked.join(keyed, "cls").where("sig = want or (not contains(want, '(') and substring_index(sig, '(', 1) = want)")
    both = bare.select("name", "id", "own").unionByName(found.select("name", "id", "own"))
    best = both.withColumn("_best", F.max("own").over(Window.partitionBy("name")))
    return exact.unionByName(best.where("own = _best").select("name", "id")).distinct()
