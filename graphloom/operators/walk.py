"""Walks over the graph: reach, closures, shortest paths, components. Rounds of joins, each cut from the lineage of those before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.functions.names import member, owner
from graphloom.operators import graph as G

#: Lines of a file that one key of the joins on lines stands for.
LINES_PER_BLOCK = 100


def reach(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, distance of everything that links (src, dst) lead to from seeds (id) in depth steps at most, by the fewest steps.

    Every round joins only what the last one found, and only with links; an empty round ends it."""
    links = links.where("src is not null and dst is not null").select("src", "dst")
    seen = cut(seeds.where("id is not null").select("id").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = cut(found.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def closure(links: DataFrame) -> DataFrame:
    """src, dst of all pairs that links lead from one to the other in one step or more, rings included. Links must be few per chain, as of types.

    Each round puts a pair of the last one before any pair so far, so the length of the ways doubles."""
    seen = frontier = cut(links.where("src is not null and dst is not null").select("src", "dst").distinct())
    while not frontier.isEmpty():
        found = frontier.alias("f").join(seen.alias("s"), F.col("f.dst") == F.col("s.src")).select("f.src", "s.dst").distinct()
        frontier = cut(found.join(seen, ["src", "dst"], "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def backwards(edges: DataFrame, kinds: tuple[str, ...] = G.IMPACT) -> DataFrame:
    """The edges of some kinds turned round, so that a walk leads from what is used to what uses it."""
    return edges.where(F.col("kind").isin(*kinds)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def class_seeds(g: G.Graph, ids: DataFrame) -> DataFrame:
    """The ids themselves and the members of those that are types."""
    held = g.edges.where("kind = 'CONTAINS'").join(ids.select(F.col("id").alias("src")), "src").join(g.nodes.where(G.is_code()).select(F.col("id").alias("src")), "src", "left_semi")
    return ids.select("id").union(held.select(F.col("dst").alias("id"))).distinct()


def neighbors(g: G.Graph, ids: DataFrame, depth: int = 1, least: float = 0.0) -> DataFrame:
    """src, dst, kind, level: the edges met within depth steps in either direction, at the step that meets them first. Structure is left out but for CONTAINS."""
    told = g.edges.where(~F.col("kind").isin(*(s for s in G.STRUCTURE if s != "CONTAINS"))).where(F.col("confidence") >= least).select("src", "dst", "kind")
    both = told.union(told.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    near = reach(both, ids, depth - 1) if depth > 1 else ids.select("id").distinct().withColumn("distance", F.lit(0))
    out = near.join(told, F.col("id") == F.col("src")).select("src", "dst", "kind", (F.col("distance") + 1).alias("level"))
    into = near.join(told, F.col("id") == F.col("dst")).select("src", "dst", "kind", (F.col("distance") + 1).alias("level"))
    return out.union(into).groupBy("src", "dst", "kind").agg(F.min("level").alias("level"))


def shortest_path(g: G.Graph, start: str, end: str, longest: int = 6) -> DataFrame:
    """step, src, dst, kind of one shortest chain from start to end; of equal ones the smallest src and kind. Empty if there is none.

    Edges lead forwards, and from a member back to what holds it."""
    told = g.edges.where(~F.col("kind").isin(*(s for s in G.STRUCTURE if s != "CONTAINS"))).select("src", "dst", "kind")
    back = g.edges.where("kind = 'CONTAINS'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    links = cut(told.union(back))
    spark = links.sparkSession
    near = reach(links, spark.createDataFrame([(start,)], "id string"), longest)
    at = cut(near)
    came = links.join(at.select(F.col("id").alias("src"), F.col("distance").alias("d")), "src").join(at.select(F.col("id").alias("dst"), F.col("distance").alias("e")), "dst").where("e = d + 1")
    parents = cut(came.groupBy("dst", "e").agg(F.min(F.struct("src", "kind")).alias("p")).select("e", "p.src", "dst", "p.kind"))
    wanted, steps = end, []
    for row in at.where(F.col("id") == end).select("distance").collect():  # at most one row, and a path of a few steps behind it
        for _ in range(row[0]):
            step = parents.where(F.col("dst") == wanted).first()
            steps.append((step["e"], step["src"], step["dst"], step["kind"]))
            wanted = step["src"]
    return spark.createDataFrame(steps, "step int, src string, dst string, kind string")


def changed_members(g: G.Graph, ranges: DataFrame) -> DataFrame:
    """id of the members whose lines overlap changed ranges (file, first, last), or of the file's types where no member does.

    Members and ranges meet by file and block of lines, so a file with very many of both is no one group."""
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / LINES_PER_BLOCK), F.floor(F.greatest(a, b) / LINES_PER_BLOCK))).alias("block")
    spans = g.nodes.where("file is not null and start_line is not null").select("id", "file", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), G.is_code().alias("code"), "kind")
    members = spans.where("not code and kind <> 'FILE'").select("id", "file", "start_line", "end_line", blocks("start_line", "end_line"))
    wanted = ranges.where("file is not null and first is not null and last is not null").select("file", "first", "last", blocks("first", "last"))
    hit = members.join(wanted, ["file", "block"]).where("start_line <= last and end_line >= first").select("id", "file").distinct()
    rest = ranges.select("file").distinct().join(hit, "file", "left_anti")
    types = g.nodes.where(G.is_code()).where("file is not null").select("id", "file").join(rest, "file")
    return hit.select("id").union(types.select("id")).distinct()


def tests_of(g: G.Graph, affected: DataFrame, seeds: DataFrame) -> DataFrame:
    """id of the tests to run: those with a TESTS edge into a class of seeds or affected ids, and affected classes that are tests themselves."""
    owners = affected.select(owner("id").alias("dst")).union(seeds.select(owner("id").alias("dst"))).distinct()
    linked = g.edges.where("kind = 'TESTS'").join(owners, "dst", "left_semi").select(F.col("src").alias("id"))
    own = g.nodes.where(G.is_test()).select("id").join(affected.select(owner("id").alias("id")), "id", "left_semi")
    return linked.union(own).distinct()


def test_runs(tests: DataFrame, tool: str, many: bool) -> DataFrame:
    """tests: id, module. module, command: how the project's own build runs the tests of each module, by Gradle or Maven; of another tool nothing is known.

    many: whether the build has several modules. A command holds its module's tests in the order of their ids."""
    of = tests.select(F.coalesce("module", F.lit("")).alias("module"), "id").distinct().groupBy("module").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    if tool == "gradle":
        task = F.when(F.col("module").isin("", ":"), "test").otherwise(F.concat("module", F.lit(":test")))
        return of.select("module", F.concat(F.lit("./gradlew "), task, F.array_join(F.transform("ids", lambda i: F.concat(F.lit(" --tests "), i)), "")).alias("command"))
    if tool == "maven":
        part = F.when(F.lit(many) & (F.col("module") != ""), F.concat(F.lit(" -pl "), "module", F.lit(" -Dsurefire.failIfNoSpecifiedTests=false"))).otherwise("")
        return of.select("module", F.concat(F.lit("./mvnw -q test"), part, F.lit(" -Dtest="), F.array_join("ids", ",")).alias("command"))
    return of.limit(0).select("module", F.lit("").alias("command"))


def dispatches(g: G.Graph) -> DataFrame:
    """src, dst, confidence: calls followed into every body below the called type. A call with n bodies gives each 1/n; two calls of one source to one body
    keep the confidence of the call whose target comes first by name."""
    below = closure(g.edges.where("kind in ('EXTENDS', 'IMPLEMENTS')").select("src", "dst")).select(F.col("dst").alias("cls"), F.col("src").alias("sub"))
    methods = cut(g.nodes.where("kind = 'METHOD' and contains(id, '#')").select(owner("id").alias("cls"), member("id").alias("m"), G.overridable(F.col("signature")).alias("open")))
    calls = g.edges.where("kind = 'CALLS' and contains(dst, '#')").select("src", F.col("dst").alias("called"), owner("dst").alias("cls"), member("dst").alias("m")).where("m not like '<%'")
    open_ = calls.join(methods.where("not open").select("cls", "m"), ["cls", "m"], "left_anti")
    bodies = open_.select("called", "cls", "m").distinct().join(below, "cls").join(methods.select(F.col("cls").alias("sub"), "m"), ["sub", "m"])
    counted = bodies.select("called", F.concat_ws("#", "sub", "m").alias("dst"), F.count("*").over(Window.partitionBy("called")).alias("n"))
    return open_.join(counted, "called").groupBy("src", "dst").agg(F.min_by(F.lit(1.0) / F.col("n"), F.col("called")).alias("confidence"))


def overridden(g: G.Graph) -> DataFrame:
    """src, dst: each method and the methods of the same name and parameters that types above its own declare."""
    above = closure(g.edges.where("kind in ('EXTENDS', 'IMPLEMENTS')").select("src", "dst"))
    methods = cut(g.nodes.where("kind = 'METHOD' and contains(id, '#')").select("id", owner("id").alias("cls"), member("id").alias("m")).where("m not like '<%'"))
    return methods.join(above, F.col("cls") == F.col("src")).select(F.col("id").alias("sub_id"), "dst", "m").join(methods.select(F.col("cls").alias("dst"), "m", "id"), ["dst", "m"]).select(F.col("sub_id").alias("src"), F.col("id").alias("dst")).distinct()


def climb(g: G.Graph, ids: DataFrame, levels: int = 4) -> DataFrame:
    """start, top: for each id the caller furthest above it, within levels, that is an own, named member of two lines at least; the smallest id of that level."""
    fit = cut(g.nodes.where("origin = 'REPO' and file is not null").where(~G.is_test()).select("id", (~F.contains(owner("id"), F.lit("$")) & (F.coalesce("end_line", F.lit(0)) - F.coalesce("start_line", F.lit(0)) >= 1)).alias("top")))
    calls = cut(g.edges.where("kind = 'CALLS'").join(fit.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("at"), F.col("src").alias("id")))
    seen = cut(ids.select(F.col("id").alias("start"), "id").distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for level in range(1, levels + 1):
        up = frontier.select("start", F.col("id").alias("at")).join(calls, "at").select("start", "id").distinct()
        frontier = cut(up.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(frontier)
    tops = seen.where("level > 0").join(fit.where("top").select("id"), "id", "left_semi")
    return tops.groupBy("start").agg(F.min(F.struct((-F.col("level")).alias("l"), "id"))["id"].alias("top"))


def chains(g: G.Graph, ids: DataFrame, steps: int = 4) -> DataFrame:
    """start, step, id: from each id the best next callee again and again: by layer of its class, whether it calls on, how sure the call is, and id."""
    layers = g.nodes.where(G.is_code()).select(F.col("id").alias("_cls"), G.attr("layer").alias("layer"))
    rank = F.when(F.col("layer").isin("controller", "service", "repository", "client"), 0).when(F.col("layer").isin("util", "config"), 2).when(F.col("layer") == "model", 3).otherwise(1)
    calling = g.edges.where("kind = 'CALLS'").select(F.col("src").alias("_caller")).distinct()
    fit = g.nodes.where("origin <> 'EXTERNAL' and file is not null").where(~G.is_test()).select("id").join(layers, owner("id") == F.col("_cls"), "left").join(calling, F.col("id") == F.col("_caller"), "left")
    fit = fit.select(F.col("id").alias("dst"), rank.alias("rank"), F.col("_caller").isNull().alias("ends"))
    sure = F.array_position(F.array(*map(F.lit, G.RESOLUTIONS)), F.col("resolution"))
    calls = cut(g.edges.where("kind = 'CALLS' or (kind = 'DISPATCHES_TO' and confidence >= 0.2)").join(fit, "dst").select("src", F.struct("rank", "ends", sure.alias("sure"), (-F.col("confidence")).alias("less"), "dst").alias("way")))
    state = cut(ids.select(F.col("id").alias("start"), "id", F.array("id").alias("path")).distinct())
    for _ in range(steps - 1):
        nexts = state.join(calls, F.col("id") == F.col("src")).where(~F.array_contains("path", F.col("way.dst"))).groupBy("start").agg(F.min("way")["dst"].alias("_next"))
        state = cut(state.join(nexts, "start", "left").select("start", F.col("_next").alias("id"), F.when(F.col("_next").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("_next"))).alias("path")))
    return state.where("size(path) > 1").select("start", F.posexplode("path").alias("step", "id"))


def components(links: DataFrame) -> DataFrame:
    """id, component: the strongly connected component of each end of links (src, dst), named by its smallest id; alone means its own.

    Ends that nothing reaches or that reach nothing fall off round by round. Then the smallest id spreads forwards, and back from each such id along
    what it has reached; both together are one component, and the rest goes round again."""
    left = cut(links.where("src is not null and dst is not null").select("src", "dst").distinct())
    nodes = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct())
    done = None
    left = cut(left.where("src <> dst"))
    while not left.isEmpty():
        n = -1
        while n != (now := left.count()) and now:
            n = now
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), left)
        color = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("color", F.col("id")))
        if color.isEmpty():
            break
        while True:
            lower = left.join(color, F.col("src") == F.col("id")).groupBy("dst").agg(F.min("color").alias("_low"))
            nexts = cut(color.join(lower, F.col("id") == F.col("dst"), "left").select("id", F.least("color", "_low").alias("color"), (F.col("_low") < F.col("color")).alias("changed")))
            color = nexts.select("id", "color")
            if nexts.where("changed").isEmpty():
                break
        inside = left.join(color.select(F.col("id").alias("src"), F.col("color").alias("_a")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("_b")), "dst").where("_a = _b")
        inside = cut(inside.select("src", "dst"))
        back = reach(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), color.where("id = color"), 1 << 20)
        found = cut(back.select("id").join(color, "id"))
        done = found if done is None else done.unionByName(found)
        gone = found.select("id")
        left = cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    if done is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(done, "id", "left").select("id", F.coalesce("color", "id").alias("component"))
