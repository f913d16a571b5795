"""The questions one asks a code graph, by name: each answers with a DataFrame, or with text where a report is asked for.

    graph = CodeGraph.open(spark, "/data/project")
    graph.impact("org.example.Store", depth=3).show()
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.functions import names
from graphloom.functions.names import owner
from graphloom.operators import derive, diff, flows, kernels, search, walk
from graphloom.operators import graph as G

#: How many entries of each list an answer holds, tried in turn until it fits.
LADDER = (40, 20, 15, 10, 7, 5, 4, 3, 2, 1)


class CodeGraph:
    """A graph and what is derived from it, each made once when first asked for."""

    def __init__(self, graph: G.Graph):
        self.graph = graph

    @classmethod
    def open(cls, spark: SparkSession, folder: str, snap_no: int | None = None) -> CodeGraph:
        g = G.load(spark, folder, snap_no)
        return cls(G.Graph(cut(g.nodes), cut(g.edges)))

    @cached_property
    def projection(self) -> DataFrame:
        return cut(derive.class_projection(self.graph))

    @cached_property
    def index(self) -> DataFrame:
        return cut(search.postings(self.graph.nodes))

    @cached_property
    def all_flows(self) -> DataFrame:
        return cut(flows.flows(self.graph))

    def _ids(self, *ids: str) -> DataFrame:
        return self.graph.nodes.sparkSession.createDataFrame([(i,) for i in ids], "name string")

    def resolve(self, *names: str) -> DataFrame:
        """name, id of what names denote; several ids of one name are candidates."""
        return G.resolve_ids(self._ids(*names), self.graph.nodes)

    def _seeds(self, name: str) -> DataFrame:
        return self.resolve(name).select("id").distinct()

    def get_node(self, name: str) -> DataFrame:
        return self.graph.nodes.join(self._seeds(name), "id", "left_semi")

    def edges_of(self, name: str) -> DataFrame:
        """The telling edges out of and into a node."""
        seeds = self._seeds(name)
        told = G.clean_edges(self.graph)
        return told.join(seeds.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(told.join(seeds.withColumnRenamed("id", "dst"), "dst", "left_semi")).distinct()

    def search(self, text: str, top: int = 20, kinds: list[str] | None = None) -> DataFrame:
        """The ids that hold all words of a text: no tests first, then by exact name, types, and shortness."""
        asked = self._ids(text).select(F.col("name").alias("query"), search.tokens("name").alias("words"))
        index = self.index if kinds is None else self.index.join(self.graph.nodes.where(F.col("kind").isin(*kinds)).select("id"), "id", "left_semi")
        hits = search.ranked(index, asked, 3 * top).join(self.graph.nodes.select("id", "kind", "attrs"), "id")
        exact = F.lower(names.simple_name("id")) == F.lower(F.lit(text.replace(" ", "")))
        return hits.orderBy(G.is_test(), ~exact, ~G.is_code(), F.length("id"), "id").limit(top).select("id", "kind", "score")

    def neighbors(self, name: str, depth: int = 1, least: float = 0.0) -> DataFrame:
        return walk.neighbors(self.graph, self._seeds(name), depth, least)

    def path(self, start: str, end: str, longest: int = 6) -> DataFrame:
        return walk.shortest_path(self.graph, start, end, longest).orderBy("step")

    def impact(self, name: str, depth: int = 3) -> DataFrame:
        """id, distance of what a change of a node or a type with its members reaches."""
        return walk.reach(walk.backwards(self.graph.edges), walk.class_seeds(self.graph, self._seeds(name)), depth)

    def impact_of_changes(self, ranges: DataFrame, depth: int = 3) -> DataFrame:
        """The same for changed lines (file, first, last)."""
        return walk.reach(walk.backwards(self.graph.edges), walk.changed_members(self.graph, ranges), depth)

    def tests_to_run(self, affected: DataFrame) -> DataFrame:
        """The tests for what impact gave."""
        return walk.tests_of(self.graph, affected.where("distance > 0"), affected.where("distance = 0"))

    def communities(self) -> DataFrame:
        return kernels.communities(self.projection)

    def flow(self, entry: str) -> DataFrame:
        """Flows by the id or the end of the label of their entry."""
        return self.all_flows.where((F.col("entry") == entry) | F.endswith("label", F.lit(entry)))

    def _listing(self, kind: str, prefix: str) -> DataFrame:
        name = F.regexp_replace("id", "^[a-z]+:", "")
        return self.graph.nodes.where(F.col("kind") == kind).where(F.startswith(name, F.lit(prefix)) | F.startswith(F.substring_index(name, " ", -1), F.lit(prefix)))

    def routes(self, prefix: str = "") -> DataFrame:
        handlers = self.graph.edges.where("kind = 'HANDLES_ROUTE'").select(F.col("dst").alias("id"), F.col("src").alias("handler"))
        return self._listing("HTTP_ROUTE", prefix).select("id", "fqn", "signature").join(handlers, "id", "left")

    def topics(self) -> DataFrame:
        ends = self.graph.edges.where("kind in ('PRODUCES_TO', 'CONSUMES_FROM')").select(F.col("dst").alias("id"), "kind", "src")
        return self._listing("MESSAGE_TOPIC", "").select("id").join(ends, "id", "left")

    def config(self, prefix: str = "") -> DataFrame:
        bound = self.graph.edges.where("kind = 'BINDS_CONFIG'").select(F.col("dst").alias("id"), F.col("src").alias("bound_by"))
        return self._listing("CONFIG_KEY", prefix).select("id", G.attr("value").alias("value")).join(bound, "id", "left")

    def beans(self, type_: str = "") -> DataFrame:
        provided = self.graph.edges.where("kind = 'PROVIDES_BEAN'").select(F.col("dst").alias("id"), owner("src").alias("provider"))
        return self.graph.nodes.where("kind = 'BEAN'").select("id").join(provided, "id", "left").where(F.contains(F.coalesce("provider", "id"), F.lit(type_)))

    def dependencies(self, module: str) -> DataFrame:
        return self.graph.edges.where(F.col("kind") == "DEPENDS_ON_ARTIFACT").where(F.col("src") == module).select(F.col("dst").alias("artifact"))

    def findings(self) -> DataFrame:
        """kind, subject, about of layer violations, rings of packages, version conflicts, dead classes and dead members."""
        g = self.graph
        bad = derive.layer_violations(self.projection, derive.layers(g, self.projection)).select(F.lit("layer-violation").alias("kind"), F.col("src").alias("subject"), F.col("dst").alias("about"))
        rings = derive.cyclic_packages(g, self.projection).select(F.lit("cyclic-packages").alias("kind"), F.col("id").alias("subject"), F.col("component").alias("about"))
        versions = derive.version_conflicts(g).select(F.lit("version-conflict").alias("kind"), F.col("src").alias("subject"), F.concat_ws(" ", "name", "versions").alias("about"))
        refs = cut(derive.live_references(g, derive.generated_members(g)))
        classes = cut(derive.dead_classes(g, refs))
        dead = classes.select(F.lit("dead-code").alias("kind"), F.col("id").alias("subject"), F.col("via").alias("about"))
        members = derive.dead_members(g, refs, classes).select(F.lit("dead-code").alias("kind"), F.col("id").alias("subject"), F.col("implements").alias("about"))
        return bad.unionByName(rings).unionByName(versions).unionByName(dead).unionByName(members)

    def overview(self) -> DataFrame:
        return self.graph.nodes.where("module is not null").groupBy("module", "kind").agg(F.count("*").alias("n"))

    def compare(self, base: CodeGraph, depth: int = 3) -> tuple[DataFrame, DataFrame]:
        """What changed since base, and what that reaches."""
        changed = cut(diff.changes(base.graph, self.graph))
        return changed, diff.affected(base.graph, self.graph, changed, depth)

    def diff_report(self, base: CodeGraph, depth: int = 3, top: int = 40) -> str:
        """A page on what changed since base: how much, what, what it reaches with the flows it touches, the tests to run, and findings before and after; of each list
        the first top."""
        changed, reached = self.compare(base, depth)
        reached = cut(reached)
        seeds = changed.where("what <> 'added'").select("id")
        tests = cut(walk.tests_of(self.graph, reached.select("id"), seeds))
        ids = seeds.union(reached.select("id")).distinct()
        flows = self.all_flows.select("label", F.explode("steps.id").alias("id")).join(ids, "id", "left_semi").groupBy("label").agg(F.count("*").alias("n"))
        counts = {r["what"]: r["n"] for r in changed.groupBy(F.when(F.col("what").isin("added", "removed"), F.col("what")).otherwise("changed").alias("what")).agg(F.count("*").alias("n")).collect()}
        if not counts:
            return "# Changes\n\nNothing changed.\n"
        out = ["# Changes", "", "| added | removed | changed | reached | tests |", "|---|---|---|---|---|", f"| {counts.get('added', 0)} | {counts.get('removed', 0)} | {counts.get('changed', 0)} | {reached.count()} | {tests.count()} |"]

        def part(title: str, df: DataFrame, line) -> None:
            rows, n = df.limit(top).collect(), df.count()
            if n:
                out.extend(["", f"## {title} ({n})", "", *(line(r) for r in rows), *([f"- ... and {n - top} more"] if n > top else [])])

        for title, these in (("Removed", "what = 'removed'"), ("Changed", "what not in ('added', 'removed')"), ("Added", "what = 'added'")):
            part(title, changed.where(these).orderBy("id"), lambda r: f"- `{r['id']}` {r['kind'].lower()}: {r['what']}")
        part("Reached", reached.orderBy("distance", "id"), lambda r: f"- `{r['id']}` (distance {r['distance']})")
        part("Flows touched", flows.orderBy(F.desc("n"), "label"), lambda r: f"- {r['label']} ({r['n']})")
        part("Tests to run", tests.orderBy("id"), lambda r: f"- `{r['id']}`")
        return "\n".join([*out, "", f"Findings: {base.findings().count()} before, {self.findings().count()} after"]) + "\n"

    def report(self, top: int = 25) -> str:
        """A page on the graph: sizes, what most depends on, findings; of each list the first few."""
        part = lambda title, df, line: [f"\n## {title}\n", *(line(r) for r in df.limit(top).collect())]
        sizes = self.graph.nodes.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")
        gods = derive.god_classes(self.graph, derive.in_degrees(self.projection), top)
        out = ["# Code graph", *part("Nodes", sizes, lambda r: f"- {r['kind']}: {r['n']}"), *part("Most depended on", gods, lambda r: f"- `{r['id']}` by {r['n']} classes")]
        for kind in ("layer-violation", "cyclic-packages", "version-conflict", "dead-code"):
            out += part(kind, self.findings().where(F.col("kind") == kind).orderBy("subject", "about"), lambda r: f"- `{r['subject']}`" + (f" ({r['about']})" if r["about"] else ""))
        return "\n".join(out) + "\n"


def fitted(lists: dict[str, DataFrame], budget: int, order: list[str]) -> str:
    """Several results as one JSON text of at most budget tokens (four characters each) and a tenth: of each list as many entries as fit, with the number left out.

    One entry more than the longest rung is read of each list; the counts come from Spark."""
    read = {k: [r.asDict(recursive=True) for r in df.orderBy(*[c for c in order if c in df.columns]).limit(LADDER[0]).collect()] for k, df in lists.items()}
    sizes = {k: df.count() for k, df in lists.items()}
    for rung in LADDER:
        answer = {k: rows[:rung] for k, rows in read.items()}
        answer["omitted"] = {k: sizes[k] - len(answer[k]) for k in lists if sizes[k] > len(answer[k])}
        text = json.dumps(answer, ensure_ascii=False, default=str)
        if len(text) // 4 <= budget * 1.1:
            break
    return text
