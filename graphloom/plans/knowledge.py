"""Flows, centrality, communities, versions and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import cut, last_snapshot, snapshots, table
from graphloom.functions.names import owner
from graphloom.operators import derive as D
from graphloom.operators import diff as X
from graphloom.operators import flows as L
from graphloom.operators import graph as G
from graphloom.operators import kernels as K
from graphloom.plans import sql
from graphloom.plans.walks import ORACLE as _WALKS


def flow_entries(spark: SparkSession, d: str) -> DataFrame:
    return L.entries(G.load(spark, d))


def flows(spark: SparkSession, d: str) -> DataFrame:
    """The steps of every flow in their order."""
    return L.flows(G.load(spark, d)).select("entry", F.posexplode("steps").alias("at", "s")).select("entry", "at", "s.id", "s.depth", "s.via")


def flow_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Each flow as a line: its label, its first six steps and how many there are."""
    short = lambda s: F.substring_index(F.substring_index(s["id"], "(", 1), ".", -1)
    return L.flows(G.load(spark, d)).select("entry", "entry_kind", F.size("steps").alias("n_steps"), F.concat_ws(": ", "label", F.array_join(F.transform(F.slice("steps", 1, 6), short), " -> ")).alias("summary"))


def betweenness(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return K.betweenness(cut(D.class_projection(g)), D.classes(g).select("id")).withColumn("betweenness", F.round("betweenness", 3))


def god_scores(spark: SparkSession, d: str) -> DataFrame:
    """Dependents and betweenness of each class, each by its greatest, added up."""
    g = G.load(spark, d)
    projection = cut(D.class_projection(g))
    scored = K.betweenness(projection, D.classes(g).select("id")).join(D.in_degrees(projection), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = scored.agg(F.greatest(F.max("n"), F.lit(1)).alias("_n"), F.greatest(F.max("betweenness"), F.lit(1e-9)).alias("_b"))
    return scored.crossJoin(F.broadcast(most)).select("id", "n", F.round(F.col("n") / F.col("_n") + F.col("betweenness") / F.col("_b"), 6).alias("score"))  # one row of maxima


def communities(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return K.communities(cut(D.class_projection(g)), D.classes(g).select("id"))


def community_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each community with a name for people, its size and the one above it."""
    return K.labelled(communities(spark, d))


def _versions(spark: SparkSession, d: str) -> tuple[G.Graph, G.Graph]:
    snaps = snapshots(spark, d) or [-1]
    return G.load(spark, d, snaps[0]), G.load(spark, d, snaps[-1])


def version_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed in the graph from the first snapshot to the last."""
    return X.changes(*_versions(spark, d))


def version_affected(spark: SparkSession, d: str) -> DataFrame:
    base, head = _versions(spark, d)
    return X.affected(base, head, cut(X.changes(base, head)))


def overview(spark: SparkSession, d: str) -> DataFrame:
    """What each module holds: nodes, types, tests and its health."""
    n = G.load(spark, d).nodes.where("module is not null")
    meta = table(spark, d, "meta").where((F.col("snap_no") == last_snapshot(spark, d)) & F.startswith("key", F.lit("health:")))
    health = meta.groupBy(F.substr("key", F.lit(8)).alias("module")).agg(F.max(F.lower("value")).alias("health"))
    return n.groupBy("module").agg(F.count("*").alias("n"), F.sum(G.is_code().cast("int")).alias("n_types"), F.sum(G.is_test().cast("int")).alias("n_tests")).join(health, "module", "left")


def _listed(g: G.Graph, kind: str, edge: str, name: str) -> DataFrame:
    """The nodes of a kind with the sources of edges into them in one line."""
    into = g.edges.where(F.col("kind") == edge).groupBy(F.col("dst").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("src")), "; ").alias(name))
    return g.nodes.where(F.col("kind") == kind).select("id", "fqn").join(into, "id", "left").withColumn(name, F.coalesce(name, F.lit("")))


def routes(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    access = g.nodes.where("kind = 'HTTP_ROUTE'").select("id", "signature")
    return _listed(g, "HTTP_ROUTE", "HANDLES_ROUTE", "handlers").join(access, "id")


def topics(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return _listed(g, "MESSAGE_TOPIC", "PRODUCES_TO", "producers").join(_listed(g, "MESSAGE_TOPIC", "CONSUMES_FROM", "consumers").select("id", "consumers"), "id")


def config_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys with their value and what binds them; a key that nothing binds has none."""
    g = G.load(spark, d)
    return _listed(g, "CONFIG_KEY", "BINDS_CONFIG", "bound_by").join(g.nodes.where("kind = 'CONFIG_KEY'").select("id", G.attr("value").alias("value")), "id")


def beans(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return _listed(g, "BEAN", "PROVIDES_BEAN", "provided_by").join(_listed(g, "BEAN", "INJECTS", "injected_into").select("id", "injected_into"), "id")


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """What modules depend on, and whether the project builds it itself."""
    g = G.load(spark, d)
    origin = g.nodes.where("kind = 'ARTIFACT'").select(F.col("id").alias("artifact"), (F.col("origin") != "EXTERNAL").alias("internal"))
    deps = g.edges.where("kind = 'DEPENDS_ON_ARTIFACT'").select(F.col("src").alias("module"), F.col("dst").alias("artifact"))
    return deps.join(origin, "artifact", "left").select("module", "artifact", F.coalesce("internal", F.lit(False)).alias("internal"))


def injections(spark: SparkSession, d: str) -> DataFrame:
    """What each injected bean comes down to: its providers, each with its share of confidence."""
    g = G.load(spark, d)
    providers = g.edges.where("kind = 'PROVIDES_BEAN'").select(F.col("dst").alias("bean"), owner("src").alias("provider")).distinct()
    counted = providers.join(providers.groupBy("bean").agg(F.count("*").alias("n")), "bean")
    return g.edges.where("kind = 'INJECTS'").select("src", F.col("dst").alias("bean")).distinct().join(counted, "bean").select("src", "bean", "provider", F.round(1 / F.col("n"), 6).alias("confidence"))


def self_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls inside one class to a member with an annotation of its own, which no proxy sees."""
    g = G.load(spark, d)
    noted = g.nodes.where("kind = 'METHOD'").where(F.coalesce(F.size(F.json_object_keys(G.attr("annotations"))), F.lit(0)) > 0).select(F.col("id").alias("dst"))
    return g.edges.where("kind = 'CALLS' and src <> dst").where(owner("src") == owner("dst")).join(noted, "dst", "left_semi").select("src", "dst", "line")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """All findings of the graph: layer violations, package rings, version conflicts, untested god classes, dead classes and dead members, by kind and subject; id is the node that a HAS_FINDING edge from the
    subject leads to."""
    g = G.load(spark, d)
    projection = cut(D.class_projection(g))
    layer = D.layers(g, projection)
    refs = cut(D.live_references(g, D.generated_members(g)))
    dead = cut(D.dead_classes(g, refs))
    row = lambda df, kind, severity, subject: df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col(subject).alias("subject"))
    return (
        row(D.layer_violations(projection, layer), "layer-violation", "warning", "src")
        .unionByName(row(D.cyclic_packages(g, projection).where("id = component"), "cyclic-packages", "warning", "id"))
        .unionByName(row(D.version_conflicts(g), "version-conflict", "info", "src"))
        .unionByName(row(D.untested_gods(g, D.in_degrees(projection)), "untested-god-node", "info", "id"))
        .unionByName(row(dead, "dead-code", "info", "id"))
        .unionByName(D.dead_members(g, refs, dead).select(F.lit("dead-code").alias("kind"), "severity", F.col("id").alias("subject")))
        .groupBy("kind", "severity", "subject").agg(F.count("*").alias("n")).select(F.concat(F.lit("finding:"), "kind", F.lit(":"), "subject").alias("id"), "kind", "severity", "subject", "n")
    )


def graph_rows(spark: SparkSession, d: str) -> DataFrame:
    """The whole graph as lines of JSON, nodes and edges with all they hold, as an export has them; edges go without their line."""
    g = G.load(spark, d)
    attrs = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>")))))
    whole = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"}).alias("json")
    nodes = g.nodes.select(F.lit("node").alias("tab"), F.col("id").alias("key"), whole("id", "kind", "fqn", "origin", "signature", "file", "start_line", "end_line", "doc", "sha", "module", "artifact", attrs.alias("attrs")))
    edges = g.edges.select(F.lit("edge").alias("tab"), F.concat_ws(" ", "src", "dst", "kind").alias("key"), whole("src", "dst", "kind", "resolution", "confidence"))
    return nodes.unionByName(edges)


QUERIES = {f.__name__: f for f in (flow_entries, flows, flow_summaries, betweenness, god_scores, communities, community_labels, version_changes, version_affected, overview, routes, topics, config_keys, beans, dependencies, injections, self_calls, findings, graph_rows)}

_G = f"with recursive {sql.graph()}"
_LIST = "coalesce((select string_agg(distinct src, '; ' order by src) from e where e.kind = '{1}' and e.dst = {0}.id), '') as {2}"
_SHORT = "replace(regexp_extract(split_part(id, '#', 1), '[^.]*$'), '$', '.') || '.' || split_part(regexp_extract(id, '[^#]*$'), '(', 1)"


def _side(n: str, e: str, name: str) -> str:
    return f"""{name}c as (select src, string_agg(dst, '|' order by dst) as calls from {e} where kind = 'CALLS' group by src), {name} as (select {n}.id, kind, lower(trim(sha, E' \\t\\r\\n\\f\\v')) as sha, signature,
        coalesce(array_to_string(list_sort(list_transform(list_filter(map_entries(attrs), lambda x: x.key <> 'handler'), lambda x: x.key || '=' || coalesce(x.value, ''))), '; '), '') as attrs, c.calls
        from {n} left join {name}c c on c.src = {n}.id where kind in {X.COMPARED} and origin = 'REPO' and not {sql.TEST.format('')})"""


_DIFF = f"""with recursive {sql.graph('(select min(snap_no) from snaps)', 'bn', 'be')}, {sql.graph()}, {_side('bn', 'be', 'bc')}, {_side('n', 'e', 'hc')},
    ch as (select coalesce(hc.id, bc.id) as id, coalesce(hc.kind, bc.kind) as kind, case when bc.id is null then 'added' when hc.id is null then 'removed'
        when hc.kind in {X.WIRING} then case when hc.attrs <> bc.attrs then 'attributes changed' end when hc.sha is not null and bc.sha is not null then case when hc.sha <> bc.sha then 'body changed' end
        when hc.signature is distinct from bc.signature then 'signature changed' when hc.calls is distinct from bc.calls then 'calls changed' end as what from hc full join bc on bc.id = hc.id)"""

_ATTRS = "map_from_entries(list_sort(map_entries(coalesce(attrs, map {}))))"
ORACLE = {
    "graph_rows": f"{_G} select 'node' as tab, id as key, to_json({{'id': id, 'kind': kind, 'fqn': fqn, 'origin': origin, 'signature': signature, 'file': file, 'start_line': start_line, 'end_line': end_line, 'doc': doc, 'sha': sha, 'module': module, 'artifact': artifact, 'attrs': {_ATTRS}}})::varchar as json from n "
    "union all select 'edge', src || ' ' || dst || ' ' || kind, to_json({'src': src, 'dst': dst, 'kind': kind, 'resolution': resolution, 'confidence': confidence})::varchar from e",
    "flow_entries": f"""{_G}, x as (select src as id, 0 as rank, n.fqn as label from e join n on n.id = e.dst where e.kind = 'HANDLES_ROUTE' and coalesce(n.attrs['remote'] <> 'true', true) union all select src, 1, 'consume ' || n.fqn from e join n on n.id = e.dst where e.kind = 'CONSUMES_FROM'
        union all select dst, 2, 'scheduled ' || {_SHORT.replace('id', 'dst')} from e where kind = 'CALLS' and src like 'job:%' union all select id, 3, 'main ' || {_SHORT} from n where kind = 'METHOD' and origin = 'REPO' and id like '%#main(java.lang.String[])' and not {sql.TEST.format('')})
        select id, (['route','consumer','job','main'])[rank + 1] as entry_kind, label from x where id in (select id from n) qualify row_number() over (partition by id order by rank, label) = 1""",
    "version_changes": f"{_DIFF} select * from ch where what is not null",
    "version_affected": f"""{_DIFF}, seeds as (select id from ch where what is not null and what <> 'added'), back as (select distinct dst as src, src as dst from e where kind in {X.REACHED} and dst in (select id from n) union select dst, src from be where kind in {X.REACHED} and dst not in (select id from n)),
        r as (select id, 0 as d from seeds union select b.dst, r.d + 1 from r join back b on b.src = r.id where r.d < 3), near as (select id, min(d) as distance from r group by id) select * from near where distance > 0""",
    "overview": f"""{_G}, h as (select substr(key, 8) as module, max(lower(value)) as health from meta where snap_no = (select max(snap_no) from snaps) and starts_with(key, 'health:') group by 1)
        select n.module, count(*) as n, sum((kind in {sql.CODE})::int)::bigint as n_types, sum({sql.TEST.format('')}::int)::bigint as n_tests, any_value(h.health) as health from n left join h using (module) where n.module is not null group by n.module""",
    "routes": f"{_G} select id, fqn, {_LIST.format('n', 'HANDLES_ROUTE', 'handlers')}, signature from n where kind = 'HTTP_ROUTE'",
    "topics": f"{_G} select id, fqn, {_LIST.format('n', 'PRODUCES_TO', 'producers')}, {_LIST.format('n', 'CONSUMES_FROM', 'consumers')} from n where kind = 'MESSAGE_TOPIC'",
    "config_keys": f"{_G} select id, fqn, {_LIST.format('n', 'BINDS_CONFIG', 'bound_by')}, attrs['value'] as value from n where kind = 'CONFIG_KEY'",
    "beans": f"{_G} select id, fqn, {_LIST.format('n', 'PROVIDES_BEAN', 'provided_by')}, {_LIST.format('n', 'INJECTS', 'injected_into')} from n where kind = 'BEAN'",
    "dependencies": f"{_G} select e.src as module, e.dst as artifact, coalesce(n.origin <> 'EXTERNAL', false) as internal from e left join n on n.id = e.dst and n.kind = 'ARTIFACT' where e.kind = 'DEPENDS_ON_ARTIFACT'",
    "injections": f"{_G}, p as (select distinct dst as bean, split_part(src, '#', 1) as provider from e where kind = 'PROVIDES_BEAN'), k as (select *, count(*) over (partition by bean) as c from p) select distinct e.src, bean, provider, round(1.0::double / c, 6) as confidence from e join k on k.bean = e.dst where e.kind = 'INJECTS'",
    "self_calls": f"{_G} select e.src, e.dst, e.line from e join n on n.id = e.dst where e.kind = 'CALLS' and e.src <> e.dst and split_part(e.src, '#', 1) = split_part(e.dst, '#', 1) and n.kind = 'METHOD' and len(json_keys(n.attrs['annotations']::json)) > 0",
    "findings": "select 'finding:' || kind || ':' || subject as id, kind, severity, subject, count(*) as n from ("
    f"select 'layer-violation' as kind, 'warning' as severity, src as subject from ({_WALKS['layer_violations']}) union all select 'cyclic-packages', 'warning', id from ({_WALKS['package_rings']}) where id = component "
    f"union all select 'version-conflict', 'info', src from ({_WALKS['version_conflicts']}) union all select 'untested-god-node', 'info', id from ({_WALKS['untested_gods']}) union all select 'dead-code', 'info', id from ({_WALKS['dead_classes']}) union all select 'dead-code', severity, id from ({_WALKS['dead_members']})) group by all",
}
