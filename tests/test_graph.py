"""Operators of the graph on a small project made by hand."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.common import cut, cut_measured
from graphloom.operators import derive as D
from graphloom.operators import diff as X
from graphloom.operators import flows as L
from graphloom.operators import graph as G
from graphloom.operators import kernels as K
from graphloom.operators import search as S
from graphloom.operators import walk as W
from graphloom.operators import wiring as V
from tests.conftest import DATA

NODE = "id string, kind string, fqn string, origin string, signature string, file string, start_line int, end_line int, doc string, sha string, module string, artifact string, attrs map<string,string>"
EDGE = "src string, dst string, kind string, resolution string, confidence double, line int"


def node(id_, kind="METHOD", origin="REPO", signature=None, lines=(10, 20), attrs=None, module="app", sha=None):
    return (id_, kind, id_, origin, signature, "/repo/A.java", *lines, None, sha, module, None, attrs or {})


def edge(src, dst, kind="CALLS", confidence=1.0, resolution="EXACT"):
    return (src, dst, kind, resolution, confidence, None)


@pytest.fixture(scope="module")
def project(spark):
    """A weather station: sensors behind an interface, readings in a store, an alarm that goes over a topic, and what nobody uses any more."""
    note = lambda name: {"annotations": f'{{"{name}": {{}}}}'}
    types = {"wx.api.StationController": "CLASS", "wx.core.ReadingService": "CLASS", "wx.data.ReadingStore": "CLASS", "wx.core.Reading": "RECORD", "wx.sensor.Probe": "INTERFACE", "wx.sensor.Thermo": "CLASS", "wx.sensor.FieldThermo": "CLASS",
             "wx.alarm.AlarmLoop": "CLASS", "wx.alarm.Bell": "INTERFACE", "wx.old.PaperTape": "CLASS", "wx.old.TapeHole": "CLASS"}
    nodes = [node(c, k, signature=f"{k.lower()} {c}", lines=(1, 90)) for c, k in types.items()]
    nodes += [node("wx.core.ReadingServiceIT", "CLASS", attrs={"test": "true"}), node("wx.alarm.Siren", "CLASS", attrs=note("org.springframework.stereotype.Component")), node("wx.sensor.Gauge", "CLASS", attrs=note("org.springframework.cloud.openfeign.FeignClient"))]
    methods = ["wx.api.StationController#show(long)", "wx.api.StationController#drop(long)", "wx.core.ReadingService#latest(long)", "wx.core.ReadingService#prune()", "wx.core.ReadingService#getLimit()", "wx.data.ReadingStore#load(long)", "wx.data.ReadingStore#erase()",
               "wx.data.ReadingStore#flush()", "wx.sensor.Probe#sample()", "wx.sensor.Thermo#sample()", "wx.sensor.FieldThermo#sample()", "wx.sensor.Gauge#sample()", "wx.alarm.AlarmLoop#tick()", "wx.alarm.Siren#blow()", "wx.alarm.Bell#ring()", "wx.alarm.Siren#ring()", "wx.core.Reading#celsius()"]
    nodes += [node(m, signature=f"public void {m}", lines=(10 * k + 11, 10 * k + 15)) for k, m in enumerate(methods)] + [node("wx.data.ReadingStore#compact()", signature="private void compact()", lines=(300, 310))]
    fields = {"wx.core.ReadingService#LIMIT": "private static final LIMIT: int", "wx.core.ReadingService#log": "private static final log: org.slf4j.Logger", "wx.core.ReadingService#limit": "private limit: int"}
    nodes += [node(f, "FIELD", signature=x, lines=(k + 2, k + 2)) for k, (f, x) in enumerate(fields.items())] + [node("wx.core.ReadingService#setLimit(int)", signature="public void setLimit(int)", lines=(4, 4))]
    nodes += [node("wx.core.ReadingServiceIT#latestIsFresh()", attrs={"test": "true"}), node("route:GET /stations/{id}", "HTTP_ROUTE"), node("route:DELETE /stations/{id}", "HTTP_ROUTE"), node("lib.Print#line()", origin="EXTERNAL"), node("topic:alarms", "MESSAGE_TOPIC")]
    held = [*methods, *fields, "wx.data.ReadingStore#compact()", "wx.core.ReadingService#setLimit(int)", "wx.core.ReadingServiceIT#latestIsFresh()"]
    edges = [edge(m.split("#")[0], m, "CONTAINS") for m in held]
    edges += [
        edge("wx.api.StationController#show(long)", "route:GET /stations/{id}", "HANDLES_ROUTE"), edge("wx.api.StationController#drop(long)", "route:DELETE /stations/{id}", "HANDLES_ROUTE"), edge("wx.api.StationController#show(long)", "wx.core.ReadingService#latest(long)"),
        edge("wx.api.StationController#drop(long)", "wx.core.ReadingService#prune()"), edge("wx.core.ReadingService#latest(long)", "wx.data.ReadingStore#load(long)"), edge("wx.core.ReadingService#latest(long)", "wx.core.Reading#celsius()"), edge("wx.core.ReadingService#prune()", "wx.data.ReadingStore#erase()"),
        edge("wx.core.ReadingService#prune()", "lib.Print#line()"), edge("wx.core.ReadingService#prune()", "wx.alarm.AlarmLoop#tick()"), edge("wx.data.ReadingStore#load(long)", "wx.sensor.Probe#sample()"), edge("wx.data.ReadingStore#erase()", "wx.core.ReadingService#latest(long)"),
        edge("wx.core.ReadingServiceIT#latestIsFresh()", "wx.core.ReadingService#latest(long)"), edge("wx.core.ReadingServiceIT#latestIsFresh()", "wx.data.ReadingStore#flush()"), edge("wx.core.ReadingService#setLimit(int)", "wx.data.ReadingStore#compact()"),
        edge("wx.sensor.Thermo", "wx.sensor.Probe", "IMPLEMENTS"), edge("wx.sensor.FieldThermo", "wx.sensor.Thermo", "EXTENDS"), edge("wx.sensor.Gauge", "wx.sensor.Probe", "IMPLEMENTS"), edge("wx.alarm.Siren", "wx.alarm.Bell", "IMPLEMENTS"), edge("wx.alarm.Siren#ring()", "wx.alarm.Bell#ring()", "OVERRIDES"),
        edge("wx.old.PaperTape", "wx.old.TapeHole", "USES_TYPE"), edge("wx.alarm.AlarmLoop#tick()", "topic:alarms", "PRODUCES_TO"), edge("wx.alarm.Siren#blow()", "topic:alarms", "CONSUMES_FROM"), edge("route:GET /stations/{id}", "x", "MENTIONS"),
    ]
    return G.Graph(spark.createDataFrame(nodes, NODE).cache(), spark.createDataFrame(edges, EDGE).cache())


def pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_reach_and_path(spark, project):
    seeds = spark.createDataFrame([("wx.data.ReadingStore#load(long)",)], "id string")
    near = dict(pairs(W.reach(W.backwards(project.edges), seeds, 3), "id", "distance"))
    assert near == {"wx.data.ReadingStore#load(long)": 0, "wx.core.ReadingService#latest(long)": 1, "wx.api.StationController#show(long)": 2, "wx.core.ReadingServiceIT#latestIsFresh()": 2, "wx.data.ReadingStore#erase()": 2, "wx.core.ReadingService#prune()": 3}
    tests = W.tests_of(project, spark.createDataFrame([(x,) for x in near], "id string"), seeds)
    assert pairs(tests, "id") == {("wx.core.ReadingServiceIT",)}
    steps = W.shortest_path(project, "wx.api.StationController", "wx.sensor.Probe#sample()").orderBy("step").collect()
    assert [r["dst"] for r in steps] == ["wx.api.StationController#show(long)", "wx.core.ReadingService#latest(long)", "wx.data.ReadingStore#load(long)", "wx.sensor.Probe#sample()"]
    assert W.shortest_path(project, "wx.old.TapeHole", "wx.sensor.Probe#sample()").count() == 0


def test_changed_members(spark, project):
    nodes = spark.createDataFrame([("p.A", "CLASS", "A", 1, 900), ("p.A#m()", "METHOD", "A", 95, 305), ("p.A#n()", "METHOD", "A", 306, 306), ("p.B", "CLASS", "B", 1, 9), ("p.A#x", "FIELD", None, 1, 1)], "id string, kind string, file string, start_line int, end_line int")
    g = G.Graph(nodes, project.edges)
    changed = lambda *r: pairs(W.changed_members(g, spark.createDataFrame(list(r), "file string, first int, last int")), "id")
    assert changed(("A", 200, 200)) == {("p.A#m()",)} and changed(("A", 305, 400)) == {("p.A#m()",), ("p.A#n()",)} and changed(("A", 700, 100_000), ("B", 3, 2), (None, 1, 1), ("A", None, 5)) == {("p.A",), ("p.B",)}


def test_dispatch_and_overrides(project):
    bodies = {f"wx.sensor.{c}#sample()" for c in ("Thermo", "FieldThermo", "Gauge")}
    assert {(s, d, round(c, 6)) for s, d, c in pairs(W.dispatches(project), "src", "dst", "confidence")} == {("wx.data.ReadingStore#load(long)", b, round(1 / 3, 6)) for b in bodies}
    above = {(b, "wx.sensor.Probe#sample()") for b in bodies} | {("wx.sensor.FieldThermo#sample()", "wx.sensor.Thermo#sample()"), ("wx.alarm.Siren#ring()", "wx.alarm.Bell#ring()")}
    assert pairs(W.overridden(project), "src", "dst") == above


def test_derived(project):
    projection = D.class_projection(project)
    assert ("wx.api.StationController", "wx.core.ReadingService", 2.0) in pairs(projection, "src", "dst", "weight")
    layer = dict(pairs(D.layers(project, projection), "id", "layer"))
    assert {c.split(".")[-1]: layer[c] for c in layer} == {
        "StationController": "controller", "ReadingService": "service", "ReadingStore": "repository", "Reading": "model", "Probe": None, "Thermo": None, "FieldThermo": None, "AlarmLoop": None, "Bell": None, "PaperTape": None, "TapeHole": "model", "Siren": "service", "Gauge": "client"}
    assert pairs(D.layer_violations(projection, D.layers(project, projection)), "src", "dst", "src_layer", "dst_layer") == {("wx.data.ReadingStore", "wx.core.ReadingService", "repository", "service")}
    assert pairs(D.cyclic_packages(project, projection), "id", "component") == {("wx.core", "wx.core"), ("wx.data", "wx.core")}
    assert ("wx.core.ReadingServiceIT", "wx.core.ReadingService", "EXACT") in pairs(D.test_links(project), "src", "dst", "resolution")


def test_layers_by_annotation_and_supertype(spark, project):
    noted = {"a.Plain": "org.springframework.stereotype.Repository", "a.MyService": "jakarta.ws.rs.Path", "a.XController": "jakarta.persistence.Entity", "a.YStore": "org.springframework.stereotype.Component", "a.Bare": "org.springframework.stereotype.Component"}
    nodes = [node(c, "CLASS", attrs={"annotations": f'{{"{a}": {{"value": "x"}}}}'}) for c, a in noted.items()] + [node("a.Rows", "INTERFACE"), node("a.Broken", "CLASS", attrs={"annotations": "no json"})]
    g = G.Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame([edge("a.Rows", "org.springframework.data.jpa.JpaRepository", "EXTENDS")], EDGE))
    layer = dict(pairs(D.layers(g, D.class_projection(g)), "id", "layer"))
    assert layer == {"a.Plain": "repository", "a.MyService": "controller", "a.XController": "model", "a.YStore": "repository", "a.Bare": "service", "a.Rows": "repository", "a.Broken": "model"}


def test_dead_code(project):
    dead = dict(pairs(D.dead_classes(project), "id", "via"))
    assert dead == {"wx.old.PaperTape": None, "wx.old.TapeHole": "wx.old.PaperTape", "wx.sensor.FieldThermo": None, "wx.sensor.Thermo": "wx.sensor.FieldThermo", "wx.sensor.Gauge": None}
    assert pairs(D.generated_members(project), "id") == {("wx.core.ReadingService#setLimit(int)",)}
    assert pairs(D.dead_members(project), "id", "what", "severity", "tested", "implements") == {
        ("wx.core.ReadingService#LIMIT", "field", "info", False, None), ("wx.data.ReadingStore#compact()", "method", "warning", False, None), ("wx.data.ReadingStore#flush()", "method", "info", True, None),
        ("wx.alarm.Siren#ring()", "method", "info", False, "wx.alarm.Bell#ring()")}


def test_words_of_annotations(spark):
    nodes = [("a.B#c()", "a.B#c()", {"annotations": '{"x.PreAuthorize": {"value": "hasRole(ADMIN)"}, "y.Note": {}}'}, "int c()", None), ("a.D", "a.D", {"annotations": "broken"}, None, None)]
    found = pairs(S.postings(spark.createDataFrame(nodes, "id string, fqn string, attrs map<string,string>, signature string, doc string")), "id", "term", "tf")
    assert {("a.B#c()", t, 1) for t in ("authorize", "pre", "role", "hasrole", "preauthorize")} <= found and {("a.B#c()", "admin", 2), ("a.B#c()", "note", 2), ("a.D", "d", 1)} <= found


def test_wiring(spark):
    web, ctx, bean = "org.springframework.web.bind.annotation.", "org.springframework.context.annotation.", "org.springframework.beans.factory.annotation."
    at = lambda *pairs_: {"annotations": json.dumps(dict(pairs_))}
    service, auto = "org.springframework.stereotype.Service", bean + "Autowired"
    nodes = [
        node("m.Own", "ANNOTATION", attrs=at((service, {}))), node("p.Ask", "INTERFACE"), node("p.Mail", "CLASS", attrs=at(("m.Own", {}))), node("p.Post", "CLASS", attrs=at((service, {"value": "post"}), (ctx + "Primary", {}))), node("p.Slow", "CLASS", attrs=at((service, {}), (ctx + "Profile", {"value": "dev"}))),
        node("p.URLs", "CLASS", attrs=at((service, {}))), node("p.Conf", "CLASS", attrs=at((ctx + "Configuration", {}))), node("p.Conf#clock()", signature="clock(): java.time.Clock", attrs=at((ctx + "Bean", {"name": "utc,other"}))), node("p.Rows", "INTERFACE"), node("p.BaseRows", "INTERFACE"),
        node("p.Desk", "CLASS", attrs=at((service, {}))), node("p.Desk#<init>(p.Ask,java.util.List<p.Ask>)", "CONSTRUCTOR"), node("p.Desk#rows", "FIELD", signature="private rows: p.Rows", attrs=at((auto, {}))), node("p.Desk#clock", "FIELD", signature="clock: java.time.Clock", attrs=at((auto, {}), (bean + "Qualifier", {"value": "utc"}))),
        node("p.Desk#plain", "FIELD", signature="plain: p.Rows"), node("w.Api", "INTERFACE", attrs=at((web + "RequestMapping", {"value": "/api/"}))), node("w.Api#list()", attrs=at((web + "GetMapping", {"value": "a, /b"}))), node("w.Impl", "CLASS", attrs=at((web + "RestController", {}))), node("w.Impl#list()"), node("w.Impl#other()"),
        node("w.Impl#drop()", attrs=at((web + "RequestMapping", {"path": "x", "method": "DELETE,RequestMethod.PUT"}))), node("w.Impl#tick()", attrs=at(("org.springframework.scheduling.annotation.Scheduled", {"cron": "0 * *"}))), node("w.Impl#hear()", attrs=at(("org.springframework.kafka.annotation.KafkaListener", {"topics": "t1, t2"}))),
    ]
    held = [n[0] for n in nodes if "#" in n[0]]
    edges = [edge(m.split("#")[0], m, "CONTAINS") for m in held] + [edge(c, "p.Ask", "IMPLEMENTS") for c in ("p.Mail", "p.Post", "p.Slow")] + [edge("p.Rows", "p.BaseRows", "EXTENDS"), edge("p.BaseRows", "org.springframework.data.repository.CrudRepository", "EXTENDS"), edge("w.Impl", "w.Api", "IMPLEMENTS")]
    g = G.Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    found = V.beans(g)
    assert pairs(found, "id", "type", "primary", "profile") == {
        ("bean:mail", "p.Mail", False, None), ("bean:post", "p.Post", True, None), ("bean:slow", "p.Slow", False, "dev"), ("bean:URLs", "p.URLs", False, None), ("bean:conf", "p.Conf", False, None), ("bean:utc", "java.time.Clock", False, None),
        ("bean:rows", "p.Rows", False, None), ("bean:baseRows", "p.BaseRows", False, None), ("bean:desk", "p.Desk", False, None), ("bean:impl", "w.Impl", False, None), ("bean:own", "m.Own", False, None)}
    assert pairs(V.injections(g, found), "src", "dst", "resolution", "confidence") == {("p.Desk", f"bean:{b}", "SPRING", 1.0) for b in ("post", "mail", "rows", "utc")}
    assert pairs(V.injections(g, found.withColumn("primary", F.lit(False))), "dst", "confidence") == {("bean:post", 1.0), ("bean:mail", 1.0), ("bean:rows", 1.0), ("bean:utc", 1.0)}  # of a list each is sure
    lone = G.Graph(g.nodes.where("id <> 'p.Desk#<init>(p.Ask,java.util.List<p.Ask>)'").union(spark.createDataFrame([node("p.Desk#<init>(p.Ask)", "CONSTRUCTOR")], NODE)), g.edges.union(spark.createDataFrame([edge("p.Desk", "p.Desk#<init>(p.Ask)", "CONTAINS")], EDGE)))
    assert {("bean:post", "HEURISTIC", 0.5), ("bean:mail", "HEURISTIC", 0.5)} <= pairs(V.injections(lone, found.withColumn("primary", F.lit(False))), "dst", "resolution", "confidence")
    assert pairs(V.routes(g), "handler", "verb", "path") == {("w.Impl#list()", "GET", "/api/a"), ("w.Impl#list()", "GET", "/api/b"), ("w.Impl#drop()", "DELETE", "/api/x"), ("w.Impl#drop()", "PUT", "/api/x")}
    assert pairs(V.jobs(g), "id", "schedule") == {("job:w.Impl#tick()", "0 * *")} and pairs(V.listeners(g), "method", "topic") == {("w.Impl#hear()", "t1"), ("w.Impl#hear()", "t2")}


def test_flows(project):
    found = {r["entry"]: r for r in L.flows(project).collect()}
    flow = found["wx.api.StationController#show(long)"]
    assert (flow["entry_kind"], flow["label"], flow["external"]) == ("route", "route:GET /stations/{id}", [])
    below = [("wx.core.ReadingService#latest(long)", 0), ("wx.core.Reading#celsius()", 1), ("wx.data.ReadingStore#load(long)", 1), ("wx.sensor.Probe#sample()", 2)]
    assert [(s["id"], s["depth"]) for s in flow["steps"]] == [("wx.api.StationController#show(long)", 0), *((i, d + 1) for i, d in below)]
    flow = found["wx.api.StationController#drop(long)"]
    assert flow["external"] == ["lib.Print#line()"] and [(s["id"], s["depth"]) for s in flow["steps"]] == [
        ("wx.api.StationController#drop(long)", 0), ("wx.core.ReadingService#prune()", 1), ("wx.alarm.AlarmLoop#tick()", 2), ("wx.alarm.Siren#blow()", 3), ("wx.data.ReadingStore#erase()", 2), *((i, d + 3) for i, d in below)]


def test_stubs_and_merge(spark, project):
    g = G.Graph(project.nodes, project.edges.union(spark.createDataFrame([edge("wx.core.ReadingService#prune()", "wx.data.ReadingStore#save()"), edge("wx.core.ReadingService#prune()", "lib.Gone#m()")], EDGE)))
    made, held = G.stubs(g)
    assert {("wx.data.ReadingStore#save()", "METHOD", "REPO", True), ("lib.Gone#m()", "METHOD", "EXTERNAL", False), ("lib.Gone", "CLASS", "EXTERNAL", False)} <= pairs(made, "id", "kind", "origin", "inherited")
    assert ("lib.Gone", "lib.Gone#m()") in pairs(held, "src", "dst")
    tiers = spark.createDataFrame([("a", 0, "x", {"p": "1", "q": "1"}), ("a", 2, "y", {"q": "2"}), ("b", 1, None, None)], "id string, tier int, sha string, attrs map<string,string>")
    assert {r["id"]: (r["sha"], r["attrs"]) for r in G.merge_tiers(tiers, "tier").collect()} == {"a": ("y", {"p": "1", "q": "2"}), "b": (None, {})}


def test_changes(spark, project):
    head = G.Graph(project.nodes.where("id <> 'wx.old.TapeHole'").union(spark.createDataFrame([node("wx.core.ReadingService#pause(long)")], NODE)).withColumn("signature", F.when(F.col("id") == "wx.alarm.Siren#blow()", "int blow()").otherwise(F.col("signature"))),
                   project.edges.where("not (src = 'wx.api.StationController#show(long)' and kind = 'CALLS')"))
    assert pairs(X.changes(project, head), "id", "what") == {("wx.core.ReadingService#pause(long)", "added"), ("wx.old.TapeHole", "removed"), ("wx.alarm.Siren#blow()", "signature changed"), ("wx.api.StationController#show(long)", "calls changed")}
    assert X.changes(project, project).count() == 0


def _random_links(seed, n=24, m=40):
    rnd = random.Random(seed)
    return {(f"v{rnd.randrange(n):02}", f"v{rnd.randrange(n):02}") for _ in range(m)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_closure(spark, seed):
    links = _random_links(seed)
    ids = {x for link in links for x in link}
    far = set(links)
    while more := {(a, d) for (a, b), (c, d) in itertools.product(far, links) if b == c} - far:
        far |= more
    df = spark.createDataFrame(sorted(links), "src string, dst string")
    assert pairs(W.closure(df), "src", "dst") == far
    expected = {(v, min([v, *(w for w in ids if (v, w) in far and (w, v) in far)])) for v in ids}
    assert pairs(W.components(df), "id", "component") == expected


def test_betweenness(spark):
    links = {(a, b) for a, b in _random_links(4) if a != b}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = dict.fromkeys(near, 0.0)
    for s in near:
        level, ways, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in sorted(near[v]):
                if w not in level:
                    level[w] = level[v] + 1
                    order.append(w)
                if level[w] == level[v] + 1:
                    ways[w] = ways.get(w, 0) + ways[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if level[v] == level[w] - 1:
                    share[v] += ways[v] / ways[w] * (1 + share[w])
            if w != s:
                expected[w] += share[w] / 2
    df = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(links)], "src string, dst string, weight double")
    found = dict(pairs(K.betweenness(df, spark.createDataFrame([(v,) for v in near], "id string")), "id", "betweenness"))
    assert found.keys() == expected.keys() and all(abs(found[v] - expected[v]) < 1e-6 for v in found)


def test_betweenness_in_blocks_and_by_sample(spark, monkeypatch):
    links = sorted({(min(a, b), max(a, b)) for a, b in _random_links(5) if a != b})
    df = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src string, dst string, weight double")
    ids = spark.createDataFrame([(v,) for v in sorted({x for link in links for x in link})], "id string")
    whole = dict(pairs(K.betweenness(df, ids), "id", "betweenness"))
    monkeypatch.setattr(K, "SOURCES_PER_BLOCK", 5)
    parts = dict(pairs(K.betweenness(df, ids), "id", "betweenness"))
    assert parts.keys() == whole.keys() and all(abs(parts[v] - whole[v]) < 1e-9 for v in whole)
    assert len(dict(pairs(K.betweenness(df, ids, 4), "id", "betweenness"))) == len(whole)


def test_communities(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 2.0) for c in "xyz" for i in range(5) for j in range(i)] + [("x0", "y0", 0.5), ("y1", "z1", 0.5)]
    found = K.communities(spark.createDataFrame(cliques, "src string, dst string, weight double")).collect()
    levels = {n: {r["id"]: r["community"] for r in found if r["level"] == n} for n in range(3)}
    assert levels[0] == {f"{c}{i}": f"{c}0" for c in "xyz" for i in range(5)}
    for lower, upper in ((0, 1), (1, 2)):
        assert len({(levels[lower][v], levels[upper][v]) for v in levels[0]}) == len(set(levels[lower].values()))


def test_communities_of_packages_and_chains(spark):
    links = [(f"p{p}.C{k}", f"p{p}.C{k + 1}", 1.0) for p in range(3) for k in range(3)]
    ids = [(f"p{p}.C{k}",) for p in range(3) for k in range(6)] + [("q.Only",)]  # C4 and C5 have no link but their package's
    found = K.communities(spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame(ids, "id string")).collect()
    assert {(r["id"], r["community"]) for r in found if r["level"] == 0} == {(i, "q.Only" if i == "q.Only" else f"{i[:2]}.C0") for i, in ids}
    chain = [(f"n{k:03}", f"n{k + 1:03}", 1.0) for k in range(120)]
    near, level = {}, {}
    for a, b, _ in chain:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    both = spark.createDataFrame([(a, b, w) for x, y, w in chain for a, b in ((x, y), (y, x))], "src string, dst string, weight double")
    level = dict(pairs(K._moved(both, 1.0), "id", "community"))
    mass = lambda c: sum(len(near[v]) for v in near if level[v] == c)
    gain = lambda v, c: sum(level[w] == c for w in near[v]) - len(near[v]) * (mass(c) - len(near[v]) * (level[v] == c)) / 240
    assert all(gain(v, level[w]) <= gain(v, level[v]) + 1e-8 for v in near for w in near[v])


def test_own_vocabulary(spark):
    nodes = [("a.OrderStore", "CLASS", "REPO", "a.OrderStore"), ("a.OrderStore$Key", "RECORD", None, "a.OrderStore.Key"), ("a.OrderStore#saveOrder(java.lang.String)", "METHOD", "REPO", "x"), ("a.OrderStore#tax", "FIELD", "REPO", "x"),
             ("config:spring.datasource.url", "CONFIG_KEY", "REPO", "spring.datasource.url"), ("route:GET /carts/{id}", "HTTP_ROUTE", "REPO", "GET /carts/{id}"), ("lib.Outside", "CLASS", "EXTERNAL", "lib.Outside"), ("a.Marked", "ANNOTATION", "REPO", "a.Marked")]
    vocab = S.own_vocabulary(spark.createDataFrame(nodes, "id string, kind string, origin string, fqn string"))
    counts = dict(pairs(vocab, "term", "n"))
    assert counts == {"order": 2, "store": 1, "key": 1, "save": 1, "tax": 1, "spring": 1, "datasource": 1, "url": 1, "get": 1, "carts": 1}
    words = ["sourcery", "taxes", "ord", "car", "keyboard", "urn", "storage", "order", "datas", "or"]
    expected = {(w, t) for w in words for t in counts if len(w) > 2 and w != t and (t.startswith(w[:4]) or w.startswith(t[:4]) or (len(w) > 4 and w[:5] in t))}
    assert {("sourcery", "datasource"), ("taxes", "tax"), ("ord", "order")} <= expected
    assert pairs(S.own_nearby(spark.createDataFrame([(w,) for w in words], "word string"), vocab), "word", "term") == expected


def test_sessions_and_recall(spark):
    log = [(1000, " Explain", "where is the order stored"), (1010, "source", "a.OrderRepository"), (1200, "node", "a.Late"), (1201, "explain", "what cancels shipments"), (1202, "SOURCE", "b.Ship"), (1202, "source", "b.Ship"), (None, "source", "x"), (7200, "source", None)]
    entries = S.log_entries(spark.createDataFrame(log, "t long, kind string, arg string"))
    assert pairs(S.sessions(entries), "t", "session") == {(1000, 1000), (1010, 1000), (1200, 1200), (1201, 1200), (1202, 1200)}
    assert pairs(S.fetches(entries), "t", "arg", "question") == {(1010, "a.OrderRepository", "where is the order stored"), (1202, "b.Ship", "what cancels shipments")}
    asked = spark.createDataFrame([("how are orders stored?",), ("nothing alike",), ("",)], "question string")
    assert pairs(S.recall(entries, asked), "question", "arg", "place") == {("how are orders stored?", "a.OrderRepository", 1)}


def test_labels_and_runs(spark):
    found = [("a.b.X", 0, "a.b.X"), ("a.b.Y", 0, "a.b.X"), ("c.Z", 0, "a.b.X"), ("Q", 0, "Q"), ("a.b.X", 1, "Q"), ("a.b.Y", 1, "Q"), ("c.Z", 1, "Q"), ("Q", 1, "Q")]
    labels = K.labelled(spark.createDataFrame(found, "id string, level int, community string"))
    assert pairs(labels, "level", "community", "label", "n", "parent") == {(0, "a.b.X", "a.b (+1 packages)", 3, "Q"), (0, "Q", "(default package)", 1, "Q"), (1, "Q", "a.b (+2 packages)", 4, None)}
    tests = spark.createDataFrame([("p.BTest", "web"), ("p.ATest", "web"), ("p.CTest", None)], "id string, module string")
    assert pairs(W.test_runs(tests, "gradle", True), "command") == {("./gradlew web:test --tests p.ATest --tests p.BTest",), ("./gradlew test --tests p.CTest",)}
    assert pairs(W.test_runs(tests, "maven", True), "command") == {("./mvnw -q test -pl web -Dsurefire.failIfNoSpecifiedTests=false -Dtest=p.ATest,p.BTest",), ("./mvnw -q test -Dtest=p.CTest",)}
    assert pairs(W.test_runs(tests, "maven", False), "module", "command") == {("web", "./mvnw -q test -Dtest=p.ATest,p.BTest"), ("", "./mvnw -q test -Dtest=p.CTest")} and W.test_runs(tests, "ant", True).count() == 0


def test_questions(spark, project):
    from graphloom.api import CodeGraph, fitted

    q = CodeGraph(project)
    assert pairs(q.resolve("ReadingService", "ReadingService#latest", "nothing"), "name", "id") == {("ReadingService", "wx.core.ReadingService"), ("ReadingService#latest", "wx.core.ReadingService#latest(long)")}
    affected = q.impact("ReadingStore", 3)
    assert ("wx.api.StationController#show(long)", 2) in pairs(affected, "id", "distance") and pairs(q.tests_to_run(affected), "id") == {("wx.core.ReadingServiceIT",)}
    assert [r["id"] for r in q.search("reading service", 3, ["CLASS"]).collect()][:1] == ["wx.core.ReadingService"]
    assert pairs(q.routes("/stations"), "id", "handler") == {("route:GET /stations/{id}", "wx.api.StationController#show(long)"), ("route:DELETE /stations/{id}", "wx.api.StationController#drop(long)")}
    assert q.flow("GET /stations/{id}").count() == 1 and q.get_node("wx.core.Reading").count() == 1 and q.neighbors("wx.data.ReadingStore#load(long)").count() == 3
    assert {("dead-code", "wx.old.TapeHole"), ("dead-code", "wx.data.ReadingStore#compact()")} <= pairs(q.findings(), "kind", "subject")
    assert "wx.old.TapeHole" in q.report() and q.diff_report(q) == "# Changes\n\nNothing changed.\n"
    page = q.diff_report(CodeGraph(G.Graph(project.nodes.where("id <> 'wx.core.ReadingService#prune()'").withColumn("signature", F.when(F.col("id") == "wx.data.ReadingStore#load(long)", "x").otherwise(F.col("signature"))), project.edges)))
    assert "| 1 | 0 | 1 | 5 | 1 |" in page and "- `wx.core.ReadingService#prune()` method: added" in page and "- `wx.core.ReadingService#latest(long)` (distance 1)" in page and "- route:GET /stations/{id} (" in page and "- `wx.core.ReadingServiceIT`" in page
    text = fitted({"affected": affected}, 20, ["distance", "id"])
    assert len(text) // 4 <= 22 and '"omitted"' in text


def test_communities_in_one_task_as_in_rounds(spark, monkeypatch):
    rnd = random.Random(3)
    links = [(f"p{rnd.randrange(6)}.C{rnd.randrange(9)}", f"p{rnd.randrange(6)}.C{rnd.randrange(9)}", rnd.choice((0.5, 1.0, 3.0))) for _ in range(70)]
    ids = spark.createDataFrame([(i,) for i in sorted({x for a, b, _ in links for x in (a, b)} | {"q.Lone"})], "id string")
    df, written = spark.createDataFrame(links, "src string, dst string, weight double"), []
    monkeypatch.setattr(K, "cut", lambda *a: written.append(1) or cut(*a))
    found = pairs(K.communities(df, ids), "id", "level", "community")
    # the rounds wrote two tables each
    assert len(written) <= 5
    monkeypatch.setattr(K, "LINKS_PER_TASK", -1)
    assert found == pairs(K.communities(df, ids), "id", "level", "community") and len(written) > 20


def test_single_moves_gather_what_moved_only(monkeypatch):
    rnd, n, single = random.Random(0), 300, []
    links = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(1500)} | {(0, k) for k in range(1, n, 2)}
    links = sorted({x for a, b in links for x in ((a, b), (b, a))})
    src, dst = np.array(links).T
    weight = np.array([1.0 + (a + b) % 3 for a, b in links])
    hashes, grouped = np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64), K._grouped
    monkeypatch.setattr(K, "_grouped", lambda keys, w: single.append(len(keys)) or grouped(keys, w))
    found = K.moved_arrays(src, dst, weight, hashes, 0.4)
    # while halves of the nodes move at once, half of all links are gathered; each of the many single moves gathers few
    assert len(single) > 100 and sorted(single)[len(single) // 2] < len(src) / 4, single
    k, inside = np.bincount(src, weights=weight, minlength=n), found[src] == found[dst]
    mass = np.bincount(found, weights=k, minlength=n)
    assert weight[inside].sum() / k.sum() - 0.4 * (mass**2).sum() / k.sum() ** 2 > 0.5 and (found <= np.arange(n)).all()


def test_labels_of_communities_in_one_task(spark, monkeypatch):
    links, written = [("a.A", "a.B", 1.0), ("a.B", "a.C", 1.0), ("b.A", "b.B", 1.0), ("b.B", "b.C", 1.0), ("a.A", "b.A", 0.1)], []
    ids = spark.createDataFrame([(f"{p}.{c}",) for p in "ab" for c in "ABC"], "id string")
    monkeypatch.setattr(K, "cut", lambda *a: written.append(1) or cut(*a))
    labels = pairs(K.labelled(K.communities(spark.createDataFrame(links, "src string, dst string, weight double"), ids)), "level", "community", "label", "n", "parent")
    # the rounds wrote two tables each
    assert len(written) <= 5 and {(0, "a.A", "a", 3), (0, "b.A", "b", 3)} == {x[:4] for x in labels if x[0] == 0}


def test_large_packages_draw_their_classes_together(spark):
    ids = [(f"wide.p.C{k:03}",) for k in range(230)] + [(f"small.C{k}",) for k in range(3)] + [("lone.Only",)]
    links = [("small.C0", "small.C1", 1.0), ("small.C1", "small.C2", 1.0)]
    labels = K.labelled(K.communities(spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame(ids, "id string")))
    assert pairs(labels.where("level = 0"), "community", "label", "n") == {("wide.p.C000", "wide.p", 230), ("small.C0", "small", 3), ("lone.Only", "lone", 1)}


def test_packages_by_counts_as_by_pairs(spark, monkeypatch):
    rnd = random.Random(11)
    classes = [f"p{p}.C{k:02}" for p in range(2) for k in range(9 + 4 * p)]
    links = [(*rnd.sample(classes, 2), rnd.choice((0.5, 1.0, 3.0))) for _ in range(14)] + [(f"p1.C{k:02}", f"p1.C{k + 1:02}", 9.0) for k in range(0, 12, 2)]
    df, ids = spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame([(i,) for i in classes], "id string")
    by_pairs = pairs(K.communities(df, ids), "id", "level", "community")
    # only the smaller one has its pairs written
    monkeypatch.setattr(K, "PAIRED", 9)
    assert K.package_links(K.packaged(ids)).count() == 36 and by_pairs == pairs(K.communities(df, ids), "id", "level", "community")
    monkeypatch.setattr(K, "PAIRED", 0)
    monkeypatch.setattr(K, "LINKS_PER_TASK", -1)
    assert by_pairs == pairs(K.communities(df, ids), "id", "level", "community")
    assert 2 < len({c for _, level, c in by_pairs if level == 0}) < len(classes)


def test_moves_by_counts_as_by_pairs(monkeypatch):
    several = 0
    for seed in range(20):
        rnd, n, size = random.Random(seed), 120, np.array([50, 40, 20])
        package = np.repeat([0, 1, 2, -1], [50, 40, 20, 10])
        linked = {(a, b) if a < b else (b, a): float(rnd.randrange(1, 4)) for a, b in (rnd.sample(range(n), 2) for _ in range(90))}
        paired = dict(linked)
        for a in range(n):
            for b in range(a + 1, n):
                if package[a] == package[b] >= 0:
                    paired[a, b] = paired.get((a, b), 0.0) + 2.0 / size[package[a]]
        held = np.flatnonzero(package >= 0)
        # as they are, and with some of them gathered, so that a node has classes of several packages
        up = np.arange(n) if seed % 2 else np.array([rnd.randrange(0, n, 3) if v % 3 else v for v in range(n)])
        drawn = K.Drawn(held, package[held], np.ones(len(held), np.int64), size, n).above(up)
        several += (np.diff(drawn.start) > 1).sum()
        hashes = np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64)
        monkeypatch.setattr(K, "DRAWN_AT_ONCE", 4_000_000 if seed < 10 else 60)
        for resolution in (1.0, 0.15):
            moved, alone = [], []
            for links, own in ((linked, drawn), (paired, K.Drawn(*[np.zeros(0, np.int64)] * 4, n))):
                ends, weight = np.array([(a, b) for x, y in links for a, b in ((x, y), (y, x))]), np.repeat(list(links.values()), 2)
                keys, weight = K._grouped(up[ends[:, 0]] * n + up[ends[:, 1]], weight)
                src, dst = keys // n, keys % n
                moved.append(K.moved_arrays(src, dst, weight, hashes, resolution, own).tolist())
                k, off, by_one = np.bincount(src, weights=weight, minlength=n) + own.k, src != dst, np.arange(n)
                K._moved_alone(by_one, src[off], dst[off], weight[off], k, k > 0, resolution, float(k.sum()), own)
                alone.append(by_one.tolist())
            assert moved[0] == moved[1] and alone[0] == alone[1], (seed, resolution)
    assert several > 100


def test_betweenness_in_arrays_as_in_rounds(spark, monkeypatch):
    rnd = random.Random(5)
    links = [(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}", 1.0) for _ in range(40)] + [("x", "y", 1.0)]
    df, written = spark.createDataFrame(links, "src string, dst string, weight double"), []
    ids = spark.createDataFrame([(f"n{k}",) for k in range(26)] + [("x",), ("y",), ("lone",)], "id string")
    monkeypatch.setattr(K, "LINKS_AT_ONCE", 200)
    monkeypatch.setattr(K, "cut_measured", lambda *a, **k: written.append(1) or cut_measured(*a, **k))
    whole = dict(pairs(K.betweenness(df, ids), "id", "betweenness"))
    assert not written, "a table was written for each level of the search"
    monkeypatch.setattr(K, "LINKS_PER_TASK", -1)
    rounds = dict(pairs(K.betweenness(df, ids), "id", "betweenness"))
    assert written and whole.keys() == rounds.keys() and all(abs(whole[i] - rounds[i]) < 1e-9 for i in rounds) and max(whole.values()) > 1


def test_god_scores_without_rounds(spark, monkeypatch):
    from graphloom.plans import knowledge

    written = []
    monkeypatch.setattr(K, "cut_measured", lambda *a, **k: written.append(1) or cut_measured(*a, **k))
    found = dict(pairs(knowledge.god_scores(spark, DATA), "id", "score"))
    assert not written and 1 <= max(found.values()) <= 2


def brandes(start, to, sources):
    """The shares of the shortest ways from sources, one by one."""
    total = [0.0] * (len(start) - 1)
    for s in sources:
        level, ways, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in to[start[v] : start[v + 1]]:
                if w not in level:
                    level[w], ways[w] = level[v] + 1, 0
                    order.append(w)
                if level[w] == level[v] + 1:
                    ways[w] += ways[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in to[start[w] : start[w + 1]]:
                if level[v] == level[w] - 1:
                    delta[v] += ways[v] / ways[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    return total


def arrays(n, links):
    src, dst = np.array(sorted({x for a, b in links if a != b for x in ((a, b), (b, a))})).T
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst


def test_shares_by_rows_as_by_links(monkeypatch):
    rnd, n = random.Random(8), 90
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(200)] + [(k, k + 1) for k in range(58, 75)] + [(80, k) for k in range(81, 88)]
    start, to = arrays(n, links)
    sources = np.array([k for k in range(n) if rnd.random() < 0.8])
    wanted = brandes(start.tolist(), to.tolist(), sources.tolist())
    for rows_from, side, values in ((0, 7, 1 << 16), (16, 64, 1 << 16), (1e9, 64, 1 << 16), (1e9, 5, 40), (1e9, 64, 1), (3, 1, 100)):
        monkeypatch.setattr(K, "ROWS_FROM", rows_from)
        monkeypatch.setattr(K, "SIDE_BY_SIDE", side)
        monkeypatch.setattr(K, "VALUES_AT_ONCE", values)
        assert np.abs(K.shares(start, to, sources) - wanted).max() < 1e-9, (rows_from, side, values)


def test_shares_follow_few_links_one_by_one(monkeypatch):
    rnd, n = random.Random(8), 1000
    start, to = arrays(n, [(rnd.randrange(n), rnd.randrange(n)) for _ in range(8 * n)])
    counted, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: counted.append(len(x)) or plain(x, *a, **k))
    K.shares(start, to, np.arange(n))
    # followed one by one, each node is met at least twice from each source
    assert sum(counted) < 1.5 * n * n


def test_recall_in_tasks_as_in_a_join(spark, monkeypatch):
    rnd, log = random.Random(9), []
    for k in range(120):
        log += [(1000 * k, "explain", " ".join(rnd.choices(["region", "parcel", "depot", "queue", "vault", "panel"], k=rnd.randrange(1, 5)))), (1000 * k + 5, "source", f"a.C{rnd.randrange(7)}")]
    entries = spark.createDataFrame([*log, (5, "explain", "unheard words alone"), (500_000, "explain", "unheard region parcel")], "t long, kind string, arg string")
    asked = entries.where("kind = 'explain'").select(F.col("arg").alias("question"))
    whole = S.recall(entries, asked)
    assert "MapInPandas" in whole._jdf.queryExecution().toString(), "pairs of questions were joined and written"
    found = pairs(whole, "question", "arg", "n", "place")
    monkeypatch.setattr(S, "REMEMBERED_PER_TASK", -1)
    assert found == pairs(S.recall(entries, asked), "question", "arg", "n", "place") and len(found) > 50
    assert S.recall(entries.where("false"), asked).count() == 0


def test_cards_in_tasks_as_in_a_join(spark, monkeypatch):
    names = [f"a.{x}{y}" for x in ("Region", "Parcel", "Depot") for y in ("Queue", "Vault", "Panel", "")]
    nodes = [node(n, "CLASS") for n in names] + [node("a.Sub$In", "CLASS")] + [node(f"{n}#m()", lines=(1, 9)) for n in names[::2]]
    edges = [edge("a.Sub$In", "a.Depot", "EXTENDS")] + [edge(n, f"{n}#m()", "CONTAINS") for n in names[::2]] + [edge(f"{a}#m()", b) for a in names[::4] for b in names[1::2]]
    g = G.Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    asked = spark.createDataFrame([("region queue",), ("depot",), ("queue vault panel",), ("parcel",), ("nothing",), ("",)], "question string")
    whole = S.subsystems(g, asked)
    assert "MapInPandas" in whole._jdf.queryExecution().toString(), "pairs of questions and types were joined and written"
    found = pairs(whole, "question", "id", "n_in", "busiest", "place")
    monkeypatch.setattr(S, "REMEMBERED_PER_TASK", -1)
    assert found == pairs(S.subsystems(g, asked), "question", "id", "n_in", "busiest", "place") and {x[0] for x in found} == {"depot", "queue vault panel", "parcel"}
