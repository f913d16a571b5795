"""Traversals and what is derived from the class projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import cut, last_snapshot, table
from graphloom.functions.names import owner, package
from graphloom.operators import derive as D
from graphloom.operators import graph as G
from graphloom.operators import walk as W
from graphloom.plans import sql


def most_used(g: G.Graph) -> DataFrame:
    """The class of the project that most USES_TYPE edges reach, the smallest id of equals: where the walks start."""
    used = g.edges.where("kind = 'USES_TYPE'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return used.join(g.nodes.where("kind = 'CLASS' and origin = 'REPO'").select("id"), "id", "left_semi").orderBy(F.desc("n"), "id").limit(1).select("id")


def _impact(g: G.Graph) -> tuple[DataFrame, DataFrame]:
    seeds = cut(W.class_seeds(g, most_used(g)))
    return seeds, W.reach(W.backwards(g.edges), seeds, 3)


def impact(spark: SparkSession, d: str) -> DataFrame:
    """What a change of the most used class reaches in three steps."""
    return _impact(G.load(spark, d))[1]


def impact_by_module(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    _, near = _impact(g)
    unit = F.coalesce("module", "artifact", F.lit("external")).alias("unit")
    return near.where("distance > 0").join(g.nodes.select("id", "module", "artifact"), "id", "left").groupBy(unit).agg(F.count("*").alias("n"))


def impact_tests(spark: SparkSession, d: str) -> DataFrame:
    """The tests to run, with the command of their module."""
    g = G.load(spark, d)
    seeds, near = _impact(g)
    tests = W.tests_of(g, near.where("distance > 0"), seeds)
    named = tests.join(g.nodes.select("id", "module"), "id", "left")
    return named.select("id", F.concat(F.lit("./gradlew "), F.coalesce(F.concat("module", F.lit(":test")), F.lit("test")), F.lit(" --tests "), "id").alias("command"))


def impact_test_runs(spark: SparkSession, d: str) -> DataFrame:
    """The commands that run these tests, one for each module, by the build tool that the build names."""
    g = G.load(spark, d)
    seeds, near = _impact(g)
    tests = W.tests_of(g, near.where("distance > 0"), seeds).join(g.nodes.select("id", "module"), "id", "left")
    tool = table(spark, d, "meta").where((F.col("snap_no") == last_snapshot(spark, d)) & (F.col("key") == "buildTool")).agg(F.max(F.lower("value"))).first()[0] or ""
    return W.test_runs(tests, tool, g.nodes.where("kind = 'MODULE'").limit(2).count() > 1)


def impact_of_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed lines reach: in each file of the project the lines 10 to 14 stand for a change."""
    g = G.load(spark, d)
    ranges = g.nodes.where("origin = 'REPO' and file is not null").select("file").distinct().select("file", F.lit(10).alias("first"), F.lit(14).alias("last"))
    return W.reach(W.backwards(g.edges), W.changed_members(g, ranges), 2)


def around(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return W.neighbors(g, most_used(g), 2)


def path(spark: SparkSession, d: str) -> DataFrame:
    """From the smallest class of the project to the method that most calls reach."""
    g = G.load(spark, d)
    start = g.nodes.where("kind = 'CLASS' and origin = 'REPO'").agg(F.min("id")).first()[0] or ""
    called = g.edges.where("kind = 'CALLS'").groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return W.shortest_path(g, start, called[0] if called else "")


def type_closure(spark: SparkSession, d: str) -> DataFrame:
    return W.closure(G.load(spark, d).edges.where("kind in ('EXTENDS', 'IMPLEMENTS')"))


def dispatches(spark: SparkSession, d: str) -> DataFrame:
    return W.dispatches(G.load(spark, d)).withColumn("confidence", F.round("confidence", 6))


def overrides(spark: SparkSession, d: str) -> DataFrame:
    return W.overridden(G.load(spark, d))


def climbs(spark: SparkSession, d: str) -> DataFrame:
    """For every method of a repository or client class the entry above it."""
    g = G.load(spark, d)
    low = g.nodes.where(G.is_code() & G.attr("layer").isin("repository", "client")).select(F.col("id").alias("_c"))
    return W.climb(g, g.nodes.where("kind = 'METHOD'").join(low, owner("id") == F.col("_c"), "left_semi"))


def call_chains(spark: SparkSession, d: str) -> DataFrame:
    """From every method that handles a route its chain of best callees."""
    g = G.load(spark, d)
    return W.chains(g, g.edges.where("kind = 'HANDLES_ROUTE'").select(F.col("src").alias("id")))


def class_projection(spark: SparkSession, d: str) -> DataFrame:
    return D.class_projection(G.load(spark, d)).withColumn("weight", F.round("weight", 4))


def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return D.in_degrees(D.class_projection(G.load(spark, d)))


def layers(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return D.layers(g, cut(D.class_projection(g)))


def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    projection = cut(D.class_projection(g))
    return D.layer_violations(projection, D.layers(g, projection))


def test_links(spark: SparkSession, d: str) -> DataFrame:
    return D.test_links(G.load(spark, d))


def package_rings(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return D.cyclic_packages(g, cut(D.class_projection(g)))


def dead_classes(spark: SparkSession, d: str) -> DataFrame:
    return D.dead_classes(G.load(spark, d))


def dead_members(spark: SparkSession, d: str) -> DataFrame:
    """Methods that nothing live calls and constants that nothing reads."""
    return D.dead_members(G.load(spark, d))


def version_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return D.version_conflicts(G.load(spark, d))


def god_classes(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return D.god_classes(g, D.in_degrees(D.class_projection(g)))


def untested_gods(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return D.untested_gods(g, D.in_degrees(D.class_projection(g)))


def package_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Classes and layers of each package, with the layer most of them have; of equals the smallest."""
    g = G.load(spark, d)
    own = D.classes(g).select(package("id").alias("pkg"), F.coalesce(G.attr("layer"), F.lit("none")).alias("layer"))
    counted = own.groupBy("pkg", "layer").agg(F.count("*").alias("n"))
    return counted.groupBy("pkg").agg(F.sum("n").alias("n"), F.count("*").alias("n_layers"), F.min(F.struct((-F.col("n")).alias("less"), "layer"))["layer"].alias("main_layer"))


QUERIES = {f.__name__: f for f in (impact, impact_by_module, impact_tests, impact_test_runs, impact_of_changes, around, path, type_closure, dispatches, overrides, climbs, call_chains, class_projection, in_degree, layers, layer_violations,
                                   test_links, package_rings, dead_classes, dead_members, version_conflicts, god_classes, untested_gods, package_sizes)}

_G = f"with recursive {sql.graph()}"
_O = sql.OWNER.format
_SEED = f"""
    seed as (select dst as id from e where kind = 'USES_TYPE' and dst in (select id from n where kind = 'CLASS' and origin = 'REPO') group by dst order by count(*) desc, dst limit 1),
    seeds as (select id from seed union select dst from e where kind = 'CONTAINS' and src in (from seed))"""
_BACK = f"back as (select distinct dst as src, src as dst from e where kind in {sql.IMPACT})"
_REACH = f"{_SEED}, {_BACK}, r as (select id, 0 as d from seeds union select b.dst, r.d + 1 from r join back b on b.src = r.id where r.d < 3), near as (select id, min(d) as distance from r group by id)"
_TESTS = "t as (select src as id from e where kind = 'TESTS' and dst in (select split_part(id, '#', 1) from near) union select id from n where " + sql.TEST.format("") + " and id in (select split_part(id, '#', 1) from near where distance > 0))"
_TOLD = f"told as (select src, dst, kind from e where kind not in {tuple(k for k in G.STRUCTURE if k != 'CONTAINS')})"
_CLOSE = "up as (select distinct src, dst from e where kind in ('EXTENDS','IMPLEMENTS')), clo as (select src, dst from up union select c.src, u.dst from clo c join up u on u.src = c.dst)"
_CLASSES = f"cls as (select * from n where kind in {sql.CODE} and origin <> 'EXTERNAL' and not {sql.TEST.format('')})"
_W = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in D.WEIGHTS.items()) + " end * case when kind = 'DISPATCHES_TO' then confidence else 1 end"
_PROJ = f"""{_CLASSES}, proj as (select src, dst, weight from (select {_O('src')} as src, {_O('dst')} as dst, sum({_W}) as weight from e where kind in {tuple(D.WEIGHTS)} group by 1, 2)
    where src <> dst and src in (select id from cls) and dst in (select id from cls))"""
_NAME = "regexp_extract(id, '[^.$]*$')"
_NOTES = "coalesce(json_keys(attrs['annotations']::json), [])"
_NAMED = (
    "case when id in (select src from e where kind in ('EXTENDS','IMPLEMENTS') and dst like 'org.springframework.data.%Repository') then 'repository' "
    + " ".join(f"when list_has_any({_NOTES}, {list(names)}) then '{layer}'" for layer, names in D.ANNOTATED.items()) + " " + " ".join("when " + " or ".join(f"({_NAME} like '%{s}' and length({_NAME}) > {len(s)})" for s in ends) + f" then '{layer}'" for layer, ends in D.SUFFIXES.items())
    + f" when list_contains({_NOTES}, '{D.COMPONENT}') then 'service' end"
)
_LAYERS = f"""lay1 as (select id, kind, {_NAMED} as named from cls),
    works as (select distinct src from e where kind = 'CONTAINS' and contains(dst, '(') and not (regexp_matches(split_part(substr(dst, strpos(dst, '#') + 1), '(', 1), '^(get|set|is|<)') or split_part(substr(dst, strpos(dst, '#') + 1), '(', 1) in {D.OBJECT_METHODS})),
    lay as (select id, coalesce(named, case when kind in ('RECORD','ENUM') then 'model' when id in (select p.src from proj p join lay1 x on x.id = p.dst where x.named in ('repository','client')) then 'service'
        when id not in (select src from proj) and id not in (from works) then 'model' end) as layer from lay1)"""
_TOP = "split_part(split_part({}, '#', 1), '$', 1)"
_PKG = "case when contains({0}, '.') then regexp_replace({0}, '\\.[^.]*$', '') else '' end"

_SIMPLE = "list_transform(coalesce(json_keys({}['annotations']::json), []), lambda x: regexp_extract(x, '[^.]*$'))"
_REFS = f"""mem as (select e.src as cls, m.id, m.kind, m.start_line as lo, m.end_line as hi from e join n c on c.id = e.src and c.kind in {sql.CODE} join n m on m.id = e.dst where e.kind = 'CONTAINS' and m.start_line is not null and m.kind in ('METHOD','CONSTRUCTOR','FIELD')),
    wr as (select cls, min(lo) as first from mem where kind = 'FIELD' or coalesce(hi, 0) > lo group by cls),
    made as (select m.id from mem m left join wr using (cls) where m.kind <> 'FIELD' and m.hi = m.lo and (m.lo < coalesce(wr.first, 2147483647) or exists (select 1 from mem f where f.cls = m.cls and f.kind = 'FIELD' and m.lo between f.lo and coalesce(f.hi, f.lo)))
        union select id from n where contains(coalesce(attrs['annotations'], ''), 'lombok.Generated')),
    tests as (select id from n where {sql.TEST.format('')}),
    live as (select e.src, coalesce(b.attrs['type'], e.dst) as dst, e.kind, (e.src in (from tests) or {_TOP.format('e.src')} in (from tests)) as test from e left join n b on b.id = e.dst and b.kind = 'BEAN' and e.kind = 'INJECTS' where e.kind in {D.REFERENCES} and e.src not in (from made)),
    refs as (select distinct {_TOP.format('dst')} as c, {_TOP.format('src')} as r from live where not test and {_TOP.format('dst')} <> {_TOP.format('src')})"""
_DEAD = f"""sup as (select e.src, count(*) as k, max((n.origin = 'EXTERNAL')::int) as x from e left join n on n.id = e.dst where e.kind in ('EXTENDS','IMPLEMENTS') group by e.src),
    entry as (select id from n where list_has_any({_SIMPLE.format('attrs')}, {list(D.ENTRY_ANNOTATIONS)}) or starts_with(substr(id, nullif(strpos(id, '#'), 0) + 1), 'main(') union select fqn from n where kind = 'SCHEDULED_JOB' union select src from e where kind in ('HANDLES_ROUTE','CONSUMES_FROM','PROVIDES_BEAN')),
    ent as (select distinct src from e where kind = 'CONTAINS' and dst in (from entry)),
    named as (select id, regexp_extract(regexp_replace(regexp_replace(regexp_replace(coalesce(signature, ''), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '(\\s(?:extends|implements)\\s.*)$', 1) as tail from cls),
    cnt as (select id, len(list_filter(string_split(regexp_replace(tail, '\\s(extends|implements)\\s', ',', 'g'), ','), lambda x: trim(x) <> '')) as k from named),
    con as (select c.id, c.kind, c.attrs, (cnt.k > coalesce(s.k, 0) or coalesce(s.x, 0) > 0) as contract from cls c join cnt using (id) left join sup s on s.src = c.id where c.origin = 'REPO'),
    judged as (select id from con where kind <> 'ANNOTATION' and not contains(id, '$') and id not in (from ent) and len(list_filter({_SIMPLE.format('attrs')}, lambda x: x in {D.LIVE_CLASS_ANNOTATIONS} or starts_with(x, 'Enable'))) = 0
        and ((kind = 'INTERFACE' and id in (select src from e where kind = 'PROVIDES_BEAN')) or not contract)),
    ring as (select r, c from refs union select ring.r, f.c from ring join refs f on f.r = ring.c), alive as (select r as id from refs where r not in (from judged) union select c from ring where r = c union select f.c from alive join refs f on f.r = alive.id),
    dead as (select id from judged where id not in (from alive))"""

ORACLE = {
    "impact": f"{_G}, {_REACH} select * from near",
    "impact_by_module": f"{_G}, {_REACH} select coalesce(n.module, n.artifact, 'external') as unit, count(*) as n from near left join n using (id) where distance > 0 group by 1",
    "impact_test_runs": f"{_G}, {_REACH}, {_TESTS}, k as (select coalesce(n.module, '') as module, list_sort(list(distinct t.id)) as ids from t left join n using (id) group by 1) "
    "select module, './gradlew ' || case when module in ('', ':') then 'test' else module || ':test' end || array_to_string(list_transform(ids, lambda i: ' --tests ' || i), '') as command from k where exists (select 1 from meta where snap_no = (select max(snap_no) from snaps) and key = 'buildTool' and lower(value) = 'gradle')",
    "impact_tests": f"{_G}, {_REACH}, {_TESTS} select t.id, './gradlew ' || coalesce(n.module || ':test', 'test') || ' --tests ' || t.id as command from t left join n using (id)",
    "impact_of_changes": f"""{_G}, {_BACK}, hit as (select id, file from n where file in (select file from n where origin = 'REPO') and kind not in {sql.CODE} and kind <> 'FILE' and start_line <= 14 and coalesce(end_line, start_line) >= 10),
        seeds as (select id from hit union select id from n where kind in {sql.CODE} and file in (select file from n where origin = 'REPO') and file not in (select file from hit)),
        r as (select id, 0 as d from seeds union select b.dst, r.d + 1 from r join back b on b.src = r.id where r.d < 2) select id, min(d) as distance from r group by id""",
    "around": f"""{_G}, {_SEED}, {_TOLD}, near as (select id, 0 as d from seed union select case when t.src = s.id then t.dst else t.src end, 1 from seed s join told t on t.src = s.id or t.dst = s.id), nd as (select id, min(d) as d from near group by id)
        select src, dst, kind, min(d + 1) as level from nd join told on told.src = nd.id or told.dst = nd.id group by all""",
    "path": f"""{_G}, {_TOLD}, links as (select * from told union select dst, src, kind from e where kind = 'CONTAINS'), a as (select min(id) as id from n where kind = 'CLASS' and origin = 'REPO'),
        b as (select dst as id from e where kind = 'CALLS' group by dst order by count(*) desc, dst limit 1), r as (select id, 0 as d from a union select l.dst, r.d + 1 from r join links l on l.src = r.id where r.d < 6), nd as (select id, min(d) as d from r group by id),
        par as (select l.dst, y.d as e, l.src, l.kind from links l join nd x on x.id = l.src join nd y on y.id = l.dst and y.d = x.d + 1 qualify row_number() over (partition by l.dst order by l.src, l.kind) = 1),
        w as (select p.e as step, p.src, p.dst, p.kind from par p join b on b.id = p.dst union all select p.e, p.src, p.dst, p.kind from w join par p on p.dst = w.src) select * from w""",
    "type_closure": f"{_G}, {_CLOSE} select * from clo",
    "dispatches": f"""{_G}, {_CLOSE}, m as (select split_part(id, '#', 1) as cls, substr(id, strpos(id, '#') + 1) as m, coalesce(not regexp_matches(split_part(signature, '(', 1), '\\b(static|private|final)\\b'), true) as open from n where kind = 'METHOD' and contains(id, '#')),
        c as (select src, dst as called, split_part(dst, '#', 1) as cls, substr(dst, strpos(dst, '#') + 1) as m from e where kind = 'CALLS' and contains(dst, '#')),
        o as (select c.* from c where c.m not like '<%' and not exists (select 1 from m where m.cls = c.cls and m.m = c.m and not m.open)),
        b as (select o.called, k.src || '#' || o.m as dst from (select distinct called, cls, m from o) o join clo k on k.dst = o.cls join m on m.cls = k.src and m.m = o.m), k as (select *, count(*) over (partition by called) as cnt from b)
        select o.src, k.dst, round(arg_min(1.0::double / k.cnt, o.called), 6) as confidence from o join k using (called) group by all""",
    "overrides": f"""{_G}, {_CLOSE}, m as (select id, split_part(id, '#', 1) as cls, substr(id, strpos(id, '#') + 1) as m from n where kind = 'METHOD' and contains(id, '#')) select distinct a.id as src, b.id as dst from m a join clo on clo.src = a.cls join m b on b.cls = clo.dst and b.m = a.m where a.m not like '<%'""",
    "climbs": f"""{_G}, fit as (select id, not contains(split_part(id, '#', 1), '$') and coalesce(end_line, 0) - coalesce(start_line, 0) >= 1 as top from n where origin = 'REPO' and file is not null and not {sql.TEST.format('')}),
        calls as (select src, dst from e where kind = 'CALLS' and src in (select id from fit)), st as (select id as start, id, 0 as l from n where kind = 'METHOD' and split_part(id, '#', 1) in (select id from n where kind in {sql.CODE} and attrs['layer'] in ('repository','client'))),
        r as (select * from st union select r.start, c.src, r.l + 1 from r join calls c on c.dst = r.id where r.l < 4), lv as (select start, id, min(l) as l from r group by all)
        select start, id as top from lv where l > 0 and id in (select id from fit where top) qualify row_number() over (partition by start order by l desc, id) = 1""",
    "call_chains": f"""{_G}, lay as (select id, attrs['layer'] as layer from n where kind in {sql.CODE}), fit as (select n.id, case when l.layer in ('controller','service','repository','client') then 0 when l.layer in ('util','config') then 2 when l.layer = 'model' then 3 else 1 end as rank,
        n.id not in (select src from e where kind = 'CALLS') as ends from n left join lay l on l.id = split_part(n.id, '#', 1) where n.origin <> 'EXTERNAL' and n.file is not null and not {sql.TEST.format('n.')}),
        ways as (select e.src, e.dst, fit.rank, fit.ends, list_position(['EXACT','CHA','SPRING','HEURISTIC'], e.resolution) as sure, e.confidence from e join fit on fit.id = e.dst where e.kind = 'CALLS' or (e.kind = 'DISPATCHES_TO' and e.confidence >= 0.2)),
        c0 as (select distinct src as start, src as id, [src] as path from e where kind = 'HANDLES_ROUTE')"""
    + "".join(f""", c{i + 1} as (select c.start, w.dst as id, list_append(c.path, w.dst) as path from c{i} c join ways w on w.src = c.id where not list_contains(c.path, w.dst) qualify row_number() over (partition by c.start order by w.rank, w.ends, w.sure, w.confidence desc, w.dst) = 1)""" for i in range(3))
    + " select start, 0 as step, id from c0 where start in (select start from c1) union all select start, 1, id from c1 union all select start, 2, id from c2 union all select start, 3, id from c3",
    "class_projection": f"{_G}, {_PROJ} select src, dst, round(weight, 4) as weight from proj",
    "in_degree": f"{_G}, {_PROJ} select dst as id, count(*) as n from proj group by dst",
    "layers": f"{_G}, {_PROJ}, {_LAYERS} select * from lay",
    "layer_violations": f"{_G}, {_PROJ}, {_LAYERS} select p.src, p.dst, a.layer as src_layer, b.layer as dst_layer from proj p join lay a on a.id = p.src join lay b on b.id = p.dst where a.layer || '>' || b.layer in {tuple(f'{a}>{b}' for a, bs in D.FORBIDDEN.items() for b in bs)}",
    "test_links": f"""{_G}, {_CLASSES}, t as (select id from n where kind in {sql.CODE} and {sql.TEST.format('')}), ends as (select id as test, id as f from t union select src, dst from e where kind = 'CONTAINS' and src in (from t)),
        ex as (select distinct test as src, {_O('e.dst')} as dst from ends join e on e.src = ends.f where e.kind <> 'CONTAINS' and test <> {_O('e.dst')} and {_O('e.dst')} in (select id from cls)),
        nm as (select id as src, case {' '.join(f"when id like '%{s}' and length(regexp_extract(id, '[^.]*$')) > {len(s)} then left(id, length(id) - {len(s)})" for s in D.TEST_SUFFIXES)} end as dst from t)
        select src, dst, 'EXACT' as resolution from ex union all select src, dst, 'HEURISTIC' from nm where dst in (select id from cls) and (src, dst) not in (select (src, dst) from ex)""",
    "package_rings": f"""{_G}, {_PROJ}, own as (select id from cls where origin = 'REPO'), pk as (select distinct {_PKG.format('src')} as src, {_PKG.format('dst')} as dst from proj where src in (from own) and dst in (from own)), pl as (select * from pk where src <> dst),
        clo as (select src, dst from pl union select c.src, p.dst from clo c join pl p on p.src = c.dst), mutual as (select a.src as id, a.dst as other from clo a join clo b on b.src = a.dst and b.dst = a.src)
        select id, min(other) as component from mutual group by id having count(*) > 1""",
    "version_conflicts": f"""{_G}, dep as (select distinct src, split_part(dst, ':', 2) || ':' || split_part(dst, ':', 3) as name, split_part(dst, ':', 4) as version from e where kind = 'DEPENDS_ON_ARTIFACT' and dst like 'artifact:%:%:%')
        select src, name, string_agg(version, ',' order by version) as versions from dep group by all having count(*) > 1""",
    "god_classes": f"{_G}, {_PROJ} select dst as id, count(*) as n from proj group by dst having count(*) >= 2 order by n desc, id limit 10",
    "untested_gods": f"{_G}, {_PROJ}, gods as (select dst as id, count(*) as n from proj group by dst having count(*) >= 2 order by n desc, id limit 10) select * from gods where id in (select id from n where origin = 'REPO') and id not in (select dst from e where kind = 'TESTS')",
    "package_sizes": f"""{_G}, {_CLASSES}, k as (select {_PKG.format('id')} as pkg, coalesce(attrs['layer'], 'none') as layer, count(*) as c from cls group by all) select pkg, sum(c)::bigint as n, count(*) as n_layers, arg_min(layer, (-c, layer)) as main_layer from k group by pkg""",
    "dead_classes": f"{_G}, {_CLASSES}, {_REFS}, {_DEAD} select dead.id, min(refs.r) as via from dead left join refs on refs.c = dead.id group by dead.id",
    "dead_members": f"""{_G}, {_CLASSES}, {_REFS}, {_DEAD}, has as (select c.id as cls, c.kind as of_, c.contract, n.id, n.kind, coalesce(n.signature, '') as sig, substr(n.id, strpos(n.id, '#') + 1) as nm, split_part(substr(n.id, strpos(n.id, '#') + 1), '(', 1) as me,
        n.attrs['annotations'] as notes from con c join e on e.src = c.id and e.kind = 'CONTAINS' join n on n.id = e.dst where c.kind not in ('INTERFACE','ANNOTATION') and {_TOP.format('c.id')} not in (from dead) and n.id not in (from made)),
        called as (select distinct dst as id from live where kind in ('CALLS','DISPATCHES_TO') and not test), tcalled as (select distinct dst as id from live where kind in ('CALLS','DISPATCHES_TO') and test),
        pr as (select *, regexp_replace(regexp_replace(regexp_replace(me, '^get', ''), '^set', ''), '^is', '') as bare from has where kind = 'METHOD'),
        me as (select *, lower(left(bare, 1)) || substr(bare, 2) as prop, contains(sig, 'public') or contains(sig, 'protected') as vis from pr)
        select id, 'field' as what, 'info' as severity, false as tested, null::varchar as implements from has where kind = 'FIELD' and contains(sig, 'static') and contains(sig, 'final') and nm <> 'serialVersionUID' and lower(nm) not in ('log','logger')
            and not regexp_matches(case when contains(sig, ': ') then substr(sig, strpos(sig, ': ') + 2) else '' end, '(Logger|[.]Log)$') and id not in (select dst from live where kind = 'READS_FIELD' and not test)
        union all select id, 'method', case when vis then 'info' else 'warning' end, id in (from tcalled), (select min(dst) from e where kind = 'OVERRIDES' and e.src = me.id) from me
            where me.me not in {D.CONTRACT_METHODS} and not starts_with(me.me, 'lambda$') and not starts_with(me.me, '<') and id not in (from entry) and not (me.me <> prop and prop <> '' and exists (select 1 from e where e.kind = 'CONTAINS' and e.src = me.cls and e.dst = me.cls || '#' || prop))
            and not (of_ = 'ENUM' and me.me in ('values','valueOf')) and not (of_ = 'RECORD' and ends_with(id, '()')) and id not in (select dst from e where kind = 'OVERRIDES') and not contains(sig, 'abstract') and id not in (from called) and not (vis and contract)
            and id not in (select o.src from e o left join n t on t.id = o.dst where o.kind = 'OVERRIDES' and (coalesce(t.origin, '') <> 'REPO' or o.dst in (from called)))""",
}
