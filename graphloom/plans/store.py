"""Lookups, writes and cuts of the graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import clean_kind, last_snapshot, latest_rows, shared_folder, table
from graphloom.functions import names
from graphloom.operators import graph as G
from graphloom.plans import sql
from graphloom.sources import files


def graph_written(spark: SparkSession, d: str) -> DataFrame:
    """The graph written as tables parted by kind and read back: rows per table and kind, and the calls that a scan of their part alone finds."""
    g, folder = G.load(spark, d), f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    files.write_graph(g.nodes, g.edges, folder)
    back = G.Graph(spark.read.schema(g.nodes.schema).parquet(f"{folder}/nodes"), spark.read.schema(g.edges.schema).parquet(f"{folder}/edges"))
    calls = back.edges.where("kind = 'CALLS'").groupBy(F.lit("callees").alias("tab"), "kind").agg(F.countDistinct("dst").alias("n"))
    return _by_kind(back).unionByName(calls)


def log_read_back(spark: SparkSession, d: str) -> DataFrame:
    """The query log written as lines of JSON and read as the tool's own log is."""
    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    table(spark, d, "query_log").select("t", "kind", "arg").write.json(folder)
    return files.query_log(spark, folder)


def first_module(g: G.Graph) -> str:
    """The module that comes first by name, which the queries on one module take; empty if there is none."""
    return g.nodes.agg(F.min("module")).first()[0] or ""


def nodes_of_kind(spark: SparkSession, d: str) -> DataFrame:
    return G.load(spark, d).nodes.where("kind = 'CLASS'").select("id", "fqn", "origin", "module")


def edges_upserted(spark: SparkSession, d: str) -> DataFrame:
    """The edges of all snapshots, each once."""
    return G.upsert_edges(table(spark, d, "edges").withColumn("kind", clean_kind()), ["snap_no", "src", "dst", "kind"])


def edges_around(spark: SparkSession, d: str) -> DataFrame:
    """Edges out of and into each node by kind."""
    e = G.load(spark, d).edges
    both = e.select(F.col("src").alias("id"), "kind", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), "kind", F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id", "kind").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def nodes_like(spark: SparkSession, d: str) -> DataFrame:
    """The twenty shortest ids that hold a fragment in any letter case; a top-k report."""
    return G.load(spark, d).nodes.where(F.instr(F.lower("id"), "gateway") > 0).orderBy(F.length("id"), "id").limit(20).select("id", "kind")


def nodes_in_file(spark: SparkSession, d: str) -> DataFrame:
    """Nodes per file, by the last two parts of its path with slashes made alike."""
    path = F.regexp_replace("file", r"\\", "/")
    return G.load(spark, d).nodes.where("file is not null").groupBy(F.substring_index(path, "/", -2).alias("suffix")).agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """Methods with their signature and whether they can have another body below."""
    return G.load(spark, d).nodes.where("kind = 'METHOD'").select("id", "signature", G.overridable(F.col("signature")).alias("overridable"))


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return g.nodes.groupBy(F.lit("nodes").alias("tab"), "kind").agg(F.count("*").alias("n")).unionByName(g.edges.groupBy(F.lit("edges").alias("tab"), "kind").agg(F.count("*").alias("n")))


def meta_values(spark: SparkSession, d: str) -> DataFrame:
    """The key-value facts of the last build; keys and values in the letter case they have, health in lower case."""
    rows = table(spark, d, "meta").where(F.col("snap_no") == last_snapshot(spark, d)).where("key is not null")
    return rows.groupBy("key").agg(F.max(F.when(F.col("key").startswith("health:"), F.lower("value")).otherwise(F.col("value"))).alias("value"))


def tier_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each id with the columns of its latest snapshot and the attributes of all, later ones over earlier ones."""
    rows = latest_rows(table(spark, d, "nodes").withColumn("kind", clean_kind()), ["snap_no", "id"]).select("snap_no", "id", "kind", "origin", "sha", "attrs")
    return G.merge_tiers(rows, "snap_no").select("id", "kind", "origin", "sha", G.rendered(F.col("attrs")).alias("attrs"))


def attrs_set(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its callers counted into its attributes; nodes nobody calls keep theirs."""
    g = G.load(spark, d)
    callers = g.edges.where("kind = 'CALLS'").groupBy(F.col("dst").alias("id")).agg(F.create_map(F.lit("callers"), F.count("*").cast("string")).alias("new"))
    return G.set_attrs(g.nodes, callers).select("id", F.coalesce(G.rendered(F.col("attrs")), F.lit("")).alias("attrs"))


def unit_deleted(spark: SparkSession, d: str) -> DataFrame:
    """What stays of nodes and edges, by kind, when the first module goes."""
    g = G.load(spark, d)
    return _by_kind(G.delete_unit(g, first_module(g)))


def kinds_deleted(spark: SparkSession, d: str) -> DataFrame:
    return _by_kind(G.delete_kinds(G.load(spark, d), ["FIELD", "BEAN"]))


def stubs_deleted(spark: SparkSession, d: str) -> DataFrame:
    return _by_kind(G.delete_stubs(G.load(spark, d)))


def orphans_pruned(spark: SparkSession, d: str) -> DataFrame:
    """What stays, by kind, when the first module goes and all that only it held follows."""
    g = G.load(spark, d)
    return _by_kind(G.prune_orphans(G.delete_unit(g, first_module(g))))


def _by_kind(g: G.Graph) -> DataFrame:
    of = lambda df, name: df.groupBy(F.lit(name).alias("tab"), "kind").agg(F.count("*").alias("n"))
    return of(g.nodes, "nodes").unionByName(of(g.edges, "edges"))


def stubs_created(spark: SparkSession, d: str) -> DataFrame:
    return G.stubs(G.load(spark, d))[0]


def unreachable(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the first module that the rest of the graph doesn't reach in three rounds."""
    g = G.load(spark, d)
    return G.prune_unreachable(g, first_module(g))


def usage(spark: SparkSession, d: str) -> DataFrame:
    g = G.load(spark, d)
    return G.usage_of(g, first_module(g))


def edges_told(spark: SparkSession, d: str) -> DataFrame:
    return G.clean_edges(G.load(spark, d))


def trivial(spark: SparkSession, d: str) -> DataFrame:
    return G.trivial_members(G.load(spark, d))


def leadable(spark: SparkSession, d: str) -> DataFrame:
    """Members of the project that an answer can lead with: no tests, and two lines of body or a place in an interface."""
    n = G.load(spark, d).nodes
    types = n.where("kind = 'INTERFACE'").select(F.col("id").alias("_type"))
    own = n.where("kind in ('METHOD', 'CONSTRUCTOR') and origin = 'REPO'").where(~G.is_test()).join(types, names.owner("id") == F.col("_type"), "left")
    return own.where("end_line - start_line >= 1 or _type is not null").select("id", F.col("_type").isNotNull().alias("in_interface"))


def ids_resolved(spark: SparkSession, d: str) -> DataFrame:
    """What the names in the query log denote."""
    log = table(spark, d, "query_log").where(clean_kind().isin("SOURCE", "NODE")).select(F.col("arg").alias("name"))
    bare = log.select(F.substring_index("name", ".", -1).alias("name"))
    return G.resolve_ids(log.union(bare), G.load(spark, d).nodes)


def ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Names in the query log that denote nothing or more than one node."""
    log = table(spark, d, "query_log").where(clean_kind().isin("SOURCE", "NODE")).where("arg is not null").select(F.substring_index("arg", ".", -1).alias("name")).distinct()
    found = G.resolve_ids(log, G.load(spark, d).nodes).groupBy("name").agg(F.count("*").alias("n"))
    return log.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


QUERIES = {f.__name__: f for f in (graph_written, log_read_back, nodes_of_kind, edges_upserted, edges_around, nodes_like, nodes_in_file, signatures, table_counts, meta_values, tier_merge, attrs_set, unit_deleted, kinds_deleted, stubs_deleted, orphans_pruned,
                                   stubs_created, unreachable, usage, edges_told, trivial, leadable, ids_resolved, ambiguous)}

_G = f"with recursive {sql.graph()}"
_LEFT = "select 'nodes' as tab, kind, count(*) as n from {n} group by kind union all select 'edges', kind, count(*) from {e} group by kind"
_LOG = f"select arg as name from query_log where {sql.KIND.format('')} in ('SOURCE','NODE')"
_SHORT = "regexp_replace(replace({}, ' ', ''), '[A-Za-z0-9_.]+\\.', '', 'g')"
_RESOLVE = f"""
    asked as (select distinct name from ({{}}) where name is not null),
    exact as (select a.name, n.id from asked a join n on n.id = a.name),
    rest as (select name from asked where name not in (select name from exact)),
    bare as (select r.name, n.id, n.origin = 'REPO' as own from rest r join n on n.kind in {sql.CODE} and regexp_extract(n.id, '[^.$]*$') = r.name where not contains(r.name, '#') and not contains(r.name, '.')),
    memb as (select r.name, n.id, n.origin = 'REPO' as own from rest r join n on contains(n.id, '#')
        and (split_part(n.id, '#', 1) = split_part(r.name, '#', 1) or regexp_extract(split_part(n.id, '#', 1), '[^.]*$') = split_part(r.name, '#', 1))
        and ({_SHORT.format("substr(n.id, strpos(n.id, '#') + 1)")} = {_SHORT.format("substr(r.name, strpos(r.name, '#') + 1)")}
             or (not contains(r.name, '(') and split_part({_SHORT.format("substr(n.id, strpos(n.id, '#') + 1)")}, '(', 1) = {_SHORT.format("substr(r.name, strpos(r.name, '#') + 1)")}))
        where contains(r.name, '#')),
    cand as (select *, max(own::int) over (partition by name) as best from (select * from bare union all select * from memb)),
    resolved as (select name, id from exact union select name, id from cand where own::int = best)"""

ORACLE = {
    "graph_written": f"{_G} select * from ({_LEFT.format(n='n', e='e')}) union all select 'callees', kind, count(distinct dst) from e where kind = 'CALLS' group by kind",
    "log_read_back": "select t, kind, arg from query_log where t is not null",
    "nodes_of_kind": f"{_G} select id, fqn, origin, module from n where kind = 'CLASS'",
    "edges_upserted": f"""with r as (select snap_no, src, dst, {sql.KIND.format('')} as kind, resolution, confidence, line, loaded_at from edges where src is not null and dst is not null and kind is not null and snap_no is not null)
        select a.snap_no, a.src, a.dst, a.kind, a.resolution, a.confidence, l.line from (select * from r qualify row_number() over (partition by snap_no, src, dst, kind order by loaded_at, resolution, confidence) = 1) a
        left join (select * from r where line is not null qualify row_number() over (partition by snap_no, src, dst, kind order by loaded_at, line) = 1) l using (snap_no, src, dst, kind)""",
    "edges_around": f"{_G} select id, kind, sum(o)::bigint as n_out, sum(i)::bigint as n_in from (select src as id, kind, 1 as o, 0 as i from e union all select dst, kind, 0, 1 from e) group by all",
    "nodes_like": f"{_G} select id, kind from n where contains(lower(id), 'gateway') order by length(id), id limit 20",
    "nodes_in_file": f"{_G} select array_to_string(list_slice(string_split(replace(file, '\\', '/'), '/'), -2, -1), '/') as suffix, count(*) as n, min(start_line) as first_line from n where file is not null group by 1",
    "signatures": f"{_G} select id, signature, coalesce(not regexp_matches(split_part(signature, '(', 1), '\\b(static|private|final)\\b'), true) as overridable from n where kind = 'METHOD'",
    "table_counts": f"{_G} {_LEFT.format(n='n', e='e')}",
    "meta_values": "select key, max(case when starts_with(key, 'health:') then lower(value) else value end) as value from meta where snap_no = (select max(snap_no) from snaps) and key is not null group by key",
    "tier_merge": f"""with r as (select snap_no, id, {sql.KIND.format('')} as kind, origin, sha, attrs from nodes where id is not null qualify row_number() over (partition by snap_no, id order by loaded_at desc nulls last) = 1),
        top as (select * from r qualify row_number() over (partition by id order by snap_no desc) = 1),
        kv as (select id, snap_no, unnest(map_entries(attrs)) as x from r), best as (select id, x.key as k, arg_max(x.value, snap_no) as v from kv group by all)
        select t.id, t.kind, t.origin, t.sha, coalesce((select string_agg(k || '=' || coalesce(v, ''), '; ' order by k || '=' || coalesce(v, '')) from best b where b.id = t.id), '') as attrs from top t""",
    "attrs_set": f"""{_G}, c as (select dst as id, count(*)::varchar as n from e where kind = 'CALLS' group by dst), kv as (select id, unnest(map_entries(attrs)) as x from n),
        al as (select id, x.key as k, x.value as v from kv where x.key <> 'callers' union all select n.id, 'callers', c.n from n join c using (id))
        select n.id, coalesce((select string_agg(k || '=' || coalesce(v, ''), '; ' order by k || '=' || coalesce(v, '')) from al where al.id = n.id), '') as attrs from n""",
    "unit_deleted": f"{_G}, n2 as (select * from n where module is distinct from {sql.MODULE}), e2 as (select * from e where src not in (select id from n where module = {sql.MODULE})) {_LEFT.format(n='n2', e='e2')}",
    "kinds_deleted": f"{_G}, x as (select id from n where kind in ('FIELD','BEAN')), n2 as (select * from n where id not in (from x)), e2 as (select * from e where src not in (from x) and dst not in (from x)) {_LEFT.format(n='n2', e='e2')}",
    "stubs_deleted": f"{_G}, x as (select id from n where origin = 'EXTERNAL'), n2 as (select * from n where id not in (from x)), e2 as (select * from e where src not in (from x)) {_LEFT.format(n='n2', e='e2')}",
    "orphans_pruned": f"{_G}, n0 as (select * from n where module is distinct from {sql.MODULE}), e0 as (select * from e where src not in (select id from n where module = {sql.MODULE}))"
    + "".join(f""", m{i} as (select * from n{i} where not (origin = 'EXTERNAL' and id not in (select src from e{i} union select dst from e{i}))),
        n{i + 1} as (select * from m{i} where not (kind = 'PACKAGE' and id not in (select src from e{i} where kind = 'CONTAINS'))), e{i + 1} as (select * from e{i} where src in (select id from n{i + 1}) and dst in (select id from n{i + 1}))""" for i in range(3))
    + f" {_LEFT.format(n='n3', e='e3')}",
    "stubs_created": f"""{_G}, miss as (select distinct dst as id from e where dst not in (select id from n)), notes as (select distinct dst from e where kind = 'ANNOTATED_WITH'),
        made as (select m.id, case when contains(m.id, '#<init>(') then 'CONSTRUCTOR' when contains(m.id, '(') then 'METHOD' when contains(m.id, '#') then 'FIELD' when m.id in (from notes) then 'ANNOTATION' else 'CLASS' end as kind,
            m.id as fqn, coalesce(o.origin, 'EXTERNAL') as origin, o.module, o.artifact, o.id is not null as inherited from miss m left join n o on contains(m.id, '#') and o.id = split_part(m.id, '#', 1))
        select * from made union all select distinct split_part(id, '#', 1), 'CLASS', split_part(id, '#', 1), 'EXTERNAL', null::varchar, null::varchar, false from made where contains(id, '#') and not inherited and split_part(id, '#', 1) not in (select id from miss)""",
    "unreachable": f"""{_G}, own as (select id, split_part(id, '#', 1) as cls, attrs['annotations'] as notes from n where module = {sql.MODULE} or artifact = {sql.MODULE}),
        links as (select src, dst from e where kind not in {sql.STRUCTURE} and dst in (select id from own)), inside as (select * from links where src in (select id from own)),
        f0 as (select dst as id from links where src not in (select id from own) union select id from own where exists (select 1 from unnest(json_keys(notes::json)) as k(x) where not regexp_matches(k.x, '^(java\\.lang|kotlin)\\.')))"""
    + "".join(f", f{i + 1} as (select id from (select o.cls as id from f{i} join own o using (id) union select i.dst from f{i} join inside i on i.src = f{i}.id) where id not in ({' union '.join(f'select id from f{k}' for k in range(i + 1))}))" for i in range(2))
    + ", kept as (select cls from own where id in (select id from f0 union select id from f1 union select id from f2 union select o.cls from f2 join own o using (id))) select id from own where cls not in (from kept)",
    "usage": f"""{_G}, pk as (select distinct regexp_replace(split_part(id, '$', 1), '\\.[^.]*$', '') as p from n where module = {sql.MODULE} and kind in {sql.CODE}),
        t as (select distinct dst as id from e where src in (select id from n where origin <> 'EXTERNAL' and module is distinct from {sql.MODULE})) select distinct id from t join pk on starts_with(t.id, pk.p || '.')""",
    "edges_told": f"""{_G}, tests as (select id from n where {sql.TEST.format('')}) select src, dst, kind, resolution, confidence from e where kind not in {sql.STRUCTURE} and kind <> 'MENTIONS' and src <> dst and (kind <> 'DISPATCHES_TO' or confidence >= 0.2)
        and (dst not in (from tests) or src in (from tests)) qualify row_number() over (partition by src, dst order by list_position(['EXACT','CHA','SPRING','HEURISTIC'], resolution), confidence desc, kind, resolution) = 1""",
    "trivial": f"""{_G}, m as (select id, substr(id, strpos(id, '#') + 1) as m from n where kind in ('METHOD','CONSTRUCTOR') and contains(id, '#')) select id from m where m like '<%'
        union all select id from m where regexp_matches(m, '^(get|set|is)') and length(split_part(m, '(', 1)) > 3 and id not in (select src from e where kind = 'CALLS')""",
    "leadable": f"{_G} select n.id, t.id is not null as in_interface from n left join n t on t.kind = 'INTERFACE' and t.id = split_part(n.id, '#', 1) where n.kind in ('METHOD','CONSTRUCTOR') and n.origin = 'REPO' and not {sql.TEST.format('n.')} and (n.end_line - n.start_line >= 1 or t.id is not null)",
    "ids_resolved": f"{_G}, {_RESOLVE.format(f'''{_LOG} union all select regexp_extract(name, '[^.]*$') from ({_LOG})''')} select * from resolved",
    "ambiguous": f"{_G}, {_RESOLVE.format(f'''select regexp_extract(name, '[^.]*$') as name from ({_LOG}) where name is not null''')} select a.name, count(r.id) as n from asked a left join resolved r using (name) group by a.name having count(r.id) <> 1",
}
