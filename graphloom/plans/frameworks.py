"""What annotations, configuration and messages wire together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import owner, package
from graphloom.operators import graph as G
from graphloom.operators import wiring
from graphloom.plans import sql

_NOTES = "map<string,map<string,string>>"


def annotation_values(spark: SparkSession, d: str) -> DataFrame:
    """Every annotation of every node with its members and values; one without members has null there."""
    notes = G.load(spark, d).nodes.select("id", F.explode(F.from_json(G.attr("annotations"), _NOTES)).alias("annotation", "members"))
    return notes.select("id", "annotation", F.explode_outer("members").alias("member", "value"))


def annotation_uses(spark: SparkSession, d: str) -> DataFrame:
    """Each annotation type by the kinds of nodes it stands on."""
    g = G.load(spark, d)
    return g.edges.where("kind = 'ANNOTATED_WITH'").select(F.col("src").alias("id"), F.col("dst").alias("annotation")).join(g.nodes.select("id", "kind"), "id").groupBy("annotation", "kind").agg(F.count("*").alias("n"))


def undefined_config(spark: SparkSession, d: str) -> DataFrame:
    """Keys that code binds and no file defines, with the smallest member that does."""
    g = G.load(spark, d)
    defined = g.nodes.where("kind = 'CONFIG_KEY'").where(F.coalesce(G.attr("defined") == "true", F.lit(False)) | G.attr("value").isNotNull()).select(F.col("id").alias("dst"))
    return g.edges.where("kind = 'BINDS_CONFIG'").join(defined, "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("first"))


def unread_config(spark: SparkSession, d: str) -> DataFrame:
    """Keys that nothing binds."""
    g = G.load(spark, d)
    return g.nodes.where("kind = 'CONFIG_KEY'").select("id").join(g.edges.where("kind = 'BINDS_CONFIG'").select(F.col("dst").alias("id")), "id", "left_anti")


def message_links(spark: SparkSession, d: str) -> DataFrame:
    """Who reads what whom sends: producers and consumers of each topic by their classes."""
    e = G.load(spark, d).edges
    sent = e.where("kind = 'PRODUCES_TO'").select(F.col("dst").alias("topic"), owner("src").alias("producer")).distinct()
    read = e.where("kind = 'CONSUMES_FROM'").select(F.col("dst").alias("topic"), owner("src").alias("consumer")).distinct()
    return sent.join(read, "topic")


def unused_beans(spark: SparkSession, d: str) -> DataFrame:
    """Beans that nothing injects, with the class that provides them."""
    e = G.load(spark, d).edges
    injected = e.where("kind = 'INJECTS'").select("dst")
    return e.where("kind = 'PROVIDES_BEAN'").join(injected, "dst", "left_anti").select(F.col("dst").alias("bean"), owner("src").alias("provider")).distinct()


def route_layers(spark: SparkSession, d: str) -> DataFrame:
    """Routes by verb, package and layer of what handles them."""
    g = G.load(spark, d)
    handled = g.edges.where("kind = 'HANDLES_ROUTE'").select(F.regexp_extract("dst", r"^route:(\w+) ", 1).alias("verb"), owner("src").alias("id"))
    known = g.nodes.select("id", F.coalesce(G.attr("layer"), F.lit("none")).alias("layer"))
    return handled.join(known, "id").groupBy("verb", package("id").alias("pkg"), "layer").agg(F.count("*").alias("n"))


#: The annotations of the given project by what they are taken for here.
ROUTE, JOB, STEREOTYPE, MAKER, LISTENER = (f"org.brackenfold.base.{a}" for a in ("Route", "Job", "Guarded", "Wired", "Timed"))


def derived_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes from the annotations of classes and their methods, inherited ones too."""
    return wiring.routes(G.load(spark, d), (ROUTE,), {}, ROUTE)


def derived_jobs(spark: SparkSession, d: str) -> DataFrame:
    return wiring.jobs(G.load(spark, d), (JOB,))


def derived_beans(spark: SparkSession, d: str) -> DataFrame:
    """Beans from the annotations of classes and of the methods of such classes."""
    return wiring.beans(G.load(spark, d), (STEREOTYPE,), (STEREOTYPE,), MAKER)


def derived_listeners(spark: SparkSession, d: str) -> DataFrame:
    return wiring.listeners(G.load(spark, d), {LISTENER: "name"})


QUERIES = {f.__name__: f for f in (annotation_values, annotation_uses, undefined_config, unread_config, message_links, unused_beans, route_layers, derived_routes, derived_jobs, derived_beans, derived_listeners)}

_G = f"with recursive {sql.graph()}"

_A = "an as (select id, kind, attrs['annotations']::json as j from n where attrs['annotations'] is not null)"
_GIVEN = "coalesce(nullif(trim(j -> '{0}' ->> '{1}'), ''), nullif(trim(j -> '{0}' ->> '{2}'), ''))"

ORACLE = {
    "derived_jobs": f"{_G}, {_A} select 'job:' || id as id, id as method, {_GIVEN.format(JOB, 'value', 'name')} as schedule from an where kind = 'METHOD' and list_contains(json_keys(j), '{JOB}')",
    "derived_listeners": f"{_G}, {_A} select distinct id as method, trim(unnest(string_split({_GIVEN.format(LISTENER, 'name', 'value')}, ','))) as topic from an where kind = 'METHOD' and list_contains(json_keys(j), '{LISTENER}')",
    "derived_routes": f"""{_G}, {_A}, rt as (select id, kind, coalesce({_GIVEN.format(ROUTE, 'value', 'path')}, '') as val from an where list_contains(json_keys(j), '{ROUTE}')), ty as (select distinct src, dst from e where kind in ('EXTENDS','IMPLEMENTS')), up as (select src, dst from ty union select up.src, ty.dst from up join ty on ty.src = up.dst),
        me as (select c.id as cls, c.val as before, m.id from rt c join e on e.src = c.id and e.kind = 'CONTAINS' join n m on m.id = e.dst and m.kind = 'METHOD' where c.kind in {sql.CODE}),
        own as (select me.id, before, rt.val from me join rt using (id)), inh as (select me.id, before, rt.val, up.dst from me join up on up.src = me.cls join rt on rt.id = up.dst || '#' || substr(me.id, strpos(me.id, '#') + 1) where me.id not in (select id from rt) qualify up.dst = min(up.dst) over (partition by me.id)),
        al as (select * from own union all select id, before, val from inh), b as (select id, trim(unnest(string_split(before, ','))) as before, val from al), v as (select id, before, trim(unnest(string_split(val, ','))) as val from b)
        select distinct id as handler, 'ANY' as verb, '/' || array_to_string(list_filter(string_split(before || '/' || val, '/'), lambda x: x <> ''), '/') as path from v""",
    "derived_beans": f"""{_G}, {_A}, meta as (select '{STEREOTYPE}' as note, 0 as lvl union select an.id, meta.lvl + 1 from meta join an on an.kind = 'ANNOTATION' and list_contains(json_keys(an.j), meta.note) where meta.lvl < 3),
        own as (select an.id, an.kind, m.note, an.j from an join (select distinct note from meta) m on list_contains(json_keys(an.j), m.note) where an.kind in {sql.CODE}),
        gi as (select id, arg_min(coalesce(nullif(trim(j -> note ->> 'value'), ''), nullif(trim(j -> note ->> 'name'), ''), ''), note) as given from own group by id),
        cl as (select id, case when given <> '' then given when regexp_matches(regexp_extract(id, '[^.$]*$'), '^[A-Z][A-Z]') then regexp_extract(id, '[^.$]*$') else lower(left(regexp_extract(id, '[^.$]*$'), 1)) || substr(regexp_extract(id, '[^.$]*$'), 2) end as name, id as type from gi),
        ma as (select m.id, split_part(coalesce({_GIVEN.format(MAKER, 'name', 'value').replace('j ->', 'a.j ->')}, split_part(substr(m.id, strpos(m.id, '#') + 1), '(', 1)), ',', 1) as name, trim(regexp_extract(m.signature, '^(?:.*: )?(.*)$', 1)) as type
            from an c join e on e.src = c.id and e.kind = 'CONTAINS' join n m on m.id = e.dst and m.kind = 'METHOD' and m.signature is not null join an a on a.id = m.id and list_contains(json_keys(a.j), '{MAKER}') where c.kind in {sql.CODE} and list_contains(json_keys(c.j), '{STEREOTYPE}')),
        al as (select * from cl union all select * from ma) select distinct 'bean:' || name || case when (select count(distinct type) from al x where x.name = al.name) > 1 then '@' || type else '' end as id, name, type, id as provider, false as primary, null::varchar as qualifier, null::varchar as profile from al""",
    "annotation_values": f"{_G}, a as (select id, attrs['annotations']::json as j from n where attrs['annotations'] is not null), k as (select id, j, unnest(json_keys(j)) as annotation from a), m as (select id, annotation, j -> annotation as v from k) "
    "select id, annotation, member, v ->> member as value from (select id, annotation, v, unnest(json_keys(v)) as member from m) union all select id, annotation, null, null from m where len(json_keys(v)) = 0",
    "annotation_uses": f"{_G} select e.dst as annotation, n.kind, count(*) as n from e join n on n.id = e.src where e.kind = 'ANNOTATED_WITH' group by 1, 2",
    "undefined_config": f"{_G} select dst as id, count(*) as n, min(src) as first from e where kind = 'BINDS_CONFIG' and dst not in (select id from n where kind = 'CONFIG_KEY' and (coalesce(attrs['defined'] = 'true', false) or attrs['value'] is not null)) group by dst",
    "unread_config": f"{_G} select id from n where kind = 'CONFIG_KEY' and id not in (select dst from e where kind = 'BINDS_CONFIG')",
    "message_links": f"{_G} select distinct p.dst as topic, split_part(p.src, '#', 1) as producer, split_part(c.src, '#', 1) as consumer from e p join e c on c.dst = p.dst and c.kind = 'CONSUMES_FROM' where p.kind = 'PRODUCES_TO'",
    "unused_beans": f"{_G} select distinct dst as bean, split_part(src, '#', 1) as provider from e where kind = 'PROVIDES_BEAN' and dst not in (select dst from e where kind = 'INJECTS')",
    "route_layers": f"{_G}, h as (select regexp_extract(dst, '^route:(\\w+) ', 1) as verb, split_part(src, '#', 1) as id from e where kind = 'HANDLES_ROUTE') select verb, case when contains(id, '.') then regexp_replace(id, '\\.[^.]*$', '') else '' end as pkg, coalesce(attrs['layer'], 'none') as layer, count(*) as n from h join n using (id) group by all",
}
