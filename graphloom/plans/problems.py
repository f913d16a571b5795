"""Queries of the general problems over whole tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import at_snapshot, clean_kind, last_snapshot, snapshots, table
from graphloom.operators import hierarchy, orphans, skew
from graphloom.operators import snapshots as changes


def _hierarchy(spark: SparkSession, d: str) -> hierarchy.Hierarchy:
    edges = at_snapshot(table(spark, d, "edges"), last_snapshot(spark, d))
    return hierarchy.build(hierarchy.links_of(edges, clean_kind()))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.positions(_hierarchy(spark, d)).withColumnRenamed("tree", "kind")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(_hierarchy(spark, d)).select(F.col("tree").alias("kind"), "id", F.concat_ws(" > ", "path").alias("path"))


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.intervals(_hierarchy(spark, d)).withColumnRenamed("tree", "kind")


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes each one has below it, from its interval."""
    return hierarchy.intervals(_hierarchy(spark, d)).select(F.col("tree").alias("kind"), "id", "root", (F.col("last") - F.col("first")).alias("n_below"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_hierarchy(spark, d)).withColumnRenamed("tree", "kind")


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, d, "edges").select("snap_no", "src", clean_kind().alias("kind"), "dst")
    return edges, orphans.orphan_keys(edges, table(spark, d, "nodes"), table(spark, d, "snaps"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*_orphans(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per snapshot and reason the keys that are referred to and the deliveries that refer to them."""
    return _orphans(spark, d)[1].groupBy("snap_no", "state").agg(F.count("*").alias("n_keys"), F.sum("refs").alias("n_refs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    snaps = snapshots(spark, d)
    nodes = changes.node_changes(table(spark, d, "nodes"), snaps)
    edges = changes.source_changes(table(spark, d, "edges"), snaps)
    return nodes.select(F.lit("nodes").alias("tab"), "*").unionByName(edges.select(F.lit("edges").alias("tab"), "*"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("tab", "snap_no", "what").agg(F.count("*").alias("n"))


def _last_edges(spark: SparkSession, d: str) -> DataFrame:
    return at_snapshot(table(spark, d, "edges"), last_snapshot(spark, d)).withColumn("kind", clean_kind())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.distinct_per_key(_last_edges(spark, d), ["kind", "dst"], "src", "n_src")


def p5_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Per kind and dst of the last snapshot the exact median, nine tenths and 99 hundredths of the lines that refer to it."""
    return skew.exact_quantiles(_last_edges(spark, d), ["kind", "dst"], "line", [0.5, 0.9, 0.99]).withColumnRenamed("value", "line")


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_intervals, p1_sizes, p1_descendants, p2_found, p2_report, p4_found, p4_counts, p5_found, p5_quantiles)}

_KIND = "upper(trim(kind, E' \\t\\r\\n\\f\\v'))"
_LINKS = f"""
    links as (
        select tree, child, min(parent) as parent from (
            select {_KIND} as tree, case when {_KIND} = 'CONTAINS' then src else dst end as parent, case when {_KIND} = 'CONTAINS' then dst else src end as child
            from edges where snap_no = (select max(snap_no) from snaps) and {_KIND} in ('CONTAINS', 'EXTENDS') and src is not null and dst is not null)
        group by tree, child),
    tops as (select distinct l.tree, l.parent as id from links l left join links u on u.tree = l.tree and u.child = l.parent where u.child is null),
    down as (
        select tree, id, id as root, 0 as depth, id as path from tops
        union all
        select l.tree, l.child, d.root, d.depth + 1, d.path || ' > ' || l.child from down d join links l on l.tree = d.tree and l.parent = d.id)"""
_RINGS = """
    up as (
        select l.tree, l.child as id, l.parent as cur, 1 as n from links l where not exists (select 1 from down d where d.tree = l.tree and d.id = l.child)
        union
        select u.tree, u.id, l.parent, u.n + 1 from up u join links l on l.tree = u.tree and l.child = u.cur where u.n < 60),
    on_ring as (select distinct tree, id from up where id = cur),
    ringed as (select u.tree, u.id, min(u.cur) as root from up u join on_ring r on r.tree = u.tree and r.id = u.cur group by u.tree, u.id)"""
_P2 = """
    has as (select distinct snap_no, id from nodes where id is not null),
    first_last as (select id, min(snap_no) as lo, max(snap_no) as hi from has group by id)"""
_P2_STATE = "case when f.lo < e.snap_no then 'deleted' when f.hi > e.snap_no then 'late' else 'missing' end"
_P4 = f"""
    s as (select snap_no, lead(snap_no) over (order by snap_no) as nxt from snaps),
    n as (select 'nodes' as tab, snap_no, id, coalesce(lower(trim(arg_max_null(sha, coalesce(loaded_at, timestamp '0001-01-01')), E' \\t\\r\\n\\f\\v')), '(null)') as content from nodes where id is not null group by snap_no, id),
    e as (select 'edges' as tab, snap_no, src as id, string_agg(distinct {_KIND} || chr(1) || dst, chr(2) order by {_KIND} || chr(1) || dst) as content from edges where src is not null group by snap_no, src),
    a as (select * from n union all select * from e),
    old as (select a.*, s.nxt from a join s using (snap_no) where s.nxt is not null),
    new as (select a.* from a where snap_no in (select nxt from s)),
    diff as (
        select coalesce(new.tab, old.tab) as tab, coalesce(new.snap_no, old.nxt) as snap_no, coalesce(new.id, old.id) as id,
               case when old.id is null then 'added' when new.id is null then 'removed' else 'changed' end as what
        from old full join new on old.tab = new.tab and old.id = new.id and old.nxt = new.snap_no
        where old.id is null or new.id is null or old.content <> new.content)"""

ORACLE = {
    "p1_found": f"with recursive {_LINKS}, {_RINGS} select tree as kind, id, root, depth from down union all select tree, id, root, -1 from ringed",
    "p1_paths": f"with recursive {_LINKS} select tree as kind, id, path from down",
    "p1_descendants": f"with recursive {_LINKS}, pairs as (select tree, parent as id, child as descendant from links l where exists (select 1 from down d where d.tree = l.tree and d.id = l.child) "
    "union all select p.tree, p.id, l.child from pairs p join links l on l.tree = p.tree and l.parent = p.descendant) select tree as kind, id, descendant from pairs",
    "p1_sizes": f"with recursive {_LINKS}, pairs as (select tree, parent as id, child as descendant from links l where exists (select 1 from down d where d.tree = l.tree and d.id = l.child) "
    "union all select p.tree, p.id, l.child from pairs p join links l on l.tree = p.tree and l.parent = p.descendant), c as (select tree, id, count(*) as n from pairs group by all) select d.tree as kind, d.id, d.root, coalesce(c.n, 0) as n_below from down d left join c on c.tree = d.tree and c.id = d.id",
    "p2_found": f"with {_P2} select distinct e.snap_no, e.src, {_KIND.replace('kind', 'e.kind')} as kind, e.dst, {_P2_STATE} as state from edges e anti join has h on h.snap_no = e.snap_no and h.id = e.dst left join first_last f on f.id = e.dst where e.dst is not null",
    "p2_report": f"with {_P2} select snap_no, state, count(distinct dst) as n_keys, count(*) as n_refs from (select e.snap_no, e.dst, {_P2_STATE} as state from edges e anti join has h on h.snap_no = e.snap_no and h.id = e.dst left join first_last f on f.id = e.dst where e.dst is not null) group by all",
    "p4_found": f"with {_P4} select * from diff",
    "p4_counts": f"with {_P4} select tab, snap_no, what, count(*) as n from diff group by all",
    "p5_found": f"select {_KIND} as kind, dst, count(distinct src) as n_src from edges where snap_no = (select max(snap_no) from snaps) and src is not null group by all",
    "p5_quantiles": f"with l as (select {_KIND} as kind, dst, line from edges where snap_no = (select max(snap_no) from snaps) and line is not null) "
    + " union all ".join(f"select kind, dst, count(*) as n, {q}::double as share, quantile_disc(line, {q})::bigint as line from l group by kind, dst" for q in (0.5, 0.9, 0.99)),
}
