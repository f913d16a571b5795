"""SQL that several queries are held against: the graph of a snapshot."""

from graphloom.operators import graph as G

KIND = "upper(trim({}kind, E' \\t\\r\\n\\f\\v'))"


def graph(snap: str = "(select max(snap_no) from snaps)", n: str = "n", e: str = "e") -> str:
    """The nodes and edges of a snapshot as two named tables."""
    return f"""
    {n} as (select id, {KIND.format('')} as kind, fqn, origin, signature, file, start_line, end_line, doc, sha, module, artifact, attrs from nodes
        where snap_no = {snap} and id is not null qualify row_number() over (partition by id order by loaded_at desc nulls last) = 1),
    {e}_raw as (select src, dst, {KIND.format('')} as kind, resolution, confidence, line, loaded_at from edges where snap_no = {snap} and src is not null and dst is not null and kind is not null),
    {e} as (select a.src, a.dst, a.kind, a.resolution, a.confidence, l.line from
        (select * from {e}_raw qualify row_number() over (partition by src, dst, kind order by loaded_at, resolution, confidence) = 1) a
        left join (select src, dst, kind, line from {e}_raw where line is not null qualify row_number() over (partition by src, dst, kind order by loaded_at, line) = 1) l using (src, dst, kind))"""


CODE, STRUCTURE, IMPACT = str(G.CODE), str(G.STRUCTURE), str(G.IMPACT)
TEST = "coalesce({}attrs['test'] = 'true', false)"
OWNER = "split_part({}, '#', 1)"
MODULE = "(select min(module) from n where module is not null)"


def rendered(attrs: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_transform(map_entries({attrs}), lambda x: x.key || '=' || coalesce(x.value, ''))), '; '), '')"
