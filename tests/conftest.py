import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folders(tmp_path_factory):
    """The smallest data as it is; without rows; with rows full of nulls and repeated ones; with extra columns of clashing names."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path_factory.mktemp("data")
    clashing = ("nid", "tree", "root", "value", "n", "bin", "_id", "key", "state", "seeds", "place", "h1", "row", "what", "title", "word")
    for kind in ("empty", "dirty", "wide"):
        (root / kind).mkdir()
    for file in os.listdir(DATA):
        table = pq.read_table(f"{DATA}/{file}")
        pq.write_table(table.slice(0, 0), root / "empty" / file)
        nulls = [pa.Table.from_arrays([pa.nulls(1, f.type) for f in table.schema], schema=table.schema)]
        head = table.slice(0, 3)
        for k, f in enumerate(table.schema):
            nulls.append(head.set_column(k, f, pa.nulls(len(head), f.type)))
        pq.write_table(pa.concat_tables([table if file.startswith("snaps") else table.slice(0, 400), table.slice(0, 20), *nulls]), root / "dirty" / file)
        wide = table
        for name in clashing:
            if name not in table.column_names:
                wide = wide.append_column(name, pa.array(["x"] * len(table)))
        pq.write_table(wide, root / "wide" / file)
    (root / "grown").mkdir()
    for file in os.listdir(DATA):
        table = pq.read_table(f"{DATA}/{file}")
        more = {"nodes.parquet": _more_nodes, "edges.parquet": _more_edges}.get(file)
        pq.write_table(pa.Table.from_pylist(more(table.to_pylist()), schema=table.schema) if more else table, root / "grown" / file)
    return {"base": DATA, **{k: str(root / k) for k in ("empty", "dirty", "wide", "grown")}}


#: Annotations that classes and methods of the grown data have by turns.
NOTES = ("org.springframework.stereotype.Repository", "jakarta.ws.rs.Path", "org.springframework.cloud.openfeign.FeignClient", "org.springframework.stereotype.Component", "x.Configuration", "x.EnableThings", "jakarta.persistence.Entity")
METHOD_NOTES = ("x.Scheduled", "lombok.Generated", "x.GetMapping", "x.PreAuthorize")


def _more_nodes(rows):
    """Methods of types again in every type of their package, so that calls are dispatched and methods overridden; annotations that tell layers and entries."""
    last = max(r["snap_no"] for r in rows if r["snap_no"] is not None)
    kind = lambda r: (r["kind"] or "").strip().upper()
    types = sorted({r["id"] for r in rows if r["snap_no"] == last and kind(r) in ("CLASS", "INTERFACE")})
    methods = sorted({r["id"]: r for r in rows if r["snap_no"] == last and kind(r) == "METHOD" and r["id"].split("#")[0] in types}.values(), key=lambda r: r["id"])
    known = {r["id"] for r in rows if r["snap_no"] == last}
    new = []
    for k, m in enumerate(methods[:40]):
        for t in types:
            if (i := f"{t}#{m['id'].split('#')[1]}") not in known:
                known.add(i)
                new.append({**m, "id": i, "fqn": i, "signature": ("public ", "private static ", "")[k % 3] + "void m()", "start_line": 20 + k, "end_line": 20 + k + k % 4, "attrs": [("annotations", f'{{"{METHOD_NOTES[k % 4]}": {{"value": "hasRole{k}"}}}}')] if k % 5 == 0 else []})
    out = []
    for r in rows:
        at = types.index(r["id"]) if r["snap_no"] == last and r["id"] in types else None
        noted = [("annotations", f'{{"{NOTES[at // 5 % len(NOTES)]}": {{}}}}')] if at is not None and at % 5 == 0 else None
        out.append({**r, "attrs": [*noted, *((k, v) for k, v in r["attrs"] or [] if k != "annotations")] if noted else r["attrs"]})
    return out + new


def _more_edges(rows):
    """Beans that nothing injects, a supertype of a data framework, types above types, and calls, overrides and holdings of the added methods."""
    last = max(r["snap_no"] for r in rows if r["snap_no"] is not None)
    some = next(r for r in rows if r["snap_no"] == last)
    own = [r for r in rows if r["snap_no"] == last and r["src"] and r["dst"]]
    held = sorted({r["dst"] for r in own if (r["kind"] or "").strip().upper() == "CONTAINS" and "(" in r["dst"] and "<init>" not in r["dst"]})
    types = sorted({r["src"] for r in own if "#" not in r["src"] and ":" not in r["src"] and (r["kind"] or "").strip().upper() == "CONTAINS"})
    edge = lambda src, dst, kind: {**some, "src": src, "dst": dst, "kind": kind}
    new = [edge(types[k], f"bean:lone{k}", "PROVIDES_BEAN") for k in range(3)] + [edge(types[5], "org.springframework.data.jpa.JpaRepository", "EXTENDS")]
    new += [edge(types[k + 1], types[k], "EXTENDS") for k in range(0, 60, 4)]
    for k, m in enumerate(held[:40]):
        for t in types[k % 7 :: 7]:
            new.append(edge(t, f"{t}#{m.split('#')[1]}", "CONTAINS"))
            if k % 3 == 1:
                new.append(edge(f"{t}#{m.split('#')[1]}", m, "OVERRIDES"))
    return rows + new


def rows(df):
    """The rows of a result as sorted tuples of text, by column name."""
    columns = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
