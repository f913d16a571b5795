"""Every query of the core against its SQL, and over empty, dirty and wide tables."""

import math
import os

import duckdb
import pytest

from graphloom.plans import catalog
from tests.conftest import DATA, rows


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for file in os.listdir(DATA):
        c.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    return c


def _compared(spark, db, name, folder):
    """How many rows a query has; they are those of its SQL."""
    df = catalog.QUERIES[name](spark, folder)
    cursor = db.execute(catalog.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = sorted(tuple(_canon(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(_canon(r[c]) for c in order) for r in df.collect()) == expected
    return len(expected)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, db, name):
    _compared(spark, db, name, DATA)


@pytest.fixture(scope="module")
def grown(folders):
    c = duckdb.connect()
    for file in os.listdir(folders["grown"]):
        c.execute(f"create view {file.removesuffix('.parquet')} as select * from '{folders['grown']}/{file}'")
    return c


@pytest.mark.parametrize("name", ["dispatches", "overrides", "unused_beans", "layers", "layer_violations", "dead_classes", "dead_members", "findings", "index_terms"])
def test_matches_sql_on_grown_data(spark, grown, folders, name):
    """The same where the given data has no or few such rows."""
    assert _compared(spark, grown, name, folders["grown"]) > 0


#: Columns of which a result has each combination once and without a null, however dirty the tables are.
ONCE = {
    "p1_found": ("kind", "id"), "p1_paths": ("kind", "id"), "p1_intervals": ("kind", "id"), "p1_descendants": ("kind", "id", "descendant"), "p2_found": ("snap_no", "src", "kind", "dst"), "p4_found": ("tab", "snap_no", "id"), "tier_merge": ("id",),
    "edges_upserted": ("snap_no", "src", "dst", "kind"), "class_projection": ("src", "dst"), "layers": ("id",), "dead_classes": ("id",), "dead_members": ("id",), "impact": ("id",), "version_changes": ("id",), "betweenness": ("id",), "communities": ("id", "level"),
    "explain_hits": ("question", "id"), "explain_leads": ("question", "id"), "explain_flows": ("question", "entry"), "recalled": ("question", "arg"), "routes": ("id",), "topics": ("id",), "beans": ("id",), "overview": ("module",),
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, folders, name):
    assert catalog.QUERIES[name](spark, folders["empty"]).collect() == []


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_dirty_tables(spark, folders, name):
    """Nulls in every column and repeated rows: no failure, and the rows of the SQL where keys and times are told apart by it as well."""
    df = catalog.QUERIES[name](spark, folders["dirty"])
    found = df.collect()
    assert all(len(r) == len(df.columns) for r in found)
    if name in ONCE:
        keys = [tuple(r[c] for c in ONCE[name]) for r in found]
        assert len(set(keys)) == len(keys) and not any(None in k for k in keys)


@pytest.mark.parametrize("name", ["p1_found", "p1_paths", "p1_intervals", "p2_found", "p2_report", "p4_found", "p5_found", "p5_quantiles", "tier_merge", "edges_upserted", "impact", "recalled", "doc_sections"])
def test_extra_columns(spark, folders, name):
    assert rows(catalog.QUERIES[name](spark, folders["wide"])) == rows(catalog.QUERIES[name](spark, DATA))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
