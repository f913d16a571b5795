"""Readers and parsers on small files."""

import json

from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.sources import files
from graphloom.sources import texts as T
from graphloom.streaming import log

YAML = 'orders:\n  max: 10  # most\n  topic: "shipments"\n  deep:\n    a.b: x\n  list:\n  - one\n---\nspring:\n  name: app\n'


def _values(spark, expr, text):
    return [tuple(e) for e in spark.createDataFrame([(text,)], "value string").select(expr(F.col("value")).alias("e")).first()[0]]


def test_yaml_and_properties(spark):
    assert _values(spark, T.yaml_keys, YAML) == [(2, "orders.max", "10"), (3, "orders.topic", "shipments"), (5, "orders.deep.a.b", "x"), (7, "orders.list", "[one]"), (10, "spring.name", "app")]
    assert _values(spark, T.yaml_keys, "") == [] and _values(spark, T.yaml_keys, "- a\nnot a key\n: x\na:\n  - 'b c'\n  -  d\n    - e\nf: |\n  g: h") == [(5, "a", "[b c, d]"), (9, "f.g", "h")]
    long = "top:\n" + "".join(f"  k{n}: {n}\n" for n in range(200_000))
    assert len(_values(spark, T.yaml_keys, long)) == 200_000
    assert _values(spark, T.property_keys, "# c\na.b = 1\n! d\nc:x=y\n\n") == [(2, "a.b", "1"), (4, "c", "x=y")]


def test_config_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "application.yml").write_text(YAML)
    (tmp_path / "bootstrap-dev.properties").write_text("orders.max=99\nonly=1\n")
    (tmp_path / "other.yml").write_text("x: 1\n")
    found = {r["key"]: r["value"] for r in files.config_values(spark, str(tmp_path)).collect()}
    assert found == {"orders.max": "10", "orders.topic": "shipments", "orders.deep.a.b": "x", "orders.list": "[one]", "spring.name": "app", "only": "1"}


def test_placeholders_and_services(spark, tmp_path):
    texts = spark.createDataFrame([("${a.topic}",), ("x ${a.topic:y} z",), ("${gone:d}",), ("plain",), (None,)], "text string")
    config = spark.createDataFrame([("a.topic", "${ENV_TOPIC:job-events}/${NONE}"), (None, "x")], "key string, value string")
    assert {r["text"]: r["value"] for r in files.resolved(texts, config).collect()} == {"${a.topic}": "job-events/${NONE}", "x ${a.topic:y} z": "job-events/${NONE}", "${gone:d}": "${gone:d}", "plain": "plain", None: None}
    (tmp_path / "m" / "META-INF" / "services").mkdir(parents=True)
    (tmp_path / "m" / "META-INF" / "services" / "p.Codec").write_text("# all\np.One # first\n\n  p.Two\np.One\n")
    (tmp_path / "m" / "other.txt").write_text("p.Three\n")
    assert {tuple(r) for r in files.registrations(spark, str(tmp_path)).collect()} == {("p.Codec", "p.One"), ("p.Codec", "p.Two")}


def test_budget_and_quota(spark):
    sizes = [900, 350, 200, 500, 90, 10]
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate(sizes)] + [(2, 0, 2000), (2, 1, 1), (3, 0, 1200), (3, 1, 5)], "doc_id long, at int, size long")
    found = {(r["doc_id"], r["at"]): r["taken"] for r in T.budgeted(rows, "doc_id", "at", "size", 1200).collect()}
    assert found == {(1, 0): 900, (1, 1): 0, (1, 2): 200, (1, 3): 0, (1, 4): 90, (1, 5): 10, (2, 0): 1200, (2, 1): 0, (3, 0): 1200, (3, 1): 0}
    kept = T.quota(rows, ["doc_id"], [F.desc("size"), F.col("at")], 2)
    assert {(r["doc_id"], r["at"]) for r in kept.collect()} == {(1, 0), (1, 3), (2, 0), (2, 1), (3, 0), (3, 1)}


def test_manifest(spark, tmp_path):
    manifest = {"schema": 1, "extra": 3, "modules": [{"name": "app", "configurations": [{"name": "compile", "artifacts": [{"group": "g", "name": "n", "version": "1", "classification": "external", "file": "/libs/own/n.jar"}, {"classification": "external", "file": "/x/tool.jar"}],
                "conflicts": [{"group": "g", "name": "n", "requested": "0.9", "selected": "1"}]}]}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert {tuple(r) for r in files.artifacts(spark, str(tmp_path), ["own/*.jar"]).collect()} == {("app", "compile", "g:n", "1", "internal"), ("app", "compile", "file:tool", "local", "external")}
    assert [tuple(r) for r in files.conflicts(spark, str(tmp_path)).collect()] == [("app", "g:n", "0.9", "1")]


def test_sarif_and_members(spark, tmp_path):
    result = {"ruleId": "R1", "level": "note", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "src/p/A.java"}, "region": {"startLine": 105}}}]}
    (tmp_path / "r.json").write_text(json.dumps({"runs": [{"tool": {"driver": {"name": "t"}}, "results": [result, {"ruleId": "R2", "message": {"text": "n"}}]}]}))
    nodes = spark.createDataFrame([("p.A", "/repo/src/p/A.java", 1, 200), ("p.A#m()", "/repo/src/p/A.java", 90, 130), ("p.A#n()", "/repo/src/p/A.java", 131, 140)], "id string, file string, start_line int, end_line int")
    found = {r["rule"]: (r["severity"], r["subject"]) for r in files.at_members(files.sarif(spark, str(tmp_path)), nodes).collect()}
    assert found == {"R1": ("info", "p.A#m()"), "R2": ("warning", None)}


def test_log_and_diff(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"t": 5, "kind": "node", "arg": "a"}\nno json\n{"t": 6, "kind": "explain"}\n')
    assert {tuple(r) for r in files.query_log(spark, str(tmp_path / "q.json")).collect()} == {(5, "node", "a"), (6, "explain", None)}
    (tmp_path / "d.diff").write_text("--- a/A.java\n+++ b/A.java\n@@ -1 +2,3 @@\n+x\n@@ -9,2 +12,0 @@\n-y\n--- a/B.java\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n--- a/C.java\n+++ b/C.java\n@@ -3 +4 @@\n+c\n")
    assert {tuple(r) for r in files.changed_lines(spark, str(tmp_path / "d.diff")).collect()} == {("A.java", 2, 4), ("A.java", 12, 12), ("C.java", 4, 4)}


def test_names(spark):
    words = ["running", "carried", "stopped", "queries", "classes", "pass", "falling", "is", "Orders"]
    found = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(names.stem("w")).collect()]
    assert found == ["run", "carry", "stop", "query", "classe", "pass", "fall", "is", "order"]
    ids = spark.createDataFrame([("p.q.Outer$Inner#saveAll(java.lang.String)",), ("Bare",)], "id string")
    row = ids.select(names.simple_name("id").alias("s"), names.owner("id").alias("o"), names.package(names.owner("id")).alias("p"), names.terms("id").alias("t")).collect()
    assert [tuple(r) for r in row] == [("saveAll", "p.q.Outer$Inner", "p.q", "p q Outer Inner saveAll java lang String p q Outer Inner save All java lang String"), ("Bare", "Bare", "", "Bare")]
    rules = [("/a/*/x", "one"), ("/a/{id}", "two"), ("/**", "all")]
    paths = spark.createDataFrame([("/a/b/x",), ("/a/b",), ("/c.d/e",), ("/a/b/c/x",)], "p string").select(T.first_rule(F.col("p"), rules)).collect()
    assert [r[0] for r in paths] == ["one", "two", "all", "all"]


def test_sections_of_markdown(spark):
    docs = [(1, "docs/a/Guide.md", "intro of Kiln\n\n# Fire the  kiln!\r\n Kiln.heat( all day\nand Glaze, not Kilns\n## \n\t\n#x\nlast Kiln.cool()"), (2, "build/x.md", "# a\nb"), (3, "CHANGES.md", "# a\nb"), (4, "a.txt", "# a\nb"), (5, None, "x"), (6, "e.md", None)]
    found = T.prose(spark.createDataFrame(docs, "doc_id long, path string, text string"))
    assert {(r["id"], r["heading"], r["first_line"], r["last_line"], r["text"]) for r in found.collect()} == {
        ("doc:docs/a/Guide.md#guide-md", "Guide.md", 1, 2, "intro of Kiln"), ("doc:docs/a/Guide.md#fire-the-kiln", "Fire the  kiln!", 3, 5, "Kiln.heat( all day and Glaze, not Kilns"), ("doc:docs/a/Guide.md#x", "x", 8, 9, "last Kiln.cool()")}
    nodes = spark.createDataFrame([("p.Kiln",), ("p.Out$Glaze",)], "id string")
    held = spark.createDataFrame([("p.Kiln", "p.Kiln#heat(int)"), ("p.Kiln", "p.Kiln#heat(long)")], "src string, dst string")
    assert {(r["src"].split("#")[1], r["dst"]) for r in T.prose_links(found, nodes, held).collect()} == {("guide-md", "p.Kiln"), ("fire-the-kiln", "p.Kiln#heat(int)"), ("fire-the-kiln", "p.Out$Glaze"), ("x", "p.Kiln")}


def test_units_are_replaced(spark, tmp_path):
    at = str(tmp_path / "units")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, sha string, module string")
    files_of = lambda m: set((tmp_path / "units" / f"module={m}").glob("*.parquet"))
    log.merge_units(at, rows(("a", "1", "m"), ("b", "1", "n")))
    before = files_of("n")
    log.merge_units(at, rows(("c", "2", "m"), ("other", "1", "n")))
    assert files_of("n") == before  # the sha is the same, so the unit stays as it is
    log.merge_units(at, rows(("c", "2", "m"), (None, None, None)))
    assert {(r["id"], r["module"]) for r in spark.read.parquet(at).collect()} == {("c", "m"), ("b", "n")}
