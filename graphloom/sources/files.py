"""Readers of the files that a build leaves: manifests, finding reports, query logs, changed lines, configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import placeholder_key, with_defaults
from graphloom.sources.texts import property_keys, yaml_keys

#: The parts of a manifest that are read; anything else in the file is passed over.
MANIFEST = "schema int, buildTool string, root string, modules array<struct<name:string,dir:string,configurations:array<struct<name:string,artifacts:array<struct<group:string,name:string,version:string,classification:string,module:string,file:string>>,conflicts:array<struct<group:string,name:string,requested:string,selected:string>>,unresolved:array<string>>>>>"
SARIF = "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
#: Severities of report levels.
SEVERITY = {"error": "error", "warning": "warning", "note": "info", "none": "info"}


def artifacts(spark: SparkSession, path: str, internal: list[str] | None = None) -> DataFrame:
    """module, configuration, name, version, classification of the artifacts in manifests. Files that match one of the internal globs (* and ?) count as internal."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("modules").alias("m")).select("m.name", F.explode("m.configurations").alias("c"))
    each = rows.select(F.col("name").alias("module"), F.col("c.name").alias("configuration"), F.explode("c.artifacts").alias("a"))
    globs = [g.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*").replace("?", "[^/]") for g in internal or ()]
    own = F.coalesce(F.col("a.file").rlike("^(?:.*/)?(?:" + "|".join(globs) + ")$"), F.lit(False)) if globs else F.lit(False)
    name = F.coalesce(F.concat_ws(":", "a.group", "a.name"), F.lit(""))
    stem = F.regexp_extract("a.file", r"([^/\\]+?)(?:\.jar)?$", 1)
    return each.select("module", "configuration", F.when(name == "", F.concat(F.lit("file:"), stem)).otherwise(name).alias("name"), F.coalesce("a.version", F.lit("local")).alias("version"),
                       F.when((F.col("a.classification") == "external") & own, "internal").otherwise(F.col("a.classification")).alias("classification"))


def conflicts(spark: SparkSession, path: str) -> DataFrame:
    """module, name, requested, selected: versions that lost, each module and name once."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("modules").alias("m")).select(F.col("m.name").alias("module"), F.explode("m.configurations").alias("c"))
    each = rows.select("module", F.col("c.name").alias("configuration"), F.explode("c.conflicts").alias("x")).select("module", "configuration", F.concat_ws(":", "x.group", "x.name").alias("name"), "x.requested", "x.selected")
    return each.groupBy("module", "name").agg(F.min(F.struct("configuration", "requested", "selected")).alias("f")).select("module", "name", "f.requested", "f.selected")


def sarif(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """tool, rule, severity, message, file, line of report results; a result without a place has null there. lines: whether each line is a report, not each file."""
    run = spark.read.schema(SARIF).json(path, multiLine=not lines).select(F.explode("runs").alias("r")).select(F.col("r.tool.driver.name").alias("tool"), F.explode("r.results").alias("x"))
    level = F.create_map(*(F.lit(v) for kv in SEVERITY.items() for v in kv))
    place = F.try_element_at(F.col("x.locations"), F.lit(1))["physicalLocation"]
    return run.select("tool", F.col("x.ruleId").alias("rule"), F.coalesce(F.try_element_at(level, F.col("x.level")), F.lit("warning")).alias("severity"), F.col("x.message.text").alias("message"), place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"))


def at_members(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """findings with subject: the innermost node of the file whose lines hold the finding's, null where none does.

    Files are matched by their last two parts, lines by blocks of a hundred that a node covers, so the range join is an equal join first."""
    tail = lambda c: F.substring_index(F.regexp_replace(c, r"\\", "/"), "/", -2)
    last = F.coalesce("end_line", "start_line")
    spans = nodes.where("file is not null and start_line is not null").select("id", tail("file").alias("tail"), "start_line", last.alias("last"), F.explode(F.sequence(F.floor(F.col("start_line") / 100), F.floor(F.greatest(last, F.col("start_line")) / 100))).alias("block"))
    asked = findings.withColumn("_n", F.monotonically_increasing_id()).withColumn("tail", tail("file")).withColumn("block", F.floor(F.col("line") / 100))
    hit = asked.join(spans, ["tail", "block"]).where("line between start_line and last").groupBy("_n").agg(F.min(F.struct((F.col("last") - F.col("start_line")).alias("size"), "id"))["id"].alias("subject"))
    return asked.join(hit, "_n", "left").drop("_n", "tail", "block")


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """t, kind, arg of a log of JSON lines; lines that are no JSON are passed over."""
    return spark.read.schema("t long, kind string, arg string").json(path, mode="DROPMALFORMED").where("t is not null")


def changed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, first, last of the hunks of a unified diff without context; a deletion stands for the line it is behind.

    Each file of diffs is one text; hunks belong to the last file named above them."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^(?=\+\+\+ )")).alias("part"))
    named = whole.select(F.regexp_extract("part", r"^\+\+\+ (?:b/)?([^\n\t]+)", 1).alias("file"), F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^@@ -\S+ \+(\d+(?:,\d+)?) @@"), 1)).alias("at")).where("file <> '' and file <> '/dev/null'")
    first, count = F.substring_index("at", ",", 1).cast("int"), F.when(F.contains("at", F.lit(",")), F.substring_index("at", ",", -1).cast("int")).otherwise(1)
    return named.select("file", first.alias("first"), F.greatest(first, first + count - 1).alias("last"))


def config_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value, file, line of application and bootstrap files in YAML or properties; of a key in several files the first by name holds."""
    name = F.substring_index("file", "/", -1)
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.input_file_name().alias("file"))
    known = whole.where(name.rlike(r"^(?:application|bootstrap)(?:-[\w.-]+)?\.(?:ya?ml|properties)$"))
    rows = known.select("file", F.explode(F.when(F.endswith("file", F.lit(".properties")), property_keys(F.col("value"))).otherwise(yaml_keys(F.col("value")))).alias("e"))
    return rows.groupBy("e.key").agg(F.min(F.struct("file", "e.line", "e.value")).alias("f")).select("key", "f.value", "f.file", "f.line")


def resolved(texts: DataFrame, config: DataFrame) -> DataFrame:
    """texts: text and more; config: key, value. The same with value: what the placeholder of a text comes down to, its key's value with nested defaults filled in; the text
    itself where it has no placeholder or no file defines its key."""
    known = config.where("key is not null").groupBy("key").agg(F.min("value").alias("_value")).withColumnRenamed("key", "_key")
    return texts.join(known, placeholder_key(F.col("text")) == F.col("_key"), "left").withColumn("value", F.coalesce(with_defaults(F.col("_value")), "text")).drop("_key", "_value")


def registrations(spark: SparkSession, path: str) -> DataFrame:
    """service, provider of the files under META-INF/services: a class per line, what follows a # is a comment."""
    rows = spark.read.text(path, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.trim(F.substring_index("value", "#", 1)).alias("provider"))
    return rows.where(F.contains("file", F.lit("META-INF/services/")) & (F.col("provider") != "")).select(F.substring_index("file", "/", -1).alias("service"), "provider").distinct()


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph as Parquet tables parted by kind, which nearly every question filters by."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")
