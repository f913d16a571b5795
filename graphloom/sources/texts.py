"""Facts out of texts by line: Markdown sections, configuration, dependencies, finding tables, Java outlines, logs, mentions of classes.

Nearly all are column expressions over the lines of a text, one text at a time, so nothing but the columns asked for leaves the scan.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import BLANKS, sieve


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line: the lines of each text from 1, without the marks at their ends. Null texts have none."""
    split = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(split).alias("line_no", "line")).select("doc_id", (F.col("line_no") + 1).alias("line_no"), "line")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title, n_lines: the headings of each text and how many lines that aren't blank follow before the next one."""
    heading = F.regexp_extract("line", r"^(#{1,6}) +(\S.*?)\s*$", 1)
    marked = lines(docs).withColumn("level", F.length(heading)).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no")))
    first = F.min(F.when(F.col("level") > 0, F.struct("line_no", "level", F.regexp_extract("line", r"^(#{1,6}) +(\S.*?)\s*$", 2).alias("title")))).alias("h")
    held = marked.where("section > 0").groupBy("doc_id", "section").agg(first, F.sum(((F.col("level") == 0) & (F.trim("line") != "")).cast("int")).alias("n_lines"))
    return held.select("doc_id", "h.line_no", "h.level", "h.title", "n_lines")


def dependencies(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, scope, name, version of the dependency lines of build files."""
    p = r'^\s*(\w+)\("([\w.-]+:[\w.-]+):([\w.-]+)"\)\s*$'
    return lines(docs).where(F.col("line").rlike(p)).select("doc_id", "line_no", F.regexp_extract("line", p, 1).alias("scope"), F.regexp_extract("line", p, 2).alias("name"), F.regexp_extract("line", p, 3).alias("version"))


def finding_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, rule, severity, subject, message of the table lines of finding reports."""
    p = r"^\|\s*([a-z-]+)\s*\|\s*(error|warning|info|note)\s*\|\s*`?([^`|]+?)`?\s*\|\s*(.*?)\s*\|\s*$"
    return lines(docs).where(F.col("line").rlike(p)).select("doc_id", "line_no", *(F.regexp_extract("line", p, k).alias(n) for k, n in enumerate(("rule", "severity", "subject", "message"), 1)))


def java_outline(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, what, name: the package, imports, types and methods that lines of Java source declare."""
    package = F.regexp_extract("line", r"^package\s+([\w.]+);", 1)
    imported = F.regexp_extract("line", r"^import\s+(?:static\s+)?([\w.*]+);", 1)
    declared = F.regexp_extract("line", r"^\s*(?:public |protected |private |abstract |final |static )*(?:class|interface|enum|record)\s+(\w+)", 1)
    method = F.regexp_extract("line", r"^\s*(?:public|protected|private)\s+(?:static |final |abstract )*[\w.<>\[\], ]+\s(\w+)\([^()]*\)\s*(?:throws [\w., ]+)?\{?\s*$", 1)
    what = F.when(package != "", "package").when(imported != "", "import").when(declared != "", "type").when(method != "", "method")
    name = F.when(package != "", package).when(imported != "", imported).when(declared != "", declared).otherwise(method)
    return lines(docs).select("doc_id", "line_no", what.alias("what"), name.alias("name")).where("what is not null")


def bodies(docs: DataFrame) -> DataFrame:
    """doc_id, type, name, first_line, last_line, size: the methods of Java texts with the type above them; a body ends before the next declaration, and size is the number
    of its characters, line ends included."""
    told = java_outline(docs)
    text = lines(docs).join(told.select("doc_id").distinct(), "doc_id", "left_semi")
    marked = text.join(told, ["doc_id", "line_no"], "left")
    upto = Window.partitionBy("doc_id").orderBy("line_no")
    placed = marked.select("doc_id", "line_no", F.length("line").alias("n"), F.last(F.when(F.col("what") == "type", F.col("name")), ignorenulls=True).over(upto).alias("type"),
                           F.last(F.when(F.col("what").isNotNull(), F.struct(F.col("line_no").alias("at"), "what", "name")), ignorenulls=True).over(upto).alias("d"))
    held = placed.where("d.what = 'method'").groupBy("doc_id", "d.at", "d.name").agg(F.first("type").alias("type"), F.max("line_no").alias("last_line"), F.sum(F.col("n") + 1).alias("size"))
    return held.select("doc_id", "type", "name", F.col("at").alias("first_line"), "last_line", "size")


def quota(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first most rows of each group; null keys are a group."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= most).drop("_place")


def budgeted(rows: DataFrame, key: str, order: str, size: str, budget: int, least: int = 400) -> DataFrame:
    """rows with taken: how much of each the budget of its group gives it, in order: all where it fits what is left, else what is left if that is more than least, else none.

    A body that gets none leaves the rest to those behind it, so this is no running sum; the sizes of one group are folded on Arrow batches."""

    def fold(sizes: pd.Series) -> pd.Series:
        def take(each: list[int]) -> list[int]:
            left, out = budget, []
            for n in each:
                got = n if n <= left else left if left > least else 0
                left -= got
                out.append(got)
            return out

        return sizes.map(take)

    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(size).cast("long").alias(size)))).alias("h"))
    given = held.select(F.col(key).alias("_key"), F.explode(F.arrays_zip(F.col(f"h.{order}").alias("at"), F.pandas_udf(fold, "array<long>")(F.col(f"h.{size}")).alias("taken"))).alias("g"))
    return rows.join(given.select("_key", F.col("g.at").alias("_at"), F.col("g.taken").alias("taken")), (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_at"))).drop("_key", "_at")


def log_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, time, level, thread, logger, message of the lines of logs."""
    p = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d) (\w+) \[([^\]]*)\] (\S+) - (.*)$"
    return lines(docs).where(F.col("line").rlike(p)).select("doc_id", "line_no", *(F.regexp_extract("line", p, k).alias(n) for k, n in enumerate(("time", "level", "thread", "logger", "message"), 1)))


def _named(rows: DataFrame, keys: list[str], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rows: keys, text. keys, id: the types whose short name stands in a text as a word, or of Class.member( the member; of members of one name the smallest id.

    nodes: id of types; edges: src, dst of what they hold. Words that name no type end at a sieve, before any shuffle."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]+(?:\.[a-z][A-Za-z0-9]*\()?"), 0))
    words = rows.select(*keys, F.explode(found).alias("w")).select(*keys, F.substring_index("w", ".", 1).alias("name"), F.when(F.contains("w", F.lit("(")), F.substring_index(F.substring_index("w", "(", 1), ".", -1)).alias("called")).withColumn("_h", F.xxhash64("name"))
    types = nodes.select(F.col("id").alias("cls"), F.substring_index(F.substring_index("id", ".", -1), "$", -1).alias("name"))
    met = sieve(words, types.select(F.xxhash64("name").alias("_h")), "_h").drop("_h").join(types, "name")
    held = edges.select(F.col("src").alias("_cls"), F.substring_index(F.substring_index("dst", "#", -1), "(", 1).alias("_called"), F.col("dst").alias("member")).groupBy("_cls", "_called").agg(F.min("member").alias("member"))
    told = met.join(held, (F.col("cls") == F.col("_cls")) & (F.col("called") == F.col("_called")), "left")
    return told.select(*keys, F.coalesce("member", "cls").alias("id")).distinct()


def mentions(docs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, id: the types and members that a text names. nodes: id of types; edges: src, dst of what they hold."""
    return _named(docs.where("doc_id is not null and text is not null").select("doc_id", "text"), ["doc_id"], nodes, edges)


#: Folders whose Markdown is no documentation of the project, and names of files that list every name ever touched.
SKIPPED = (".git", ".claude", ".idea", ".vscode", "build", "target", "node_modules", "out")
NOISE = r"(?i)^(changelog|changes|history|release[-_ ]?notes|releases)\b"


def prose(docs: DataFrame) -> DataFrame:
    """doc_id, id, heading, first_line, last_line, text of the sections of Markdown files, by their path: from one line that begins with # up to the next, the part
    before the first one under the file's name. Sections without text are left out; the text is whole, its lines joined by blanks."""
    name = F.substring_index("path", "/", -1)
    kept = docs.where(F.lower("path").endswith(".md")).where(~name.rlike(NOISE)).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))
    rows = lines(kept).join(kept.select("doc_id", "path"), "doc_id")
    head = F.startswith("line", F.lit("#"))
    marked = rows.withColumn("section", F.sum(head.cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no")))
    said = F.when(~head, F.struct("line_no", F.trim("line", F.lit(BLANKS)).alias("line")))
    title = F.min(F.when(head, F.trim(F.regexp_replace("line", "^#+", ""), F.lit(BLANKS))))
    held = marked.groupBy("doc_id", "path", "section").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), title.alias("title"), F.sort_array(F.collect_list(said))["line"].alias("body"))
    heading = F.when(F.coalesce("title", F.lit("")) == "", name).otherwise(F.col("title"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    told = held.select("doc_id", F.concat(F.lit("doc:"), "path", F.lit("#"), slug).alias("id"), heading.alias("heading"), "first_line", "last_line", F.trim(F.array_join("body", " "), F.lit(BLANKS)).alias("text"))
    return told.where("text <> ''")


def prose_links(sections: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst: each section and the types and members that it names in its heading or text."""
    return _named(sections.select(F.col("id").alias("src"), F.concat_ws("\n", "heading", "text").alias("text")), ["src"], nodes, edges).select("src", F.col("id").alias("dst"))


def _yaml(text: str) -> list[tuple[int, str, str]]:
    """line, key, value of the entries of a YAML text, each line looked at once."""
    out, above, held, items = [], [], None, []

    def flush() -> None:
        nonlocal held
        if held:
            out.append((held[1], held[0], f"[{', '.join(items)}]"))
        held = None
        items.clear()

    for n, raw in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1):
        line = raw.split(" #", 1)[0].rstrip()
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if body == "---":
            flush()
            above.clear()
            continue
        indent = len(line) - len(line.lstrip())
        if body.startswith("- "):
            if held is None and above:
                held = (".".join(k for _, k in above), n, indent)
            if held and held[2] == indent:
                items.append(body[2:].strip().strip("\"'"))
            continue
        if held and indent <= held[2]:
            flush()
        key, colon, value = body.partition(":")
        if not colon or not key:
            continue
        key, value = key.strip().strip("\"'"), value.strip()
        while above and above[-1][0] >= indent:
            above.pop()
        if value in ("", "|", ">"):
            above.append((indent, key))
        else:
            out.append((n, ".".join([*(k for _, k in above), key]), value.strip("\"'")))
    flush()
    return out


def yaml_keys(text: Column) -> Column:
    """The values of a YAML text as an array of (line, key, value): keys joined by dots along the indents, a list as one value [a, b] under its key, comments cut.

    A document mark starts anew; null has null. What stands above a line depends on all lines before, so each text is read line by line, on Arrow batches."""

    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"line": n, "key": k, "value": v} for n, k, v in _yaml(t)])

    return F.pandas_udf(read, "array<struct<line:int,key:string,value:string>>")(text)


def property_keys(text: Column) -> Column:
    """The entries of a properties text as an array of (line, key, value); the first = or : parts them, # and ! start comments."""
    p = r"^\s*([^=:\s#!][^=:]*?)\s*[=:]\s*(.*?)\s*$"
    rows = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("line"), F.regexp_extract(x, p, 1).alias("key"), F.regexp_extract(x, p, 2).alias("value")))
    return F.filter(rows, lambda r: r["key"] != "")


def first_rule(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The rule of the first of a few path patterns, in their order, that a path matches; null if none does."""
    from graphloom.functions.names import ant_pattern

    return F.coalesce(*(F.when(F.rlike(path, ant_pattern(F.lit(p))), rule) for p, rule in rules)) if rules else F.lit(None).cast("string")
