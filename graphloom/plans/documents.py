"""Facts out of the project's texts, streams over its log, and questions answered from all of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.common import cut, shared_folder, table
from graphloom.operators import answers as A
from graphloom.operators import derive as D
from graphloom.operators import explain as E
from graphloom.operators import flows as L
from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.plans import sql
from graphloom.plans.searches import _LOG, _POST, _words
from graphloom.plans.walks import _PROJ
from graphloom.sources import files
from graphloom.sources import texts as T
from graphloom.streaming import log

#: Example access rules in the order they are tried.
RULES = [("/*/*s/0", "permitAll"), ("/*/quarrys/**", "hasRole('ADMIN')"), ("/*/{name}/{id}", "authenticated"), ("/**", "denyAll")]

def doc_sections(spark: SparkSession, d: str) -> DataFrame:
    return T.sections(table(spark, d, "documents"))


def doc_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return T.dependencies(table(spark, d, "documents"))


def doc_findings(spark: SparkSession, d: str) -> DataFrame:
    return T.finding_rows(table(spark, d, "documents"))


def report_read_back(spark: SparkSession, d: str) -> DataFrame:
    """The finding tables of texts written as finding reports and read as reports are, each finding at the member whose lines hold its line."""
    folder = f"{shared_folder(spark)}/sarif-{uuid.uuid4().hex}"
    rows = T.finding_rows(table(spark, d, "documents"))
    place = F.array(F.struct(F.struct(F.struct(F.lit("src/x/A.java").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation")))
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))
    runs = rows.groupBy("doc_id").agg(F.collect_list(result).alias("results")).select(F.array(F.struct(F.struct(F.struct(F.concat(F.lit("doc"), "doc_id").alias("name")).alias("driver")).alias("tool"), "results")).alias("runs"))
    runs.write.json(folder)
    return files.sarif(spark, folder, lines=True).groupBy("tool", "rule", "severity").agg(F.count("*").alias("n"), F.max("line").alias("last_line"))


def doc_outline(spark: SparkSession, d: str) -> DataFrame:
    return T.java_outline(table(spark, d, "documents"))


def doc_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The two longest methods of each type in each text, and how much of them a budget of 300 tokens for a text gives, in the order of their lines."""
    kept = T.quota(T.bodies(table(spark, d, "documents")), ["doc_id", "type"], [F.desc("size"), F.col("first_line")], 2)
    return T.budgeted(kept, "doc_id", "first_line", "size", 1200)


def doc_logs(spark: SparkSession, d: str) -> DataFrame:
    return T.log_lines(table(spark, d, "documents")).groupBy("level", "logger").agg(F.count("*").alias("n"), F.max("time").alias("last"))


def _own_types(g: G.Graph) -> tuple[DataFrame, DataFrame]:
    """The project's own types that texts name, and what they hold."""
    return g.nodes.where("kind in ('CLASS', 'INTERFACE', 'ENUM', 'RECORD') and origin = 'REPO'"), g.edges.where("kind = 'CONTAINS'")


def doc_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Types and members of the graph by the documents that name them."""
    return T.mentions(table(spark, d, "documents"), *_own_types(G.load(spark, d))).groupBy("id").agg(F.count("*").alias("n_docs"))


def doc_prose(spark: SparkSession, d: str) -> DataFrame:
    """The sections of Markdown files."""
    return T.prose(table(spark, d, "documents"))


def doc_prose_links(spark: SparkSession, d: str) -> DataFrame:
    """What each section of a Markdown file names."""
    return T.prose_links(T.prose(table(spark, d, "documents")), *_own_types(G.load(spark, d)))


def doc_config(spark: SparkSession, d: str) -> DataFrame:
    """Keys and values of the documents that begin as YAML does."""
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"^[\w-]+:\s*\n\s+[\w-]+:"))
    return docs.select("doc_id", F.explode(T.yaml_keys(F.col("text"))).alias("e")).select("doc_id", "e.line", "e.key", "e.value")


def route_access(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that each route's path matches."""
    paths = G.load(spark, d).nodes.where("kind = 'HTTP_ROUTE'").select("id", F.regexp_extract("id", r"^route:\w+ (\S+)", 1).alias("path"))
    return paths.select("id", "path", T.first_rule(F.col("path"), RULES).alias("rule"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The runs of one kind of entries in the query log as a stream finds them."""
    stream = log.closing(log.log_stream(spark, f"{d}/query_log.parquet", table(spark, d, "query_log").schema))
    schema = "kind string, w struct<start:timestamp,end:timestamp>, n long, end timestamp, batch long"
    found = spark.read.schema(schema).parquet(log.run_to_table(log.session_counts(stream), "sessions")).where("kind is not null")
    start = F.unix_timestamp(F.col("w.start"))
    return found.select("kind", start.alias("session"), "n", (F.unix_timestamp("end") - start).alias("seconds"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """The ten ids that tell most about each logged question: every stem is a probe whose hits count by their place, rare probes three times and common ones half;
    kinds weigh differently, and so does how many classes depend on an id. A top-k report per question, ties by id."""
    g = G.load(spark, d)
    nodes = cut(g.nodes.select("id", "kind", "fqn", "signature", "doc", "attrs"))
    asked = cut(S.log_entries(table(spark, d, "query_log")).where("kind = 'explain'").select(F.col("arg").alias("question")).distinct().select("question", F.explode(S.question_words("question")).alias("word")))
    probes = asked.select(F.col("word").alias("query"), F.array("word").alias("words")).distinct()
    hits = S.ranked(cut(S.postings(nodes)), probes, 15).join(nodes.select("id", "kind"), "id")
    code = F.count(F.when(G.is_code() | F.col("kind").isin("METHOD", "CONSTRUCTOR"), 1)).over(Window.partitionBy("query"))
    factor = F.when(code <= 2, 3.0).when(code >= 12, 0.5).otherwise(1.0)
    degree = D.in_degrees(cut(D.class_projection(g)))
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in E.KIND_WEIGHTS.items() for v in kv)), F.col("kind")), F.lit(1.0))
    scored = hits.withColumn("part", factor / F.col("place")).join(degree, "id", "left").select("id", F.col("query").alias("word"), (F.col("part") * weight * (1 + F.log10(1 + F.coalesce("n", F.lit(0))) / 2)).alias("part"))
    summed = asked.join(scored, "word").groupBy("question", "id").agg(F.round(F.sum("part"), 5).alias("score"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return summed.withColumn("place", place).where("place <= 10")


def _explained(spark: SparkSession, d: str) -> tuple[G.Graph, DataFrame, DataFrame, A.Asked, Callable[[], DataFrame]]:
    """The graph, facts about its nodes, its class projection, the logged questions as tasks answer them, and what they hit by joins."""
    g = G.load(spark, d)
    g = G.Graph(cut(g.nodes), cut(g.edges))
    projection = cut(D.class_projection(g))
    facts = cut(E.node_facts(g, D.in_degrees(projection)))
    entries = cut(S.log_entries(table(spark, d, "query_log")))
    questions = cut(entries.where("kind = 'explain'").select(F.col("arg").alias("question")).distinct())
    index, recalled = cut(S.postings(g.nodes)), cut(S.recall(entries, questions))
    return g, facts, projection, A.Asked(g, index, facts, questions, recalled), lambda: E.hits(g, index, facts, questions, recalled)


def explain_hits(spark: SparkSession, d: str) -> DataFrame:
    """The ten best matches of each logged question."""
    _, facts, _, asked, scores = _explained(spark, d)
    return asked.matched(asked.held()) if asked.small() else E.matched(facts, scores())


def explain_leads(spark: SparkSession, d: str) -> DataFrame:
    """The five members whose bodies lead the answer to each logged question."""
    g, facts, projection, asked, scores = _explained(spark, d)
    layers = D.layers(g, projection)
    return asked.leads(asked.held(), layers) if asked.small() else E.leads(g, facts, layers, scores())


def explain_flows(spark: SparkSession, d: str) -> DataFrame:
    """The three flows that tell most about each logged question."""
    g, facts, _, asked, scores = _explained(spark, d)
    flows = cut(L.flows(g))
    return asked.flow_ranks(asked.held(), flows) if asked.small() else E.flow_ranks(g, facts, flows, asked.questions, scores())


QUERIES = {f.__name__: f for f in (doc_sections, doc_dependencies, doc_findings, report_read_back, doc_bodies, doc_outline, doc_logs, doc_mentions, doc_prose, doc_prose_links, doc_config, route_access, stream_sessions, answers, explain_hits, explain_leads, explain_flows)}

_LINES = "ln as (select doc_id, unnest(range(1, len(x) + 1)) as line_no, unnest(x) as line from (select doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) as x from documents where doc_id is not null and text is not null))"
_G = f"with recursive {sql.graph()}"
_EX = "regexp_extract(line, '{}', {})".format
_DEP = '^\\s*(\\w+)\\("([\\w.-]+:[\\w.-]+):([\\w.-]+)"\\)\\s*$'
_FIND = "^\\|\\s*([a-z-]+)\\s*\\|\\s*(error|warning|info|note)\\s*\\|\\s*`?([^`|]+?)`?\\s*\\|\\s*(.*?)\\s*\\|\\s*$"
_LOGP = "^(\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d) (\\w+) \\[([^\\]]*)\\] (\\S+) - (.*)$"
_HEAD = "^(#{1,6}) +(\\S.*?)\\s*$"
_JAVA = {"package": "^package\\s+([\\w.]+);", "import": "^import\\s+(?:static\\s+)?([\\w.*]+);", "type": "^\\s*(?:public |protected |private |abstract |final |static )*(?:class|interface|enum|record)\\s+(\\w+)",
         "method": "^\\s*(?:public|protected|private)\\s+(?:static |final |abstract )*[\\w.<>\\[\\], ]+\\s(\\w+)\\([^()]*\\)\\s*(?:throws [\\w., ]+)?\\{?\\s*$"}

_IDENT = "\\b[A-Z][A-Za-z0-9]+(?:\\.[a-z][A-Za-z0-9]*\\()?"
_TYPES = "tp as (select id, regexp_extract(id, '[^.$]*$') as name from n where kind in ('CLASS','INTERFACE','ENUM','RECORD') and origin = 'REPO')"
_MET = "met as (select {0}, coalesce((select min(dst) from e where e.kind = 'CONTAINS' and e.src = tp.id and contains(w.w, '(') and split_part(regexp_extract(e.dst, '[^#]*$'), '(', 1) = split_part(split_part(w.w, '.', 2), '(', 1)), tp.id) as id from w join tp on tp.name = split_part(w.w, '.', 1))"
_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
_PROSE = f"""pl as (select doc_id, path, line_no, line, starts_with(line, '#') as head, sum(starts_with(line, '#')::int) over (partition by doc_id order by line_no) as sec from ln join (select doc_id, path from documents where lower(path) like '%.md'
        and not regexp_matches(regexp_extract(path, '[^/]*$'), '{T.NOISE}') and not list_has_any(string_split(path, '/'), {list(T.SKIPPED)})) using (doc_id)),
    ps as (select doc_id, path, sec, min(line_no)::int as first_line, max(line_no)::int as last_line, max(trim(ltrim(line, '#'), {_WS})) filter (where head) as title, trim(coalesce(string_agg(trim(line, {_WS}), ' ' order by line_no) filter (where not head), ''), {_WS}) as text from pl group by all),
    pt as (select *, case when coalesce(title, '') = '' then regexp_extract(path, '[^/]*$') else title end as heading from ps where text <> ''),
    prose as (select doc_id, 'doc:' || path || '#' || trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') as id, heading, first_line, last_line, text from pt)"""

ORACLE = {
    "doc_sections": f"with {_LINES}, h as (select *, length({_EX(_HEAD, 1)}) as level, sum((length({_EX(_HEAD, 1)}) > 0)::int) over (partition by doc_id order by line_no) as sec from ln) select doc_id, (min(line_no) filter (where level > 0))::int as line_no, (min(level) filter (where level > 0))::int as level, arg_min({_EX(_HEAD, 2)}, line_no) filter (where level > 0) as title, sum((level = 0 and trim(line) <> '')::int)::bigint as n_lines from h where sec > 0 group by doc_id, sec",
    "doc_dependencies": f"with {_LINES} select doc_id, line_no::int as line_no, {_EX(_DEP, 1)} as scope, {_EX(_DEP, 2)} as name, {_EX(_DEP, 3)} as version from ln where regexp_matches(line, '{_DEP}')",
    "doc_findings": f"with {_LINES} select doc_id, line_no::int as line_no, {_EX(_FIND, 1)} as rule, {_EX(_FIND, 2)} as severity, {_EX(_FIND, 3)} as subject, {_EX(_FIND, 4)} as message from ln where regexp_matches(line, '{_FIND}')",
    "report_read_back": f"with {_LINES} select 'doc' || doc_id as tool, {_EX(_FIND, 1)} as rule, case when {_EX(_FIND, 2)} = 'note' then 'info' else {_EX(_FIND, 2)} end as severity, count(*) as n, max(line_no)::int as last_line from ln where regexp_matches(line, '{_FIND}') group by 1, 2, 3",
    "doc_bodies": f"""with recursive {_LINES}, o as (select * from (select doc_id, line_no, case {' '.join(f"when {_EX(p, 1)} <> '' then '{w}'" for w, p in _JAVA.items())} end as what, case {' '.join(f"when {_EX(p, 1)} <> '' then {_EX(p, 1)}" for p in _JAVA.values())} end as name from ln) where what is not null),
        m as (select ln.doc_id, ln.line_no, length(ln.line) as n, last_value(case when what = 'type' then name end ignore nulls) over w as type, last_value(case when what is not null then ln.line_no end ignore nulls) over w as at from ln left join o using (doc_id, line_no) where doc_id in (select doc_id from o) window w as (partition by ln.doc_id order by ln.line_no)),
        b as (select m.doc_id, any_value(m.type) as type, o.name, m.at::int as first_line, max(m.line_no)::int as last_line, sum(n + 1)::bigint as size from m join o on o.doc_id = m.doc_id and o.line_no = m.at where o.what = 'method' group by m.doc_id, m.at, o.name),
        q as (select * from b qualify row_number() over (partition by doc_id, type order by size desc, first_line) <= 2), k as (select *, row_number() over (partition by doc_id order by first_line) as i from q),
        t as (select doc_id, i, case when size <= 1200 then size else 1200 end as taken, 1200 - case when size <= 1200 then size else 1200 end as left_ from k where i = 1
            union all select k.doc_id, k.i, case when size <= left_ then size when left_ > 400 then left_ else 0 end, left_ - case when size <= left_ then size when left_ > 400 then left_ else 0 end from t join k on k.doc_id = t.doc_id and k.i = t.i + 1)
        select k.doc_id, type, name, first_line, last_line, size, taken::bigint as taken from k join t using (doc_id, i)""",
    "doc_outline": f"with {_LINES} select * from (select doc_id, line_no::int as line_no, case " + " ".join(f"when {_EX(p, 1)} <> '' then '{w}'" for w, p in _JAVA.items()) + " end as what, case " + " ".join(f"when {_EX(p, 1)} <> '' then {_EX(p, 1)}" for p in _JAVA.values()) + " end as name from ln) where what is not null",
    "doc_logs": f"with {_LINES} select {_EX(_LOGP, 2)} as level, {_EX(_LOGP, 4)} as logger, count(*) as n, max({_EX(_LOGP, 1)}) as last from ln where regexp_matches(line, '{_LOGP}') group by 1, 2",
    "doc_mentions": f"{_G}, {_TYPES}, w as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '{_IDENT}'))) as w from documents where doc_id is not null and text is not null), {_MET.format('doc_id')} select id, count(distinct doc_id) as n_docs from met group by id",
    "doc_prose": f"with {_LINES}, {_PROSE} select * from prose",
    "doc_prose_links": f"{_G}, {_TYPES}, {_LINES}, {_PROSE}, w as (select id as src, unnest(list_distinct(regexp_extract_all(heading || chr(10) || text, '{_IDENT}'))) as w from prose), {_MET.format('src')} select distinct src, id as dst from met",
    "route_access": f"{_G}, p as (select id, regexp_extract(id, '^route:\\w+ (\\S+)', 1) as path from n where kind = 'HTTP_ROUTE') select id, path, case when regexp_matches(path, '^/[^/]*/[^/]*s/0$') then 'permitAll' when regexp_matches(path, '^/[^/]*/quarrys/.*$') then 'hasRole(''ADMIN'')' when regexp_matches(path, '^/[^/]*/[^/]+/[^/]+$') then 'authenticated' when regexp_matches(path, '^/.*$') then 'denyAll' end as rule from p",
    "stream_sessions": f"with {_LOG}, s as (select *, case when t - lag(t) over (partition by kind order by t) >= {S.REMEMBERED} or lag(t) over (partition by kind order by t) is null then t end as st from l), g as (select t, kind, max(st) over (partition by kind order by t range between unbounded preceding and current row) as session from s) select kind, session, count(*) as n, max(t) - min(t) as seconds from g group by kind, session",
    "answers": f"""{_G}, {_POST}, {_PROJ}, {_LOG}, asked as (select distinct question, unnest({_words('question')}) as word from (select distinct arg as question from l where kind = 'explain')),
        lens as (select id, sum(tf) as len from post group by id), hits as (select a.word, p.id, sum(p.tf) as f from (select distinct word from asked) a join post p on starts_with(p.term, a.word) group by all), df as (select word, count(*) as df from hits group by word),
        part as (select word, id, round(greatest(ln(((select count(*) from lens) - df + 0.5) / (df + 0.5)), 1e-6) * f * {S.K1 + 1} / (f + {S.K1} * ({1 - S.B} + {S.B} * len / (select avg(len) from lens))), 6) as score from hits join df using (word) join lens using (id)),
        top as (select *, row_number() over (partition by word order by score desc, id) as pl from part qualify pl <= 15), kc as (select t.*, n.kind, count(case when n.kind in {sql.CODE} or n.kind in ('METHOD','CONSTRUCTOR') then 1 end) over (partition by t.word) as code from top t join n using (id)),
        deg as (select dst as id, count(*) as n from proj group by dst), sc as (select k.id, k.word, (case when code <= 2 then 3.0 when code >= 12 then 0.5 else 1.0 end)::double / pl * case kind {' '.join(f"when '{k}' then {v}" for k, v in E.KIND_WEIGHTS.items())} else 1 end * (1 + log10(1 + coalesce(deg.n, 0)) / 2) as part from kc k left join deg using (id)),
        su as (select question, id, round(sum(part), 5) as score from asked join sc using (word) group by all) select question, id, score, row_number() over (partition by question order by score desc, id)::int as place from su qualify place <= 10""",
}
