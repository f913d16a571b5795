"""Search, memory and scores over the graph, the query log and the evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import cut, table
from graphloom.functions import names
from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.plans import sql


def name_terms(spark: SparkSession, d: str) -> DataFrame:
    return G.load(spark, d).nodes.select("id", names.terms("fqn").alias("terms"), names.simple_name("id").alias("simple"))


def stems(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words of node comments with their stems and the nodes that have them."""
    words = G.load(spark, d).nodes.where("doc is not null").select("id", F.explode(F.array_distinct(F.filter(F.split(F.lower("doc"), "[^a-z]+"), lambda t: t != ""))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", names.stem("word").alias("stem"), "n")


def index_terms(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(G.load(spark, d).nodes).groupBy("term").agg(F.count("*").alias("n_ids"), F.sum("tf").alias("n"))


def search_classes(spark: SparkSession, d: str) -> DataFrame:
    """The best ten ids for the two commonest words of class names, and for the pair of the first and each other of the ten commonest."""
    nodes = G.load(spark, d).nodes
    common = S.vocabulary(nodes).orderBy(F.desc("n"), "term").limit(10)
    first = common.orderBy(F.desc("n"), "term").limit(1).select(F.col("term").alias("first"))
    asked = common.crossJoin(F.broadcast(first)).select(F.concat_ws(" ", "first", "term").alias("query"), F.array_distinct(F.array("first", "term")).alias("words"))  # ten rows with one
    return S.ranked(cut(S.postings(nodes)), asked)


def log_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The sessions of the query log with their entries and questions."""
    of = S.sessions(S.log_entries(table(spark, d, "query_log")))
    return of.groupBy("session").agg(F.count("*").alias("n"), F.sum((F.col("kind") == "explain").cast("int")).alias("n_questions"), (F.max("t") - F.min("t")).alias("seconds"))


def log_fetches(spark: SparkSession, d: str) -> DataFrame:
    return S.fetches(S.log_entries(table(spark, d, "query_log")))


def recalled(spark: SparkSession, d: str) -> DataFrame:
    """For each question of the log what was fetched after questions alike, itself included."""
    entries = cut(S.log_entries(table(spark, d, "query_log")))
    return S.recall(entries, entries.where("kind = 'explain'").select(F.col("arg").alias("question")))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return S.vocabulary(G.load(spark, d).nodes)


def vocabulary_near(spark: SparkSession, d: str) -> DataFrame:
    """Terms near the words of logged questions that name no class part."""
    vocab = cut(S.vocabulary(G.load(spark, d).nodes))
    words = S.log_entries(table(spark, d, "query_log")).where("kind = 'explain'").select(F.explode(S.question_words("arg")).alias("word")).distinct()
    return S.nearby(words.join(vocab.select(F.col("term").alias("word")), "word", "left_anti"), vocab)


def vocabulary_own(spark: SparkSession, d: str) -> DataFrame:
    return S.own_vocabulary(G.load(spark, d).nodes)


def vocabulary_own_near(spark: SparkSession, d: str) -> DataFrame:
    """Terms of all own nodes near the words of logged questions that are no such term."""
    vocab = cut(S.own_vocabulary(G.load(spark, d).nodes))
    words = S.log_entries(table(spark, d, "query_log")).where("kind = 'explain'").select(F.explode(S.question_words("arg")).alias("word")).distinct()
    return S.own_nearby(words.join(vocab.select(F.col("term").alias("word")), "word", "left_anti"), vocab)


def subsystem_cards(spark: SparkSession, d: str) -> DataFrame:
    """The types that each logged question names as a whole, with the member that does their work."""
    return S.subsystems(G.load(spark, d), S.log_entries(table(spark, d, "query_log")).where("kind = 'explain'").select(F.col("arg").alias("question")))


def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    """What the comment of each node says first."""
    return G.load(spark, d).nodes.where("doc is not null").select("id", names.first_sentence(F.col("doc")).alias("sentence")).where("sentence is not null")


def bench_scores(spark: SparkSession, d: str) -> DataFrame:
    """How much of each item's expected ids its text names: precision, recall and the upper median of text lengths in tokens per suite.

    An expected id counts as named if its class's short name is a word of the text; of alternatives a|b one is enough."""
    items = table(spark, d, "eval_items").where("item_id is not null and text is not null").dropDuplicates(["item_id"])
    words = items.select("item_id", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_]+"))).alias("w")).where(F.col("w").rlike("^[A-Z][a-z]+[A-Z]"))
    wanted = items.select("item_id", F.explode(F.array_distinct("expected")).alias("x")).select("item_id", "x", F.explode(F.split("x", r"\|")).alias("w")).select("item_id", "x", F.substring_index("w", "#", 1).alias("w"))
    named = words.groupBy("item_id").agg(F.count("*").alias("n_named"))
    met = wanted.join(words, ["item_id", "w"], "left_semi").select("item_id", "x").distinct().groupBy("item_id").agg(F.count("*").alias("n_met"))
    need = wanted.select("item_id", "x").distinct().groupBy("item_id").agg(F.count("*").alias("n_need"))
    each = items.select("item_id", "suite", F.floor(F.length("text") / 4).alias("tokens")).join(named, "item_id", "left").join(met, "item_id", "left").join(need, "item_id", "left")
    precision, recall = F.coalesce(F.col("n_met") / F.col("n_named"), F.lit(0.0)), F.coalesce(F.coalesce("n_met", F.lit(0)) / F.col("n_need"), F.lit(0.0))
    median = F.element_at(F.sort_array(F.collect_list("tokens")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return each.groupBy("suite").agg(F.count("*").alias("n"), F.round(F.avg(precision), 6).alias("precision"), F.round(F.avg(recall), 6).alias("recall"), F.round(F.avg((recall >= 0.999).cast("int")), 6).alias("full_share"), median.alias("median_tokens"))


QUERIES = {f.__name__: f for f in (name_terms, stems, index_terms, search_classes, log_sessions, log_fetches, recalled, vocabulary, vocabulary_near, vocabulary_own, vocabulary_own_near, subsystem_cards, first_sentences, bench_scores)}

_G = f"with recursive {sql.graph()}"
_TERMS = "trim(regexp_replace(fqn, '[.#$(),\\[\\]<>]+', ' ', 'g'), ' ')"
_CAMEL = f"regexp_replace({_TERMS}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
_UNDOUBLE = "(case when length({0}) > 3 and right({0}, 1) = left(right({0}, 2), 1) and not contains('lszaeiou', right({0}, 1)) then left({0}, length({0}) - 1) else {0} end)"


def _stem(w: str) -> str:
    return (f"case when length({w}) > 5 and {w} like '%ing' then {_UNDOUBLE.format(f'left({w}, length({w}) - 3)')} when length({w}) > 4 and {w} like '%ied' then left({w}, length({w}) - 3) || 'y' when length({w}) > 4 and {w} like '%ed' then {_UNDOUBLE.format(f'left({w}, length({w}) - 2)')} "
            f"when length({w}) > 4 and {w} like '%ies' then left({w}, length({w}) - 3) || 'y' when length({w}) > 3 and {w} like '%s' and {w} not like '%ss' then left({w}, length({w}) - 1) else {w} end")


_NOTE = "regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
_POST = f"""an as (select id, unnest(json_keys(attrs['annotations']::json)) as k, attrs['annotations']::json as j from n where attrs['annotations'] is not null),
    am as (select id, k, unnest(case when len(json_keys(j -> k)) = 0 then [null] else json_keys(j -> k) end) as m, j -> k as v from an),
    aw as (select id, string_agg(t, ' ') as t from (select id, k, trim(regexp_replace(concat_ws(' ', regexp_extract(k, '[^.]*$'), string_agg(v ->> m, ' ')), '[.#$(),\\[\\]<>]+', ' ', 'g')) as t from am group by id, k) group by id),
    post as (select id, term, count(*) as tf from (select n.id, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', case when {_TERMS} = {_CAMEL} then {_TERMS} else {_TERMS} || ' ' || {_CAMEL} end,
        case when aw.t = {_NOTE.format('aw.t')} then aw.t else aw.t || ' ' || {_NOTE.format('aw.t')} end, signature, doc)), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) as term from n left join aw on aw.id = n.id) group by all)"""
_VOCAB = f"""vocab as (select term, count(*) as n from (select id, unnest(list_distinct(list_transform(string_split(regexp_replace(regexp_extract(id, '[^.$]*$'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda p: lower(p)))) as term from n where kind in {sql.CODE}) where length(term) > 2 group by term)"""
_OWN = f"""own as (select lower(term) as term, count(*) as n from (select unnest(regexp_split_to_array(regexp_replace(case when kind in ('CONFIG_KEY','HTTP_ROUTE') then fqn else regexp_extract(split_part(id, '(', 1), '[^#.$]*$') end, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+')) as term
    from n where kind in {S.OWN_KINDS} and coalesce(origin, '') <> 'EXTERNAL') where length(term) between 3 and 30 group by 1)"""
_LOG = "l as (select distinct t, lower(trim(kind, E' \\t\\r\\n\\f\\v')) as kind, arg from query_log where t is not null and arg is not null and kind is not null)"
_FETCH = f"""{_LOG}, q as (select t as qt, max(arg) as question from l where kind = 'explain' group by t), f as (select l.t, l.arg, arg_max(q.question, q.qt) as question from l join q on q.qt <= l.t and l.t - q.qt <= {S.REMEMBERED} where l.kind in ('source','node') group by all)"""


def _words(c: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 2 and t not in {S.STOP}), lambda w: {_stem('w')}))"



ORACLE = {
    "name_terms": f"{_G} select id, case when {_TERMS} = {_CAMEL} then {_TERMS} else {_TERMS} || ' ' || {_CAMEL} end as terms, regexp_extract(split_part(id, '(', 1), case when contains(split_part(id, '(', 1), '#') then '[^#$]*$' else '[^.$]*$' end) as simple from n",
    "stems": f"{_G}, w as (select id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(doc), '[^a-z]+'), lambda t: t <> ''))) as word from n where doc is not null), k as (select word, count(*) as n from w group by word) select word, {_stem('word')} as stem, n from k",
    "index_terms": f"{_G}, {_POST} select term, count(*) as n_ids, sum(tf)::bigint as n from post group by term",
    "search_classes": f"""{_G}, {_POST}, {_VOCAB}, common as (select * from vocab order by n desc, term limit 10), first as (select term as f from common order by n desc, term limit 1),
        asked as (select distinct f || ' ' || term as query, unnest([f, term]) as word from common, first), need as (select query, count(*) as need from asked group by query), lens as (select id, sum(tf) as len from post group by id),
        hits as (select a.word, p.id, sum(p.tf) as f from (select distinct word from asked) a join post p on starts_with(p.term, a.word) group by all), df as (select word, count(*) as df from hits group by word),
        part as (select word, id, greatest(ln(((select count(*) from lens) - df + 0.5) / (df + 0.5)), 1e-6) * f * {S.K1 + 1} / (f + {S.K1} * ({1 - S.B} + {S.B} * len / (select avg(len) from lens))) as part from hits join df using (word) join lens using (id)),
        s as (select query, id, round(sum(part), 6) as score from asked join part using (word) join need using (query) group by query, id, need having count(*) = need)
        select query, id, score, row_number() over (partition by query order by score desc, id)::int as place from s qualify place <= 10""",
    "log_sessions": f"""with {_LOG}, s as (select *, case when t - lag(t) over (order by t) > {S.REMEMBERED} or lag(t) over (order by t) is null then t end as st from l), g as (select t, kind, arg, max(st) over (order by t range between unbounded preceding and current row) as session from s)
        select session, count(*) as n, sum((kind = 'explain')::int)::bigint as n_questions, max(t) - min(t) as seconds from g group by session""",
    "log_fetches": f"with {_FETCH} select * from f",
    "recalled": f"""with {_FETCH}, cnt as (select question, arg, count(*) as n from f group by all), past as (select distinct question, {_words('question')} as w from cnt), ask as (select distinct arg as ask, {_words('arg')} as w from l where kind = 'explain'),
        alike as (select p.question, a.ask from past p join ask a on len(list_intersect(p.w, a.w)) >= {S.ALIKE} * len(list_distinct(list_concat(p.w, a.w))) where len(p.w) > 0 and len(a.w) > 0)
        select a.ask as question, c.arg, sum(c.n)::bigint as n, row_number() over (partition by a.ask order by sum(c.n) desc, c.arg)::int as place from alike a join cnt c using (question) group by a.ask, c.arg qualify place <= 3""",
    "vocabulary": f"{_G}, {_VOCAB} select * from vocab",
    "vocabulary_near": f"""{_G}, {_VOCAB}, {_LOG}, w as (select distinct unnest({_words('arg')}) as word from l where kind = 'explain')
        select word, term, n, row_number() over (partition by word order by n desc, term)::int as place from w join vocab on left(word, 4) = left(term, 4) where length(word) >= 4 and length(term) >= 4 and word not in (select term from vocab) qualify place <= 20""",
    "subsystem_cards": f"""{_G}, {_LOG}, q as (select distinct arg as question, {_words('arg')} as ws from l where kind = 'explain'), w as (select question, unnest(ws) as w from q), tp as (select id from n where kind in ('CLASS','INTERFACE','ENUM','RECORD') and origin = 'REPO' and file is not null and not {sql.TEST.format('')}),
        nm as (select id, lower(regexp_extract(id, '[^.$]*$')) as name from tp where not contains(id, '$')), h as (select question, id, count(*) as c from w join nm on contains(name, w) where length(w) >= 3 group by all), top as (select question, id from h qualify c = max(c) over (partition by question)),
        fam as (select * from top union select question, e.src from top join e on e.dst = top.id and e.kind in ('EXTENDS','IMPLEMENTS') where e.src in (from tp)), big as (select * from fam qualify count(*) over (partition by question) >= 3),
        cnt as (select question, id, (select count(*) from e where e.dst = big.id and e.kind <> 'CONTAINS') as n_in from big), pl as (select *, row_number() over (partition by question order by n_in desc, id)::int as place from cnt qualify place <= 5),
        mem as (select e.src as id, m.id as member, (select count(*) from e c where c.src = m.id and c.kind = 'CALLS') as calls, coalesce(m.end_line, 0) - coalesce(m.start_line, 0) as lines from e join n m on m.id = e.dst where e.kind = 'CONTAINS' and m.kind in ('METHOD','CONSTRUCTOR') and e.src in (select id from pl)),
        bu as (select id, arg_max(member, (calls, lines, member)) as busiest from mem where lines >= 2 group by id)
        select question, pl.id, n_in, busiest, place from pl left join bu using (id)""",
    "first_sentences": f"""{_G}, t as (select id, trim(regexp_replace(regexp_replace(regexp_replace(doc, '\\{{@(?:code|link|linkplain)[ \\t\\r\\n\\f]+([^}}]*)\\}}', '\\1', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') as t from n where doc is not null),
        s as (select id, case when regexp_extract(t, '^(.*?[.!?])( |$)', 1) = '' then t else regexp_extract(t, '^(.*?[.!?])( |$)', 1) end as s from t where t <> '') select id, case when length(s) <= 200 then s else regexp_replace(left(s, 200), ' [^ ]*$', '') || ' ...' end as sentence from s""",
    "vocabulary_own": f"{_G}, {_OWN} select * from own",
    "vocabulary_own_near": f"""{_G}, {_OWN}, {_LOG}, w as (select distinct unnest({_words('arg')}) as word from l where kind = 'explain') select word, term, n, row_number() over (partition by word order by n desc, term)::int as place from w join own on length(word) >= 3 and word <> term and word not in (select term from own)
        and (starts_with(term, left(word, 4)) or starts_with(word, left(term, 4)) or (length(word) > 4 and contains(term, left(word, 5)))) qualify place <= 20""",
    "bench_scores": """with i as (select * from eval_items where item_id is not null and text is not null qualify row_number() over (partition by item_id) = 1), w as (select distinct item_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) as w from i),
        w2 as (select * from w where regexp_matches(w, '^[A-Z][a-z]+[A-Z]')), x as (select distinct item_id, unnest(expected) as x from i), a as (select item_id, x, split_part(unnest(string_split(x, '|')), '#', 1) as w from x), m as (select item_id, count(distinct x) as n_met from a where (item_id, w) in (select (item_id, w) from w2) group by item_id),
        e as (select i.item_id, suite, length(text) // 4 as tokens, coalesce(m.n_met / k.n, 0.0) as p, coalesce(coalesce(m.n_met, 0) / y.n, 0.0) as r from i left join m using (item_id) left join (select item_id, count(*) as n from w2 group by 1) k using (item_id) left join (select item_id, count(*) as n from x group by 1) y using (item_id))
        select suite, count(*) as n, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg((r >= 0.999)::int), 6) as full_share, list_sort(list(tokens))[count(*) // 2 + 1] as median_tokens from e group by suite""",
}
