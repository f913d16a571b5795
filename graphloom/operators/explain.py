"""Questions answered from the whole graph: what their words find, what a hit passes on, and which flows and members lead an answer.

All questions go side by side. Each is taken apart into probes (the whole question, pairs of words, single words); the texts of all probes are ranked once
over the index, whoever asks them, and every further rule is a join or a window over the few best hits of a probe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.functions.names import annotation_terms, owner, simple_name, stem
from graphloom.operators import graph as G
from graphloom.operators import search as S

#: What a hit of a kind weighs.
KIND_WEIGHTS = {"FIELD": 0.5, "CONSTRUCTOR": 0.6, "FILE": 0.2, "PACKAGE": 0.2, "DOC": 0.7}
#: Hits that a probe gives at most, and what its first one weighs.
PROBES = {"phrase": (30, 3.0), "stems": (30, 3.0), "pair": (10, 1.5), "word": (15, 1.0), "stem": (15, 0.8), "synonym": (10, 0.3)}
#: Words that name a kind of nodes.
KIND_WORDS = {
    "route": "HTTP_ROUTE", "endpoint": "HTTP_ROUTE", "topic": "MESSAGE_TOPIC", "queue": "MESSAGE_TOPIC", "config": "CONFIG_KEY", "configur": "CONFIG_KEY", "configuration": "CONFIG_KEY",
    "property": "CONFIG_KEY", "setting": "CONFIG_KEY", "bean": "BEAN", "job": "SCHEDULED_JOB", "schedul": "SCHEDULED_JOB", "cron": "SCHEDULED_JOB", "flow": "FLOW", "community": "COMMUNITY",
    "finding": "FINDING", "unused": "FINDING", "dead": "FINDING", "cycle": "FINDING", "cyclic": "FINDING", "conflict": "FINDING", "violation": "FINDING", "smell": "FINDING",
}
#: The code's words for a question's word that finds nothing in the project.
SYNONYMS = {
    "duplicate": ("exists", "taken"), "taken": ("exists",), "check": ("exists",), "fetch": ("get", "find", "load"), "retrieve": ("get", "find", "fetch"), "load": ("get", "find", "fetch"),
    "store": ("save", "persist"), "persist": ("save", "store"), "remove": ("delete",), "send": ("publish", "produce", "emit"), "publish": ("send", "produce"), "emit": ("send", "publish"),
}
#: Verbs of a route that a question's stem names.
HTTP_VERBS = {
    "creat": "POST", "add": "POST", "regist": "POST", "submit": "POST", "post": "POST", "updat": "PUT", "edit": "PUT", "chang": "PUT", "modify": "PUT", "put": "PUT",
    "delet": "DELETE", "remov": "DELETE", "list": "GET", "fetch": "GET", "show": "GET", "read": "GET", "look": "GET", "search": "GET", "find": "GET",
}
#: Words that ask for a route, and what a lead weighs by the layer of its class.
ROUTE_WORDS = ("endpoint", "endpoints", "route", "routes", "api", "url", "path", "request")
LAYER_WEIGHTS = {"util": 0.7, "config": 0.7, "model": 0.4}
#: Fixed value: a question about usage, which prose may answer.
USAGE = r"(?i)\b(how (do|can|should|would) (i|we|you)|why|what is|what are|where (do|can) (i|we)|example|guide|documentation|readme|tutorial)\b"
#: A name that starts with the question's verb, users that a field or accessor passes its score to, callers of a library's method, and the share that wiring passes on.
VERB_BONUS, MOST_USERS, MOST_CALLERS, PASSED_ON = 1.0, 6, 3, 0.9
#: Edges that tie code to wiring, by the kind of the node they lead to; nodes of a kind that a bare listing holds, and that stand in where nothing is found.
ATTACHED = {"HTTP_ROUTE": ("HANDLES_ROUTE", "CALLS_REMOTE"), "MESSAGE_TOPIC": ("CONSUMES_FROM", "PRODUCES_TO"), "CONFIG_KEY": ("BINDS_CONFIG",), "BEAN": ("PROVIDES_BEAN",)}
LISTED, STAND_INS = 20, 10
#: Ranked hits of a text that any probe looks at; kinds that no list of matches shows.
MOST_SEEN = 3 * max(v[0] for v in PROBES.values())
UNMATCHED = ("FLOW", "COMMUNITY", "PACKAGE", "FILE")


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def asked(questions: DataFrame) -> DataFrame:
    """question, words, stems, tests, docs of each distinct question: its telling words in lower case and order, repeated ones too, and whether tests or prose are asked
    for. A null or wordless question has no words."""
    words = F.filter(F.split(F.lower("question"), r"[^\p{Alnum}_]+"), lambda w: (F.length(w) > 2) & ~w.isin(*S.STOP))
    told = questions.where("question is not null").select("question").distinct().select("question", words.alias("words"))
    return told.select("question", "words", F.transform("words", stem).alias("stems"), F.exists("words", lambda w: F.startswith(w, F.lit("test"))).alias("tests"), F.rlike("question", F.lit(USAGE)).alias("docs"))


def probes(q: DataFrame) -> DataFrame:
    """question, how, pos, word, text, words, most, first of every probe; pos is the place of the word that a single one is about."""
    probe = lambda how, pos, words, word=F.lit(None).cast("string"): F.struct(F.lit(how).alias("how"), pos.cast("int").alias("pos"), words.alias("words"), word.alias("word"))
    none, one = F.lit(-1), lambda c: F.array(c)
    empty = F.array().cast("array<struct<how:string,pos:int,words:array<string>,word:string>>")
    at = F.sequence(F.lit(0), F.size("stems") - 1)
    differs = lambda i: F.get("words", i) != F.get("stems", i)
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: probe("pair", i * 8 + j, F.array(F.get("stems", i), F.get("stems", j))))))
    synonyms = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    every = F.concat(
        F.array(probe("phrase", none, F.col("words"))), F.when(F.col("words") != F.col("stems"), F.array(probe("stems", none, F.col("stems")))).otherwise(empty),
        F.when(F.size("stems").between(3, 8), pairs).otherwise(empty), F.transform(at, lambda i: probe("word", i, one(F.get("words", i)), F.get("words", i))),
        F.transform(F.filter(at, differs), lambda i: probe("stem", i, one(F.get("stems", i)), F.get("words", i))),
        F.flatten(F.transform(at, lambda i: F.transform(F.coalesce(F.try_element_at(synonyms, F.get("stems", i)), F.array().cast("array<string>")), lambda s: probe("synonym", i, one(s))))))
    rows = q.where("size(words) > 0").select("question", "tests", "docs", F.explode(every).alias("p")).select("question", "tests", "docs", "p.*")
    return rows.select("*", F.concat_ws(" ", "words").alias("text"), F.try_element_at(_map({k: v[0] for k, v in PROBES.items()}), F.col("how")).alias("most"), F.try_element_at(_map({k: v[1] for k, v in PROBES.items()}), F.col("how")).alias("first"))


def node_facts(g: G.Graph, degrees: DataFrame) -> DataFrame:
    """id, kind, fqn, own, external, test, rank, weight of each node: how near the front of a probe's hits it comes and what a hit on it weighs."""
    lines = F.coalesce("end_line", F.lit(0)) - F.coalesce("start_line", F.lit(0))
    rank = F.when(F.col("origin") == "EXTERNAL", 3).when(G.is_code(), 0).when(_is("METHOD", "CONSTRUCTOR"), F.when(lines >= 2, 0).otherwise(1)).when(_is("FIELD"), 2).when(_is("DOC"), 1).otherwise(0)
    weight = F.coalesce(F.try_element_at(_map(KIND_WEIGHTS), F.col("kind")), F.lit(1.0)) * (1 + F.log10(1 + F.coalesce("n", F.lit(0))) / 2)
    known = g.nodes.join(degrees.select(F.col("id").alias("_cls"), "n"), owner("id") == F.col("_cls"), "left")
    return known.select("id", "kind", "fqn", (F.col("origin") == "REPO").alias("own"), (F.col("origin") == "EXTERNAL").alias("external"), G.is_test().alias("test"), rank.alias("rank"), weight.alias("weight"), lines.alias("lines"))


def _best(scored: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best most rows by score of each group, with their place from 1."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("place") <= most)


def _taken(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: hits of probes with place, most, tests and facts. Those that the probe keeps, with at, their place from 0: no tests unless asked for, bodies and types first."""
    seen = rows.where(F.col("place") <= F.when(F.col("tests"), F.col("most")).otherwise(3 * F.col("most"))).where("tests or not test")
    return seen.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "place")) - 1).where("at < most")


def found(index: DataFrame, facts: DataFrame, asking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asking: probes. The hits that each probe keeps (question, how, pos, text, first, id, at and facts), and the ranked hits of all texts by kind of wiring (text, kind, id, place)."""
    texts = asking.select(F.col("text").alias("query"), "words").groupBy("query").agg(F.first("words").alias("words"))
    scored = cut(S.scored(index, texts).join(facts.select("id", "kind"), "id"))
    most = MOST_SEEN
    every = _best(scored, ["query"], most).select("query", "id", "place", F.lit(True).alias("_docs"))
    code = _best(scored.where("kind <> 'DOC'"), ["query"], most).select("query", "id", "place", F.lit(False).alias("_docs"))
    of_kind = _best(scored.where(_is(*set(KIND_WORDS.values()))), ["query", "kind"], most).select(F.col("query").alias("text"), "kind", "id", "place")
    best = cut(every.unionByName(code).join(facts, "id"))
    rows = asking.join(best, (F.col("text") == F.col("query")) & (F.col("docs") == F.col("_docs")))
    return _taken(rows, ["question", "how", "pos", "text"]), of_kind


def _word_scores(kept: DataFrame) -> DataFrame:
    """question, id, score from all probes: by place, rare words three times and common ones half, names that begin with the verb more."""
    probe = ["question", "how", "pos", "text"]
    telling = F.sum((G.is_code() | _is("METHOD", "CONSTRUCTOR")).cast("int")).over(Window.partitionBy(*probe))
    factor = F.when(F.col("telling") <= 2, 3.0).when(F.col("telling") >= 12, 0.5).otherwise(1.0)
    verb = F.regexp_extract(simple_name("id"), "^[a-z0-9]*", 0)
    names = (F.col("kind") == "METHOD") & ~verb.isin("get", "set", "is") & (F.length(verb) >= 3) & (
        (verb == F.col("word")) | (verb == stem("word")) | ((F.length(stem("word")) >= 4) & F.startswith(verb, stem("word"))))
    single = F.col("how").isin("word", "stem")
    rows = cut(kept.withColumn("telling", telling).withColumn("names", single & names).withColumn("base", F.col("first") / (F.col("at") + 1) * F.when(single, factor).otherwise(1.0)))
    # a synonym counts only where neither the word nor its stem finds anything of the project
    own = rows.where(single & F.col("own")).select("question", "pos").distinct()
    told = rows.where("how <> 'synonym'").unionByName(rows.where("how = 'synonym'").join(own, ["question", "pos"], "left_anti").select(rows.columns))
    base = told.select("question", "id", (F.col("base") * F.col("weight")).alias("score"))
    bonus = rows.where("names").select("question", "pos", "id", "weight").distinct().select("question", "id", (VERB_BONUS * F.col("weight")).alias("score"))
    return base.unionByName(bonus)


def _summed(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("question", "id").agg(F.sum("score").alias("score")))


def user_links(g: G.Graph, facts: DataFrame) -> DataFrame:
    """id, user of fields and one-line accessors with the few members of the project that use them."""
    name = simple_name("id")
    accessor = _is("METHOD") & (F.col("lines") <= 0) & (F.startswith(name, F.lit("get")) | F.startswith(name, F.lit("set")) | F.startswith(name, F.lit("is")))
    passing = facts.where("own").where(_is("FIELD") | accessor).select("id", "kind")
    uses = g.edges.where("kind in ('WRITES_FIELD', 'READS_FIELD', 'CALLS')").select(F.col("dst").alias("id"), F.col("src").alias("user"), F.col("kind").alias("_by"))
    users = facts.where("own and not test").where(_is("METHOD", "CONSTRUCTOR")).select(F.col("id").alias("user"))
    known = uses.join(passing, "id").where("(kind = 'FIELD') = (_by <> 'CALLS')").join(users, "user", "left_semi").select("id", "user").distinct()
    return known.join(known.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_USERS).select("id"), "id", "left_semi")


def _from_users(g: G.Graph, facts: DataFrame, hits: DataFrame) -> DataFrame:
    """What hits on fields and one-line accessors pass to the few members of the project that use them."""
    return hits.join(user_links(g, facts), "id").select("question", F.col("user").alias("id"), "score")


def kind_nodes(g: G.Graph, facts: DataFrame) -> DataFrame:
    """id, kind of the nodes of kinds that a question may name, but for those of other services."""
    return facts.where(_is(*set(KIND_WORDS.values()))).join(g.nodes.where(F.coalesce(G.attr("remote") == "true", F.lit(False))).select("id"), "id", "left_anti").select("id", "kind")


def tied_pieces(g: G.Graph, kinds: DataFrame) -> DataFrame:
    """id, kind, w: the pieces of the names of whatever is tied to each of kinds."""
    pieces = F.array_distinct(F.filter(F.transform(F.split(F.substring_index("src", "(", 1), r"[^\p{Alnum}]+|(?<=[a-z0-9])(?=[A-Z])"), F.lower), lambda w: w != ""))
    return g.edges.select("src", F.col("dst").alias("id")).join(kinds, "id").select("id", "kind", F.explode(pieces).alias("w")).distinct()


def _kind_hits(g: G.Graph, facts: DataFrame, q: DataFrame, of_kind: DataFrame) -> DataFrame:
    """question, id, score of the nodes of a kind that a question names: those that its other words find, or whose code they name, or a few."""
    named = kind_probes(q).where("word is not null").select("question", "tests", "word", "kind", "rest").distinct()
    texts = kind_texts(named)
    rows = texts.join(of_kind, ["text", "kind"]).join(facts.select("id", "test", "rank", "fqn", "weight"), "id")
    kept = _taken(rows, ["question", "word", "nr"])
    first = kept.groupBy("question", "word", "kind", "id", "fqn").agg(F.min(F.struct("nr", "at")).alias("order"))
    first = first.join(named.select("question", "word", "rest"), ["question", "word"])
    held = F.size(F.filter("rest", lambda r: F.contains(F.lower("fqn"), F.substring(stem(r), 1, 5))))
    key = Window.partitionBy("question", "word")
    matched = first.withColumn("held", held).withColumn("top", F.max("held").over(key)).withColumn("tops", F.sum((F.col("held") == F.col("top")).cast("int")).over(key))
    scoped = matched.where("top = 0 or tops > 1 or held = top").select("question", "word", "id", F.struct("order.nr", "order.at", "id").alias("by"))
    kinds = kind_nodes(g, facts)
    lacking = named.join(scoped.select("question", "word").distinct(), ["question", "word"], "left_anti")
    begins = lambda w, least: F.transform(F.filter(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length(w))), lambda k: k <= F.length(w)), lambda k: F.substring(w, F.lit(1), k))
    tied = tied_pieces(g, kinds)
    stems = lacking.select("question", "word", "kind", F.explode("rest").alias("r")).select("question", "word", "kind", stem("r").alias("st"))
    longer = tied.select("id", "kind", F.explode(begins(F.col("w"), 1)).alias("st")).distinct().join(stems, ["kind", "st"])
    shorter = stems.where("length(st) >= 4").select("question", "word", "kind", F.explode(begins(F.col("st"), 3)).alias("w")).join(tied, ["kind", "w"])
    attached = longer.select("question", "word", "id").unionByName(shorter.select("question", "word", "id")).distinct().select("question", "word", "id", F.struct(F.lit(0).alias("nr"), F.lit(0).alias("at"), "id").alias("by"))
    some = kinds.withColumn("at", F.row_number().over(Window.partitionBy("kind").orderBy("id")) - 1).where(F.col("at") < LISTED)
    bare = named.where("size(rest) = 0").join(some, "kind").select("question", "word", "id", F.struct(F.lit(0).alias("nr"), "at", "id").alias("by"))
    listed = cut(scoped.unionByName(attached).unionByName(bare))
    placed = listed.withColumn("i", F.row_number().over(key.orderBy("by"))).select("question", "id", (2.0 / F.col("i")).alias("score"))
    none = named.join(listed.select("question", "word").distinct(), ["question", "word"], "left_anti").join(some.where(F.col("at") < STAND_INS), "kind")
    return placed.unionByName(none.select("question", "id", (0.5 / (F.col("at") + 1)).alias("score"))).join(facts.select("id", "weight"), "id").select("question", "id", (F.col("score") * F.col("weight")).alias("score"))


def kind_probes(q: DataFrame) -> DataFrame:
    """question, tests, word, kind, rest of each word that names a kind, with the other words of the question."""
    each = q.select("question", "tests", "words", F.explode_outer(F.array_distinct(F.filter("stems", lambda s: s.isin(*KIND_WORDS)))).alias("word"))
    return each.select("question", "tests", "word", F.try_element_at(_map(KIND_WORDS), F.col("word")).alias("kind"), F.filter("words", lambda w: stem(w) != F.col("word")).alias("rest"))


def kind_texts(named: DataFrame) -> DataFrame:
    """question, word, kind, tests, nr, text, words, most of what is searched for among the nodes of a kind: the rest of the question, then its stems one by one."""
    searched = F.concat(F.array(F.struct(F.col("rest").alias("words"), F.lit(10).alias("most"))), F.transform("rest", lambda r: F.struct(F.array(stem(r)).alias("words"), F.lit(5).alias("most"))))
    rows = named.where("size(rest) > 0").select("question", "word", "kind", "tests", F.posexplode(searched).alias("nr", "p"))
    return rows.select("question", "word", "kind", "tests", "nr", F.concat_ws(" ", "p.words").alias("text"), "p.words", "p.most")


def _substring_hits(facts: DataFrame, q: DataFrame, hits: DataFrame) -> DataFrame:
    """Where nothing else is found, half a point for the ten first ids that hold a word anywhere. Words meet ids by their first three letters, an equal join."""
    words = q.join(hits.select("question").distinct(), "question", "left_anti").select("question", "docs", F.posexplode("words").alias("pos", "w")).withColumn("piece", F.substring("w", 1, 3))
    pieces = facts.select("id", "kind", "weight", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("id") - 2)), lambda k: F.substring(F.lower("id"), k, F.lit(3))))).alias("piece"))
    met = pieces.join(words, "piece").where(F.contains(F.lower("id"), F.col("w"))).where("docs or kind <> 'DOC'")
    first = met.withColumn("at", F.row_number().over(Window.partitionBy("question", "pos").orderBy(F.length("id"), "id"))).where("at <= 10")
    return first.select("question", "id", (0.5 * F.col("weight")).alias("score"))


def wired_links(g: G.Graph, facts: DataFrame) -> DataFrame:
    """id, other: wiring with the code that it is tied to, a row for each way."""
    known = facts.select("id", "kind")
    into = g.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.col("kind").alias("_by"))
    tied = into.join(known.where(_is(*ATTACHED)), "id").where(" or ".join(f"(kind = '{k}' and _by in ({', '.join(repr(x) for x in v)}))" for k, v in ATTACHED.items())).select("id", "other")
    jobs = g.edges.where("kind = 'CALLS'").join(known.where(_is("SCHEDULED_JOB")).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"))
    return tied.unionByName(jobs)


def caller_links(g: G.Graph, facts: DataFrame) -> DataFrame:
    """id, other: a library's methods with their callers in the project, where these are few."""
    known = facts.select("id", "kind", "own", "external", "test")
    into = g.edges.where("kind = 'CALLS'").select(F.col("dst").alias("id"), F.col("src").alias("other"))
    callers = into.join(known.where("external").where(_is("METHOD")).select("id"), "id", "left_semi").join(known.where("own and not test").select(F.col("id").alias("other")), "other", "left_semi").select("id", "other")
    return callers.join(callers.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_CALLERS).select("id"), "id", "left_semi")


def _passed_on(g: G.Graph, facts: DataFrame, q: DataFrame, hits: DataFrame) -> DataFrame:
    """What hits on wiring pass to the code it is tied to, and hits on a library's method that the question names to its few callers."""
    wired = hits.join(wired_links(g, facts), "id").select("question", F.col("other").alias("id"), "score")
    called = hits.join(caller_links(g, facts), "id").join(q.select("question", "stems"), "question").where(F.exists("stems", lambda s: F.startswith(F.lower(simple_name("id")), s))).select("question", F.col("other").alias("id"), "score")
    return wired.unionByName(called).join(facts.select("id", "weight"), "id").select("question", "id", (PASSED_ON * F.col("score") * F.col("weight")).alias("score"))


def _remembered(facts: DataFrame, hits: DataFrame, recalled: DataFrame) -> DataFrame:
    """recalled: question, arg, place. What earlier sessions fetched after questions alike, just under the best hit."""
    top = hits.groupBy("question").agg(F.max("score").alias("top"))
    known = recalled.join(facts.select(F.col("id").alias("arg")), "arg", "left_semi")
    at = known.withColumn("at", F.row_number().over(Window.partitionBy("question").orderBy("place")) - 1)
    return at.join(top, "question", "left").select("question", F.col("arg").alias("id"), (F.coalesce("top", F.lit(1.0)) * (0.9 - 0.1 * F.col("at"))).alias("score"))


def hits(g: G.Graph, index: DataFrame, facts: DataFrame, questions: DataFrame, recalled: DataFrame | None = None) -> DataFrame:
    """question, id, score of everything that a question hits, whole.

    Questions without words, or that find nothing, have no rows. facts: as node_facts gives them. recalled: question, arg, place as search.recall gives them."""
    q = cut(asked(questions))
    asking = cut(probes(q))
    extra = kind_texts(kind_probes(q).where("word is not null")).select("question", F.lit(False).alias("tests"), F.lit(False).alias("docs"), F.lit("kind").alias("how"), F.lit(-1).alias("pos"), "words", F.lit(None).cast("string").alias("word"), "text", F.lit(0).alias("most"), F.lit(0.0).alias("first"))
    kept, of_kind = found(index, facts, asking.unionByName(extra.select(asking.columns)))
    scores = _summed(_word_scores(kept))
    scores = _summed(scores.unionByName(_from_users(g, facts, scores)).unionByName(_kind_hits(g, facts, q, of_kind)))
    scores = cut(scores.unionByName(_substring_hits(facts, q, scores)).groupBy("question", "id").agg(F.sum("score").alias("score")))
    scores = _summed(scores.unionByName(_passed_on(g, facts, q, scores)))
    return scores if recalled is None else _summed(scores.unionByName(_remembered(facts, scores, recalled)))


def matched(facts: DataFrame, scores: DataFrame, top: int = 10) -> DataFrame:
    """question, id, score, place of the best matches, tests at three tenths; a top-k report per question, ties by id."""
    known = scores.join(facts.select("id", "kind", "test"), "id").where(~_is(*UNMATCHED))
    own = known.select("question", "id", F.round(F.col("score") * F.when(F.col("test"), 0.3).otherwise(1.0), 5).alias("score"))
    return _best(own, ["question"], top)


def able_members(g: G.Graph, facts: DataFrame) -> DataFrame:
    """id, lines, calls of the members whose bodies may lead an answer."""
    kind_of = facts.select(F.col("id").alias("_cls"), F.col("kind").alias("_kind"))
    able = facts.where("not external and not test").where(_is("METHOD", "CONSTRUCTOR")).join(kind_of, owner("id") == F.col("_cls"), "left").where("lines >= 1 or _kind = 'INTERFACE'").select("id", "lines")
    return able.join(g.edges.where("kind = 'CALLS'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("calls")), "id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def leads(g: G.Graph, facts: DataFrame, layers: DataFrame, scores: DataFrame, top: int = 5) -> DataFrame:
    """question, id, score, place of the members whose bodies lead an answer: own members of two lines at least, weighted by the layer of their class; one of the three best
    classes that a question hits is stood for by its busiest such member. A top-k report per question, ties by id."""
    able = cut(able_members(g, facts))
    classes = _best(scores.join(facts.where(G.is_code()).select("id", "test"), "id").select("question", "id", (F.col("score") * F.when(F.col("test"), 0.3).otherwise(1.0)).alias("score"), F.col("score").alias("own")), ["question"], 3)
    held = g.edges.where("kind = 'CONTAINS'").select(F.col("src").alias("cls"), F.col("dst").alias("id")).join(able, "id")
    members = classes.select("question", F.col("id").alias("cls"), "own").join(held, "cls").join(scores.select("question", "id"), ["question", "id"], "left_anti")
    busiest = members.groupBy("question", "cls", "own").agg(F.max(F.struct("calls", "lines", "id"))["id"].alias("id")).groupBy("question", "id").agg(F.max("own").alias("score"))
    every = scores.join(able.select("id"), "id", "left_semi").select("question", "id", "score").unionByName(busiest.select("question", "id", "score"))
    weight = F.coalesce(F.try_element_at(_map(LAYER_WEIGHTS), F.col("layer")), F.lit(1.0))
    weighed = every.join(layers.select(F.col("id").alias("_cls"), "layer"), owner("id") == F.col("_cls"), "left").select("question", "id", F.round(F.col("score") * weight, 5).alias("score"))
    return _best(weighed, ["question"], top)


def flow_steps(flows: DataFrame) -> DataFrame:
    """entry, id, sure of each step, which is surer the nearer it is to the entry."""
    return flows.select("entry", F.explode("steps").alias("s")).select("entry", F.col("s.id").alias("id"), (1.0 / (F.col("s.depth") + 1)).alias("sure"))


def flow_handles(g: G.Graph, flows: DataFrame) -> DataFrame:
    """id, entry: routes with the flows that begin at them."""
    return g.edges.where("kind = 'HANDLES_ROUTE'").select(F.col("dst").alias("id"), F.col("src").alias("entry")).join(flows.select("entry"), "entry", "left_semi")


def flow_tokens(g: G.Graph, flows: DataFrame) -> DataFrame:
    """entry, entry_kind, label, tokens: the words of a flow's label, first steps and annotations."""
    noted = g.nodes.select(F.col("id").alias("entry"), annotation_terms("attrs").alias("notes"))
    short = F.transform(F.slice("steps", 1, 6), lambda s: F.substring_index(F.substring_index(s["id"], "(", 1), ".", -1))
    text = F.concat_ws(" ", "label", F.array_join(short, " "), "notes")
    pieces = F.array_distinct(F.filter(F.transform(F.split(text, r"[^\p{Alnum}]+|(?<=[a-z0-9])(?=[A-Z])"), F.lower), lambda t: t != ""))
    return flows.join(noted, "entry", "left").select("entry", "entry_kind", "label", pieces.alias("tokens"))


def flow_ranks(g: G.Graph, facts: DataFrame, flows: DataFrame, questions: DataFrame, scores: DataFrame, top: int = 3) -> DataFrame:
    """question, entry, covered, score, place of the flows that tell most about a question: a route that it names first, then by the words that label and steps cover, rare
    ones more, the best step, the kind of entry and the sum of what hits give by their depth. A top-k report per question."""
    q = asked(questions)
    step = cut(flow_steps(flows))
    known = scores.join(facts.select("id", "kind"), "id")
    held = g.edges.where("kind = 'CONTAINS'").select(F.col("src").alias("id"), F.col("dst").alias("member"))
    members = known.where(G.is_code()).join(held, "id").select("question", F.col("member").alias("id"), "score").unionByName(known.where(~_is("FLOW", "COMMUNITY")).select("question", "id", "score"))
    given = members.join(step, "id").select("question", "entry", (F.col("score") * F.col("sure")).alias("part"))
    routed = known.where(_is("HTTP_ROUTE")).join(flow_handles(g, flows), "id")
    summed = cut(given.unionByName(routed.select("question", "entry", (3 * F.col("score")).alias("part"))).groupBy("question", "entry").agg(F.sum("part").alias("score")))
    best = step.join(scores, "id").groupBy("question", "entry").agg(F.max("score").alias("best"))
    tokens = cut(flow_tokens(g, flows))
    each = summed.join(tokens, "entry").join(q.select("question", "words", "stems"), "question")
    says = lambda s: F.exists("tokens", lambda t: F.startswith(t, s) | ((F.length(s) >= 4) & F.startswith(s, t) & (F.length(t) >= 3)))
    at = cut(each.select("question", "entry", "entry_kind", "label", "score", "words", "stems", F.transform("stems", says).alias("has")))
    per = at.select("question", F.posexplode("has").alias("pos", "h")).groupBy("question", "pos").agg(F.sum(F.col("h").cast("int")).alias("n"), F.count("*").alias("all"))
    worth = F.when(F.col("n") > F.greatest(F.lit(2), F.floor(F.col("all") / 2)), 0).when(F.col("n") <= 2, 3).otherwise(1)
    worths = per.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("pos", worth.alias("worth"))))["worth"].alias("worth"))
    verb = F.exists("stems", lambda s: F.startswith("label", F.coalesce(F.try_element_at(_map(HTTP_VERBS), s), F.lit("\0"))))
    cover = F.aggregate(F.zip_with("has", "worth", lambda h, w: F.when(h, w).otherwise(0)), F.lit(0), lambda a, b: a + b) + verb.cast("int")
    peak = scores.groupBy("question").agg(F.max("score").alias("peak"))
    wants = q.where(F.arrays_overlap("words", F.array(*map(F.lit, ROUTE_WORDS)))).select("question", "words")
    near = routed.join(wants, "question").join(peak, "question").where("score >= peak / 2").withColumn("says", F.exists("words", lambda w: w == F.lower(F.regexp_extract("id", r"^route:(\w+) ", 1))))
    pinned = near.groupBy("question").agg(F.min(F.struct(~F.col("says"), -F.col("score"), "id", "entry"))["entry"].alias("_pinned"))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, ("route", "consumer", "job", "main"))), F.col("entry_kind")), F.lit(0))
    rows = at.join(worths, "question").join(best, ["question", "entry"], "left").join(pinned, "question", "left").select(
        "question", "entry", cover.alias("covered"), F.round("score", 5).alias("score"), F.coalesce(F.col("_pinned") == F.col("entry"), F.lit(False)).alias("pin"), F.round(F.coalesce("best", F.lit(0.0)), 5).alias("best"), order.alias("order"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("pin"), F.desc("covered"), F.desc("best"), "order", F.desc("score"), "entry"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("question", "entry", "covered", "score", "place")
