"""Full-text search over the names and texts of a graph, and what the query log remembers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import BLANKS, cut, numbered, ship
from graphloom.functions.names import annotation_terms, simple_name, stem, terms, tokens
from graphloom.operators import graph as G

#: Parameters of the ranking as published for it.
K1, B = 1.2, 0.75
#: Words that questions are made of.
STOP = tuple(
    "the and how does what where which with for this that are when from into work works code mechanism used use uses exist exists there list repo project application app system service".split()
)
#: Seconds after a question in which a fetch belongs to it, and the share of words that makes two questions alike.
REMEMBERED, ALIKE = 120, 0.5
#: Rows of words of past questions, and of what they fetched, up to which each task holds all of them; beyond that questions meet in a join, with the same result.
REMEMBERED_PER_TASK = 8_000_000
#: The kinds of nodes whose names are the project's own words.
OWN_KINDS = ("CLASS", "INTERFACE", "ENUM", "RECORD", "METHOD", "FIELD", "CONFIG_KEY", "HTTP_ROUTE")


def postings(nodes: DataFrame) -> DataFrame:
    """id, term, tf of the words of names, annotations, signatures and comments of nodes with an id; nodes without words have none."""
    text = F.concat_ws(" ", terms("fqn"), annotation_terms("attrs"), "signature", "doc")
    return nodes.where("id is not null").select("id", F.explode(tokens(text)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def word_parts(index: DataFrame, words: DataFrame) -> DataFrame:
    """word, id, part: what each of the distinct words (word) adds to the score of every id that has a term which it begins."""
    lengths = index.groupBy("id").agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    begins = index.select("term").distinct().select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.substring("term", F.lit(1), k))).alias("word"))
    matched = begins.join(words, "word", "left_semi")
    hits = index.join(matched, "term").groupBy("word", "id").agg(F.sum("tf").alias("f"))
    spread = hits.groupBy("word").agg(F.count("*").alias("df"))
    found = hits.join(spread, "word").join(lengths, "id").crossJoin(F.broadcast(stats))  # one row of totals
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return found.select("word", "id", part.alias("part"))


def scored(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id, score of all ids that match each query (query, words array): every word must begin some term of an id.

    The number of ids and their mean length come from the whole index, as does the number of ids that each word hits. Words are short
    and few, so they are matched against the distinct terms by all beginnings of the terms, an equal join."""
    asked = queries.select("query", F.explode(F.array_distinct("words")).alias("word")).where("word <> ''")
    need = asked.groupBy("query").agg(F.count("*").alias("need"))
    parts = word_parts(index, asked.select("word").distinct())
    summed = asked.join(parts, "word").groupBy("query", "id").agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("have"))
    return summed.join(need, "query").where("have = need").select("query", "id", "score")


def ranked(index: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """query, id, score, place of the best ids for each query, as scored matches them; a top-k report per query, ties by id."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored(index, queries).withColumn("place", place).where(F.col("place") <= top)


def question_words(text: str) -> F.Column:
    """The stems of the telling words of a question, each once."""
    telling = F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(*STOP))
    return F.array_distinct(F.transform(telling, stem))


def log_entries(log: DataFrame) -> DataFrame:
    """t, kind, arg of the query log with kinds clean, each once; entries without a time or text are left out."""
    return log.select("t", F.lower(F.trim("kind", F.lit(BLANKS))).alias("kind"), "arg").where("t is not null and arg is not null and kind is not null").distinct()


def sessions(entries: DataFrame, gap: int = REMEMBERED) -> DataFrame:
    """t, kind, arg, session: a session starts at each entry more than gap seconds behind the one before.

    Entries fall into hours; the last one before each hour comes from sums per hour, so no task sorts the whole log. A session is named by the time of its
    first entry."""
    hour = F.floor(F.col("t") / 3600)
    byhour = entries.withColumn("hour", hour)
    ends = byhour.groupBy("hour").agg(F.max("t").alias("end"))
    carried = ends.withColumn("prior", F.lag("end").over(Window.orderBy("hour"))).select("hour", "prior")  # one row per hour
    inside = Window.partitionBy("hour").orderBy("t")
    flagged = byhour.join(carried, "hour").withColumn("before", F.coalesce(F.lag("t").over(inside), "prior")).withColumn("first", (F.col("before").isNull() | (F.col("t") - F.col("before") > gap)))
    starts = flagged.groupBy("hour").agg(F.max(F.when(F.col("first"), F.col("t"))).alias("open"))
    prior = starts.withColumn("prior_open", F.last("open", ignorenulls=True).over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))).select("hour", "prior_open")
    # entries of one second belong together, whatever their order
    upto = Window.partitionBy("hour").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.join(prior, "hour").select("t", "kind", "arg", F.coalesce(F.max(F.when(F.col("first"), F.col("t"))).over(upto), "prior_open").alias("session"))


def fetches(entries: DataFrame) -> DataFrame:
    """t, arg, question: each fetch with the last question at most REMEMBERED seconds before it, of equal times the greatest text.

    Questions are spread over the seconds they hold for in blocks, an equal join on the block; the window then looks at one fetch's few questions."""
    block = lambda t: F.floor(t / REMEMBERED)
    asked = entries.where("kind = 'explain'").select(F.col("t").alias("qt"), F.col("arg").alias("question"))
    asked = asked.groupBy("qt").agg(F.max("question").alias("question")).select("*", F.explode(F.array(block(F.col("qt")), block(F.col("qt")) + 1)).alias("block"))
    got = entries.where("kind in ('source', 'node')").select("t", "arg", block(F.col("t")).alias("block"))
    met = got.join(asked, "block").where(f"qt <= t and t - qt <= {REMEMBERED}")
    return met.groupBy("t", "arg").agg(F.max_by("question", "qt").alias("question"))


def recall(entries: DataFrame, questions: DataFrame, top: int = 3) -> DataFrame:
    """question, arg, n, place: what was fetched most after questions alike, for each question (question); ties by arg.

    Alike means that the stems have a Jaccard share of ALIKE at least. Candidates share one of their rarest stems: of m stems, two sets with that share have
    a common one among the first m - ceil(ALIKE * m) + 1 in order of rarity, so only these are joined (prefix filter), and no pair is lost."""
    found = cut(fetches(entries).groupBy("question", "arg").agg(F.count("*").alias("n")))
    past = found.select("question").distinct().select("question", question_words("question").alias("words")).where("size(words) > 0")
    asked = questions.select("question").distinct().select(F.col("question").alias("ask"), question_words("question").alias("asked")).where("size(asked) > 0")
    rarity = past.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    if max(rarity.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0], found.count()) <= REMEMBERED_PER_TASK:
        return _recalled_in_tasks(found, past, asked, rarity, top)

    def prefix(df: DataFrame, key: str, words: str) -> DataFrame:
        each = df.select(key, words, F.explode(words).alias("w")).join(rarity, "w", "left").withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "w")))
        return each.where(F.col("at") <= F.size(words) - F.ceil(F.size(words) * ALIKE) + 1).select(key, words, "w")

    pairs = prefix(past, "question", "words").join(prefix(asked, "ask", "asked"), "w").dropDuplicates(["question", "ask"])
    alike = pairs.where(F.size(F.array_intersect("words", "asked")) >= ALIKE * F.size(F.array_union("words", "asked"))).select("question", "ask")
    counted = alike.join(found, "question").groupBy(F.col("ask").alias("question"), "arg").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("n"), "arg"))
    return counted.withColumn("place", place).where(F.col("place") <= top)


def _lists(key: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """start, values: those of key k, a place from 0 to n - 1, are values[start[k]:start[k + 1]]."""
    return np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))]), value[np.argsort(key, kind="stable")]


def _recalled_in_tasks(found: DataFrame, past: DataFrame, asked: DataFrame, rarity: DataFrame, top: int) -> DataFrame:
    """recall with all that is remembered in arrays of each task, so that no pair of questions is ever written. Words are numbered from the rarest on, args in their order."""
    spark = found.sparkSession
    ship(spark)
    words = cut(numbered(rarity, F.struct("df", "w"), "wnr")).select("w", "wnr")
    args = cut(numbered(found.select("arg").distinct(), "arg", "anr"))
    olds = cut(numbered(past, "question", "qnr"))
    had = olds.select("qnr", F.explode("words").alias("w")).join(words, "w").select("qnr", "wnr").toArrow()
    got = found.join(olds.select("question", "qnr"), "question").join(args, "arg").select("qnr", "anr", "n").toArrow()
    known, q = np.unique(had["qnr"].to_numpy(), return_inverse=True)
    names, w = np.unique(had["wnr"].to_numpy(), return_inverse=True)
    by_word = _lists(w, q.astype(np.int32), len(names))
    at = np.searchsorted(known, got["qnr"].to_numpy())
    by_old = _lists(at, np.arange(len(at)), len(known))
    order = by_old[1]
    held = spark.sparkContext.broadcast((names, by_word, np.bincount(q, minlength=len(known)), by_old[0], got["anr"].to_numpy()[order], got["n"].to_numpy()[order]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, (start, olds), sizes, first, anr, n = held.value
        shared = np.zeros(len(sizes), np.int32)
        for p in parts:
            out = []
            for ask, m, own in zip(p["ask"], p["m"], p["own"]):
                own = np.searchsorted(names, np.sort(own))
                lists = [olds[start[k] : start[k + 1]] for k in own]
                for x in lists:
                    shared[x] += 1
                # of m words so many must be common that one is among the rarest; words that nobody asked before are rarer still
                few = int(m - np.ceil(m * ALIKE) + 1) - int(m - len(own))
                near = np.concatenate(lists[:few]) if few > 0 else np.zeros(0, np.int32)
                near = near[shared[near] >= ALIKE * (m + sizes[near] - shared[near])]
                for x in lists:
                    shared[x] = 0
                near = np.unique(near)
                count = first[near + 1] - first[near]
                at = np.arange(count.sum()) + np.repeat(first[near] - (np.cumsum(count) - count), count)
                each, to = np.unique(anr[at], return_inverse=True)
                total = np.bincount(to, weights=n[at], minlength=len(each)).astype(np.int64)
                best = np.lexsort((each, -total))[:top]
                out += [(ask, each[k], total[k], place) for place, k in enumerate(best, 1)]
            yield pd.DataFrame(out, columns=["question", "anr", "n", "place"])

    own = asked.select("ask", F.size("asked").alias("m"), F.explode("asked").alias("w")).join(words, "w").groupBy("ask", "m").agg(F.collect_list("wnr").alias("own"))
    told = own.repartition(4 * max(1, spark.sparkContext.defaultParallelism), "ask").mapInPandas(run, "question string, anr long, n long, place int")
    return told.join(args, "anr").select("question", "arg", "n", "place")


def _cards_in_tasks(words: DataFrame, held: DataFrame, below: DataFrame, used: DataFrame, types: DataFrame, least: int, top: int) -> DataFrame:
    """question, id, n_in, place of subsystems. words: question, w. held: w, id. Types are numbered as they are placed, so that the best are the smallest numbers, and each
    task has the numbers of each word and of what is below each type, so that no pair of a question and a type is written but the best."""
    spark = words.sparkSession
    ship(spark)
    ranked = types.join(used, "id", "left").select("id", F.coalesce("n_in", F.lit(0)).alias("n_in"))
    nrs = cut(ranked.orderBy(F.desc("n_in"), "id").withColumn("nr", F.monotonically_increasing_id()))
    of = held.join(nrs.select("id", "nr"), "id").select("w", "nr").toArrow()
    subs = below.join(nrs.select("id", "nr"), "id").join(nrs.select(F.col("id").alias("sub"), F.col("nr").alias("snr")), "sub").select("nr", "snr").toArrow()
    known = np.sort(nrs.select("nr").toArrow()["nr"].to_numpy())
    names, w = np.unique(of["w"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    place = lambda x: np.searchsorted(known, x.to_numpy())
    tables = spark.sparkContext.broadcast((known, dict(zip(names.tolist(), range(len(names)))), _lists(w, place(of["nr"]), len(names)), _lists(place(subs["nr"]), place(subs["snr"]), len(known))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, names, (start, ids), (first, subs) = tables.value
        done: dict[tuple[int, ...], np.ndarray] = {}
        for p in parts:
            out = []
            for question, ws in zip(p["question"], p["ws"]):
                own = tuple(sorted(names[x] for x in ws if x in names))
                if own not in done:
                    done.clear() if len(done) >= 100_000 else None
                    met, n = np.unique(np.concatenate([ids[start[k] : start[k + 1]] for k in own]) if own else ids[:0], return_counts=True)
                    named = met[n == n.max()] if len(n) else met
                    count = first[named + 1] - first[named]
                    at = np.arange(count.sum()) + np.repeat(first[named] - (np.cumsum(count) - count), count)
                    family = np.unique(np.concatenate([named, subs[at]]))
                    done[own] = family[:top].copy() if len(family) >= least else family[:0]
                out += [(question, known[k], at) for at, k in enumerate(done[own], 1)]
            yield pd.DataFrame(out, columns=["question", "nr", "place"])

    asked = words.groupBy("question").agg(F.collect_list("w").alias("ws")).repartition(4 * max(1, spark.sparkContext.defaultParallelism), "question")
    return asked.mapInPandas(run, "question string, nr long, place int").join(nrs, "nr").select("question", "id", "n_in", "place")


def subsystems(g: G.Graph, questions: DataFrame, least: int = 3, top: int = 5) -> DataFrame:
    """question, id, n_in, busiest, place: the types whose names carry most of a question's stems and those directly below them, where there are at least least; the most
    used first, a top-k report per question. busiest: the member with most calls out, then the longest, of three lines at least.

    Stems meet names by their first three letters, an equal join. Without stems of three letters a question has none."""
    types = g.nodes.where("kind in ('CLASS', 'INTERFACE', 'ENUM', 'RECORD') and origin = 'REPO' and file is not null").where(~G.is_test()).select("id")
    names = types.where("not contains(id, '$')").select("id", F.lower(simple_name("id")).alias("name"))
    pieces = names.where("length(name) >= 3").select("id", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda k: F.substring(F.col("name"), k, F.lit(3))))).alias("piece"))
    words = questions.select("question").distinct().select("question", F.explode(question_words("question")).alias("w")).where("length(w) >= 3")
    met = words.select("w").distinct().withColumn("piece", F.substring("w", 1, 3)).join(pieces, "piece").where(F.contains("name", F.col("w"))).select("w", "id").distinct()
    held = words.withColumn("piece", F.substring("w", 1, 3)).join(pieces, "piece").where(F.contains("name", F.col("w"))).groupBy("question", "id").agg(F.count("*").alias("n"))
    named = held.withColumn("most", F.max("n").over(Window.partitionBy("question"))).where("n = most").select("question", "id")
    below = g.edges.where("kind in ('EXTENDS', 'IMPLEMENTS')").select(F.col("dst").alias("id"), F.col("src").alias("sub")).join(types.withColumnRenamed("id", "sub"), "sub", "left_semi")
    used = g.edges.where("kind <> 'CONTAINS'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    met = cut(met)
    small = met.count() <= REMEMBERED_PER_TASK
    family = named.unionByName(named.join(below, "id").select("question", F.col("sub").alias("id"))).distinct()
    counted = family.withColumn("size", F.count("*").over(Window.partitionBy("question"))).where(F.col("size") >= least)
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("n_in"), "id"))
    best = counted.join(used, "id", "left").select("question", "id", F.coalesce("n_in", F.lit(0)).alias("n_in")).withColumn("place", place).where(F.col("place") <= top)
    if small:
        best = _cards_in_tasks(words, met, below, used, types, least, top)
    lines = F.coalesce("end_line", F.lit(0)) - F.coalesce("start_line", F.lit(0))
    bodies = g.nodes.where("kind in ('METHOD', 'CONSTRUCTOR')").select(F.col("id").alias("member"), lines.alias("lines")).where("lines >= 2")
    calls = g.edges.where("kind = 'CALLS'").groupBy(F.col("src").alias("member")).agg(F.count("*").alias("calls"))
    ranked_members = g.edges.where("kind = 'CONTAINS'").select(F.col("src").alias("id"), F.col("dst").alias("member")).join(bodies, "member").join(calls, "member", "left")
    busiest = ranked_members.groupBy("id").agg(F.max(F.struct(F.coalesce("calls", F.lit(0)).alias("calls"), "lines", "member"))["member"].alias("busiest"))
    return best.join(busiest, "id", "left").select("question", "id", "n_in", "busiest", "place")


def vocabulary(nodes: DataFrame) -> DataFrame:
    """term, n: the camel-case parts of class names in lower case with the number of classes."""
    parts = F.split(F.regexp_replace(F.substring_index(F.substring_index("id", ".", -1), "$", -1), "([a-z0-9])([A-Z])", "$1 $2"), " ")
    own = nodes.where(G.is_code()).select("id", F.explode(F.array_distinct(F.transform(parts, lambda p: F.lower(p)))).alias("term"))
    return own.where("length(term) > 2").groupBy("term").agg(F.count("*").alias("n"))


def nearby(words: DataFrame, vocab: DataFrame, top: int = 20) -> DataFrame:
    """word, term, n, place: terms that begin with the same four letters as a word, the commonest first; a top-k report per word."""
    met = words.where("length(word) >= 4").select("word", F.substring("word", 1, 4).alias("k")).join(vocab.where("length(term) >= 4").select("term", "n", F.substring("term", 1, 4).alias("k")), "k").where("word <> term")
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "term"))
    return met.withColumn("place", place).where(F.col("place") <= top).select("word", "term", "n", "place")


def own_vocabulary(nodes: DataFrame) -> DataFrame:
    """term, n: the pieces of 3 to 30 characters of the names of the project's own classes, methods, fields, configuration keys and routes, with how often they stand there.

    A member's name is what stands before its parameters, whose types the reference takes instead where they have dots."""
    member = F.substring_index(F.substring_index(F.substring_index(F.substring_index("id", "(", 1), "#", -1), ".", -1), "$", -1)
    name = F.when(F.col("kind").isin("CONFIG_KEY", "HTTP_ROUTE"), F.col("fqn")).otherwise(member)
    own = nodes.where(F.col("kind").isin(*OWN_KINDS) & (F.coalesce("origin", F.lit("")) != "EXTERNAL"))
    pieces = own.select(F.explode(F.split(name, r"[^\p{Alnum}]+|(?<=[a-z0-9])(?=[A-Z])")).alias("term"))
    return pieces.select(F.lower("term").alias("term")).where("length(term) between 3 and 30").groupBy("term").agg(F.count("*").alias("n"))


def own_nearby(words: DataFrame, vocab: DataFrame, top: int = 20) -> DataFrame:
    """word, term, n, place: terms that begin with a word's first four letters or whose first four begin the word, or that contain its first five; the commonest
    first; a top-k report per word. Words and terms of three letters count whole. All ways are equal joins on short pieces, which are distinct per term."""
    key = lambda how, c: F.struct(F.lit(how).alias("how"), c.alias("piece"))
    long = lambda c, n, some: F.when(F.length(c) >= n, some)
    piece = lambda c, k, n: F.substring(c, k, n)
    exact = lambda c, how, other: F.when(F.length(c) == 3, key(how, F.col(c))).otherwise(key(other, piece(c, 1, 4)))
    asked = F.array(exact("word", "word", "four"), key("term", piece("word", 1, 3)), long("word", 5, key("five", piece("word", 1, 5))))
    inner = F.when(F.length("term") >= 5, F.transform(F.sequence(F.lit(1), F.length("term") - 4), lambda k: key("five", F.substring(F.col("term"), k, F.lit(5))))).otherwise(F.array())
    held = F.array_distinct(F.concat(F.array(exact("term", "term", "four"), key("word", piece("term", 1, 3))), inner))
    met = words.where("length(word) >= 3").distinct().select("word", F.explode(asked).alias("k")).where("k is not null").join(vocab.where("length(term) >= 3").select("term", "n", F.explode(held).alias("k")), "k")
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "term"))
    return met.where("word <> term").select("word", "term", "n").distinct().withColumn("place", place).where(F.col("place") <= top).select("word", "term", "n", "place")
